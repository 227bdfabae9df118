"""Queries by name: the plan's table and the same in DuckDB SQL. ``None`` where SQL can't express the loop."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import QUERY_CONFIG, platform
from ..functions import text as T
from ..operators import legacy as L
from ..operators import ngrams as N
from ..operators import typos as Y
from ..sources import files
from . import oracle as O
from . import reports as R
from . import sinks as S
from .engine import KEY, Engine
from .solver import solve

C = QUERY_CONFIG
_engines: dict[tuple[str, str], Engine] = {}


def reset() -> None:
    """Forget all engines: the next query builds all that it needs."""
    _engines.clear()


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """One engine for an application and a folder, so that queries share its checkpoints."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        _engines[key] = Engine(spark, read("documents"), read("benchmark"), C)
    return _engines[key]


def _espanso(e: Engine) -> Engine:
    """The engine's tables for the other platform: its own checks, pair removal and constraints."""
    if "_espanso" not in e.__dict__:
        o = Engine(e.spark, e.documents, e.benchmark, replace(e.config, platform="espanso"), e.given_include, e.given_adjacency, e.rules_given, e.passes)
        o.__dict__.update({k: getattr(e, k) for k in ("lex", "valid", "words", "pairs", "flags", "collisions", "tries", "corrections")})
        e.__dict__["_espanso"] = o
    return e.__dict__["_espanso"]


# Lines of hand-written files, made of the lexicon so that there are some of each kind: comments, blank and repeated ones.
_INCLUDE = "CASE freq % 5 WHEN 0 THEN concat('# ', word) WHEN 1 THEN concat('  ', upper(word), ' ') WHEN 2 THEN concat(word, chr(92)) WHEN 3 THEN '   ' ELSE word END"
_EXCLUSION = "CASE freq % 4 WHEN 0 THEN concat('#', word) WHEN 1 THEN concat(' ', substring(word, 1, 3), '* ') WHEN 2 THEN concat(':', word, ' -> *') ELSE ' ' END"
_ADJACENCY = "CASE freq % 4 WHEN 0 THEN concat('# ', word, ' -> x') WHEN 1 THEN concat(substring(word, 1, 1), ' -> ', word) WHEN 2 THEN concat(substring(word, 1, 1), '->', word) ELSE concat(substring(word, 2, 1), ' -> ', word, ' ') END"
_numbered = "SELECT row_number() OVER (ORDER BY word) - 1 AS line_no, {} AS value FROM lex WHERE length(word) > 2"
_INCLUDE_SQL, _EXCLUSION_SQL, _ADJACENCY_SQL = (_numbered.format(x) for x in (_INCLUDE, _EXCLUSION, _ADJACENCY))


def _lines(e: Engine, value: str) -> DataFrame:
    n = F.row_number().over(Window.orderBy("word")) - 1
    return e.lex.where("length(word) > 2").select(n.alias("line_no"), F.expr(value).alias("value"))


def _include_lines(e: Engine) -> DataFrame:
    return _lines(e, _INCLUDE)


def _exclusion_lines(e: Engine) -> DataFrame:
    return _lines(e, _EXCLUSION)


def _adjacency_lines(e: Engine) -> DataFrame:
    return _lines(e, _ADJACENCY)


def _b(*cols: str):
    """Those columns as bigint."""
    return [F.col(c).cast("long").alias(c) for c in cols]


_K = ", ".join(KEY)


def _wrong_use(e: Engine) -> DataFrame:
    """(typo, word, victim, result): the first validation word that starts or ends with the typo, as the rule would spoil it."""
    g = N.affixes(e.valid, "prefix", True).unionByName(N.affixes(e.valid, "suffix", True)).select(F.col("gram").alias("typo"), F.col("word").alias("victim"))
    v = e.pairs.join(g, "typo").groupBy("typo", "word").agg(F.min("victim").alias("victim"))
    return v.withColumn("result", L.wrong_use("victim", "typo", "word"))


def _marks(e: Engine) -> DataFrame:
    return e._rows([(p,) for p in (":", ":a", "a:", ":a:", "a", "::", "")], "pattern string")


QUERIES: dict[str, tuple] = {
    # word lists
    "src_include_parse": (lambda e: files.parse_include(_include_lines(e)).select(*_b("line_no"), "word"), f"SELECT line_no, lower(trim(value)) AS word FROM ({_INCLUDE_SQL}) WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#') AND NOT contains(value, chr(92))"),
    "src_exclusions_parse": (lambda e: files.parse_exclusions(_exclusion_lines(e)), f"SELECT DISTINCT trim(value) AS rule FROM ({_EXCLUSION_SQL}) WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')"),
    "src_adjacency": (lambda e: files.parse_adjacency(_adjacency_lines(e)).select("key", *_b("pos"), "neighbor"), f"SELECT key, (i - 1)::BIGINT AS pos, near[i] AS neighbor FROM (SELECT key, near, unnest(range(1, length(near) + 1))::INT AS i FROM (SELECT trim(split_part(value, ' -> ', 1)) AS key, arg_max(trim(substring(value, instr(value, ' -> ') + 4)), line_no) AS near FROM ({_ADJACENCY_SQL}) WHERE NOT starts_with(value, '#') AND contains(value, ' -> ') GROUP BY 1))"),
    "lex_tokenize_freq": (lambda e: e.lex, "SELECT word, freq FROM lex"),
    "lex_validation": (lambda e: e.valid, "SELECT word FROM valid"),
    "lex_topn_source": (lambda e: e.source.select("word", "freq", *_b("rnk")), "SELECT word, freq, rnk FROM src"),
    "lex_all_source": (lambda e: e.valid.where(F.length("word").between(C.min_word_length, C.max_word_length)), f"SELECT word FROM valid WHERE length(word) BETWEEN {C.min_word_length} AND {C.max_word_length}"),
    "lex_dictionary": (lambda e: e.words, "SELECT word, freq, is_user FROM words"),
    # scalars
    "fn_parse_boundary": (lambda e: _marks(e).select("pattern", T.marker_core("pattern").alias("core"), T.marker_boundary("pattern").alias("boundary")), f"SELECT pattern, {O.core('pattern')} AS core, {O.scope('pattern')} AS boundary FROM (VALUES {O.values([(p,) for p in (':', ':a', 'a:', ':a:', 'a', '::', '')])}) t(pattern)"),
    "fn_boundary_display": (lambda e: e.corrections.select("boundary").distinct().select("boundary", F.upper("boundary").alias("name"), T.boundary_display("boundary").alias("display")), "SELECT DISTINCT boundary, upper(boundary) AS name, CASE WHEN boundary = 'none' THEN '' ELSE '(' || upper(boundary) || ' boundary)' END AS display FROM corrections"),
    "fn_replace_first_last": (lambda e: e.words.select("word", F.expr("substring(word, 1, 1)").alias("s")).select("word", T.replace_first("word", "s", "'__'").alias("first"), T.replace_last("word", "s", "'__'").alias("last")), f"SELECT word, {O.first_spliced('word', 'left(word, 1)', chr(39) + '__' + chr(39))} AS first, {O.last_spliced('word', 'left(word, 1)', chr(39) + '__' + chr(39))} AS last FROM words"),
    "fn_glob_match": (lambda e: e.words.join(F.broadcast(e.word_rules), T.glob_match("word", "rule")).select("word", "rule").unionByName(e.lex.where("freq < 20").join(F.broadcast(e.word_rules), T.glob_match("word", "rule")).select("word", "rule")).distinct(), "SELECT DISTINCT word, rule FROM (SELECT word FROM words UNION SELECT word FROM lex WHERE freq < 20), word_rules WHERE regexp_full_match(word, replace(rule, '*', '.*'))"),
    "fn_proper_substring": (lambda e: e.pairs.select("typo", "word", F.expr("contains(word, typo) AND word <> typo").alias("inside")), "SELECT typo, word, strpos(word, typo) > 0 AND length(word) > length(typo) AS inside FROM pairs"),
    "fmt_qmk": (lambda e: e.corrections.select(*KEY, T.qmk_text("typo", "boundary").alias("text")), f"SELECT {_K}, {O.qmk('typo', 'boundary')} AS text FROM corrections"),
    "agg_strictest_boundary": (lambda e: L.strictest(e.corrections, "word"), "SELECT word, CASE WHEN bool_or(boundary = 'both') OR (bool_or(boundary = 'left') AND bool_or(boundary = 'right')) THEN 'both' WHEN bool_or(boundary = 'left') THEN 'left' WHEN bool_or(boundary = 'right') THEN 'right' ELSE 'none' END AS boundary FROM corrections GROUP BY word"),
    # generators
    "typo_transposition": (lambda e: Y.transpositions(e.words), "SELECT typo, word FROM typo_transposition"),
    "typo_omission": (lambda e: Y.omissions(e.words), "SELECT typo, word FROM typo_omission"),
    "typo_duplication": (lambda e: Y.duplications(e.words), "SELECT typo, word FROM typo_duplication"),
    "typo_insertion": (lambda e: Y.insertions(e.words, e.adjacency), "SELECT typo, word FROM typo_insertion"),
    "typo_replacement": (lambda e: Y.replacements(e.words, e.adjacency), "SELECT typo, word FROM typo_replacement"),
    "typo_all": (lambda e: e.all_typos.select("typo", "word", "kind"), "SELECT typo, word, kind FROM typos"),
    "typo_filter_reason": (lambda e: e.typo_reasons, "SELECT typo, word, reason FROM reasons"),
    "typo_not_word": (lambda e: e.all_typos.select("typo").distinct().join(e.words.select(F.col("word").alias("typo")), "typo", "left_anti").join(e.valid.select(F.col("word").alias("typo")), "typo", "left_anti"), "SELECT DISTINCT typo FROM typos WHERE typo NOT IN (SELECT word FROM words) AND typo NOT IN (SELECT word FROM valid)"),
    "typo_freq_threshold": (lambda e: e.typo_reasons.where("reason = 'too_frequent'").select("typo", "word"), "SELECT typo, word FROM reasons WHERE reason = 'too_frequent'"),
    "typo_suffix_guard": (lambda e: e.all_typos.where(T.suffix_guard("typo", "word")).select("typo", "word").distinct(), f"SELECT DISTINCT typo, word FROM typos WHERE {O.guard('typo', 'word')}"),
    "typo_filtered": (lambda e: e.pairs, "SELECT typo, word FROM pairs"),
    "typo_map": (lambda e: e.typo_map.select("typo", F.array_join("words", ",").alias("words")), "SELECT typo, string_agg(word, ',' ORDER BY word) AS words FROM pairs GROUP BY typo"),
    # exclusions
    "excl_parse": (lambda e: e.typo_rules, "SELECT rule, typo_glob, word_glob, required FROM typo_rules"),
    "excl_word_filter": (lambda e: e._ruled_out(e.dictionary_words), f"SELECT DISTINCT word FROM dictionary_words w, word_rules WHERE w.word LIKE {O.like('rule')} ESCAPE '!'"),
    "excl_correction": (lambda e: e.excluded(e.tries.select(*KEY)).select(*KEY).distinct(), f"SELECT DISTINCT {_K} FROM tries, typo_rules WHERE typo LIKE {O.like('typo_glob')} ESCAPE '!' AND word LIKE {O.like('word_glob')} ESCAPE '!' AND (required IS NULL OR required = boundary)"),
    "excl_rule": (lambda e: e.excluded(e.tries.select(*KEY)).groupBy(*KEY).agg(F.min("rule").alias("rule")), f"SELECT {_K}, min(rule) AS rule FROM tries, typo_rules WHERE typo LIKE {O.like('typo_glob')} ESCAPE '!' AND word LIKE {O.like('word_glob')} ESCAPE '!' AND (required IS NULL OR required = boundary) GROUP BY ALL"),
    # substring joins
    "idx_substrings": (lambda e: N.substrings(e.valid, C.max_ngram), f"SELECT g AS gram, bool_or(i = 1) AS is_prefix, bool_or(i + n - 1 = length(word)) AS is_suffix FROM (SELECT word, i, n, substring(word, i, n) AS g FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM valid), range(1, {C.max_ngram + 1}) r(n) WHERE n < length(word) AND i + n - 1 <= length(word)) GROUP BY g"),
    "idx_containing": (lambda e: N.contained(e.corrections.select(F.col("typo").alias("text")).distinct()), "SELECT a.typo AS text, b.typo AS longer FROM (SELECT DISTINCT typo FROM corrections) a, (SELECT DISTINCT typo FROM corrections) b WHERE a.typo <> b.typo AND contains(b.typo, a.typo)"),
    "bnd_prefix": (lambda e: e.flags.where("v_start").select("typo"), "SELECT typo FROM flags WHERE v_start"),
    "bnd_suffix": (lambda e: e.flags.where("v_end").select("typo"), "SELECT typo FROM flags WHERE v_end"),
    "bnd_substring": (lambda e: e.flags.where("v_sub OR s_sub").select("typo"), "SELECT typo FROM flags WHERE v_sub OR s_sub"),
    "bnd_determine": (lambda e: e.natural, 'SELECT typo, "natural" FROM nat'),
    "bnd_target": (lambda e: e.pairs.withColumn("t", T.target_relation("typo", "word")).select("typo", "word", "t.prefix", "t.suffix", "t.middle"), f"SELECT typo, word, {O.place('typo', 'word', 'prefix')} AS prefix, {O.place('typo', 'word', 'suffix')} AS suffix, {O.place('typo', 'word', 'middle')} AS middle FROM pairs"),
    "ft_flags": (lambda e: e.flags, "SELECT typo, v_start, v_end, v_sub, s_start, s_end, s_sub FROM flags"),
    "ft_verdict": (lambda e: L.verdicts(e), f"SELECT typo, word, boundary, {O.fires('boundary', 'typo', 'word')} AS fires, {L.reason_sql()} AS reason FROM pairs JOIN flags USING (typo), (VALUES ('none'), ('left'), ('right'), ('both')) b(boundary)"),
    # candidates
    "bnd_order": (lambda e: e.orders.select("natural", *_b("ord"), "boundary"), 'SELECT "natural", ord::BIGINT AS ord, boundary FROM orders'),
    "col_ratio": (lambda e: e.collisions.withColumn("f2", F.coalesce("f2", F.lit(0))), "SELECT typo, n_words, word, f1, coalesce(f2, 0) AS f2, accepted FROM coll"),
    "col_ambiguous": (lambda e: e.ambiguous, f"SELECT {_K}, f1, f2 FROM amb"),
    "sel_length_gate": (lambda e: e.pairs.where(f"NOT (length(word) <= {C.min_typo_length} AND length(typo) < {C.min_typo_length})"), f"SELECT typo, word FROM pairs WHERE length(word) > {C.min_typo_length} OR length(typo) >= {C.min_typo_length}"),
    "sel_candidates": (lambda e: e.corrections, f"SELECT {_K} FROM corrections"),
    "sel_rejected": (lambda e: e.rejected, f"SELECT {_K}, reason FROM rejected"),
    "sel_by_boundary": (lambda e: e.corrections.groupBy("typo").agg(F.countDistinct("boundary").alias("boundaries"), F.count(F.lit(1)).alias("words")), "SELECT typo, count(DISTINCT boundary)::BIGINT AS boundaries, count(*)::BIGINT AS words FROM corrections GROUP BY typo"),
    "sel_worklist": (lambda e: e.pairs.select("typo").distinct().join(e.unblocked.select("typo"), "typo", "left_anti"), "SELECT DISTINCT typo FROM pairs WHERE typo NOT IN (SELECT typo FROM unblocked)"),
    # the interface of whole groups
    "legacy_bnd_order": (lambda e: L.target_orders(e).select("typo", "word", "place", *_b("ord"), "boundary"), f"SELECT typo, word, place, ord::BIGINT AS ord, boundary FROM (SELECT *, {L.place_sql()} AS place FROM pairs) JOIN target_orders USING (place)"),
    "legacy_choose_boundary": (lambda e: L.chosen(e), L.CHOSEN_SQL),
    "legacy_groups": (lambda e: L.groups(e).withColumn("f2", F.coalesce("f2", F.lit(0))), f"SELECT * REPLACE (coalesce(f2, 0) AS f2) FROM ({L.GROUPS_SQL})"),
    "legacy_short": (lambda e: L.short(e), f"SELECT typo, word FROM pairs WHERE length(typo) < {C.min_typo_length + 1} AND length(word) > {C.min_word_length}"),
    "legacy_user_override": (lambda e: L.overridden(e), L.OVERRIDE_SQL),
    "legacy_resolve": (lambda e: L.resolved(e), L.RESOLVE_SQL),
    "dbg_examples": (lambda e: L.examples(e), L.EXAMPLES_SQL),
    "dbg_examples_suffix": (lambda e: L.examples(e, "suffix"), L.SUFFIX_EXAMPLES_SQL),
    "dbg_examples_inside": (lambda e: L.examples(e, "inside"), L.INSIDE_EXAMPLES_SQL),
    "dbg_wrong_use": (lambda e: _wrong_use(e), "SELECT t.typo, t.word, min(v.word) AS victim, min_by(CASE WHEN starts_with(v.word, t.typo) THEN t.word || substring(v.word, length(t.typo) + 1) ELSE left(v.word, length(v.word) - length(t.typo)) || t.word END, v.word) AS result FROM pairs t JOIN valid v ON v.word <> t.typo AND (starts_with(v.word, t.typo) OR suffix(v.word, t.typo)) GROUP BY t.typo, t.word"),
    # patterns
    "pat_extract_suffix": (lambda e: e.extracted("suffix"), "SELECT tp, wp, boundary, typo, word FROM ext_suffix"),
    "pat_extract_prefix": (lambda e: e.extracted("prefix"), "SELECT tp, wp, boundary, typo, word FROM ext_prefix"),
    "pat_eligible": (lambda e: e.corrections.select(*KEY, F.expr("boundary IN ('right', 'none') AND length(typo) = length(word) AND length(typo) >= 4").alias("suffix"), F.expr("boundary IN ('left', 'none') AND length(typo) = length(word) AND length(typo) >= 4").alias("prefix")), f"SELECT {_K}, boundary <> 'left' AND boundary <> 'both' AND length(typo) = length(word) AND length(typo) > 3 AS suffix, boundary <> 'right' AND boundary <> 'both' AND length(typo) = length(word) AND length(typo) > 3 AS prefix FROM corrections"),
    "pat_candidates": (lambda e: e.occurrences.groupBy("tp", "wp", "boundary").agg(F.count(F.lit(1)).alias("n")), "SELECT tp, wp, boundary, count(*)::BIGINT AS n FROM occ GROUP BY ALL"),
    "pat_merged": (lambda e: e.occurrences, "SELECT tp, wp, boundary, typo, word FROM occ"),
    "pat_min_len": (lambda e: e.pattern_checks.where("reason = 'too_short'").select("tp", "wp", "boundary"), f"SELECT tp, wp, boundary FROM checks WHERE length(tp) < {C.min_typo_length}"),
    "pat_valid_result": (lambda e: e.occurrences.select("*", F.coalesce(e.rewritten("tp", "wp", "boundary", "typo") == F.col("word"), F.lit(False)).alias("ok")).groupBy("tp", "wp", "boundary").agg(F.min("ok").alias("ok")), "SELECT tp, wp, boundary, bool_and(CASE WHEN boundary = 'right' THEN suffix(typo, tp) AND left(typo, length(typo) - length(tp)) || wp = word WHEN boundary = 'left' THEN starts_with(typo, tp) AND wp || substring(typo, length(tp) + 1) = word WHEN suffix(typo, tp) THEN left(typo, length(typo) - length(tp)) || wp = word ELSE starts_with(typo, tp) AND wp || substring(typo, length(tp) + 1) = word END) AS ok FROM occ GROUP BY ALL"),
    "pat_conflict_validation": (lambda e: e.pattern_flags.where("v_word OR v_start OR v_end OR v_sub").select("tp", "v_word", "v_start", "v_end", "v_sub"), "SELECT * FROM (SELECT tp, tp IN (SELECT word FROM valid) AS v_word, EXISTS (SELECT 1 FROM valid w WHERE w.word <> tp AND starts_with(w.word, tp)) AS v_start, EXISTS (SELECT 1 FROM valid w WHERE w.word <> tp AND suffix(w.word, tp)) AS v_end, EXISTS (SELECT 1 FROM valid w WHERE w.word <> tp AND contains(w.word, tp)) AS v_sub FROM (SELECT DISTINCT tp FROM occ)) WHERE v_word OR v_start OR v_end OR v_sub"),
    "pat_conflict_source": (lambda e: e.pattern_checks.join(e.pattern_flags.where(platform(C.platform).direction).select("tp"), "tp").select("tp", "wp", "boundary"), "SELECT DISTINCT tp, wp, boundary FROM occ WHERE EXISTS (SELECT 1 FROM words w WHERE starts_with(w.word, tp))"),
    "pat_corrupt_rtl": (lambda e: e.pattern_flags.where("rtl").select("tp"), "SELECT DISTINCT tp FROM occ WHERE EXISTS (SELECT 1 FROM words w WHERE starts_with(w.word, tp))"),
    "pat_corrupt_ltr": (lambda e: e.pattern_flags.where("ltr").select("tp"), "SELECT DISTINCT tp FROM occ WHERE EXISTS (SELECT 1 FROM words w WHERE suffix(w.word, tp))"),
    "pat_affix_matches": (lambda e: e.affix_matches, "SELECT tp, wp, boundary, side, typo, word FROM affix"),
    "pat_incorrect_match": (lambda e: e.mismatches, "SELECT tp, wp, boundary, side, typo, word, result FROM mism"),
    "pat_redundant": (lambda e: e.redundancy, "SELECT boundary, tp, wp, long_tp, long_wp FROM red"),
    "pat_generalize": (lambda e: e.patterns, f"SELECT {_K}, n FROM patterns"),
    "pat_rejected": (lambda e: e.pattern_rejects, "SELECT tp, wp, boundary, n, reason FROM pat_rejects"),
    "pass_patterns": (lambda e: e.rules, f"SELECT {_K} FROM rules"),
    "state_replacements": (lambda e: e.replacements, "SELECT pattern_typo, pattern_word, boundary, typo, word FROM repl"),
    "state_covered": (lambda e: e.pairs.select("typo").distinct().join(e.rules.select("typo").distinct().withColumn("covered", F.lit(True)), "typo", "left").select("typo", F.coalesce("covered", F.lit(False)).alias("covered")), "SELECT DISTINCT typo, typo IN (SELECT typo FROM rules) AS covered FROM pairs"),
    "state_removed": (lambda e: e.corrections.join(e.rules, KEY, "left_anti").select(*KEY), f"SELECT {_K} FROM corrections EXCEPT SELECT {_K} FROM rules"),
    # conflicts
    "conf_edges": (lambda e: e.conflict_edges, f"SELECT {_K}, long_typo, long_word FROM edges"),
    "conf_kept": (lambda e: e.unblocked, f"SELECT {_K} FROM unblocked"),
    "pass_conflicts": (lambda e: e.blocked, f"SELECT {_K}, blocker FROM blocked"),
    # platform
    "plat_formatted": (lambda e: e.formatted(e.unblocked).groupBy("text").agg(F.count(F.lit(1)).alias("n")), "SELECT text, count(*)::BIGINT AS n FROM fmt GROUP BY text"),
    "plat_pairs": (lambda e: e.platform_pairs.select(*[F.col(f"{s}.{k}").alias(f"{s}_{k}") for s in ("short", "long") for k in (*KEY, "text")]), "SELECT * FROM ppairs"),
    "plat_decision": (lambda e: e.platform_decisions.select(*[F.col(f"{s}.{k}").alias(f"{s}_{k}") for s in ("short", "long") for k in (*KEY, "text")], "remove_shorter"), "SELECT * FROM decisions"),
    "plat_removed": (lambda e: e.platform_removed, f"SELECT {_K} FROM premoved"),
    "pass_platform": (lambda e: e.final, f"SELECT {_K} FROM fin"),
    "plat_constraints": (lambda e: e.violations(e.rules), f"SELECT {_K}, CASE WHEN NOT (regexp_full_match(typo, '[a-z'']*') AND regexp_full_match(word, '[a-z'']*')) THEN 'Invalid characters' WHEN length(typo) > 62 THEN 'Typo too long (>62)' WHEN length(word) > 62 THEN 'Word too long (>62)' END AS reason FROM rules"),
    # ranking, sinks and their reports before the platform's pair removal; after it: final_*
    "rank_union": (lambda e: e.corrections.unionByName(e.patterns.select(*KEY)).distinct(), f"SELECT {_K} FROM corrections UNION SELECT {_K} FROM patterns"),
    "rank_tiers": (lambda e: R.ranked_before(e).tiers, f"SELECT {_K}, tier FROM ({R.TIERS_SQL})"),
    "rank_pattern_scores": (lambda e: e.pattern_scores, "SELECT pattern_typo AS typo, pattern_word AS word, boundary, sum(coalesce(freq, 0))::BIGINT AS score FROM repl LEFT JOIN lex USING (word) GROUP BY ALL"),
    "rank_direct_scores": (lambda e: e.corrections.join(e.lex, "word", "left").select(*KEY, F.coalesce("freq", F.lit(0)).alias("score")), f"SELECT {_K}, coalesce(freq, 0)::BIGINT AS score FROM corrections LEFT JOIN lex USING (word)"),
    "rank_qmk": (lambda e: R.ranked_before(e).ranking().select(*_b("rnk"), *KEY, "tier", "score"), f"SELECT row_number() OVER ({O._rank})::BIGINT AS rnk, * FROM ({R.SCORED_SQL}) QUALIFY rnk <= {C.max_corrections}"),
    "rank_topk": (lambda e: R.ranked_before(e).ranking(100).select(*_b("rnk"), *KEY), f"SELECT row_number() OVER ({O._rank})::BIGINT AS rnk, {_K} FROM ({R.SCORED_SQL}) QUALIFY rnk <= 100"),
    "rank_espanso": (lambda e: e.unblocked.select(*KEY), f"SELECT {_K} FROM unblocked"),
    # sinks
    "out_espanso_rows": (lambda e: S.espanso_rows(e.unblocked), S.ESPANSO_SQL),
    "out_by_letter": (lambda e: S.by_letter(e.unblocked), "SELECT CASE WHEN regexp_full_match(lower(left(word, 1)), '[a-z]') THEN lower(left(word, 1)) ELSE 'symbols' END AS letter, count(*)::BIGINT AS n FROM unblocked GROUP BY 1"),
    "out_chunking": (lambda e: S.chunks(e.unblocked, C.max_entries_per_file), S.CHUNK_SQL),
    "out_ram_estimate": (lambda e: S.ram(e.unblocked), "SELECT count(*)::BIGINT AS n, round((avg(length(typo)) + avg(length(word)) + 60) * count(*) / 1024, 2) AS kb, round((avg(length(typo)) + avg(length(word)) + 60) * count(*) / 1024 / 1024, 4) AS mb FROM unblocked"),
    "out_qmk_lines": (lambda e: S.qmk_lines(e.unblocked), f"SELECT DISTINCT word, {O.qmk('typo', 'boundary')} || ' -> ' || word AS line FROM unblocked"),
    # reports
    "rep_graveyard": (lambda e: R.by_reason(e), R.GRAVEYARD_SQL),
    "rep_summary": (lambda e: R.summary(e), R.SUMMARY_SQL),
    "rep_statistics": (lambda e: R.statistics(e), f"SELECT metric, value FROM (UNPIVOT ({R.SUMMARY_SQL}) ON COLUMNS(*) INTO NAME metric VALUE value)"),
    "rep_collisions": (lambda e: R.collisions(e), R.COLLISIONS_SQL),
    "rep_patterns": (lambda e: R.patterns(e), R.PATTERNS_SQL),
    "rep_conflicts": (lambda e: R.conflicts(e), R.CONFLICTS_SQL),
    "rep_short": (lambda e: R.short(e), R.SHORT_SQL),
    "rep_exclusions": (lambda e: R.exclusions(e), R.EXCLUSIONS_SQL),
    "rep_espanso": (lambda e: R.espanso(e.unblocked), R.ESPANSO_SQL),
    "rep_qmk": (lambda e: R.qmk(R.ranked_before(e)), R.QMK_SQL),
    "rep_qmk_shares": (lambda e: R.shares(R.ranked_before(e)), R.SHARES_SQL),
    "rep_qmk_list": (lambda e: R.ranked_list(R.ranked_before(e)), R.RANKED_LIST_SQL),
    "rep_user_words": (lambda e: R.first_user_words(e), R.USER_WORDS_SQL),
    "rep_history": (lambda e: R.history(e), R.HISTORY_SQL),
    **{f"rep_lifecycle_{k}": (lambda e, k=k: R.early(e, k), R.LIFECYCLE_SQL[k]) for k in ("corrections", "patterns", "graveyard", "typos", "words")},
    "dbg_traced": (lambda e: R.debug_corrections(e), R.LIFECYCLE_SQL["traced"]),
    "dbg_typo_match": (lambda e: R.debug_matches(e), R.DEBUG_SQL),
    # what a pass puts out, after the platform's pair removal
    "final_rank_qmk": (lambda e: e.ranked_rules.select(*_b("rnk"), *KEY, "tier", "score"), R.final(f"SELECT row_number() OVER ({O._rank})::BIGINT AS rnk, * FROM ({R.SCORED_SQL}) QUALIFY rnk <= {C.max_corrections}")),
    "final_rank_topk": (lambda e: e.ranking(100).select(*_b("rnk"), *KEY), R.final(f"SELECT row_number() OVER ({O._rank})::BIGINT AS rnk, {_K} FROM ({R.SCORED_SQL}) QUALIFY rnk <= 100")),
    "final_rank_tiers": (lambda e: e.tiers, R.final(f"SELECT {_K}, tier FROM ({R.TIERS_SQL})")),
    "final_rank_espanso": (lambda e: _espanso(e).final.select(*KEY), None),
    "final_out_qmk_lines": (lambda e: S.qmk_lines(e.ranked_rules), R.final(f"SELECT DISTINCT word, {O.qmk('typo', 'boundary')} || ' -> ' || word AS line FROM (SELECT * FROM ({R.SCORED_SQL}) ORDER BY tier, score DESC, typo, word, boundary LIMIT {C.max_corrections})")),
    "final_out_espanso_rows": (lambda e: S.espanso_rows(_espanso(e).final), None),
    "final_out_by_letter": (lambda e: S.by_letter(_espanso(e).final), None),
    "final_out_chunking": (lambda e: S.chunks(_espanso(e).final, C.max_entries_per_file), None),
    "final_rep_qmk": (lambda e: R.qmk(e), R.final(R.QMK_SQL)),
    "final_rep_qmk_list": (lambda e: R.ranked_list(e), R.final(R.RANKED_LIST_SQL)),
    "final_rep_espanso": (lambda e: R.espanso(_espanso(e).final), None),
    # the loop
    "solve": (lambda e: solve(e).rules, None),
    "solve_graveyard": (lambda e: solve(e).graveyard, None),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(engine(spark, sf_dir))) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: O.with_tables(sql) for name, (_, sql) in QUERIES.items() if sql}
