"""Reports as queries over the engine's tables."""

from __future__ import annotations

import copy
import time
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import QUERY_CONFIG
from ..functions import text as T
from ..functions.names import human_time, report_folder, safe_name
from .engine import KEY, Engine

C = QUERY_CONFIG


def ranked_before(e: Engine) -> Engine:
    """The engine with the platform's pair removal left out."""
    o = copy.copy(e)
    for name in ("final", "tiers", "scored", "ranked_rules"):
        o.__dict__.pop(name, None)
    o.__dict__["final"] = e.violations(e.unblocked).where("reason IS NULL").select(*KEY)
    return o


TIERS_SQL = "SELECT u.typo, u.word, u.boundary, (CASE WHEN w.word IS NOT NULL THEN 0 WHEN p.typo IS NOT NULL THEN 1 ELSE 2 END)::INT AS tier FROM unblocked u LEFT JOIN (SELECT word FROM words WHERE is_user) w ON w.word = u.word LEFT JOIN (SELECT DISTINCT typo, word FROM patterns) p ON p.typo = u.typo AND p.word = u.word LEFT JOIN (SELECT DISTINCT typo, word, boundary FROM repl) r ON r.typo = u.typo AND r.word = u.word AND r.boundary = u.boundary WHERE w.word IS NOT NULL OR p.typo IS NOT NULL OR r.typo IS NULL"
SCORED_SQL = f"SELECT t.typo, t.word, t.boundary, t.tier, (CASE t.tier WHEN 1 THEN coalesce(s.score, 0) ELSE coalesce(l.freq, 0) END)::BIGINT AS score FROM ({TIERS_SQL}) t LEFT JOIN (SELECT pattern_typo, pattern_word, boundary, sum(coalesce(freq, 0))::BIGINT AS score FROM repl LEFT JOIN lex USING (word) GROUP BY ALL) s ON s.pattern_typo = t.typo AND s.pattern_word = t.word AND s.boundary = t.boundary LEFT JOIN lex l ON l.word = t.word"
_TABLES = {"words": "words", "typos": "pairs", "corrections": "corrections", "ambiguous": "ambiguous", "patterns": "patterns", "replaced": "replacements", "rules": "rules", "kept": "unblocked"}
_SQL_OF = {"ambiguous": "amb", "replacements": "repl"}
SUMMARY_SQL = "SELECT " + ", ".join(f"(SELECT count(*)::BIGINT FROM {_SQL_OF.get(t, t)}) AS {m}" for m, t in _TABLES.items())


def statistics(e: Engine) -> DataFrame:
    """(metric, value)"""
    out = None
    for metric, table in _TABLES.items():
        row = getattr(e, table).agg(F.count(F.lit(1)).alias("value")).select(F.lit(metric).alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def summary(e: Engine) -> DataFrame:
    return statistics(e).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in _TABLES])


def by_reason(e: Engine) -> DataFrame:
    return e.graveyard.groupBy("pass", "reason").agg(F.count(F.lit(1)).alias("n"))


def _first(rows: DataFrame, group: list[str], order: list[str], most: int, what, name: str) -> DataFrame:
    """The first ``most`` of each group in one string, with the group's size. Ranked before they are gathered."""
    # the rank is limited before the shuffle, the sizes are combined before it: no group is gathered whole
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_k") <= most)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("_k", what.alias("x")))), lambda s: s["x"])
    first = first.groupBy(*group).agg(F.array_join(shown, ",").alias(name))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).join(first, group)


def collisions(e: Engine) -> DataFrame:
    """(typo, n_words, percent): ambiguous typos with the first frequency in percent of the second, least first."""
    return e.collisions.where("NOT accepted").select("typo", "n_words", F.expr("(100 * f1) div f2").alias("percent")).orderBy("percent", "typo")


COLLISIONS_SQL = "SELECT typo, n_words, (100 * f1) // f2 AS percent FROM coll WHERE NOT accepted"


def patterns(e: Engine) -> DataFrame:
    return _first(e.replacements, ["pattern_typo", "pattern_word", "boundary"], ["typo", "word"], 10, F.concat("typo", F.lit("="), "word"), "shown")


PATTERNS_SQL = "SELECT pattern_typo, pattern_word, boundary, max(n)::BIGINT AS n, string_agg(typo || '=' || word, ',' ORDER BY typo, word) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY pattern_typo, pattern_word, boundary ORDER BY typo, word) AS k, count(*) OVER (PARTITION BY pattern_typo, pattern_word, boundary) AS n FROM repl) WHERE k <= 10 GROUP BY ALL"


def conflicts(e: Engine) -> DataFrame:
    return _first(e.blocked, ["boundary", "word"], ["typo"], 20, F.col("typo"), "shown")


CONFLICTS_SQL = "SELECT boundary, word, max(n)::BIGINT AS n, string_agg(typo, ',' ORDER BY typo) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY boundary, word ORDER BY typo) AS k, count(*) OVER (PARTITION BY boundary, word) AS n FROM blocked) WHERE k <= 20 GROUP BY boundary, word"


def short(e: Engine) -> DataFrame:
    r = e.rejected.where("reason = 'too_short'").select(F.length("typo").cast("long").alias("length"), "typo").distinct()
    return _first(r, ["length"], ["typo"], 30, F.col("typo"), "shown")


SHORT_SQL = "SELECT length, max(n)::BIGINT AS n, string_agg(typo, ',' ORDER BY typo) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY length ORDER BY typo) AS k, count(*) OVER (PARTITION BY length) AS n FROM (SELECT DISTINCT length(typo)::BIGINT AS length, typo FROM rejected WHERE reason = 'too_short')) WHERE k <= 30 GROUP BY length"


def exclusions(e: Engine) -> DataFrame:
    """The first hundred excluded rules: a report, cut by design."""
    return e.rejected.where("reason = 'excluded_by_pattern'").select(*KEY).orderBy(*KEY).limit(100)


EXCLUSIONS_SQL = "SELECT typo, word, boundary FROM rejected WHERE reason = 'excluded_by_pattern' ORDER BY ALL LIMIT 100"


def espanso(rules: DataFrame, most: int = C.max_entries_per_file) -> DataFrame:
    """(letter, n, files, place): place among the five largest letters, else 0."""
    n = rules.groupBy(T.letter_of("word").alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "letter"))
    n = n.withColumn("place", place.cast("long"))
    return n.select("letter", "n", F.expr(f"(n + {most - 1}) div {most}").alias("files"), F.when(F.col("place") <= 5, F.col("place")).otherwise(F.lit(0)).alias("place"))


ESPANSO_SQL = f"SELECT letter, n, (n + {C.max_entries_per_file - 1}) // {C.max_entries_per_file} AS files, CASE WHEN place <= 5 THEN place ELSE 0 END AS place FROM (SELECT *, row_number() OVER (ORDER BY n DESC, letter)::BIGINT AS place FROM (SELECT CASE WHEN regexp_full_match(lower(left(word, 1)), '[a-z]') THEN lower(left(word, 1)) ELSE 'symbols' END AS letter, count(*)::BIGINT AS n FROM unblocked GROUP BY 1))"


def qmk(e: Engine) -> DataFrame:
    """(tier, n, low, high) of the ranked rules."""
    return e.ranking().groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


QMK_SQL = f"SELECT tier, count(*)::BIGINT AS n, min(score) AS low, max(score) AS high FROM (SELECT * FROM ({SCORED_SQL}) ORDER BY tier, score DESC, typo, word, boundary LIMIT {C.max_corrections}) GROUP BY tier"


def shares(e: Engine) -> DataFrame:
    """(tier, n, percent, low, high): the ranked rules by kind, with each kind's share."""
    t = qmk(e)
    whole = t.agg(F.sum("n").alias("whole"))
    return t.crossJoin(F.broadcast(whole)).select("tier", "n", F.expr("(1000 * n) div whole / 10").alias("percent"), "low", "high")  # one row


SHARES_SQL = f"SELECT tier, n, (1000 * n) // (sum(n) OVER ())::BIGINT / 10 AS percent, low, high FROM ({QMK_SQL})"


def ranked_list(e: Engine) -> DataFrame:
    """(rnk, line, kind, score, replaces): the ranked rules as text, with the corrections that a pattern replaces."""
    kind = F.element_at(F.array(F.lit("user"), F.lit("pattern"), F.lit("direct")), F.col("tier") + 1)
    n = e.replacements.groupBy(F.col("pattern_typo").alias("typo"), F.col("pattern_word").alias("word"), "boundary").agg(F.count(F.lit(1)).alias("replaces"))
    r = e.ranking().join(n, KEY, "left")
    return r.select(F.col("rnk").cast("long").alias("rnk"), F.concat(T.qmk_text("typo", "boundary"), F.lit(" -> "), "word").alias("line"), kind.alias("kind"), "score", F.when(F.col("tier") == 1, F.coalesce("replaces", F.lit(0))).otherwise(F.lit(0)).alias("replaces"))


RANKED_LIST_SQL = f"SELECT rnk, (CASE WHEN q.boundary IN ('left', 'both') THEN ':' ELSE '' END) || q.typo || (CASE WHEN q.boundary IN ('right', 'both') THEN ':' ELSE '' END) || ' -> ' || q.word AS line, ['user', 'pattern', 'direct'][tier + 1] AS kind, score, CASE WHEN tier = 1 THEN coalesce(r.n, 0) ELSE 0 END::BIGINT AS replaces FROM (SELECT row_number() OVER (ORDER BY tier, score DESC, typo, word, boundary)::BIGINT AS rnk, * FROM ({SCORED_SQL}) QUALIFY rnk <= {C.max_corrections}) q LEFT JOIN (SELECT pattern_typo, pattern_word, boundary, count(*) AS n FROM repl GROUP BY ALL) r ON r.pattern_typo = q.typo AND r.pattern_word = q.word AND r.boundary = q.boundary"


def first_user_words(e: Engine) -> DataFrame:
    """The first twenty user words: a report, cut by design."""
    return e.words.where("is_user").select("word").orderBy("word").limit(20)


USER_WORDS_SQL = "SELECT word FROM words WHERE is_user ORDER BY word LIMIT 20"
STAGES = ("candidate_selection", "pattern_generalization")


def history(e: Engine) -> DataFrame:
    """(pass_no, pass, action, typo, word, boundary, reason): additions and rejections in the order of the passes."""
    no = F.array_position(F.array(*[F.lit(p) for p in (*STAGES, *(p.name for p in e.passes))]), F.col("pass"))
    none = F.lit(None).cast("string")
    added = e.corrections.select(F.lit(STAGES[0]).alias("pass"), F.lit("added").alias("action"), *KEY, none.alias("reason")).unionByName(e.patterns.select(F.lit(STAGES[1]).alias("pass"), F.lit("added").alias("action"), *KEY, none.alias("reason")))
    return added.unionByName(e.graveyard.select("pass", F.lit("rejected").alias("action"), *KEY, "reason")).select(no.cast("int").alias("pass_no"), "pass", "action", *KEY, "reason")


def debug_matches(e: Engine, rows: DataFrame | None = None) -> DataFrame:
    """(typo, word, boundary, ..., pattern): rows that a traced pattern names; a scoped one only at fitting boundaries."""
    on = T.glob_match("typo", "glob") & F.expr("scope IS NULL OR boundary = 'both' OR boundary = scope")
    rows = e.corrections if rows is None else rows
    return rows.join(e.small("debug_rules")(e.debug_rules), on).select(*rows.columns, "pattern")


def is_debug_word(e: Engine, word: str = "word"):
    """Whether a word is traced: the whole word, whatever its case."""
    traced = [w.lower() for w in e.config.debug_words]
    return F.lower(word).isin(traced) if traced else F.lit(False)


def debug_corrections(e: Engine, rows: DataFrame | None = None) -> DataFrame:
    """The rows whose word or whose typo is traced."""
    rows = e.corrections if rows is None else rows
    named = debug_matches(e, rows).select(*KEY).distinct().withColumn("_named", F.lit(True))
    return rows.join(named, KEY, "left").where(F.col("_named") | is_debug_word(e)).select(*rows.columns)


def lifecycle(e: Engine, of: str) -> DataFrame:
    """The history of corrections, patterns, the graveyard, traced typos or traced words; in order by (pass_no, typo, word, boundary)."""
    h = history(e)
    if of == "corrections":
        return h.where("pass = 'candidate_selection'").unionByName(h.where("pass NOT IN ('candidate_selection', 'pattern_generalization')").join(e.corrections, KEY, "left_semi").select(h.columns))
    if of == "patterns":
        return h.where("pass = 'pattern_generalization'").unionByName(h.where("pass NOT IN ('candidate_selection', 'pattern_generalization')").join(e.patterns.select(*KEY), KEY, "left_semi").select(h.columns))
    if of == "graveyard":
        return h.where("action = 'rejected'")
    if of == "typos":
        return debug_matches(e, h)
    if of == "words":
        return h.where(is_debug_word(e))
    raise ValueError(f"no such report: {of!r}")


#: What the lifecycle reports show of the stages that SQL can follow.
_HISTORY_SQL = "(SELECT 1 AS pass_no, 'candidate_selection' AS pass, 'added' AS action, typo, word, boundary, NULL AS reason FROM corrections UNION ALL SELECT 2, 'pattern_generalization', 'added', typo, word, boundary, NULL FROM patterns UNION ALL SELECT 1, 'candidate_selection', 'rejected', typo, word, boundary, reason FROM rejected UNION ALL SELECT 2, 'pattern_generalization', 'rejected', tp, wp, boundary, 'pattern_validation_failed' FROM pat_rejects UNION ALL SELECT 3, 'conflict_removal', 'rejected', typo, word, boundary, 'blocked_by_conflict' FROM blocked)"


#: The whole of a pass, the platform's removals included.
HISTORY_SQL = f"SELECT * FROM {_HISTORY_SQL} UNION ALL SELECT 4, 'platform_substrings', 'rejected', typo, word, boundary, 'platform_constraint' FROM premoved UNION ALL SELECT 5, 'platform_constraints', 'rejected', typo, word, boundary, 'platform_constraint' FROM pleft WHERE reason IS NOT NULL"
GRAVEYARD_SQL = f"SELECT pass, reason, count(*)::BIGINT AS n FROM ({HISTORY_SQL}) WHERE action = 'rejected' GROUP BY ALL"


def final(sql: str) -> str:
    """SQL over the rules before the platform's removals -> the same over those after them."""
    import re

    return re.sub(r"\bunblocked\b", "fin", sql)


def early(e: Engine, of: str) -> DataFrame:
    """The same up to the conflict pass, with SQL."""
    return lifecycle(e, of).where("pass_no <= 3")


def _debug_sql() -> str:
    from .oracle import like

    return f"SELECT typo, word, boundary, pattern FROM corrections, debug_rules WHERE typo LIKE {like('pat')} ESCAPE '!' AND (scope IS NULL OR boundary = 'both' OR boundary = scope)"


def _lifecycle_sql() -> dict[str, str]:
    from .oracle import like, values

    words = values([(w,) for w in C.debug_words])
    typo = f"typo LIKE {like('pat')} ESCAPE '!' AND (scope IS NULL OR boundary = 'both' OR boundary = scope)"
    part = lambda t: f"SELECT * FROM {_HISTORY_SQL} h WHERE pass_no = 3 AND EXISTS (SELECT 1 FROM {t} c WHERE c.typo = h.typo AND c.word = h.word AND c.boundary = h.boundary)"
    return {
        "corrections": f"SELECT * FROM {_HISTORY_SQL} WHERE pass_no = 1 UNION ALL {part('corrections')}",
        "patterns": f"SELECT * FROM {_HISTORY_SQL} WHERE pass_no = 2 UNION ALL {part('patterns')}",
        "graveyard": f"SELECT * FROM {_HISTORY_SQL} WHERE action = 'rejected'",
        "typos": f"SELECT h.*, pattern FROM {_HISTORY_SQL} h, debug_rules WHERE {typo}",
        "words": f"SELECT * FROM {_HISTORY_SQL} WHERE lower(word) IN (SELECT * FROM (VALUES {words}))",
        "traced": f"SELECT typo, word, boundary FROM corrections WHERE lower(word) IN (SELECT * FROM (VALUES {words})) OR EXISTS (SELECT 1 FROM debug_rules WHERE {typo})",
    }


DEBUG_SQL = _debug_sql()
LIFECYCLE_SQL = _lifecycle_sql()


def write_reports(e: Engine, folder: str, platform: str, times: dict[str, float] | None = None, now: datetime | None = None) -> list[str]:
    """The run's reports as CSV files in <folder>/<time>_<platform>, through Spark's writer; runs don't meet. -> their folders.

    ``times``: seconds of the run's stages; the reports' own come last.
    """
    at = f"{folder}/{report_folder(platform, now)}"
    kinds = {"summary": summary, "statistics": statistics, "graveyard": by_reason, "collisions": collisions, "patterns": patterns, "conflicts": conflicts, "short": short, "exclusions": exclusions, "history": history}
    if platform == "qmk":
        kinds |= {"ranking": qmk, "ranking_shares": shares, "ranking_list": lambda e: ranked_list(e).orderBy("rnk"), "user_words": first_user_words}
    else:
        kinds |= {"files": lambda e: espanso(e.final, e.config.max_entries_per_file)}
    order = lambda k: lambda e: lifecycle(e, k).orderBy("pass_no", *KEY)
    kinds |= {f"lifecycle_{k}": order(k) for k in ("corrections", "patterns", "graveyard", *(("typos",) if e.config.debug_typos else ()), *(("words",) if e.config.debug_words else ()))}
    done, began = [], time.time()
    for name, f in kinds.items():
        f(e).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{at}/{safe_name(name)}")
        done.append(f"{at}/{name}")
    times = (times or {}) | {"reports": time.time() - began}
    whole = sum(times.values()) or 1.0
    rows = [(k, human_time(s), round(100 * s / whole, 1)) for k, s in times.items()]
    e.spark.createDataFrame(rows, "stage string, time string, percent double").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{at}/times")
    return [*done, f"{at}/times"]
