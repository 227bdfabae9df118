"""The compiler's stages as tables, each built once from those before it.

A table is a property; building one builds what it needs. Tables that several stages read are checkpoints in the shared
folder, so plans stay short and lost executors cost no more than a stage. All joins are equi-joins: substring tests run on exploded n-grams, and the only tables
that are broadcast are the fixed ones of the configuration (keys, boundary orders, rules).
"""

from __future__ import annotations

import copy
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ADJACENT, TYPO_RULES, WORD_RULES, Config, platform
from ..functions import text as T
from ..operators import ngrams as N
from ..operators import typos as Y
from ..operators.fixpoint import cut, greedy_losers, kernel
from ..sources.lexicon import lexicon, top_words, user_words

#: Boundaries in the order they are tried, by natural boundary.
ORDERS = {"none": ("none", "left", "right", "both"), "left": ("left", "both"), "right": ("right", "both"), "both": ("both",)}
#: The same for the rules of whole groups, by the typo's place in its word.
TARGET_ORDERS = {"suffix": ("none", "right", "both"), "prefix": ("none", "left", "both"), "middle": ("none", "both"), "apart": ("none", "left", "right", "both")}
KEY = ["typo", "word", "boundary"]
#: Tables that hang on the rules before the passes.
AFTER_RULES = ("rules", "conflict_edges", "unblocked", "blocked", "platform_pairs", "platform_decisions", "platform_removed", "passed", "final", "tiers", "scored", "ranked_rules", "graveyard", "_espanso", "_solved")


class Engine:
    def __init__(self, spark: SparkSession, documents: DataFrame, benchmark: DataFrame, config: Config | None = None, include: DataFrame | None = None, adjacency: DataFrame | None = None, rules: tuple[tuple[str, ...], tuple[str, ...]] = (WORD_RULES, TYPO_RULES), passes: tuple | None = None):
        from .passes import PASSES

        self.passes = PASSES if passes is None else passes
        self.spark, self.documents, self.benchmark, self.config = spark, documents, benchmark, config or Config()
        self.given_include, self.given_adjacency, self.rules_given = include, adjacency, rules

    def _rows(self, rows, schema: str) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)

    # -- word lists -------------------------------------------------------------------------------------------------

    @cached_property
    def lex(self) -> DataFrame:
        return cut(lexicon(self.documents))

    @cached_property
    def user(self) -> DataFrame:
        return self.given_include.select("word").distinct() if self.given_include is not None else user_words(self.benchmark, self.config.user_count)

    @cached_property
    def word_rules(self) -> DataFrame:
        return self._rows([(r,) for r in self.rules_given[0]], "rule string")

    @cached_property
    def typo_rules(self) -> DataFrame:
        """(rule, typo_glob, word_glob, required)"""
        r = self._rows([(r,) for r in self.rules_given[1]], "rule string")
        r = r.withColumn("left", F.trim(F.substring_index("rule", "->", 1))).withColumn("word_glob", F.trim(F.substring_index("rule", "->", -1)))
        return r.select("rule", T.marker_core("left").alias("typo_glob"), "word_glob", T.marker_boundary("left").alias("required"))

    def _ruled_out(self, words: DataFrame) -> DataFrame:
        exact = self.word_rules.where("NOT contains(rule, '*')").select(F.col("rule").alias("word"))
        globs = self.word_rules.where("contains(rule, '*')").select("rule")
        near = self.small("word_rules")
        hit = words.join(near(globs), T.glob_match("word", "rule")).select("word")
        return words.join(near(exact), "word", "left_semi").select("word").unionByName(hit).distinct()

    def small(self, table: str, most: int = 100_000):
        """Broadcasts that table of the user's if it has few rows, else leaves the join to the planner."""
        if f"_few_{table}" not in self.__dict__:
            self.__dict__[f"_few_{table}"] = getattr(self, table).count() <= most
        return F.broadcast if self.__dict__[f"_few_{table}"] else lambda df: df

    @cached_property
    def dictionary_words(self) -> DataFrame:
        return self.lex.where(F.col("freq") >= self.config.validation_count).select("word").unionByName(self.user).distinct()

    @cached_property
    def valid(self) -> DataFrame:
        """Validation words: the dictionary and the user's words, less those that word rules name."""
        w = self.dictionary_words
        return cut(w.join(self._ruled_out(w), "word", "left_anti"))

    @cached_property
    def source(self) -> DataFrame:
        """(word, freq, rnk); without ``top_n`` all validation words of fitting length, by name, unranked."""
        c = self.config
        if c.top_n is None:
            every = self.valid.where(F.length("word").between(c.min_word_length, c.max_word_length)).join(self.lex, "word", "left")
            return every.select("word", F.coalesce("freq", F.lit(0)).alias("freq"), F.lit(None).cast("int").alias("rnk"))
        return top_words(self.lex, c.top_n, c.min_word_length, c.max_word_length)

    @cached_property
    def words(self) -> DataFrame:
        """(word, freq, is_user): source words and user words, once each."""
        w = self.source.select("word", F.lit(False).alias("is_user")).unionByName(self.user.select("word", F.lit(True).alias("is_user")))
        w = w.groupBy("word").agg(F.max("is_user").alias("is_user"))
        return cut(w.join(self.lex, "word", "left").select("word", F.coalesce("freq", F.lit(0)).alias("freq"), "is_user"))

    @cached_property
    def adjacency(self) -> DataFrame:
        if self.given_adjacency is not None:
            return self.given_adjacency
        return self._rows([(k, i, c) for k, near in ADJACENT.items() for i, c in enumerate(near)], "key string, pos int, neighbor string")

    # -- typos ------------------------------------------------------------------------------------------------------

    @cached_property
    def all_typos(self) -> DataFrame:
        return Y.all_typos(self.words.select("word"), self.adjacency)

    @cached_property
    def typo_reasons(self) -> DataFrame:
        """(typo, word, reason): why a generated typo is dropped; null if it stays. A typo equal to its word is none."""
        c = self.config
        p = self.all_typos.where("typo <> word").select("typo", "word").distinct()
        p = p.join(self.words.select(F.col("word").alias("typo"), F.lit(True).alias("in_source")), "typo", "left")
        p = p.join(self.valid.select(F.col("word").alias("typo"), F.lit(True).alias("in_valid")), "typo", "left")
        p = p.join(self.lex.select(F.col("word").alias("typo"), "freq"), "typo", "left")
        named = " OR ".join(f"typo LIKE {T.like_of_glob(_literal(r))} ESCAPE '!'" for r in self._typo_globs()) or "false"
        frequent = f"{c.typo_freq_threshold} > 0 AND coalesce(freq, 0) >= {c.typo_freq_threshold} AND NOT ({named})"
        guard = T.suffix_guard("typo", "word")
        reason = F.when(F.col("in_source"), "source_word").when(F.col("in_valid"), "validation_word").when(F.expr(frequent), "too_frequent").when(guard, "valid_suffix")
        return p.select("typo", "word", reason.alias("reason"))

    def _typo_globs(self) -> list[str]:
        return [r.partition("->")[0].strip().strip(":") for r in self.rules_given[1]]

    @cached_property
    def pairs(self) -> DataFrame:
        return cut(self.typo_reasons.where("reason IS NULL").select("typo", "word"))

    @cached_property
    def typo_map(self) -> DataFrame:
        return self.pairs.groupBy("typo").agg(F.array_sort(F.collect_set("word")).alias("words"))

    @cached_property
    def flags(self) -> DataFrame:
        return cut(N.flags(self.pairs, self.valid, self.words.select("word")))

    @cached_property
    def natural(self) -> DataFrame:
        return self.flags.select("typo", N.natural_boundary().alias("natural"))

    # -- candidates -------------------------------------------------------------------------------------------------

    @cached_property
    def ranked(self) -> DataFrame:
        """(typo, word, freq, rk): the words of a typo by frequency."""
        r = self.pairs.join(self.lex, "word", "left").select("typo", "word", F.coalesce("freq", F.lit(0)).alias("freq"))
        return r.withColumn("rk", F.row_number().over(Window.partitionBy("typo").orderBy(F.desc("freq"), "word")))

    @cached_property
    def collisions(self) -> DataFrame:
        """(typo, n_words, word, f1, f2, accepted): accepted if the first word is far more common than the second."""
        c = self.ranked.groupBy("typo").agg(F.count(F.lit(1)).alias("n_words"), F.max(F.when(F.col("rk") == 1, F.col("word"))).alias("word"), F.max(F.when(F.col("rk") == 1, F.col("freq"))).alias("f1"), F.max(F.when(F.col("rk") == 2, F.col("freq"))).alias("f2"))
        return cut(c.withColumn("accepted", (F.col("n_words") == 1) | (F.col("f2") == 0) | (F.col("f1") > self.config.freq_ratio * F.col("f2"))))

    @cached_property
    def ambiguous(self) -> DataFrame:
        a = self.collisions.where("NOT accepted").select("typo", "f1", "f2").join(self.ranked.select("typo", "word"), "typo").join(self.natural, "typo")
        return a.select("typo", "word", F.col("natural").alias("boundary"), "f1", "f2")

    @cached_property
    def orders(self) -> DataFrame:
        return self._rows([(k, i + 1, b) for k, bs in ORDERS.items() for i, b in enumerate(bs)], "natural string, ord int, boundary string")

    def excluded(self, corrections: DataFrame) -> DataFrame:
        """(typo, word, boundary) with the rules that match: -> typo, word, boundary, rule."""
        on = T.glob_match("typo", "typo_glob") & T.glob_match("word", "word_glob") & F.expr("required IS NULL OR required = boundary")
        return corrections.join(self.small("typo_rules")(self.typo_rules), on).select(*KEY, "rule")

    @cached_property
    def tries(self) -> DataFrame:
        """(typo, word, natural, ord, boundary, reason): each boundary of a winner; null reason: it would do."""
        least = self.config.min_typo_length
        t = self.collisions.where("accepted").select("typo", "word").join(self.flags, "typo").withColumn("natural", N.natural_boundary())
        t = t.join(F.broadcast(self.orders), "natural").withColumn("t", T.target_relation("typo", "word"))
        named = self.excluded(t.select(*KEY)).select(*KEY).distinct().withColumn("named", F.lit(True))
        t = t.join(named, KEY, "left")
        reason = F.when(F.expr(f"length(word) <= {least} AND length(typo) < {least}"), "too_short").when(F.col("named"), "excluded_by_pattern").when(F.expr(N.false_trigger("boundary")), "false_trigger")
        return cut(t.select("typo", "word", "natural", "ord", "boundary", reason.alias("reason")))

    @cached_property
    def corrections(self) -> DataFrame:
        c = self.tries.where("reason IS NULL").groupBy("typo", "word").agg(F.min_by("boundary", "ord").alias("boundary"))
        return cut(c)

    @cached_property
    def rejected(self) -> DataFrame:
        """Graveyard of the selection: boundaries tried before the one taken, and ambiguous words."""
        done = self.tries.where("reason IS NULL").groupBy("typo", "word").agg(F.min("ord").alias("taken"))
        r = self.tries.join(done, ["typo", "word"], "left").where("reason IS NOT NULL AND ord < coalesce(taken, 99)").select(*KEY, "reason")
        return r.unionByName(self.ambiguous.select(*KEY, F.lit("ambiguous_collision").alias("reason")))

    # -- patterns ---------------------------------------------------------------------------------------------------

    def extracted(self, side: str) -> DataFrame:
        """(tp, wp, boundary, typo, word): ends of corrections of equal length whose other parts agree."""
        c = self.corrections.where(F.col("boundary").isin("none", "right" if side == "suffix" else "left")).where("length(typo) = length(word) AND length(typo) >= 4")
        c = c.select("*", F.explode(F.expr("sequence(2, length(typo) - 2)")).alias("n"))
        if side == "suffix":
            parts = ("substring(typo, length(typo) - n + 1, n)", "substring(word, length(word) - n + 1, n)", "substring(typo, 1, length(typo) - n) = substring(word, 1, length(word) - n)")
        else:
            parts = ("substring(typo, 1, n)", "substring(word, 1, n)", "substring(typo, n + 1) = substring(word, n + 1)")
        return c.where(parts[2]).select(F.expr(parts[0]).alias("tp"), F.expr(parts[1]).alias("wp"), *["boundary", "typo", "word"]).where("tp <> wp")

    @cached_property
    def occurrences(self) -> DataFrame:
        """(tp, wp, boundary, typo, word) of patterns with two occurrences on one side; sides merged."""
        def often(side: str) -> DataFrame:
            e = self.extracted(side).distinct()
            n = e.groupBy("tp", "wp", "boundary").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
            return e.join(n, ["tp", "wp", "boundary"], "left_semi")

        return cut(often("suffix").unionByName(often("prefix")).distinct())

    @cached_property
    def pattern_checks(self) -> DataFrame:
        """(tp, wp, boundary, n, reason): the first check that a pattern fails."""
        key = ["tp", "wp", "boundary"]
        p = self.occurrences.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(self.rewritten("tp", "wp", "boundary", "typo") == F.col("word")).alias("right_result"))
        v = self.pattern_flags.select("tp", "v_word", "v_start", "v_end", "v_sub", "rtl", "ltr")
        p = p.join(v, "tp").join(self.mismatches.select(*key).distinct().withColumn("wrong", F.lit(True)), key, "left")
        conflict = "v_word OR (boundary IN ('right', 'none') AND v_end) OR (boundary IN ('left', 'none') AND v_start) OR (boundary = 'none' AND v_sub)"
        corrupt = platform(self.config.platform).direction
        reason = F.when(F.expr(f"length(tp) < {self.config.min_typo_length}"), "too_short").when(~F.coalesce("right_result", F.lit(False)), "wrong_result").when(F.expr(conflict), "validation_conflict").when(F.col(corrupt), "corrupts_source").when(F.col("wrong"), "incorrect_match")
        return cut(p.select(*key, "n", reason.alias("reason")))

    @staticmethod
    def rewritten(tp: str, wp: str, boundary: str, typo: str) -> Column:
        end = f"concat(substring({typo}, 1, length({typo}) - length({tp})), {wp})"
        start = f"concat({wp}, substring({typo}, length({tp}) + 1))"
        return F.expr(f"CASE WHEN {boundary} = 'right' THEN IF(endswith({typo}, {tp}), {end}, NULL) WHEN {boundary} = 'left' THEN IF(startswith({typo}, {tp}), {start}, NULL) WHEN endswith({typo}, {tp}) THEN {end} WHEN startswith({typo}, {tp}) THEN {start} END")

    @cached_property
    def pattern_flags(self) -> DataFrame:
        """(tp, v_word, v_start, v_end, v_sub, rtl, ltr): of pattern texts among validation words; at ends of source words."""
        p = self.occurrences.select("tp").distinct()
        g = N.substrings(self.valid, N.longest(p, "tp")).select(F.col("gram").alias("tp"), F.col("is_prefix").alias("v_start"), F.col("is_suffix").alias("v_end"), F.lit(True).alias("v_sub"))
        p = p.join(g, "tp", "left").join(self.valid.select(F.col("word").alias("tp"), F.lit(True).alias("v_word")), "tp", "left")
        for name, side in (("rtl", "prefix"), ("ltr", "suffix")):
            a = N.affixes(N.parts(self.words.select("word"), side), side, False).select(F.col("gram").alias("tp")).distinct().withColumn(name, F.lit(True))
            p = p.join(a, "tp", "left")
        return p.select("tp", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("v_word", "v_start", "v_end", "v_sub", "rtl", "ltr")])

    @cached_property
    def affix_matches(self) -> DataFrame:
        """(tp, wp, boundary, side, typo, word): other corrections whose typo properly ends or starts with the pattern."""
        p = self.occurrences.select("tp", "wp", "boundary").distinct()
        out = None
        for side in ("suffix", "prefix"):
            a = N.affixes(self.corrections.select(F.col("typo").alias("word")).distinct(), side, True).select(F.col("gram").alias("tp"), F.col("word").alias("typo"))
            m = p.join(a, "tp").join(self.corrections.select("typo", "word"), "typo").select("tp", "wp", "boundary", F.lit(side).alias("side"), "typo", "word")
            out = m if out is None else out.unionByName(m)
        own = self.occurrences.select("tp", "wp", "boundary", "typo", "word")
        return out.join(own, ["tp", "wp", "boundary", "typo", "word"], "left_anti").distinct()

    @cached_property
    def mismatches(self) -> DataFrame:
        """Affix matches that the pattern would turn into another word. If the pattern's text stands in the word itself,
        what follows its last place there is kept."""
        at = T.last_place("word", "tp")
        end = f"concat(substring(typo, 1, length(typo) - length(tp)), wp, CASE WHEN {at} > 0 THEN substring(word, {at} + length(tp)) ELSE '' END)"
        result = F.expr(f"CASE WHEN side = 'suffix' THEN {end} ELSE concat(wp, substring(typo, length(tp) + 1)) END")
        return self.affix_matches.withColumn("result", result).where("result <> word")

    @cached_property
    def redundancy(self) -> DataFrame:
        """Edges (short -> long) between sound patterns of one boundary: the short one, set in somewhere, gives the long one."""
        p = self.pattern_checks.where("reason IS NULL").select("tp", "wp", "boundary")
        g = p.select(F.col("tp").alias("long_tp"), F.col("wp").alias("long_wp"), "boundary", F.explode(F.expr("sequence(1, length(tp))")).alias("i"))
        g = g.select("*", F.explode(F.expr("sequence(1, length(long_tp) - i + 1)")).alias("k")).where("k < length(long_tp)").withColumn("tp", F.expr("substring(long_tp, i, k)"))
        e = g.join(p, ["tp", "boundary"]).where("concat(substring(long_tp, 1, i - 1), wp, substring(long_tp, i + k)) = long_wp")
        return e.select("boundary", "tp", "wp", "long_tp", "long_wp").distinct()

    @staticmethod
    def _id(*cols: str) -> Column:
        return F.concat_ws("\t", *cols)

    @cached_property
    def patterns(self) -> DataFrame:
        """(typo, word, boundary, n): accepted patterns."""
        p = self.pattern_checks.where("reason IS NULL").withColumn("id", self._id("tp", "wp", "boundary"))
        e = self.redundancy.select(self._id("tp", "wp", "boundary").alias("u"), self._id("long_tp", "long_wp", "boundary").alias("v"))
        return cut(p.join(kernel(p, e), "id", "left_semi").select(F.col("tp").alias("typo"), F.col("wp").alias("word"), "boundary", "n"))

    @cached_property
    def pattern_rejects(self) -> DataFrame:
        kept = self.patterns.select(F.col("typo").alias("tp"), F.col("word").alias("wp"), "boundary")
        return self.pattern_checks.join(kept, ["tp", "wp", "boundary"], "left_anti").select("tp", "wp", "boundary", "n", F.coalesce("reason", F.lit("redundant")).alias("reason"))

    @cached_property
    def replacements(self) -> DataFrame:
        """(pattern_typo, pattern_word, boundary, typo, word) of accepted patterns."""
        kept = self.patterns.select(F.col("typo").alias("tp"), F.col("word").alias("wp"), "boundary")
        return self.occurrences.join(kept, ["tp", "wp", "boundary"], "left_semi").select(F.col("tp").alias("pattern_typo"), F.col("wp").alias("pattern_word"), "boundary", "typo", "word")

    @cached_property
    def rules(self) -> DataFrame:
        """(typo, word, boundary): corrections that no pattern replaces, and the patterns."""
        left = self.corrections.join(self.replacements.select(*KEY), KEY, "left_anti").select(*KEY)
        return cut(left.unionByName(self.patterns.select(*KEY)).distinct())

    # -- conflicts --------------------------------------------------------------------------------------------------

    @cached_property
    def conflict_edges(self) -> DataFrame:
        """(typo, word, boundary, long_typo, long_word): of one boundary, a shorter rule that gives the longer one's word.
        The two typos share the first letter, or the last one for right boundaries."""
        r = self.rules
        g = r.select(F.col("typo").alias("long_typo"), F.col("word").alias("long_word"), "boundary", F.explode(F.expr("sequence(1, length(typo))")).alias("i"))
        g = g.select("*", F.explode(F.expr("sequence(1, length(long_typo) - i + 1)")).alias("k")).where("k < length(long_typo)")
        g = g.select("long_typo", "long_word", "boundary", F.expr("substring(long_typo, i, k)").alias("typo")).where("IF(boundary = 'right', right(typo, 1) = right(long_typo, 1), left(typo, 1) = left(long_typo, 1))").distinct()
        e = g.join(r, ["typo", "boundary"])
        result = F.when(F.col("boundary") == "right", T.replace_last("long_typo", "typo", "word")).otherwise(T.replace_first("long_typo", "typo", "word"))
        return e.where(result == F.col("long_word")).select(*KEY, "long_typo", "long_word")

    @cached_property
    def unblocked(self) -> DataFrame:
        r = self.rules.withColumn("id", self._id(*KEY))
        e = self.conflict_edges.select(self._id(*KEY).alias("u"), self._id("long_typo", "long_word", "boundary").alias("v"))
        return cut(r.join(kernel(r, e), "id", "left_semi").select(*KEY))

    @cached_property
    def blocked(self) -> DataFrame:
        """(typo, word, boundary, blocker): removed rules with the shortest kept rule that blocks them."""
        gone = self.rules.join(self.unblocked, KEY, "left_anti")
        e = self.conflict_edges.join(self.unblocked, KEY, "left_semi").select(F.col("long_typo").alias("typo"), F.col("long_word").alias("word"), "boundary", F.struct(F.length("typo").alias("n"), F.col("typo").alias("t"), F.col("word").alias("w")).alias("by"))
        return gone.join(e, KEY).groupBy(*KEY).agg(F.min("by").alias("by")).select(*KEY, F.concat_ws(" -> ", "by.t", "by.w").alias("blocker"))

    # -- platform ---------------------------------------------------------------------------------------------------

    def formatted(self, rules: DataFrame) -> DataFrame:
        out = T.qmk_text("typo", "boundary") if self.config.platform == "qmk" else F.col("typo")
        return rules.select(*KEY, out.alias("text"))

    @cached_property
    def platform_pairs(self) -> DataFrame:
        """(short, long) formatted rules, the first a proper substring of the second."""
        f = self.formatted(self.unblocked)
        g = f.select(F.struct(*KEY, "text").alias("long"), F.explode(F.expr("sequence(1, length(text))")).alias("i"))
        g = g.select("*", F.explode(F.expr("sequence(1, length(long.text) - i + 1)")).alias("k")).where("k < length(long.text)").select("long", F.expr("substring(long.text, i, k)").alias("text")).distinct()
        return cut(g.join(f, "text").select(F.struct(*KEY, "text").alias("short"), "long"))

    @cached_property
    def platform_decisions(self) -> DataFrame:
        """(short, long, remove_shorter): the less restrictive rule stays unless it fires falsely; of equals, by direction."""
        tight = lambda b: f"(CASE {b} WHEN 'none' THEN 0 WHEN 'both' THEN 2 ELSE 1 END)"
        p = self.platform_pairs.withColumn("s", F.expr(tight("short.boundary"))).withColumn("l", F.expr(tight("long.boundary")))
        p = p.withColumn("loose", F.expr("IF(s < l, short, long)"))
        names = p.select(F.col("loose.typo").alias("typo")).distinct()
        f = N.flags(names, self.valid, self.words.select("word"))
        p = p.withColumn("typo", F.col("loose.typo")).join(f, "typo").withColumn("t", T.target_relation("typo", "loose.word"))
        fires = N.false_trigger("loose.boundary")
        keeps_short = platform(self.config.platform).direction == "rtl"
        remove = f"CASE WHEN s = l THEN {str(not keeps_short).lower()} WHEN s < l THEN {fires} ELSE NOT {fires} END"
        return cut(p.select("short", "long", F.expr(remove).alias("remove_shorter")))

    @cached_property
    def platform_removed(self) -> DataFrame:
        """Rules that lose, pairs taken in the order of (long text, short text, long word, short word)."""
        d = self.platform_decisions.select(self._id("short.typo", "short.word", "short.boundary").alias("a"), self._id("long.typo", "long.word", "long.boundary").alias("b"), "remove_shorter", F.col("long.text").alias("o1"), F.col("short.text").alias("o2"), F.col("long.word").alias("o3"), F.col("short.word").alias("o4"), F.col("long.boundary").alias("o5"), F.col("short.boundary").alias("o6"))
        d = d.withColumn("loser", F.when(F.col("remove_shorter"), F.col("a")).otherwise(F.col("b")))
        gone = greedy_losers(d, ["o1", "o2", "o3", "o4", "o5", "o6"])
        return gone.select(F.split("x", "\t").alias("x")).select(*[F.col("x")[i].alias(k) for i, k in enumerate(KEY)])

    def violations(self, rules: DataFrame) -> DataFrame:
        """(typo, word, boundary, reason): the first constraint of the platform that a rule breaks, else null."""
        c = platform(self.config.platform)
        reason = F.lit(None).cast("string")
        if not c.supports_boundaries:
            reason = F.when(F.col("boundary") != "none", "Platform doesn't support boundaries").otherwise(reason)
        if c.max_word_length:
            reason = F.when(F.length("word") > c.max_word_length, f"Word too long (>{c.max_word_length})").otherwise(reason)
        if c.max_typo_length:
            reason = F.when(F.length("typo") > c.max_typo_length, f"Typo too long (>{c.max_typo_length})").otherwise(reason)
        if c.allowed:
            reason = F.when(~(F.col("typo").rlike(c.allowed) & F.col("word").rlike(c.allowed)), "Invalid characters").otherwise(reason)
        return rules.select(*KEY, reason.alias("reason"))

    @cached_property
    def final(self) -> DataFrame:
        """Rules after all passes."""
        return cut(self.passed[0])

    @cached_property
    def passed(self) -> tuple[DataFrame, DataFrame]:
        """(rules left, rules turned down by a pass): see :mod:`passes`."""
        from .passes import run

        return run(self, self.passes)

    def given(self, **tables: DataFrame) -> Engine:
        """An engine with some tables set and all that does not hang on rules taken over."""
        o = copy.copy(self)
        o.__dict__ = {k: v for k, v in self.__dict__.items() if k not in AFTER_RULES} | tables
        return o

    # -- ranking ----------------------------------------------------------------------------------------------------

    @cached_property
    def tiers(self) -> DataFrame:
        """(typo, word, boundary, tier): 0 user words, 1 patterns, 2 direct corrections."""
        r = self.final.join(self.words.where("is_user").select("word").withColumn("u", F.lit(True)), "word", "left")
        r = r.join(self.patterns.select("typo", "word").distinct().withColumn("p", F.lit(True)), ["typo", "word"], "left")
        r = r.join(self.replacements.select(*KEY).distinct().withColumn("gone", F.lit(True)), KEY, "left")
        return r.where("u OR p OR gone IS NULL").select(*KEY, F.expr("CASE WHEN u THEN 0 WHEN p THEN 1 ELSE 2 END").alias("tier"))

    @cached_property
    def pattern_scores(self) -> DataFrame:
        """(typo, word, boundary, score): frequencies of the words that a pattern's replaced corrections give."""
        s = self.replacements.join(self.lex, "word", "left").groupBy("pattern_typo", "pattern_word", "boundary").agg(F.sum(F.coalesce("freq", F.lit(0))).alias("score"))
        return s.select(F.col("pattern_typo").alias("typo"), F.col("pattern_word").alias("word"), "boundary", "score")

    @cached_property
    def scored(self) -> DataFrame:
        t = self.tiers.join(self.pattern_scores, KEY, "left").join(self.lex.withColumnRenamed("freq", "direct"), "word", "left")
        return t.select(*KEY, "tier", F.expr("CASE tier WHEN 1 THEN coalesce(score, 0) ELSE coalesce(direct, 0) END").alias("score"))

    def ranking(self, limit: int | None = None) -> DataFrame:
        """The first rules by (tier, score, typo, word, boundary). With a limit a top-k sort, so the window sees k rows."""
        order = ["tier", F.desc("score"), "typo", "word", "boundary"]
        most = platform(self.config.platform).max_corrections
        limit = min(x for x in (limit, self.config.max_corrections, most, 1 << 31) if x)
        top = self.scored.orderBy(*order).limit(limit)
        return top.withColumn("rnk", F.row_number().over(Window.orderBy(*order)))

    @cached_property
    def ranked_rules(self) -> DataFrame:
        return cut(self.ranking())

    # -- graveyard --------------------------------------------------------------------------------------------------

    @cached_property
    def graveyard(self) -> DataFrame:
        """(typo, word, boundary, reason, blocker, pass): all rules that a pass turned down in the first iteration."""
        none = F.lit(None).cast("string")
        parts = [
            self.rejected.select(*KEY, "reason", none.alias("blocker"), F.lit("candidate_selection").alias("pass")),
            self.pattern_rejects.select(F.col("tp").alias("typo"), F.col("wp").alias("word"), "boundary", F.lit("pattern_validation_failed").alias("reason"), F.col("reason").alias("blocker"), F.lit("pattern_generalization").alias("pass")),
            self.passed[1],
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def debug_rules(self) -> DataFrame:
        p = self._rows([(p,) for p in self.config.debug_typos], "pattern string")
        return p.select("pattern", T.marker_core("pattern").alias("glob"), T.marker_boundary("pattern").alias("scope"))


def _literal(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
