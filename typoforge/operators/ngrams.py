"""Prefix, suffix and substring tests as equi-joins with the exploded n-grams of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def substrings(words: DataFrame, longest: int) -> DataFrame:
    """(word) -> (gram, is_prefix, is_suffix): each proper substring up to ``longest`` letters, flags over all words."""
    s = words.select("word", F.explode(F.expr("sequence(1, greatest(length(word), 1))")).alias("i"))
    s = s.select("word", "i", F.explode(F.expr(f"sequence(1, greatest(1, least({longest}, length(word) - i + 1)))")).alias("n")).where("n < length(word) AND i + n - 1 <= length(word)")
    s = s.select(F.expr("substring(word, i, n)").alias("gram"), (F.col("i") == 1).alias("p"), F.expr("i + n - 1 = length(word)").alias("s"))
    return s.groupBy("gram").agg(F.max("p").alias("is_prefix"), F.max("s").alias("is_suffix"))


def longest(texts: DataFrame, column: str) -> int:
    """Letters of the longest text: no longer gram can be looked up."""
    return max(texts.agg(F.max(F.length(column))).first()[0] or 1, 1)


def affixes(words: DataFrame, side: str, proper: bool) -> DataFrame:
    """(word) -> (gram, word) for the prefixes or suffixes of each word."""
    s = words.select("word", F.explode(F.expr("sequence(1, greatest(length(word), 1))")).alias("n")).where("n < length(word)" if proper else "length(word) > 0")
    return s.select(F.expr("substring(word, 1, n)" if side == "prefix" else "substring(word, length(word) - n + 1, n)").alias("gram"), "word")


def parts(words: DataFrame, side: str) -> DataFrame:
    """(word): each word from its start and from behind each non-letter on; for suffixes to its end and to before each non-letter."""
    cut = F.expr("sequence(1, greatest(length(word), 1))")
    w = words.select("word", F.explode(cut).alias("i"))
    if side == "prefix":
        return w.where("i = 1 OR substring(word, i - 1, 1) RLIKE '[^A-Za-z]'").select(F.expr("substring(word, i)").alias("word")).distinct()
    return w.where("i = length(word) OR substring(word, i + 1, 1) RLIKE '[^A-Za-z]'").select(F.expr("substring(word, 1, i)").alias("word")).distinct()


def flags(typos: DataFrame, validation: DataFrame, source: DataFrame) -> DataFrame:
    """(typo) -> typo, v_start, v_end, v_sub, s_start, s_end, s_sub: stands at the start, end, anywhere of another word."""
    out, most = typos.select("typo").distinct(), longest(typos, "typo")
    for tag, words in (("v", validation), ("s", source)):
        g = substrings(words, most).select(F.col("gram").alias("typo"), F.col("is_prefix").alias(f"{tag}_start"), F.col("is_suffix").alias(f"{tag}_end"), F.lit(True).alias(f"{tag}_sub"))
        out = out.join(g, "typo", "left")
    return out.select("typo", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("v_start", "v_end", "v_sub", "s_start", "s_end", "s_sub")])


def contained(texts: DataFrame) -> DataFrame:
    """(text) -> (text, longer): texts that stand inside longer ones, by an equi-join on all proper substrings."""
    g = texts.select(F.col("text").alias("longer"), F.explode(F.expr("sequence(1, length(text))")).alias("i"))
    g = g.select("longer", "i", F.explode(F.expr("sequence(1, length(longer) - i + 1)")).alias("n")).where("n < length(longer)")
    return g.select("longer", F.expr("substring(longer, i, n)").alias("text")).distinct().join(texts, "text").select("text", "longer")


def natural_boundary() -> Column:
    """The least restrictive safe boundary from the flags."""
    return F.expr("CASE WHEN NOT (v_sub OR s_sub) THEN 'none' WHEN v_start AND v_end THEN 'both' WHEN v_end THEN 'left' WHEN v_start THEN 'right' ELSE 'both' END")


def false_trigger(boundary: str) -> str:
    """SQL: the rule would fire inside another word, or in its own target (prefix, suffix, middle from target_relation)."""
    start, end, anywhere = "(v_start OR s_start OR t.prefix)", "(v_end OR s_end OR t.suffix)", "(v_sub OR s_sub OR t.middle)"
    return f"(CASE {boundary} WHEN 'none' THEN {start} OR {end} OR {anywhere} WHEN 'left' THEN {start} WHEN 'right' THEN {end} ELSE false END)"


def false_trigger_reason(boundary: str) -> str:
    """SQL: where the rule would fire first: target, validation, source; null if nowhere."""
    parts = {"target": ("t.prefix", "t.suffix", "t.middle"), "validation": ("v_start", "v_end", "v_sub"), "source": ("s_start", "s_end", "s_sub")}
    case = lambda pick: "CASE " + " ".join(f"WHEN {pick(x)} THEN '{k}'" for k, x in parts.items()) + " END"
    return f"(CASE {boundary} WHEN 'none' THEN {case(lambda x: '(' + ' OR '.join(x) + ')')} WHEN 'left' THEN {case(lambda x: x[0])} WHEN 'right' THEN {case(lambda x: x[1])} END)"
