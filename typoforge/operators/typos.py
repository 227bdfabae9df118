"""Mechanical typing errors as expansions of (word) -> (typo, word)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _at(words: DataFrame, typo: str, where: str) -> DataFrame:
    """One row for each place i, 1-based, of the word where ``where`` holds."""
    return words.select("word", F.explode(F.expr("sequence(1, greatest(length(word), 1))")).alias("i")).where(f"length(word) > 0 AND ({where})").select(F.expr(typo).alias("typo"), "word")


def transpositions(words: DataFrame) -> DataFrame:
    return _at(words, "concat(substring(word, 1, i - 1), substring(word, i + 1, 1), substring(word, i, 1), substring(word, i + 2))", "i < length(word)")


def omissions(words: DataFrame) -> DataFrame:
    return _at(words, "concat(substring(word, 1, i - 1), substring(word, i + 1))", "length(word) >= 4")


def duplications(words: DataFrame) -> DataFrame:
    return _at(words, "concat(substring(word, 1, i), substring(word, i))", "true")


def _near(words: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(word, i, neighbor); the adjacency of a keyboard has a few hundred rows at most."""
    places = words.select("word", F.explode(F.expr("sequence(1, greatest(length(word), 1))")).alias("i")).withColumn("key", F.expr("substring(word, i, 1)"))
    return places.join(F.broadcast(adjacency.select("key", "neighbor")), "key")


def insertions(words: DataFrame, adjacency: DataFrame) -> DataFrame:
    """A neighbour after and before each place."""
    n = _near(words, adjacency).withColumn("cut", F.explode(F.array(F.col("i"), F.col("i") - 1)))
    return n.select(F.expr("concat(substring(word, 1, cut), neighbor, substring(word, cut + 1))").alias("typo"), "word")


def replacements(words: DataFrame, adjacency: DataFrame) -> DataFrame:
    return _near(words, adjacency).select(F.expr("concat(substring(word, 1, i - 1), neighbor, substring(word, i + 1))").alias("typo"), "word")


def all_typos(words: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(typo, word, kind), duplicates kept."""
    parts = {"transposition": transpositions(words), "omission": omissions(words), "duplication": duplications(words), "insertion": insertions(words, adjacency), "replacement": replacements(words, adjacency)}
    out = None
    for kind, df in parts.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out
