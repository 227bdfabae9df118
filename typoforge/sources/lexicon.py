"""Word frequencies from text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokens(texts: DataFrame) -> DataFrame:
    """(text) -> (word): runs of a-z of the lower-cased text."""
    return texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


def lexicon(documents: DataFrame, lang: str = "en") -> DataFrame:
    """(word, freq). The count is combined before the shuffle, so a frequent word costs a row a task."""
    return tokens(documents.where(F.col("lang") == lang)).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def user_words(benchmark: DataFrame, least: int) -> DataFrame:
    t = tokens(benchmark).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return t.where((F.col("n") >= least) & (F.length("word") >= 2)).select("word")


def top_words(lex: DataFrame, n: int, shortest: int, longest: int) -> DataFrame:
    """(word, freq, rnk): of the 3 n most frequent words the first n of fitting length. Top-k sorts, no full sort."""
    from pyspark.sql import Window

    most = lex.orderBy(F.desc("freq"), "word").limit(3 * n).where(F.length("word").between(shortest, longest))
    return most.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("freq"), "word"))).where(F.col("rnk") <= n)
