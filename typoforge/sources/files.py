"""Parsers of line files, over spark.read.text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = " -> "


def _lines(lines: DataFrame) -> DataFrame:
    """(line_no, value) without blank lines and comments, trimmed."""
    t = lines.select("line_no", F.trim("value").alias("value"))
    return t.where("value <> '' AND NOT startswith(value, '#')")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a small text file. FileNotFoundError, IsADirectoryError or UnicodeDecodeError if it is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if fs.getFileStatus(at).isDirectory():
        raise IsADirectoryError(path)
    if spark.read.format("binaryFile").load(path).where(~F.is_valid_utf8(F.col("content").cast("string"))).count():
        raise UnicodeDecodeError("utf-8", b"", 0, 1, f"{path} is no UTF-8 text")
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def parse_include(lines: DataFrame) -> DataFrame:
    """Lower-cased words, duplicates and order kept; words with control marks or backslashes are left out."""
    return _lines(lines).select("line_no", F.lower("value").alias("word")).where(r"NOT word RLIKE '[\\n\\r\\t\\\\]'")


def parse_exclusions(lines: DataFrame) -> DataFrame:
    """Rules as they stand, case kept, once each."""
    return _lines(lines).select(F.col("value").alias("rule")).distinct()


def parse_adjacency(lines: DataFrame) -> DataFrame:
    """(key, pos, neighbor); of repeated keys the last line counts, lines without the mark are skipped."""
    t = _lines(lines).where(F.col("value").contains(MARK))
    t = t.select("line_no", F.trim(F.substring_index("value", MARK, 1)).alias("key"), F.expr(f"trim(substring(value, instr(value, '{MARK}') + {len(MARK)}))").alias("near"))
    t = t.groupBy("key").agg(F.max_by("near", "line_no").alias("near")).where("length(near) > 0")
    return t.select("key", F.posexplode(F.split("near", "")).alias("pos", "neighbor")).where("neighbor <> ''")


def include_file(spark: SparkSession, path: str) -> DataFrame:
    return parse_include(read_lines(spark, path))


def exclusion_file(spark: SparkSession, path: str) -> DataFrame:
    return parse_exclusions(read_lines(spark, path))


def adjacency_file(spark: SparkSession, path: str) -> DataFrame:
    return parse_adjacency(read_lines(spark, path))
