"""Output for text expanders (YAML) and keyboard firmware (lines)."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import QUERY_CONFIG
from ..functions import text as T
from ..operators.fixpoint import cut

C = QUERY_CONFIG


def _flag(name: str, boundary: str) -> Column:
    return F.when(F.col("boundary") == boundary, F.lit(True)).alias(name)


def espanso_rows(rules: DataFrame) -> DataFrame:
    return rules.select(F.col("typo").alias("trigger"), F.col("word").alias("replace"), F.lit(True).alias("propagate_case"), _flag("word", "both"), _flag("left_word", "left"), _flag("right_word", "right"))


ESPANSO_SQL = 'SELECT typo AS "trigger", word AS replace, true AS propagate_case, CASE WHEN boundary = \'both\' THEN true END AS word, CASE WHEN boundary = \'left\' THEN true END AS left_word, CASE WHEN boundary = \'right\' THEN true END AS right_word FROM unblocked'


def by_letter(rules: DataFrame) -> DataFrame:
    return rules.groupBy(T.letter_of("word").alias("letter")).agg(F.count(F.lit(1)).alias("n"))


def placed(rules: DataFrame, most: int) -> DataFrame:
    """Rules with letter and chunk number."""
    r = rules.withColumn("letter", T.letter_of("word"))
    rn = F.row_number().over(Window.partitionBy("letter").orderBy("word", "typo", "boundary"))
    return r.withColumn("chunk", F.floor((rn - 1) / most).cast("long"))


def chunks(rules: DataFrame, most: int) -> DataFrame:
    """(letter, chunk, n, file)"""
    return _named(placed(rules, most).groupBy("letter", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("first"), F.max("word").alias("last"))).select("letter", "chunk", "n", "file")


def _named(c: DataFrame) -> DataFrame:
    """Chunks (letter, chunk, first, last, ...) with the names of their files; of equal names the later ones get the chunk's number."""
    of = F.count(F.lit(1)).over(Window.partitionBy("letter"))
    name = F.when(F.col("letter") == "symbols", F.when(of == 1, "typos_symbols.yml").otherwise(F.concat(F.lit("typos_symbols_"), F.lpad((F.col("chunk") + 1).cast("string"), 3, "0"), F.lit(".yml"))))
    name = name.when(of == 1, F.concat(F.lit("typos_"), "letter", F.lit(".yml"))).otherwise(F.concat(F.lit("typos_"), "first", F.lit("_to_"), "last", F.lit(".yml")))
    c = c.withColumn("file", name)
    again = F.row_number().over(Window.partitionBy("letter", "file").orderBy("chunk")) > 1
    return c.withColumn("file", F.when(again, F.concat(F.regexp_replace("file", r"\.yml$", "_"), F.lpad((F.col("chunk") + 1).cast("string"), 3, "0"), F.lit(".yml"))).otherwise(F.col("file")))


CHUNK_SQL = f"SELECT letter, chunk, n, CASE WHEN row_number() OVER (PARTITION BY letter, file ORDER BY chunk) > 1 THEN replace(file, '.yml', '_' || lpad((chunk + 1)::VARCHAR, 3, '0') || '.yml') ELSE file END AS file FROM (SELECT letter, chunk, n, CASE WHEN letter = 'symbols' THEN CASE WHEN k = 1 THEN 'typos_symbols.yml' ELSE 'typos_symbols_' || lpad((chunk + 1)::VARCHAR, 3, '0') || '.yml' END WHEN k = 1 THEN 'typos_' || letter || '.yml' ELSE 'typos_' || f || '_to_' || l || '.yml' END AS file FROM (SELECT *, count(*) OVER (PARTITION BY letter) AS k FROM (SELECT letter, chunk, count(*)::BIGINT AS n, min(word) AS f, max(word) AS l FROM (SELECT *, ((row_number() OVER (PARTITION BY letter ORDER BY word, typo, boundary) - 1) // {C.max_entries_per_file})::BIGINT AS chunk FROM (SELECT *, CASE WHEN regexp_full_match(lower(left(word, 1)), '[a-z]') THEN lower(left(word, 1)) ELSE 'symbols' END AS letter FROM unblocked)) GROUP BY letter, chunk)))"


def ram(rules: DataFrame) -> DataFrame:
    kb = (F.avg(F.length("typo")) + F.avg(F.length("word")) + 60) * F.count(F.lit(1)) / 1024
    return rules.agg(F.count(F.lit(1)).alias("n"), F.round(kb, 2).alias("kb"), F.round(kb / 1024, 4).alias("mb"))


def qmk_lines(rules: DataFrame) -> DataFrame:
    return rules.select("word", F.concat(T.qmk_text("typo", "boundary"), F.lit(" -> "), "word").alias("line")).distinct()


def yaml_files(rules: DataFrame, most: int) -> DataFrame:
    """(file, n, text): the files' names and their block-style YAML, a row a chunk; strings in double quotes."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"([\\\\\"])", r"\\$1"), "\n", r"\\n"), F.lit('"'))
    flag = lambda k, b: F.when(F.col("boundary") == b, f"    {k}: true\n").otherwise("")
    entry = F.concat(F.lit("  - trigger: "), quote("typo"), F.lit("\n    replace: "), quote("word"), F.lit("\n    propagate_case: true\n"), flag("word", "both"), flag("left_word", "left"), flag("right_word", "right"))
    c = placed(rules, most).groupBy("letter", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("first"), F.max("word").alias("last"), F.array_sort(F.collect_list(F.struct("word", "typo", "boundary", entry.alias("entry")))).alias("rules"))
    text = F.concat(F.lit("matches:\n"), F.array_join(F.transform("rules", lambda r: r["entry"]), ""))
    return _named(c).select("file", "n", text.alias("text"))


def _write(rows, folder: str):
    """Each file first under another name, so that a task that is run again leaves whole files."""
    for r in rows:
        at = Path(folder, r["file"])
        part = at.with_name(f".{at.name}.{os.getpid()}")
        part.write_text(r["text"], encoding="utf-8")
        part.replace(at)


def write_espanso(rules: DataFrame, folder: str, most: int = 500) -> list[str]:
    """One YAML file a chunk, written by the tasks: ``folder`` must be one that driver and executors share. -> names."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    files = cut(yaml_files(rules, most))
    whole = str(Path(folder).absolute())
    files.foreachPartition(lambda rows: _write(rows, whole))
    return [r["file"] for r in files.select("file").orderBy("file").collect()]


def print_espanso(rules: DataFrame) -> None:
    """The rules as one YAML document on standard output."""
    print("matches:")
    for r in yaml_files(rules, 500).orderBy("file").toLocalIterator():
        print(r["text"].removeprefix("matches:\n"), end="")


def write_qmk(rules: DataFrame, path: str) -> str:
    """One line a rule, by word, to ``path`` or ``path``/autocorrect.txt where it is a folder. Firmware holds some
    thousand rules, so the lines come through the driver one by one."""
    at = Path(path).expanduser()
    if at.suffix == "" or at.is_dir():
        at = at / "autocorrect.txt"
    at.parent.mkdir(parents=True, exist_ok=True)
    with at.open("w", encoding="utf-8") as f:
        for r in qmk_lines(rules).orderBy("word", "line").toLocalIterator():
            f.write(r["line"] + "\n")
    return str(at)
