"""What the operators of this subpackage share: the shared folder, materialised tables, word bytes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="typoforge-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: With it, the files of a query's shuffles go when the query ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, frees its shuffles.

    settings: those of Spark that hold while it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    settings = {CLEANUP: "true"} | (settings or {})
    was = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize`; nothing may read it afterwards."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if root.split(":")[-1].lstrip("/") in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A join has so many hot keys at most, and a key so many rows at least before it is hot.
HOT_KEYS, HOT_ROWS = 20_000, 64


def join_spread(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and its number of rows as ``n`` (dropped).

    Keys with over 1 / HOT_KEYS of the ``total`` rows, so at most HOT_KEYS of them, are broadcast, and their rows stay
    where they are; only the others are shuffled.
    """
    hot = F.col(n) > max(HOT_ROWS, total // HOT_KEYS)
    few = table.where(hot).drop(n)
    heavy = rows.join(F.broadcast(few), key)
    return heavy.unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(table.where(~hot).drop(n), key).select(heavy.columns))


def give_back() -> None:
    """Return what the allocator of this Python worker holds but does not use: workers outlive their tasks."""
    import ctypes
    import gc

    gc.collect()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
