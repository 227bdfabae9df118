"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Steps, all DataFrame expressions:

1. Word counts; sizes of sources and of (source, shard) cells, where the shard comes from a seeded hash of
   id and text, so a source with a third of all rows is spread over all shards.
2. Targets: ``share`` times all words, dealt by weight; a source stops at ``max_epochs`` times its size and the
   excess goes to the others by weight (water-filling, solved in closed form over the sources' table).
3. Blocks of equal length are dealt to the sources by the highest quotients target / (2 k + 1), and each source's blocks
   to its shards by the quotients of their sizes: integer quotas per shard.
4. Each cell lines its documents up in a seeded order, cuts the line into blocks and takes its quota of blocks,
   going round at most ``max_epochs`` times; a document gets the words of the blocks that cover it.

Sources are a small table, one row each, that windows without keys run over: some million of them fit the one task.
A cell takes at most ``max_epochs`` times its words, so a source may miss its target by half a block for each shard.

Cases: null text has size 0; null source is a source of its own, last; rows are dealt to shards by id and text, so rows
without id or with one id are spread; repeated rows each count and may differ by a block's edge only; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 6
#: Documents a shard should hold on average: a shard is sorted in one task.
SHARD_DOCS = 4_000
#: Blocks are at most so long, and shorter where a cell of mean size would get under BLOCKS_PER_CELL of them.
MAX_BLOCK, BLOCKS_PER_CELL = 256, 400


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with weight and target. One row per source: the windows run over that small table."""
    n = len(weights)
    at = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_index = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % n + 1).cast("int"))
    s = sources.withColumn("i", F.row_number().over(at) - 1).withColumn("weight", by_index)
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "i")
    whole = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
    s = s.withColumn("capped_before", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weight_from", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_from"))
    # the first source, by ratio, that stays under its cap sets the level for itself and all after it
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(whole)
    s = s.withColumn("water", level)
    return s.withColumn("target", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))).select("source", "source_size", "weight", "target")


def sainte_lague(votes: DataFrame, key: list[str], vote: str, seats: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Deal ``seats`` (the same in all rows of a group of ``within``) to the group's rows by the highest quotients vote / (2 k + 1).

    Any divisor leaves each row within one of (seats +- rows / 2) * vote / total: only the quotients between these two
    counts are ranked, about two per row. Ties go to the smaller key. Zero or null votes get nothing.
    """
    whole = Window.partitionBy(*within)
    v = votes.withColumn("_all", F.sum(vote).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    share = F.when(F.col("_all") > 0, F.col(vote) / F.col("_all")).otherwise(F.lit(0.0))
    v = v.withColumn("_low", F.greatest(F.lit(0), F.floor((F.col(seats) - F.col("_n") / 2) * share + 0.5) - 1).cast("long"))
    v = v.withColumn("_high", F.greatest(F.col("_low"), (F.floor((F.col(seats) + F.col("_n") / 2) * share + 0.5) + 1).cast("long")))
    v = v.withColumn("_left", F.col(seats) - F.sum("_low").over(whole))
    q = v.select(*key, vote, "_left", F.explode(F.sequence(F.col("_low"), F.col("_high"))).alias("_k"))
    q = q.withColumn("_rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(F.col(vote) / (2 * F.col("_k") + 1)), *key, "_k")))
    won = q.where((F.col("_rank") <= F.col("_left")) & (F.col(vote) > 0)).groupBy(*key).agg(F.count(F.lit(1)).alias("_won"))
    on = [F.col(f"v.{k}").eqNullSafe(F.col(f"w.{k}")) for k in key]
    return v.alias("v").join(won.alias("w"), on, "left").select(*[F.col(f"v.{c}").alias(c) for c in votes.columns], (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """documents (doc_id, text, source) -> doc_id, size, source, shard, source_size, target, quota, block, taken."""
    sized = materialize(docs.select("doc_id", "source", F.xxhash64("text").alias("h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    rows = sized.count()
    shards = max(1, -(-rows // shard_docs))
    placed = sized.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "h", F.lit("order"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h", F.lit("shard")), F.lit(shards)).cast("int"))
    # the cells are shards times sources: a small table, written once
    cells = materialize(placed.groupBy("source", "shard").agg(F.sum("size").alias("cell_size")), "mix-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, max_epochs)
    # one row per source: windows without keys run over that table only
    whole = Window.partitionBy()
    total, n = F.sum("target").over(whole), F.count(F.lit(1)).over(whole)
    targets = targets.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(total / (n * shards * BLOCKS_PER_CELL)))).cast("long"))
    targets = sainte_lague(targets.withColumn("seats", F.round(total / F.col("block")).cast("long")), ["source"], "target", "seats")
    targets = targets.select("source", "source_size", "target", "block", F.col("quota").alias("source_quota"))
    c = cells.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "shard", "cell_size", "source_size", "target", "block", "source_quota")
    c = materialize(sainte_lague(c, ["source", "shard"], "cell_size", "source_quota", ("source",)), "mix-quotas")
    line = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = placed.withColumn("end", F.sum("size").over(line))
    d = lined.alias("d").join(c.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.shard") == F.col("c.shard")))
    words = F.least(F.col("quota") * F.col("block"), F.col("cell_size") * F.lit(max_epochs))
    rounds = F.when(F.col("cell_size") > 0, F.floor(words / F.col("cell_size"))).otherwise(F.lit(0)).cast("long")
    rest = words - rounds * F.col("cell_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("end") - F.col("size"))))
    return d.select("doc_id", "size", F.col("d.source").alias("source"), F.col("d.shard").alias("shard"), "source_size", "target", "quota", "block", (rounds * F.col("size") + part).cast("long").alias("taken"))


def op6(spark, sf_dir, docs: DataFrame | None = None) -> DataFrame:
    from .common import read

    docs = read(spark, sf_dir, "documents") if docs is None else docs
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "quota", "block")
