"""Greedy removals as fixpoints over edges, with tables cut by checkpoints in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of the rows: ends the lineage and outlives executors. The folder is the cluster's, if it names one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="typoforge-"))
    return df.checkpoint()


def kernel(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) and (u, v), acyclic -> ids kept: a node goes if and only if a kept node points to it.

    Each round decides the nodes whose sources are all decided, so rounds are the longest chain, not the node count.
    """
    edges = cut(edges.distinct())
    kept = nodes.select("id").distinct().join(edges.select(F.col("v").alias("id")).distinct(), "id", "left_anti")
    gone = None
    live = edges
    while not live.isEmpty():
        lost = live.join(kept, live["u"] == kept["id"], "left_semi").select(F.col("v").alias("id")).distinct()
        gone = cut(lost if gone is None else gone.unionByName(lost).distinct())
        # edges from and to removed nodes are done; what has no edge left is kept
        left = live.join(gone, live["v"] == gone["id"], "left_anti")
        rest = left.join(gone, left["u"] == gone["id"], "left_anti")
        free = left.select(F.col("v").alias("id")).distinct().join(rest.select(F.col("v").alias("id")), "id", "left_anti")
        kept = cut(kept.unionByName(free))
        live = cut(rest)
    return kept


def greedy_losers(edges: DataFrame, order: list[str]) -> DataFrame:
    """(a, b, loser, ...) taken in ``order``: an edge counts if neither end is out yet, and then its loser is out.

    An edge counts for sure if no earlier open edge threatens its winner. Each round settles all such edges; the loser's
    edges after the first of them fall away, those before it stay open. The rounds follow chains of threats.
    """
    winner = F.when(F.col("loser") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    live = cut(edges.select(winner.alias("w"), F.col("loser").alias("l"), F.struct(*order).alias("rank")))
    out = None
    while not live.isEmpty():
        threat = live.groupBy("l").agg(F.min("rank").alias("threat")).withColumnRenamed("l", "w")
        sure = live.join(threat, "w", "left").where("threat IS NULL OR threat > rank")
        dead = cut(sure.groupBy(F.col("l").alias("x")).agg(F.min("rank").alias("end")))
        out = dead.select("x") if out is None else out.unionByName(dead.select("x"))
        left = live.join(threat, "w", "left").where("threat <= rank").drop("threat")
        for end in ("w", "l"):
            left = left.join(dead, left[end] == dead["x"], "left").where("end IS NULL OR rank < end").drop("x", "end")
        live = cut(left)
    return cut(out.distinct()) if out is not None else edges.select(F.col("loser").alias("x")).limit(0)
