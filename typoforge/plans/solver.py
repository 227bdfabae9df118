"""The loop: passes repeat, with what they turned down kept out, until nothing new is turned down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fixpoint import cut
from .engine import KEY, Engine


class _Round(Engine):
    """One iteration: the tables before selection come from the first engine; graveyard rules are not tried again."""

    KEEP = ("lex", "user", "valid", "words", "pairs", "flags", "natural", "collisions", "tries", "adjacency", "typo_rules", "orders")

    def __init__(self, first: Engine, buried: DataFrame | None):
        super().__init__(first.spark, first.documents, first.benchmark, first.config, first.given_include, first.given_adjacency, first.rules_given, first.passes)
        for name in self.KEEP:
            self.__dict__[name] = getattr(first, name)
        if buried is not None:
            self.__dict__["tries"] = first.tries.join(buried.select(*KEY), KEY, "left_anti")
            keyed = buried.select(F.col("typo").alias("tp"), F.col("word").alias("wp"), "boundary")
            self.__dict__["occurrences"] = cut(Engine.occurrences.func(self).join(keyed, ["tp", "wp", "boundary"], "left_anti"))


@dataclass
class Result:
    rules: DataFrame
    graveyard: DataFrame
    iterations: int
    converged: bool
    engine: Engine


def solve(first: Engine, max_iterations: int | None = None) -> Result:
    """Rules of the last iteration and all rules turned down, each with the iteration. Each round plans from checkpoints."""
    if (done := first.__dict__.get("_solved")) is not None and max_iterations is None:
        return done
    buried, known, last = None, 0, None
    most = max_iterations or first.config.max_iterations
    for i in range(1, most + 1):
        last = _Round(first, buried)
        down = last.graveyard.where("pass <> 'candidate_selection'").select(*KEY, "reason")
        down = down.groupBy(*KEY).agg(F.min("reason").alias("reason")).withColumn("iteration", F.lit(i))
        if buried is not None:
            down = buried.unionByName(down.join(buried.select(*KEY), KEY, "left_anti"))
        buried = cut(down)
        count = buried.count()
        if settled := count == known:
            break
        known = count
    result = Result(last.final, buried, i, settled, last)
    if max_iterations is None:
        first.__dict__["_solved"] = result
    return result
