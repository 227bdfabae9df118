"""The passes over the rules, in order. A pass is a name and a function (engine, rules) -> (rules left, rules turned down).

Rules are (typo, word, boundary); those turned down also have (reason, blocker). Passes can be left out, put in another
order or joined by others: ``Engine(..., passes=(*PASSES, Pass("mine", f)))``. What a pass turns down goes to the graveyard
under its name, and the solver keeps it out of the next round.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import KEY, Engine


class Pass(NamedTuple):
    name: str
    run: Callable[[Engine, DataFrame], tuple[DataFrame, DataFrame]]


def _none():
    return F.lit(None).cast("string")


def conflict_removal(e: Engine, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Longer rules that a shorter one makes needless go."""
    o = e if rules is e.rules else e.given(rules=rules)
    return o.unblocked, o.blocked.select(*KEY, F.lit("blocked_by_conflict").alias("reason"), "blocker")


def platform_substrings(e: Engine, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of two rules whose texts contain one another on the platform one goes."""
    o = e if rules is e.__dict__.get("unblocked") else e.given(unblocked=rules)
    gone = o.platform_removed
    return rules.join(gone, KEY, "left_anti"), gone.select(*KEY, F.lit("platform_constraint").alias("reason"), _none().alias("blocker"))


def platform_constraints(e: Engine, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules that the platform can't hold go."""
    v = e.violations(rules)
    return v.where("reason IS NULL").select(*KEY), v.where("reason IS NOT NULL").select(*KEY, F.lit("platform_constraint").alias("reason"), F.col("reason").alias("blocker"))


PASSES = (Pass("conflict_removal", conflict_removal), Pass("platform_substrings", platform_substrings), Pass("platform_constraints", platform_constraints))


def run(e: Engine, passes: tuple[Pass, ...]) -> tuple[DataFrame, DataFrame]:
    """(rules left, (typo, word, boundary, reason, blocker, pass) of those turned down)."""
    rules, out = e.rules, None
    for p in passes:
        rules, gone = p.run(e, rules)
        gone = gone.select(*KEY, "reason", "blocker", F.lit(p.name).alias("pass"))
        out = gone if out is None else out.unionByName(gone)
    if out is None:
        out = rules.limit(0).select(*KEY, *[_none().alias(c) for c in ("reason", "blocker", "pass")])
    return rules, out
