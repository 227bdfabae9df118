"""URL filters: host and path rules, and a Bloom filter cascade that gives exact membership in a list of hosts.

Cascade: level 1 holds the listed keys; level 2 holds the other keys of the corpus that level 1 takes for listed;
level 3 the keys of level 1's list that level 2 takes for false positives; and so on, until a level makes no mistake
on the key universe, which is every host of the corpus with its parent domains. A key is listed if the first level
that misses it is an even one. A level is an array of longs in one row; probes read it as a scalar subquery, so no
join runs over the pages. A filter is broadcast with the plan: its bits are bounded by ``max_bits``, and a longer list
is worked off in as many passes over the pages as the bound asks for, each with the keys of one residue and, in memory, its
own cascade only; verdicts so far are written to the shared folder between them.

Cases: a null url, or one without ``://``, has host and path empty; empty keys and null keys of a list are ignored;
repeated rows give repeated results; an empty table gives an empty result; of the pages only page_id and url are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Fixed values: (action, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# The listed hosts; their subdomains are listed with them.
LISTED = ("spam-farm.example.org", "ads.example.com", "casino.example.org", "malware.example.com", "phish.example.org", "tionble.example.com", "ththre.example.org")
BITS_PER_KEY, PROBES = 8, 4
#: 4 MB a level.
MAX_BITS = 1 << 25


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_fit(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, action) of the longest rule that fits; of equal ones the first."""
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def domain(host: Column, n: int) -> Column:
    """The last n labels of the host, null if it has fewer: a.b.c, 2 -> b.c."""
    return F.when(labels(host) >= n, F.substring_index(host, ".", -n))


def _probe(key: Column, level: int, bits: int, i: int) -> Column:
    """The i-th bit of the key at this level."""
    return F.pmod(F.xxhash64(key, F.lit(level * PROBES + i)), F.lit(bits))


def _hit(key: Column, level: int, bits: int, words: DataFrame) -> Column:
    """Whether the level has all bits of the key."""
    filled, hit = words.scalar(), F.lit(True)
    for i in range(PROBES):
        at = _probe(key, level, bits, i)
        hit = hit & (F.getbit(F.element_at(filled, (F.floor(at / 64) + 1).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
    return hit


class Cascade:
    """Built by :func:`build_cascade`; ``contains(key)`` is a column expression."""

    def __init__(self, levels: list[tuple[int, DataFrame]], passes: int, number: int):
        self.levels, self.passes, self.number = levels, passes, number

    def contains(self, key: Column) -> Column:
        inside = F.lit(False)
        for k, (bits, words) in reversed(list(enumerate(self.levels, 1))):
            inside = _hit(key, k, bits, words) & ~inside
        if self.passes > 1:
            inside = inside & (F.pmod(F.xxhash64(key, F.lit(0)), F.lit(self.passes)) == self.number)
        return inside


def _bitmap(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row with the level's words in order, as an array of bits / 64 longs."""
    spark = keys.sparkSession
    at = keys.select(F.explode(F.array(*[_probe(F.col("key"), level, bits, i) for i in range(PROBES)])).alias("at"))
    bit = F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")
    words = at.groupBy(F.floor(F.col("at") / 64).cast("long").alias("w")).agg(F.bit_or(bit).alias("set"))
    every = spark.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left").select("w", F.coalesce("set", F.lit(0)).cast("long").alias("set"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "set"))), lambda x: x["set"]).alias("words"))


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS, max_levels: int = 60) -> list[Cascade]:
    """``listed`` and ``universe``: (key). One cascade for each pass; a key is in the list if any of them has it."""
    listed = materialize(listed.where("key is not null and key <> ''").select("key").distinct(), "url-listed")
    passes = max(1, math.ceil(listed.count() * bits_per_key / max_bits))
    out = []
    for number in range(passes):
        mine = lambda df: df.where(F.pmod(F.xxhash64("key", F.lit(0)), F.lit(passes)) == number)
        inside = mine(listed)
        outside = materialize(mine(universe.where("key is not null and key <> ''").select("key").distinct()).join(inside, "key", "left_anti"), "url-others")
        levels: list[tuple[int, DataFrame]] = []
        hold, other = inside, outside
        while len(levels) < max_levels and (n := hold.count()):
            bits = 64 * max(1, math.ceil(n * bits_per_key / 64))
            levels.append((bits, materialize(_bitmap(hold, len(levels) + 1, bits), "url-level")))
            hold, other = materialize(other.where(_hit(F.col("key"), len(levels), *levels[-1])), "url-wrong"), hold
        if hold.count():
            raise RuntimeError("the cascade did not end; raise bits_per_key")
        out.append(Cascade(levels, passes, number))
    return out


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict: the longest rule's, else by the list."""
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # only domains with as many labels as some listed key can be listed: at most the labels of a host name
    depths = sorted(r[0] for r in listed.where("key is not null and key <> ''").select(labels(F.col("key"))).distinct().collect())
    host = F.col("host")
    universe = seen.select("host").distinct().select(F.explode(F.array(F.lit(None).cast("string"), *[domain(host, n) for n in depths])).alias("key"))
    cascades = build_cascade(listed, universe, bits_per_key, max_bits)
    seen = seen.withColumn("listed", F.lit(False))
    for c in cascades:
        inside = F.col("listed")
        for n in depths:
            inside = inside | F.coalesce(c.contains(domain(host, n)), F.lit(False))
        after = seen.withColumn("listed", inside)
        if len(cascades) > 1:
            after = materialize(after, "url-pass")
            if c.number:
                discard(seen)
        seen = after
    rule, action = rule_fit(F.col("host"), F.col("path"), rules)
    return seen.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def op1(spark, sf_dir) -> DataFrame:
    from .common import read

    return judge(read(spark, sf_dir, "pages"), spark.createDataFrame([(h,) for h in LISTED], "key string"))


OP1_SQL = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(action, h, p) AS (VALUES {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)}),
fit AS (SELECT u.page_id, u.host, u.path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM (SELECT DISTINCT host, path, page_id FROM u) u JOIN rules ON (u.host = h OR suffix(u.host, '.' || h)) AND starts_with(u.path, p) GROUP BY ALL),
listed(k) AS (VALUES {", ".join(f"('{h}')" for h in LISTED)}),
bad AS (SELECT DISTINCT host FROM u JOIN listed ON u.host = k OR suffix(u.host, '.' || k))
SELECT u.page_id, u.host, u.path, fit.rule, coalesce(fit.action, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit ON u.page_id IS NOT DISTINCT FROM fit.page_id AND u.host = fit.host AND u.path = fit.path LEFT JOIN bad ON u.host = bad.host
"""
