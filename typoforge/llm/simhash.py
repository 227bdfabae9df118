"""SimHash near-duplicates: 64-bit fingerprints, a binary-trie self-join under a Hamming budget, components.

Fingerprints: A-Z lower-cased, words of non-white-space, 3-word shingles with repeats (fewer words: all of them as one
shingle; none: zero), XXH64 with seed 42, a bit is set when over half of the shingles set it.

Links: distinct fingerprints (exact copies have met already) are dealt into buckets. Two fingerprints within ``budget``
bits agree on at least one of ``budget + 1`` blocks, so each goes to one bucket for each block, keyed by that block's
bits. A bucket over ``BUCKET`` rows is dealt again over the blocks of its free bits: a bucket with f free bits has at
most 2**f fingerprints, so the splitting always ends. In a bucket the trie is walked in node pairs: both nodes
descend together, differing bits add up, and a pair over the budget is pruned. A bucket returns a spanning forest of
its links, not its pairs. Components: alternating large-star and small-star rounds over the forest's edges, until they
settle. Nodes are fingerprints; a component's id is the smallest doc_id of its rows. Fingerprints that a large part of
the rows share are broadcast, not shuffled.

Cases: null and empty text have fingerprint zero and link like any other; rows with a null doc_id link others and get the
component of their fingerprint (null if no row with an id is linked to it); repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored, whatever their names.

:mod:`simhash_docs` runs the same trie join on five-word shingles with a wide budget and an exact check.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_spread, materialize, partitions

BUDGET = 3
#: A bucket with more distinct fingerprints is dealt again.
BUCKET = 1 << 15
#: Rows of buckets that a task gets at most, on average.
TASK_ROWS = 400_000
#: Node pairs that the walk holds at once for one level.
FRONTIER = 1 << 20


def shingles(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``shingle`` words, with repeats; of all words if there are fewer; empty if there are none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    flat = b" ".join(words)
    if len(words) < shingle:
        return np.array([xxh64_intdigest(flat, seed)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    return np.array([xxh64_intdigest(flat[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)


def sign(h: np.ndarray) -> int:
    """The fingerprint of hashes: the bits that over half of them set."""
    n = len(h)
    if n < 2:
        return int(h[0]) if n else 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = n // 255 * 255
    ones = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    return sign(shingles(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp), fp the fingerprint as a signed long. Reads texts a few rows at a time."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _compress(parent: np.ndarray) -> None:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return
        parent[:] = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a[i] and b[i]; parent is kept flat, roots are the smallest members."""
    while len(a):
        ra, rb = parent[a], parent[b]
        keep = ra != rb
        if not keep.any():
            return
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        _compress(parent)


def _pairs(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, most: int):
    """All pairs of rows of node pairs, a few at a time; a node with itself gives each pair once."""
    size = (a1 - a0).astype(np.int64) * (b1 - b0)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        which = np.repeat(np.arange(lo, hi), size[lo:hi])
        off = np.arange(len(which)) - np.repeat(ends[lo:hi] - size[lo:hi] - (ends[lo - 1] if lo else 0), size[lo:hi])
        x, y = a0[which] + off // (b1 - b0)[which], b0[which] + off % (b1 - b0)[which]
        keep = (a0[which] != b0[which]) | (x < y)
        yield x[keep], y[keep]
        lo = hi


def trie_join(group: np.ndarray, fp: np.ndarray, budget: int = BUDGET, frontier: int = FRONTIER, label: np.ndarray | None = None):
    """Rows sorted by (group, fp) -> arrays (x, y) of the pairs of rows of one group within ``budget`` bits.

    A node is a range of rows that share the bits above the level; a pair of nodes holds (a0, a1, b0, b1, d). With
    ``label``, pairs of nodes whose rows all have one label are pruned too, and pairs of one label are left out.
    """
    n = len(fp)
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if n else np.zeros(1, np.int64)
    lo, hi = edges[:-1], edges[1:]
    big = hi - lo > 1
    lo, hi = lo[big].astype(np.int32), hi[big].astype(np.int32)
    todo = [(63, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))] if len(lo) else []
    ones: dict[int, np.ndarray] = {}
    changes = None if label is None else np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))

    def ones_before(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1)))).astype(np.int32)
        return ones[bit]

    def near(x: np.ndarray, y: np.ndarray):
        ok = np.bitwise_count(fp[x] ^ fp[y]) <= budget
        if label is not None:
            ok &= label[x] != label[y]
        return x[ok], y[ok]

    while todo:
        bit, p = todo.pop()
        if p.shape[1] > frontier:
            todo += [(bit, p[:, frontier:]), (bit, p[:, :frontier])]
            continue
        a0, a1, b0, b1, d = p
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            yield near(a0[leaf], b0[leaf])
            p = p[:, ~leaf]
            a0, a1, b0, b1, d = p
        if not p.shape[1]:
            continue
        if bit < 0:  # rows of one fingerprint
            for x, y in _pairs(a0, a1, b0, b1, frontier):
                yield near(x, y)
            continue
        c = ones_before(bit)
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        other = a0 != b0
        down = np.concatenate([
            np.stack([a0, am, b0, bm, d]),
            np.stack([am, a1, bm, b1, d]),
            np.stack([a0, am, bm, b1, d + 1]),
            np.stack([am, a1, b0, bm, d + 1])[:, other],
        ], axis=1)
        a0, a1, b0, b1, d = down
        live = (a1 > a0) & (b1 > b0) & (d <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        if label is not None:
            down = down[:, live]
            a0, a1, b0, b1, d = down
            live = ~((label[a0] == label[b0]) & (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]))
        todo.append((bit - 1, down[:, live]))


def trie_components(group: np.ndarray, fp: np.ndarray, budget: int = BUDGET, frontier: int = FRONTIER) -> np.ndarray:
    """Rows sorted by (group, fp), distinct -> for each row the first row of its component of links in its group."""
    parent = np.arange(len(fp))
    for x, y in trie_join(group, fp, budget, frontier):
        _union(parent, x, y)
    _compress(parent)
    return parent


def _blocks(free: int, parts: int) -> list[int]:
    """The set bits of ``free`` in ``parts`` blocks, as masks."""
    bits = [i for i in range(64) if free >> i & 1]
    cut = [round(len(bits) * k / parts) for k in range(parts + 1)]
    return [sum(1 << i for i in bits[cut[k] : cut[k + 1]]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """Distinct (fp, rep) -> (a, b): edges between reps, a < b, with the links' components and never all pairs."""
    spark = fps.sparkSession
    full = (1 << 64) - 1
    parts = budget + 1

    def deal(df: DataFrame, masks: list[int]) -> DataFrame:
        """masks: those that rows may have now; each row goes on with each block of its free bits."""
        next_of = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(m | b)) for b in _blocks(full & ~m, parts)]))])
        out = df.withColumn("mask", F.explode(F.element_at(next_of, F.col("mask"))))
        return out.withColumn("bucket", F.xxhash64("bucket", "mask", F.col("fp").bitwiseAND(F.col("mask"))))

    masks = [0]
    live = deal(fps.select("fp", "rep", F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("bucket")), masks)
    done: list[DataFrame] = []
    while True:
        masks = sorted({m | b for m in masks for b in _blocks(full & ~m, parts)})
        sizes = live.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
        if all(64 - m.bit_count() <= 15 for m in masks) or sizes.isEmpty():
            break
        sizes = materialize(sizes, "simhash-hot")
        done.append(live.join(sizes, "bucket", "left_anti"))
        live = deal(live.join(sizes.select("bucket"), "bucket", "left_semi"), masks)
    for more in done:
        live = live.unionByName(more)
    rows = live.count()
    n = max(partitions(spark), -(-rows // TASK_ROWS))

    def run(batches):
        import pyarrow as pa

        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        key, fp, rep = (np.concatenate(x) for x in zip(*got, strict=True))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, key))
        key, fp, rep = key[order], fp[order], rep[order]
        root = trie_components(key, fp, budget)
        own = root != np.arange(len(root))
        a, b = rep[own], rep[root[own]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return live.select("bucket", "fp", "rep").repartition(n, "bucket").mapInArrow(run, "a long, b long").where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (id, root): root is the smallest id that can be reached. Large-star and small-star in turn.

    Each round keeps only (node, smaller neighbour) rows; the smallest of a node comes from an aggregate with map-side
    combining, and goes back to the node's edges by a join whose hot partitions adaptive execution splits: the other side
    has a row a node. The rounds end when nothing changes: a few more than the logarithm of the longest path.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "cc")
    mark = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v"), F.col("m").alias("u")).where("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        # a node has few smaller neighbours left
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("u < v").distinct()
        after = materialize(small, "cc")
        new = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(now)
        now = after
        if new == mark:
            return now.select(F.col("v").alias("id"), F.col("u").alias("root"))
        mark = new


def near_duplicates(docs: DataFrame, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text) -> doc_id, fp, component_id."""
    fps = materialize(fingerprints(docs), "simhash-fp")
    one = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-one")
    roots = components(links(one.select("fp", F.col("fp").alias("rep")), budget, bucket))
    label = one.join(roots, F.col("fp") == F.col("id"), "left").select("fp", "n", "low", F.coalesce("root", "fp").alias("root"))
    linked = materialize(label, "simhash-roots")
    first = linked.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("size"))
    label = join_spread(linked.select("fp", "n", "root"), first, "root", "size", linked.count()).select("fp", "n", "component_id")
    return join_spread(fps, materialize(label, "simhash-label"), "fp", "n", fps.count()).select("doc_id", "fp", "component_id")


def op3(spark, sf_dir) -> DataFrame:
    from .common import read

    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
