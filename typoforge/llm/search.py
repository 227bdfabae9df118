"""Exact top-k search: BM25 over an inverted index with block-max WAND pruning, by shard, merged with global statistics.

Score of a document: the sum over the query's distinct words of idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)),
with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); N, df and avgdl are those of all documents, so scores of shards compare.

Index: a shard lines its documents up, those with words in common as neighbours. The posting list of a word is cut where
blocks of ``BLOCK`` documents end; each piece has its largest part of a score and its place, so all words have block maxima.

Search: the maxima of a block's pieces, times idf, add up to the bound of its documents. Pivots are the blocks of the
highest bounds, ``WAVE`` at first: cursors go to their postings, whatever lies between is skipped, and the k-th best score
rises. Then come the blocks whose bounds still reach it, four times as many, and so on until none does. Where most blocks
do, as for queries of hundreds of words, their bounds are made sharp: words in many documents have a row of parts beside
their list, rows are added up for many queries at once in single precision and other words by their lists, which gives each
score but for rounding (``SLACK``). Pivots are then the documents that may be among the k best by these. All scores are sums
in double precision over a pivot's postings in the order of the query's words, and nothing else is dropped: the result is
exact, and equal texts have equal scores in whatever shard.

Queries are rows of a table, packed in blocks of some hundred with one list of their words; equal queries are neighbours
and searched for once. Each block goes to every shard, one after the other (a query set against all rows, in blocks): a
task holds one shard's index and one block of queries. A shard's size is a parameter, not a share of the input.

Shards are searched in waves: ``FIRST`` shards, then as many as before them, and so on, but no more than the queries' copies
may take on disk (``COPIES`` times the texts). After a wave each query has its best so far; their last score goes with the
query to the next one, where only documents that reach it are looked for and returned. The shuffle of a wave is deleted with
it, so disk does not grow with the number of shards, nor do the rows returned, but for a step a doubling.

Ties go to the smaller id. Cases: null and empty texts match nothing and, as queries, find nothing; null doc_ids are not
searched for nor found; repeated rows are all found; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, give_back, materialize, partitions
from .substring import pack, unpack

K1, B, TOP = 1.2, 0.75, 10
BLOCK, WAVE = 64, 8
#: Where more than this part of the blocks are still pivots, bounds are made sharp.
DENSE = 0.4
#: Words that have a row, at most; they are in one of OFTEN documents of the shard at least. Queries whose rows are added up at once.
ROWS, OFTEN, TOGETHER = 400, 32, 128
#: More than the rounding of sums in single precision over ROWS words, as a part of the sum; of block maxima.
SLACK, ROUNDED = 1e-4, 1e-6
#: Documents and words that a shard has at most, on average.
SHARD_DOCS, SHARD_WORDS = 16_000, 12_000_000
#: Queries and words of a block of queries.
PACK, PACK_WORDS = 256, 100_000
#: Shards of the first wave; bytes of the queries' copies in a wave, as a part of the texts' bytes.
FIRST, COPIES = 4, 1.5
#: Distinct words that a task counts before it sends the counts on.
HELD = 300_000
FLOORS = "array<struct<id:long,score:double>>"
#: A search task gets documents and blocks of queries in batches of some 4 MB: as one batch, the queries of all blocks lay twice in memory.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _counts(batches):
    """Texts -> (word, documents with it); the empty word carries the number of documents and of words."""
    import pyarrow as pa

    df: Counter = Counter()
    docs = total = 0

    def rows():
        keys = list(df)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([df[k] for k in keys], pa.int64()), pa.array([0] * len(keys), pa.int64())], names=["word", "n", "total"])

    for b in batches:
        for t in b.column(0):
            w = words(t.as_py())
            docs, total = docs + 1, total + len(w)
            df.update(set(w))
            if len(df) > HELD:
                yield rows()
                df.clear()
    yield rows()
    yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], names=["word", "n", "total"])


def _distinct_words(batches):
    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, 64):
            ids, ws = [], []
            for i, t in zip(b.column(0)[at : at + 64].to_pylist(), b.column(1)[at : at + 64].to_pylist(), strict=True):
                w = set(words(t))
                ids += [i] * len(w)
                ws += w
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ws, pa.binary())], names=["id", "word"])


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1], and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Index:
    """One shard. ``add`` documents, ``close``, then ``search``."""

    def __init__(self, n: int, avgdl: float):
        self.n, self.avgdl = n, max(avgdl, 1e-9)
        self.number: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.length: list[int] = []
        self.size: list[int] = []
        self.kind: list[int] = []
        self.word, self.count = array("i"), array("i")
        self.ready = False

    def add(self, doc_id: int, text: str | None) -> None:
        w = words(text)
        c = Counter(w)
        number = self.number
        self.word.extend([number.setdefault(x, len(number)) for x in c])
        self.count.extend(c.values())
        self.size.append(len(c))
        self.ids.append(doc_id)
        self.length.append(len(w))
        self.kind.append(min(map(zlib.crc32, c), default=0) & 0xFFFFFFFF)

    def close(self) -> None:
        """Documents are lined up so that those with words in common are neighbours, then by length."""
        ids, length = np.array(self.ids, np.int64), np.array(self.length, np.int64)
        place = np.lexsort((ids, length, np.array(self.kind, np.int64)))
        self.id = ids[place]
        length = length[place]
        rank = np.empty(len(place), np.int64)
        rank[place] = np.arange(len(place))
        bits = len(place).bit_length()
        key = np.asarray(self.word).astype(np.int64) << bits
        key |= np.repeat(rank, self.size)
        order = np.argsort(key)  # each pair of word and document is there once
        count = np.asarray(self.count)[order]
        self.word, self.count = array("i"), array("i")
        key = key[order]
        del order
        word = (key >> bits).astype(np.int32)
        key &= (1 << bits) - 1
        self.doc = key.astype(np.int32)
        del key
        self.offset = (self.doc % BLOCK).astype(np.uint8)
        self.part = count * (K1 + 1)  # over (count + norm): what idf is multiplied by
        self.norm = K1 * (1 - B + B * length / self.avgdl)
        norm = self.norm[self.doc]
        norm += count
        self.part /= norm
        del norm
        block = self.doc // BLOCK
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        self.blocks = -(-len(self.id) // BLOCK)
        self.block = block[first].astype(np.uint16 if self.blocks < 1 << 16 else np.int32)
        del block, new
        self.cut = np.searchsorted(word[first], np.arange(len(self.number) + 1))
        self.start = np.append(first, len(word)).astype(np.int32 if len(word) < 1 << 31 else np.int64)
        del word
        self.most = (np.maximum.reduceat(self.part, first) if len(first) else np.zeros(0)).astype(np.float32)
        del first
        docs = np.diff(self.start[self.cut])
        often = np.flatnonzero(docs >= max(1, len(self.id) / OFTEN))
        often = often[np.argsort(-docs[often], kind="stable")[:ROWS]]
        self.row = np.full(len(docs), -1, np.int32)
        self.row[often] = np.arange(len(often), dtype=np.int32)
        self.rows = np.zeros((len(often), self.blocks * BLOCK), np.float32)
        self.most_of = np.zeros((len(often), self.blocks))  # block maxima of words with a row
        self.counts = np.zeros(self.rows.shape, np.uint16 if count.max(initial=0) < 1 << 16 else np.int32)
        for at, w in enumerate(often.tolist()):
            x, y = self.start[self.cut[w]], self.start[self.cut[w + 1]]
            self.rows[at, self.doc[x:y]] = self.part[x:y]
            piece = slice(self.cut[w], self.cut[w + 1])
            self.most_of[at, self.block[piece]] = self.most[piece]
            self.counts[at, self.doc[x:y]] = count[x:y]
        self.ready = True

    def search(self, query: np.ndarray, idf: np.ndarray, top: int = TOP, floor: float = 0.0, often: Callable[[], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words and their idf -> ids and scores of the best, by (score, id); only scores from ``floor`` on.

        often: gives the sums of the rows of the query's words, where they were made with those of other queries.
        """
        row = self.row[query]
        common = np.flatnonzero(row >= 0)
        least = idf[common] @ self.most_of[row[common]] * (1 - ROUNDED)
        if floor > 0 and np.count_nonzero(least >= floor) > self.blocks * DENSE:  # the bounds, but for other words: they only grow
            return self._best(*self._sharp(query, idf, top, floor, often), floor, top)
        size = self.cut[query + 1] - self.cut[query]
        entry, weight = _spread(self.cut[query], size), np.repeat(idf, size)
        block = self.block[entry]
        # the sum of a block's maxima bounds the scores in it; a little more, as sums are rounded
        bound = np.bincount(block, weights=self.most[entry] * weight, minlength=self.blocks) * (1 + ROUNDED)
        live = np.argsort(-bound, kind="stable")
        live = live[(bound[live] > 0) & (bound[live] >= floor)]
        best_id, best, take = np.zeros(0, np.int64), np.zeros(0), WAVE
        slot = np.full(self.blocks, -1, np.int32)
        while len(live):
            low = best[-1] if len(best) == top else floor
            if (take > WAVE or floor > 0) and len(live) > self.blocks * DENSE:
                rank, score = self._sharp(query, idf, top, low, often)
                open_ = np.zeros(self.blocks, bool)
                open_[live] = True
                keep = open_[rank // BLOCK]
                rank, score, live = rank[keep], score[keep], live[:0]
            else:
                # pivots: the blocks of the highest bounds; cursors go to their postings and skip the others
                now, live = live[:take], live[take:]
                slot[now] = np.arange(len(now), dtype=np.int32) * BLOCK
                at = slot[block]
                on = np.flatnonzero(at >= 0)
                e = entry[on]
                size = self.start[e + 1] - self.start[e]
                post = _spread(self.start[e], size)
                score = np.bincount(np.repeat(at[on], size) + self.offset[post], weights=self.part[post] * np.repeat(weight[on], size), minlength=len(now) * BLOCK)
                slot[now] = -1
                hit = np.flatnonzero(score > 0)
                rank, score = now[hit // BLOCK] * BLOCK + hit % BLOCK, score[hit]
            best_id, best = self._best(rank, score, low, top, best_id, best)
            if len(best) == top:
                live = live[: np.searchsorted(-bound[live], -best[-1], "right")]  # bounds fall
            take *= 4
        return best_id, best

    def _best(self, rank: np.ndarray, score: np.ndarray, low: float, top: int, best_id: np.ndarray | None = None, best: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best of places that reach ``low`` and those found so far."""
        keep = score >= low
        rank, score = rank[keep], score[keep]
        if (best is None or len(best) < top) and len(score) > top:  # the best and all ties of the last of them
            keep = score >= np.partition(score, len(score) - top)[len(score) - top]
            rank, score = rank[keep], score[keep]
        found = self.id[rank]
        if best is not None:
            found, score = np.concatenate((best_id, found)), np.concatenate((best, score))
        order = np.lexsort((found, -score))[:top]
        return found[order], score[order]

    def _sharp(self, query: np.ndarray, idf: np.ndarray, top: int, low: float, often: Callable[[], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that may be among the best and reach ``low``."""
        row = self.row[query]
        rare, common = np.flatnonzero(row < 0), np.flatnonzero(row >= 0)
        first = self.start[self.cut[query[rare]]]
        size = self.start[self.cut[query[rare] + 1]] - first
        post = _spread(first, size)
        doc, part = self.doc[post], self.part[post]
        part *= np.repeat(idf[rare], size)
        near = np.bincount(doc, weights=part, minlength=self.blocks * BLOCK)
        near = near + (often() if often else idf[common].astype(np.float32) @ self.rows[row[common]])
        least = np.partition(near, len(near) - top)[len(near) - top] * (1 - SLACK) if len(near) > top else 0.0
        hit = np.flatnonzero((near > 0) & (near * (1 + SLACK) >= max(low, least)))
        # pivots: their postings, in the order of the query's words
        here = np.zeros(len(near), bool)
        here[hit] = True
        on = np.flatnonzero(here[doc])
        count = self.counts[np.ix_(row[common], hit)]
        w, at = np.nonzero(count)
        count = count[w, at]
        part = np.concatenate((part[on], count * (K1 + 1) / (count + self.norm[hit[at]]) * idf[common[w]]))
        order = np.argsort(np.concatenate((np.repeat(rare, size)[on], common[w])), kind="stable")
        score = np.bincount(np.concatenate((np.searchsorted(hit, doc[on]), at))[order], weights=part[order], minlength=len(hit))
        return hit, score.astype(np.float64, copy=False)  # of nothing, counts are whole numbers


def _search(n: int, avgdl: float, top: int):
    def run(batches):
        index = Index(n, avgdl)
        b = kind = ids = texts = blobs = floors = None
        for b in batches:
            for at in range(0, b.num_rows, 64):
                kind, ids, texts, blobs, floors = (b.column(k)[at : at + 64] for k in ("kind", "id", "text", "queries", "floors"))
                for k, i, text, blob, floor in zip(kind, ids, texts, blobs, floors, strict=True):
                    if k.as_py() == 0:
                        index.add(i.as_py(), text.as_py())
                        continue
                    if not index.ready:
                        index.close()
                    yield answers(index, blob.as_py(), {x["id"]: x["score"] for x in floor.as_py() or ()})
        del index, b, kind, ids, texts, blobs, floors
        give_back()

    def answers(index: Index, blob: bytes, floors: dict[int, float]):
        import pyarrow as pa

        ids, ends, refs, df, words_of, cut = unpack(blob)
        raw, cut = words_of.tobytes(), cut.tolist()
        number = np.array([index.number.get(raw[x:y], -1) for x, y in zip([0, *cut[:-1]], cut, strict=True)], np.int64)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        found, size = [], []
        spans = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        sums: dict[int, np.ndarray] = {}

        def often(q: int) -> np.ndarray:
            at = q - q % TOGETHER
            if at not in sums:
                sums.clear()
                some = spans[at : at + TOGETHER]
                weight = np.zeros((len(some), len(index.rows)), np.float32)
                for w, (x, y) in zip(weight, some, strict=True):
                    mine = refs[x:y]
                    mine = mine[number[mine] >= 0]
                    row = index.row[number[mine]]
                    w[row[row >= 0]] = idf[mine[row >= 0]]
                sums[at] = weight @ index.rows
            return sums[at][q - at]

        for q, (i, (x, y)) in enumerate(zip(ids.tolist(), spans, strict=True)):
            mine = refs[x:y]
            key = mine.tobytes()  # equal queries have one floor
            if key not in known:
                mine = mine[number[mine] >= 0]
                known[key] = index.search(number[mine], idf[mine], top, floors.get(i, 0.0), partial(often, q))
            found.append(known[key])
            size.append(len(known[key][0]))
        cols = [np.repeat(ids, size), *(np.concatenate(x) for x in zip(*found, strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "doc_id", "score"])

    return run


def _packed(batches):
    """Rows (id, pairs of df and word, sorted) -> blocks of queries, and their ids: ids, ends of their words, words by place, df, words."""
    import pyarrow as pa

    ids: list[int] = []
    ends: list[int] = []
    refs: list[int] = []
    place: dict[bytes, int] = {}
    df: list[int] = []

    def block():
        every = list(place)
        cut = np.cumsum(np.fromiter(map(len, every), np.int64, len(every)))
        blob = pack(np.array(ids, np.int64), np.array(ends, np.int64), np.array(refs, np.int32), np.array(df, np.float64), np.frombuffer(b"".join(every), np.uint8), cut)
        row = pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["queries", "ids"])
        for x in (ids, ends, refs, place, df):
            x.clear()
        return row

    for b in batches:
        for i, pairs in zip(b.column(0), b.column(1), strict=True):
            ids.append(i.as_py())
            for x in pairs.as_py():
                if x["word"] not in place:
                    place[x["word"]] = len(place)
                    df.append(x["df"])
                refs.append(place[x["word"]])
            ends.append(len(refs))
            if len(ids) >= PACK or len(refs) >= PACK_WORDS:
                yield block()
    if ids:
        yield block()


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS, first: int = FIRST, copies: float = COPIES) -> DataFrame:
    """(doc_id, text), (query_id, text) -> query_id, rank, doc_id, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    counts = materialize(docs.select("text").mapInArrow(_counts, "word binary, n long, total long").groupBy("word").agg(F.sum("n").alias("df"), F.sum("total").alias("total")), "search-df")
    whole = counts.where(F.octet_length("word") == 0).first()
    n, total = (whole["df"], whole["total"]) if whole else (0, 0)
    shards = max(1, -(-n // shard_docs), -(-total // shard_words))
    asked = queries.select(F.col("query_id").cast("long").alias("id"), "text").where("id is not null").mapInArrow(_distinct_words, "id long, word binary")
    asked = asked.join(counts.select("word", "df"), "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("pairs"))
    asked = asked.repartition(partitions(docs.sparkSession), F.xxhash64("pairs")).sortWithinPartitions(F.xxhash64("pairs"), "id")
    blocks = materialize(asked.mapInArrow(_packed, "queries binary, ids array<long>").withColumn("block", F.monotonically_increasing_id()), "search-queries")
    size = blocks.agg(F.sum(F.octet_length("queries"))).first()[0] or 0
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = max(1, int(copies * bytes_ / max(size, 1)))
    of_block = blocks.select("block", F.explode("ids").alias("query_id"))
    blocks = blocks.drop("ids")
    own = docs.select(F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "text", F.lit(None).cast("binary").alias("queries"), F.lit(None).cast(FLOORS).alias("floors"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    best, lo = None, 0
    while lo < shards:
        hi = min(shards, lo + min(most, max(first, lo)))
        if best is None:
            asked = blocks.withColumn("floors", F.lit(None).cast(FLOORS))
        else:  # the last of the best so far
            floors = best.where(F.col("rank") == top).select("query_id", "score").join(of_block, "query_id")
            floors = floors.groupBy("block").agg(F.collect_list(F.struct(F.col("query_id").alias("id"), "score")).alias("floors"))
            asked = blocks.join(floors, "block", "left")
        every = asked.select(F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "queries", "floors")
        mine = own.where(F.col("shard").between(lo, hi - 1)) if hi - lo < shards else own
        dealt = mine.unionByName(every).withColumn("shard", F.col("shard") - lo).repartitionById(hi - lo, "shard").sortWithinPartitions("kind", "id")
        found = dealt.mapInArrow(_search(n, total / n if n else 0.0, top), "query_id long, doc_id long, score double")
        found = found if best is None else found.unionByName(best.drop("rank"))
        was, best = best, materialize(found.withColumn("rank", rank).where(F.col("rank") <= top), "search-best", BATCHES)
        if was is not None:
            discard(was)
        lo = hi
    return best.select("query_id", "rank", "doc_id", "score")


def op5(spark, sf_dir) -> DataFrame:
    from .common import read

    docs = read(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"))
