"""Suffix-array dedup: remove each byte covered by a string of ``LENGTH`` bytes that also starts earlier in the corpus.

Sharding that keeps equal strings together: a window of 100 bytes is named by the least hash of its 16-byte grams, and
consecutive windows with one name form a segment; equal windows have equal names, so each name's segments can be sorted
alone. Steps:

1. ``_names``: map over texts -> lists of segment names, by name shard.
2. ``_repeated``: by name shard -> the segments whose name occurs again; a name that occurs once holds no repeat.
3. ``_cut``: texts by chunk with the answers of 2 -> bytes of those segments, equal segments of a chunk collapsed to the
   earliest. Hot names go on window by window, named by the whole window, so that a line that many documents hold is
   spread by its surroundings.
4. ``_sort``: by segment shard -> suffix and common-prefix arrays of the distinct segments (external induced sorting,
   :mod:`esort`), of names that have several; in each run of suffixes with 100 common bytes all windows but the earliest are removed.
5. ``_apply``: texts by chunk with the removed spans -> results.

Hot names have ``HOT`` occurrences, or one of ``HOT_NAMES`` of all if that is more, so there are at most as many. They are
counted twice: step 1 adds up those that occur four times in a batch of lists, which finds what one document in five hundred
holds, before anything is dealt; step 2 has all occurrences of the others of a shard and counts them exactly, before texts
are dealt. Only lists of numbers and the segments that may repeat move in 1 to 4; the list of hot names goes to all tasks. Queues of the sort spill to a scratch file of the task, as Spark's own sorts do; what passes
between tasks goes through shuffles and tables in the shared folder.

Cases: null text is empty; texts under 100 bytes stay whole; null doc_ids come after all others, the largest id included; rows with one doc_id and
different texts are different documents, ordered by a hash of the text; repeated rows (same id and text) are one document
and get the same result; an empty table gives an empty result; columns besides doc_id and text are carried or ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import esort
from .common import give_back, materialize

LENGTH, GRAM = 100, 16
#: Bytes of text in a chunk, behind a name shard, and of segments in a sorting shard, on average.
CHUNK, NAME_SHARD, SORT_SHARD = 4 << 20, 16 << 20, 2 << 20
#: Bytes of text that a task looks at in one go.
BATCH = 1 << 19
#: See above; hot names take 16 MB at most.
HOT, LOCAL, HOT_NAMES = 20_000, 4, 2_000_000
_LAST = np.iinfo(np.int64).max
#: Set in the hash of texts without id, whose id is read as _LAST.
_NO_ID = 1 << 62


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(arrays), *[len(a) for a in arrays]], np.int64)
    kinds = b"".join(a.dtype.str.encode().ljust(4) for a in arrays)
    return zstandard.compress(head.tobytes() + kinds + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at, out = 8 * (n + 1) + 4 * n, []
    for i, size in enumerate(sizes.tolist()):
        kind = np.dtype(raw[8 * (n + 1) + 4 * i :][:4].strip().decode())
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Whole texts -> doc, start, windows, name, again (the name occurs twice in the segment), in text order."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(size)))
    n = int(starts[-1])
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    buf = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    eight = np.ndarray((n - 7,), "<u8", buf, 0, (1,)).copy()
    h = eight[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    h += (eight[8:] ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    m, have, want = h, 1, LENGTH - GRAM + 1
    while have < want:
        step = min(have, want - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    long = np.flatnonzero(size >= LENGTH)
    ok = np.zeros(n + 1, np.int8)
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, starts[long] + size[long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(ok)[: len(m)])
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    name = m[at]
    first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1))))
    last = np.append(first[1:], len(at)) - 1
    seen = np.concatenate(([0], np.cumsum(h[at] == name)))
    doc = np.searchsorted(starts, at[first], "right") - 1
    # of texts that start at one place, the last is found: those before it have no bytes
    return doc, at[first] - starts[doc], last - first + 1, name[first], seen[last] > seen[first]


def _batches(texts: list[bytes]):
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (held == 0 or held + len(texts[end]) <= BATCH):
            held += len(texts[end])
            end += 1
        yield at, end
        at = end


def _bytes(column) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _names(shards: int):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("shard", pa.int32()), ("name", pa.int64()), ("n", pa.int64()), ("list", pa.binary())])
        for b in batches:
            rows = []
            for at in range(0, b.num_rows, 2048):
                c = b.slice(at, 2048)
                texts = _bytes(c.column("text"))
                got = []
                for lo, hi in _batches(texts):
                    doc, _, _, name, again = segments(texts[lo:hi])
                    first = np.searchsorted(doc, doc)  # place of each document's first segment
                    got.append((doc + lo, np.arange(len(doc)) - first, name, again))
                doc, nth, name, again = (np.concatenate(x) for x in zip(*got, strict=True)) if got else [np.zeros(0, np.int64)] * 4
                often, count = np.unique(name, return_counts=True)
                rows += [(-1, int(v.astype(np.int64)), int(k), None) for v, k in zip(often[count >= LOCAL], count[count >= LOCAL], strict=True)]
                ids, hs, chunks = (np.asarray(c.column(k)) for k in ("__id", "__h", "__chunk"))
                part = ((name >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cut)).tolist():
                    o = order[cut[s] : cut[s + 1]]
                    docs, place = np.unique(doc[o], return_inverse=True)
                    rows.append((s, None, None, pack(name[o], place.astype(np.uint32), (nth[o] * 2 + again[o]).astype(np.uint32), ids[docs], hs[docs], chunks[docs])))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _without(hot: np.ndarray):
    """Takes hot names out of the lists before they are dealt."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for blob in b.column(1).to_pylist():
                name, place, nth, ids, hs, chunks = unpack(blob)
                if len(hot):
                    keep = ~np.isin(name, hot)
                    if not keep.all():
                        blob = pack(name[keep], place[keep], nth[keep], ids, hs, chunks)
                out.append(blob)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["shard", "list"])

    return run


def _stack(blobs: list[list[np.ndarray]], at: int, docs: int) -> list[np.ndarray]:
    """Joins blobs whose arrays are: some by entry, the one at ``at`` the place of its document, then ``docs`` by document."""
    base, out = 0, []
    for b in blobs:
        b = list(b)
        b[at] = b[at].astype(np.int64) + base
        base += len(b[-1]) if docs else 0
        out.append(b)
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _repeated(hot: int):
    def run(table):
        return repeated_names(table, hot)

    return run


def repeated_names(table, hot: int):
    """Lists of one shard -> (chunk, list of segments whose name occurs again); hot names come as a list with chunk -1."""
    import pyarrow as pa

    schema = pa.schema([("chunk", pa.int32()), ("n", pa.int64()), ("list", pa.binary())])
    rows = []
    if table.num_rows:
        name, place, nth, ids, hs, chunks = _stack([unpack(x) for x in table.column("list").to_pylist()], 1, 3)
        order = np.argsort(name)
        s = name[order]
        twin = np.zeros(len(s), bool)
        same = s[1:] == s[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        count = np.diff(np.append(first, len(s)))
        burning = count >= hot
        if burning.any():
            rows.append((-1, 0, pack(s[first[burning]])))
        keep = np.zeros(len(s), bool)
        keep[order] = twin
        keep |= (nth & 1).astype(bool)
        keep[order] &= ~np.repeat(burning, count)
        place, nth = place[keep], nth[keep] >> 1
        to = chunks[place]
        order = np.argsort(to, kind="stable")
        place, nth, to = place[order], nth[order], to[order]
        cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))) if len(to) else []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            docs, at = np.unique(place[a:b], return_inverse=True)
            rows.append((int(to[a]), int(b - a), pack(at.astype(np.uint32), nth[a:b].astype(np.uint32), ids[docs], hs[docs])))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _packed(batches):
    """Texts of a batch by chunk -> (chunk, list of ids, hashes, sizes and bytes), so that shuffles move them compressed."""
    import pyarrow as pa

    for b in (x.slice(at, 2048) for x in batches for at in range(0, x.num_rows, 2048)):
        ids, hs, chunk = (np.asarray(b.column(k)) for k in ("__id", "__h", "__chunk"))
        texts = _bytes(b.column("text"))
        order = np.argsort(chunk, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(chunk[order]) != 0, [True]))) if len(order) else []
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            mine = order[x:y]
            parts = [texts[i] for i in mine.tolist()]
            blob = pack(ids[mine], hs[mine], np.fromiter(map(len, parts), np.int64, len(parts)), np.frombuffer(b"".join(parts), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([int(chunk[mine[0]])], pa.int32()), pa.array([blob], pa.binary())], names=["__chunk", "texts"])


def _documents(table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Rows with texts, or packed ones."""
    if "text" in table.column_names:
        return np.asarray(table.column("__id")), np.asarray(table.column("__h")), _bytes(table.column("text"))
    ids, hs, texts = [], [], []
    for blob in table.column("texts").to_pylist():
        i, h, size, raw = unpack(blob)
        ids.append(i), hs.append(h)
        end, whole = np.cumsum(size).tolist(), raw.tobytes()
        texts += [whole[a:b] for a, b in zip([0, *end[:-1]], end, strict=True)]
    return np.concatenate(ids), np.concatenate(hs), texts


def _spans_by_chunk(chunk: np.ndarray, ids: np.ndarray, hs: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(chunk, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], np.diff(chunk[order]) != 0, [True]))) if len(order) else []
    return [(int(chunk[order[x]]), pack(*[v[order[x:y]] for v in (ids, hs, a, b)])) for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _cut(hot: np.ndarray, shards: int):
    def run(left, right):
        import pyarrow as pa
        from xxhash import xxh3_128_digest, xxh64_intdigest

        schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("list", pa.binary())])
        rows = []
        if left.num_rows:
            ids, hs, texts = _documents(left)
            chunk = left.column("__chunk")[0].as_py()
            order = np.lexsort((hs, ids))
            order = order[np.concatenate(([True], (np.diff(ids[order]) != 0) | (np.diff(hs[order]) != 0)))]
            ids, hs, texts = ids[order], hs[order], [texts[i] for i in order]
            if right.num_rows:
                at, nth, rid, rh = _stack([unpack(x) for x in right.column("list").to_pylist()], 0, 2)
                where = {k: i for i, k in enumerate(zip(ids.tolist(), hs.tolist(), strict=True))}
                of = np.array([where.get(k, -1) for k in zip(rid.tolist(), rh.tolist(), strict=True)], np.int64)
                asked = np.unique(of[at] * (1 << 32) + nth)
            else:
                asked = np.zeros(0, np.int64)
            earliest: dict[tuple, int] = {}
            kept, removed = [], []  # (document, start, windows, name, bytes, name occurs twice); (document, from, to)
            for lo, hi in _batches(texts):
                doc, start, windows, name, again = segments(texts[lo:hi])
                nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
                code = (doc + lo) * (1 << 32) + nth
                is_hot = np.isin(name, hot) if len(hot) else np.zeros(len(name), bool)
                pick = np.flatnonzero(np.isin(code, asked) | is_hot)
                for d, s, w, v, burning, twice in zip((doc[pick] + lo).tolist(), start[pick].tolist(), windows[pick].tolist(), name[pick].tolist(), is_hot[pick].tolist(), again[pick].tolist(), strict=True):
                    raw = texts[d][s : s + w + LENGTH - 1]
                    key = (v, xxh3_128_digest(raw))
                    if key in earliest:  # documents come in order, so the first one is the earliest
                        removed.append((d, s, s + len(raw)))
                        continue
                    earliest[key] = d
                    if burning:
                        for k in range(w):
                            one = raw[k : k + LENGTH]
                            if (one,) in earliest:
                                removed.append((d, s + k, s + k + LENGTH))
                            else:
                                earliest[(one,)] = d
                                kept.append((d, s + k, 1, xxh64_intdigest(one), one, False))
                    else:
                        kept.append((d, s, w, v, raw, twice))
            if removed:
                d, a, b = np.array(removed, np.int64).T
                rows.append((chunk % shards, chunk, pack(ids[d], hs[d], a, b)))
            if kept:
                part = np.array([(k[3] >> 13) % shards for k in kept], np.int64)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cut)).tolist():
                    mine = [kept[i] for i in order[cut[s] : cut[s + 1]].tolist()]
                    d = np.array([k[0] for k in mine], np.int64)
                    rows.append((s, None, pack(ids[d], hs[d], np.full(len(d), chunk, np.int32), np.array([k[1] for k in mine], np.int64), np.array([k[2] for k in mine], np.int32), np.array([k[3] for k in mine], np.uint64), np.array([k[5] for k in mine], np.uint8), np.frombuffer(b"".join(k[4] for k in mine), np.uint8))))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def repeats(ids: np.ndarray, hs: np.ndarray, start: np.ndarray, windows: np.ndarray, name: np.ndarray, again: np.ndarray, raw: list[bytes], limit: int = esort.QUEUE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments -> (segment, from, to): runs of bytes covered by windows that also start earlier in some segment.

    Equal windows have one name, so a segment that is the only one of its name, but for its equals, and has the name once
    holds no other repeat: such segments, most of exact copies, are not sorted.
    """
    from xxhash import xxh3_128_digest

    digest = np.frombuffer(b"".join(map(xxh3_128_digest, raw)), np.uint64).reshape(-1, 2)
    order = np.lexsort((start, hs, ids, digest[:, 1], digest[:, 0]))
    g = digest[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]).any(axis=1)))
    lead = order[new][np.cumsum(new) - 1]  # the earliest of each row's equals
    later = order[(ids[order] != ids[lead]) | (hs[order] != hs[lead]) | (start[order] != start[lead])]
    out = [(later, start[later], start[later] + windows[later] + LENGTH - 1)]
    reps = np.sort(order[new])
    _, which, count = np.unique(name[reps], return_inverse=True, return_counts=True)
    reps = reps[(count[which] > 1) | (again[reps] > 0)]
    if not len(reps):
        return out[0]
    text, at = esort.join_texts([raw[i] for i in reps.tolist()])
    sa, lcp = esort.suffix_array(text, limit)
    which = np.searchsorted(at, sa, "right") - 1
    off = sa - at[which]
    valid = (which >= 0) & (off < windows[reps][which])
    # runs of equal windows; a window's text holds no separator, so others never stand between equal ones
    run = np.cumsum(lcp < LENGTH)
    sa, which, off, run = sa[valid], which[valid], off[valid], run[valid]
    if len(sa):
        age = np.lexsort((hs[reps], ids[reps]))
        a, b = ids[reps][age], hs[reps][age]
        rank = np.empty(len(reps), np.int64)
        rank[age] = np.cumsum(np.concatenate(([0], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        key = (rank[which] << 40) + start[reps][which] + off
        first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        best = np.repeat(np.minimum.reduceat(key, first), np.diff(np.append(first, len(key))))
        gone = np.sort(sa[key > best])
        if len(gone):
            of = np.searchsorted(at, gone, "right") - 1
            head = np.flatnonzero(np.concatenate(([True], (gone[1:] != gone[:-1] + 1) | (of[1:] != of[:-1]))))
            tail = np.append(head[1:], len(gone)) - 1
            seg = reps[of[head]]
            out.append((seg, start[seg] + gone[head] - at[of[head]], start[seg] + gone[tail] - at[of[tail]] + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sort(table):
    import pyarrow as pa

    schema = pa.schema([("chunk", pa.int32()), ("spans", pa.binary())])
    rows, ids, hs, chunks, start, windows, name, again, raw = [], [], [], [], [], [], [], [], []
    for chunk, blob in zip(table.column("chunk").to_pylist(), table.column("list").to_pylist(), strict=True):
        if chunk is not None:  # spans found in step 3 pass through
            rows.append((chunk, blob))
            continue
        i, h, c, s, w, v, a, b = unpack(blob)
        ids.append(i), hs.append(h), chunks.append(c), start.append(s), windows.append(w.astype(np.int64)), name.append(v), again.append(a)
        end = np.cumsum(w.astype(np.int64) + LENGTH - 1)
        whole = b.tobytes()
        raw += [whole[x:y] for x, y in zip((end - w - LENGTH + 1).tolist(), end.tolist(), strict=True)]
    if raw:
        ids, hs, chunks, start, windows, name, again = (np.concatenate(x) for x in (ids, hs, chunks, start, windows, name, again))
        seg, a, b = repeats(ids, hs, start, windows, name, again, raw)
        rows += _spans_by_chunk(chunks[seg], ids[seg], hs[seg], a, b)
        del ids, hs, chunks, start, windows, name, again, raw
        give_back()
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def kept(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """Remaining bytes, removed bytes and maximal removed runs; spans sorted."""
    out, at, runs = [], 0, 0
    end = -1
    for a, b in spans:
        if a > end:
            out.append(raw[at:a])
            runs += 1
        end = max(end, b)
        at = end
    out.append(raw[at:])
    left = b"".join(out)
    return left, len(raw) - len(left), runs


def _apply(columns: list[str] | None = None, text_at: str = "", n_chars: str | None = None):
    """The last step: those columns of the input, with the remaining text, or else the digest columns."""

    def run(left, right):
        import pyarrow as pa

        ids, hs, raw = _documents(left)
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if right.num_rows:
            i, h, a, b = (np.concatenate(x) for x in zip(*[unpack(x) for x in right.column("spans").to_pylist()], strict=True))
            order = np.lexsort((b, a, h, i))
            for k, s in zip(zip(i[order].tolist(), h[order].tolist(), strict=True), zip(a[order].tolist(), b[order].tolist(), strict=True), strict=True):
                spans.setdefault(k, []).append(s)
        got = [kept(r, spans.get(k, [])) for r, k in zip(raw, zip(ids.tolist(), hs.tolist(), strict=True), strict=True)]
        if columns:
            text = [x[0].decode("utf-8", "ignore") if x[1] else old for x, old in zip(got, left.column("text").to_pylist(), strict=True)]
            cols = {c: left.column(c) for c in columns} | {text_at: pa.array(text, pa.string())}
            if n_chars:
                cols[n_chars] = pa.array([None if t is None else len(t) for t in text], pa.int64()).cast(left.column(n_chars).type)
            return pa.table({c: cols[c] for c in columns})
        doc_id = pa.array(ids, pa.int64(), mask=(hs & _NO_ID) != 0)
        return pa.table({"doc_id": doc_id, "n_bytes": pa.array([len(r) for r in raw], pa.int64()), "n_removed": pa.array([x[1] for x in got], pa.int64()), "n_spans": pa.array([x[2] for x in got], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x[0]).hexdigest() for x in got], pa.string())})

    return run


def _hot_names(lists: DataFrame, hot: int) -> np.ndarray:
    """Names that many batches of lists have in plenty."""
    heavy = lists.where("shard < 0").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= hot).select("name")
    return np.sort(np.asarray(heavy.toArrow().column(0), np.int64).view(np.uint64))


def dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256; or the documents with what is left of their texts.

    Remaining texts drop bytes of characters that a removed run cuts through.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = lambda size: max(1, -(-total // size))
    plain = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    # the columns of the input go by number, so none can clash with those added
    at = [f"c{k}" for k in range(len(docs.columns))]
    keyed = plain.toDF(*at).select("*", F.col(at[docs.columns.index("doc_id")]).alias("__doc"), F.col(at[docs.columns.index("text")]).alias("text"))
    lost = F.when(F.col("__doc").isNull(), F.lit(_NO_ID)).otherwise(F.lit(0).cast("long"))
    keyed = keyed.withColumn("__id", F.coalesce("__doc", F.lit(_LAST))).withColumn("__h", F.xxhash64("text").bitwiseAND(_NO_ID - 1).bitwiseOR(lost)).drop("__doc")
    keyed = keyed.withColumn("__chunk", F.pmod(F.xxhash64("__id", "__h"), F.lit(shards(CHUNK))).cast("int"))
    small = keyed.select("__chunk", "__id", "__h", "text")
    lists = materialize(small.mapInArrow(_names(shards(NAME_SHARD)), "shard int, name long, n long, list binary"), "substring-names")
    # a name stands for some forty bytes of text
    limit = max(HOT, total // 40 // HOT_NAMES)
    hot = _hot_names(lists, limit)
    dealt = lists.where("shard >= 0").select("shard", "list").mapInArrow(_without(hot), "shard int, list binary")
    answers = materialize(dealt.groupBy("shard").applyInArrow(_repeated(limit), "chunk int, n long, list binary"), "substring-answers")
    found = answers.agg(F.sum("n")).first()[0] or 0
    more = [unpack(x)[0] for x in answers.where("chunk < 0").select("list").toArrow().column(0).to_pylist()]
    hot = np.unique(np.concatenate([hot, *more])).astype(np.uint64)
    answers = answers.where("chunk >= 0")
    parts = max(1, -(-found * 140 // SORT_SHARD))
    packed = small.mapInArrow(_packed, "__chunk int, texts binary")
    cut = packed.groupBy("__chunk").cogroup(answers.select("chunk", "list").groupBy("chunk")).applyInArrow(_cut(hot, parts), "shard int, chunk int, list binary")
    spans = cut.groupBy("shard").applyInArrow(_sort, "chunk int, spans binary").groupBy("chunk")
    if texts:
        n_chars = at[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None
        schema = plain.toDF(*at).schema
        return keyed.groupBy("__chunk").cogroup(spans).applyInArrow(_apply(at, at[docs.columns.index("text")], n_chars), schema).toDF(*docs.columns)
    return packed.groupBy("__chunk").cogroup(spans).applyInArrow(_apply(), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4(spark, sf_dir) -> DataFrame:
    from .common import read

    return dedup(read(spark, sf_dir, "documents"))
