"""Suffix and common-prefix arrays by external induced sorting.

Suffixes of L and S type are induced from the sorted leftmost S ones (LMS), which a recursion on the names of their
substrings sorts. The queues of the induction are monotone priority queues: keys only go up (L) or down (S), so each
first byte has a first-in-first-out bucket of (position, common prefix) tuples, and buckets beyond the memory limit
go to an unlinked scratch file that ends with the task. Common prefixes, capped at ``CAP``, travel with the tuples: of
two neighbours in a bucket it is one more than the least among their sources, as range minima or the buckets' carried minima.

Order is exact to the first ``CAP`` bytes; suffixes equal so far may stand in any order, with common prefix ``CAP``.
"""

from __future__ import annotations

import tempfile

import numpy as np

CAP = 100
SEPARATOR, SHIFT = 1, 2
#: Bytes that a queue holds in memory; a shard of 2 MB has some 10 MB of tuples.
QUEUE = 8 << 20


class BucketQueue:
    """First-in-first-out buckets of (position, lcp) chunks by byte; over ``limit`` bytes in memory, chunks go to disk."""

    def __init__(self, limit: int):
        self.limit, self.held, self.file = limit, 0, None
        self.chunks: list[list] = [[] for _ in range(256)]
        self.spilled = 0

    def push(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        if len(pos):
            self.chunks[key].append((pos, lcp))
            self.held += pos.nbytes + lcp.nbytes
            if self.held > self.limit:
                self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for bucket in self.chunks:
            held = [c for c in bucket if len(c) == 2]  # behind those on disk, which came earlier
            if held:
                pos, lcp = (np.concatenate(x) for x in zip(*held, strict=True))
                at = self.file.seek(0, 2)
                self.file.write(pos.tobytes())
                self.file.write(lcp.tobytes())
                self.spilled += pos.nbytes + lcp.nbytes
                bucket[len(bucket) - len(held) :] = [(at, len(pos), pos.dtype)]
        self.held = 0

    def take(self, key: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All chunks of the bucket, joined, in order; the bucket is empty then."""
        got, self.chunks[key] = self.chunks[key], []
        if not got:
            return None
        pos, lcp = [], []
        for c in got:
            if len(c) == 2:
                self.held -= c[0].nbytes + c[1].nbytes
                pos.append(c[0])
                lcp.append(c[1])
            else:
                at, n, kind = c
                self.file.seek(at)
                pos.append(np.frombuffer(self.file.read(n * kind.itemsize), kind))
                lcp.append(np.frombuffer(self.file.read(n), np.uint8))
        return (pos[0], lcp[0]) if len(pos) == 1 else (np.concatenate(pos), np.concatenate(lcp))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi] for each pair, lo <= hi, from a table of powers of two."""
    size = hi - lo + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    table = values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
        m = level == k
        if m.any():
            out[m] = np.minimum(table[lo[m]], table[hi[m] - (1 << k) + 1])
    return out


class _Inducer:
    """One direction of induction: takes scanned suffixes in order and pushes their left neighbours."""

    def __init__(self, text: np.ndarray, types: np.ndarray, wanted: bool, queue: BucketQueue, with_lcp: bool):
        self.text, self.types, self.wanted, self.queue, self.with_lcp = text, types, wanted, queue, with_lcp
        self.carry = np.full(256, 255, np.uint8)  # least common prefix since the last push to a bucket
        self.begun = np.zeros(256, bool)

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        left = pos - 1
        sel = np.flatnonzero((left >= 0) & (self.types[left] == self.wanted))
        if not len(sel):
            if self.with_lcp and len(lcp):
                np.minimum(self.carry, lcp.min(), out=self.carry)
            return
        left = left[sel]
        key = self.text[left]
        order = np.argsort(key, kind="stable")
        left, key, at = left[order], key[order], sel[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(starts[1:], len(key))
        if self.with_lcp:
            lo = np.empty_like(at)
            lo[1:] = at[:-1] + 1
            lo[starts] = 0
            got = _range_min(lcp, lo, at)
            d = key[starts]
            first = np.minimum(got[starts], self.carry[d])
            got = np.minimum(got, CAP - 1) + np.uint8(1)
            got[starts] = np.where(self.begun[d], np.minimum(first, CAP - 1) + 1, 0)
            tail = np.full(256, lcp.min(), np.uint8)
            np.minimum(self.carry, tail, out=self.carry)
            last = at[ends - 1] + 1
            rest = last < len(lcp)
            self.carry[d] = 255
            if rest.any():
                self.carry[d[rest]] = _range_min(lcp, last[rest], np.full(int(rest.sum()), len(lcp) - 1))
            self.begun[d] = True
        else:
            got = np.zeros(len(key), np.uint8)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            self.queue.push(int(key[a]), left[a:b], got[a:b])


def _induce(text: np.ndarray, types: np.ndarray, run: np.ndarray, lms: np.ndarray, lms_lcp: np.ndarray, limit: int, with_lcp: bool) -> tuple[np.ndarray, np.ndarray]:
    """From LMS suffixes in order (by first byte at least) -> all suffixes in order, with their common prefixes."""
    cut = np.searchsorted(text[lms], np.arange(257))
    queue, done = BucketQueue(limit), BucketQueue(limit)
    up = _Inducer(text, types, False, queue, with_lcp)
    for c in range(256):
        last = -1
        while (got := queue.take(c)) is not None:
            done.push(c, *got)
            up.scan(*got)
            last = int(got[0][-1])
        a, b = int(cut[c]), int(cut[c + 1])
        if b > a:
            seed = lms_lcp[a:b].copy()
            seed[0] = min(run[last], run[lms[a]], CAP) if last >= 0 else 0
            up.scan(lms[a:b], seed)
    queue.close()
    queue = BucketQueue(limit)
    down = _Inducer(text, types, True, queue, with_lcp)
    out_pos, out_lcp = [], []
    for c in range(255, -1, -1):
        parts = []
        last = -1
        while (got := queue.take(c)) is not None:
            parts.append(got)
            down.scan(*got)
            last = int(got[0][-1])
        got = done.take(c)
        if parts:
            pos = np.concatenate([p for p, _ in parts])[::-1]
            lcp = np.concatenate([x for _, x in parts])
            lcp = np.append(lcp[1:], 0)[::-1].astype(np.uint8)
            if got is not None:
                lcp[0] = min(run[last], run[got[0][-1]], CAP)
            out_pos.append(pos)
            out_lcp.append(lcp)
        if got is not None:
            pos, lcp = got
            out_pos.append(pos)
            out_lcp.append(lcp)
            back = np.append(np.uint8(0), lcp[:0:-1]).astype(np.uint8)
            back[0] = min(run[last], run[pos[-1]], CAP) if last >= 0 else 0
            down.scan(pos[::-1], back)
    queue.close()
    done.close()
    out_pos.append(np.array([len(text) - 1], lms.dtype))  # the end mark has no suffix to its right
    out_lcp.append(np.zeros(1, np.uint8))
    return np.concatenate(out_pos[::-1]), np.concatenate(out_lcp[::-1])


def _common(text8: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of suffixes a[i] and b[i], up to ``cap``; text8: eight bytes from each position."""
    out = np.full(len(a), cap, np.int64)
    live = np.arange(len(a))
    for at in range(0, cap, 8):
        if not len(live):
            break
        diff = text8[a[live] + at] ^ text8[b[live] + at]
        off = diff != 0
        low = diff[off] & (~diff[off] + np.uint64(1))
        out[live[off]] = np.minimum(at + (np.bitwise_count(low - np.uint64(1)) >> 3), cap)
        live = live[~off]
    return out


def _recurse(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the reduced string, to ``depth`` names at least, by doubling in memory."""
    rank, h = names.astype(np.int64), 1
    n = len(rank)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - h] = rank[h:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key)
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        h *= 2
        if new[-1] == n - 1 or h >= depth or h >= n:
            return order


def suffix_array(text: np.ndarray, limit: int = QUEUE) -> tuple[np.ndarray, np.ndarray]:
    """text: uint8, ends with its only 0 -> (positions in order, common prefix with the one before, up to CAP)."""
    n = len(text)
    kind = np.int32 if n < 2**31 else np.int64
    if n == 1:
        return np.zeros(1, kind), np.zeros(1, np.uint8)
    change = text[1:] != text[:-1]
    at = np.append(np.flatnonzero(change), n - 1)  # last place of each run of equal bytes
    length = np.diff(np.concatenate(([-1], at)))
    rising = np.append(text[at[:-1]] < text[at[:-1] + 1], True)
    types = np.repeat(rising, length)  # True: S
    run = np.minimum(np.repeat(at, length) - np.arange(n) + 1, CAP).astype(np.uint8)
    lms = (np.flatnonzero(types[1:] & ~types[:-1]) + 1).astype(kind)
    padded = np.concatenate((text, np.zeros(CAP + 16, np.uint8)))
    text8 = np.ndarray((n + CAP + 8,), "<u8", padded, 0, (1,))
    if len(lms) > 1:
        first = lms[np.argsort(text[lms], kind="stable")]
        order, _ = _induce(text, types, run, first, np.zeros(len(lms), np.uint8), limit, False)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = order[is_lms[order]]
        # substrings reach to the next LMS place, itself included; equal ones get one name
        end = np.zeros(n, kind)
        end[lms[:-1]] = lms[1:]
        end[lms[-1]] = n - 1
        size = end[order] - order + 1
        a, b = order[:-1], order[1:]
        short = np.minimum(size[:-1], size[1:])
        same = size[:-1] == size[1:]
        live = np.flatnonzero(same)
        step = 0
        while len(live):
            left = np.clip(short[live] - step, 0, 8)
            mask = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * np.minimum(left, 7).astype(np.uint64))) - np.uint64(1))
            ok = ((text8[a[live] + step] ^ text8[b[live] + step]) & mask) == 0
            same[live[~ok]] = False
            step += 8
            live = live[ok & (short[live] > step)]
            if step > CAP:  # equal to the cap is equal for us
                break
        names = np.concatenate(([0], np.cumsum(~same)))
        if names[-1] < len(lms) - 1:
            by_place = np.empty(n, np.int64)
            by_place[order] = names
            lms = lms[_recurse(by_place[lms], CAP // 2 + 1)]
        else:
            lms = order
    lcp = np.zeros(len(lms), np.uint8)
    if len(lms) > 1:
        lcp[1:] = _common(text8, lms[:-1], lms[1:], CAP)
    return _induce(text, types, run, lms, lcp, limit, True)


def join_texts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings -> (one text with separators and the end mark, start of each part)."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1])) if len(parts) else np.zeros(0, np.int64)
    raw = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(SHIFT)  # 0xff becomes SEPARATOR
    return np.append(raw, np.uint8(0)), starts
