"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nystroem landmarks.

Letters: a text is folded (lower case, look-alike digits read as letters, marks dropped, letters beyond a-z as one of 16
symbols) and split at white space. An instance is a window of a word, with its ends as a symbol of their own; a text is a
bag of instances, its margin that of the worst one. Two more kinds of words reach across blanks: runs of ``RUN`` or more
tokens of one or two letters, joined, and two neighbours that complete a landmark word at some place.

Kernel: common subsequences of three symbols, each weighed by ``DECAY`` to the length it spans in either window, so
inserted, split off and dropped letters cost a factor each and do not break a match; windows are scaled by their norm to
the power ``SCALE`` only, so that letters set in do not drown the others.

Fit, in one task, from a bounded sample of labelled texts of either class:

1. landmark words of the toxic class: letter runs, word ends included, that are far more common in toxic texts;
   landmarks of the clean class: the windows of clean texts that are closest to them, and some others;
2. features are the Nystroem map K_mm^(-1/2) k_m(x);
3. positive instances are those windows of toxic texts that are close to a landmark word and in no clean text, and the
   landmark words with letters set in, doubled or left out; negative ones are windows of clean texts. Weights come from the squared
   hinge loss by Newton steps; then all windows of clean texts are looked at, those inside the margin join, and so on;
4. the logistic curve over margins is fitted on whole texts.

A margin is linear in the scaled subsequence counts of a window, so the weights on landmarks are folded once into
weights on subsequences: the same number without a pass over the landmarks.

Cases: null and empty texts, and texts without a letter, get the margin of the bias; null labels and
labels without a document are ignored; several labels of a document give their majority, a tie none; if a class has no
rows every score is the share of the other, as where nothing sets toxic texts apart; repeated rows give repeated results
and lend their text once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, give_back
from .quality import majority

DECAY, SCALE, WIDTH, STEP, ALPHABET, RUN = 0.75, 0.7, 12, 2, 43, 3
#: Labelled texts of each class that the model is fitted on, about.
SAMPLE = 2_000
#: Landmarks of the clean class for each of the toxic one, and those at least.
CLEAN_LANDMARKS, LEAST_LANDMARKS = 2, 800
#: A window as close to a landmark word as this, of the landmark's own norm, is an instance of it.
CLOSE = 0.6
#: Share of the clean texts of the sample that may be rejected, and the least margin of a rejected text.
FALSE, LOWEST = 0.04, 0.1
#: Weights of the instances of toxic texts, of toxic words written otherwise, of words that look like them, and of clean texts.
POSITIVE, BENT, MISSED, CLEAN = 1.0, 8.0, 2.5, 30.0
#: So many of the commonest words with a landmark run are written otherwise.
MODELS = 2

_LOOKALIKE = dict(zip(b"0134578@$", b"oieastbas", strict=True))
_DROP = bytes(c for c in range(256) if not (97 <= c <= 122 or c in (9, 10, 11, 12, 13, 32) or c in _LOOKALIKE or 128 <= c < 192))
_FOLD = bytes(_LOOKALIKE.get(c, c if c < 128 else 123 + (c & 15)) for c in range(256))
_SHORT = re.compile(rb"\x01{%d,}" % RUN)
EDGE = b"\x60"


def tokens(text: str | None) -> list[bytes]:
    """The folded words of a whole text, in order, as bytes from 97 on."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD, _DROP).split()


def words(tokens: list[bytes]) -> set[bytes]:
    """The distinct words, and the runs of short ones joined."""
    sizes = bytes([min(len(t), 255) for t in tokens])
    return {*tokens, *(b"".join(tokens[m.start() : m.end()]) for m in _SHORT.finditer(sizes))}


def fragments(marks: list[bytes]) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """Beginnings and rests of the marks, from two letters on, each with the bits of the cuts it stands for."""
    head, tail, bit = {}, {}, 1
    for m in marks:
        m = m.strip(EDGE)
        for k in range(1, len(m)):
            head[m[:k]] = head.get(m[:k], 0) | bit
            tail[m[k:]] = tail.get(m[k:], 0) | bit
            bit <<= 1
    return head, tail


def split_words(tokens: list[bytes], head: dict[bytes, int], tail: dict[bytes, int]) -> list[bytes]:
    """Neighbours that make a mark together."""
    return [a + b for a, b in set(zip(tokens, tokens[1:], strict=False)) if a in head and b in tail and head[a] & tail[b]]


def pieces(word: bytes) -> list[bytes]:
    """The windows of a word with its ends."""
    w = EDGE + word + EDGE
    n = len(w)
    return [w] if n <= WIDTH else [*(w[i : i + WIDTH] for i in range(0, n - WIDTH, STEP)), w[-WIDTH:]]


_TRIPLES = {n: np.array(list(combinations(range(n), 3))) for n in range(3, WIDTH + 1)}


def counts(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of one length -> (subsequence numbers, their weights, what a window is divided by)."""
    n = len(items[0])
    c = np.frombuffer(b"".join(items), np.uint8).reshape(-1, n).astype(np.int32) - EDGE[0]
    t = _TRIPLES[n]
    number = (c[:, t[:, 0]] * ALPHABET + c[:, t[:, 1]]) * ALPHABET + c[:, t[:, 2]]
    weight = DECAY ** (t[:, 2] - t[:, 0] + 1.0)
    # norms: K(x, x) by the recurrence over prefixes, as products with triangular matrices of the decay
    i, j = np.indices((n, n))
    fade = np.where(j > i, DECAY ** np.maximum(j - i, 1.0), 0.0).astype(np.float32)
    equal = (c[:, :, None] == c[:, None, :]).astype(np.float32)
    k = equal * np.float32(DECAY)
    for _ in range(2):
        k = equal * (fade.T @ k @ fade)
    return number, weight, (DECAY * k.sum(axis=(1, 2), dtype=np.float64)) ** (SCALE / 2)


def by_length(items: list[bytes]) -> dict[int, np.ndarray]:
    length = np.fromiter(map(len, items), np.int64, len(items))
    return {n: np.flatnonzero(length == n) for n in range(3, WIDTH + 1) if (length == n).any()}


def weigh(items: list[bytes], table: np.ndarray, block: int = 8_000) -> np.ndarray:
    """For each window the sum of its scaled subsequence counts times ``table``, a number for each subsequence."""
    out = np.zeros(len(items))
    for ids in by_length(items).values():
        for at in range(0, len(ids), block):
            part = ids[at : at + block]
            number, weight, norm = counts([items[i] for i in part])
            out[part] = (table[number] @ weight) / norm
    return out


class Basis:
    """Scaled subsequence counts of landmarks, only for subsequences that some landmark has: ``phi`` (subsequences, landmarks)."""

    def __init__(self, landmarks: list[bytes]):
        got = [(ids, *counts([landmarks[i] for i in ids])) for ids in by_length(landmarks).values()]
        used = np.unique(np.concatenate([number.ravel() for _, number, _, _ in got]))
        self.used, self.row = used, np.full(ALPHABET**3, len(used), np.int32)
        self.row[used] = np.arange(len(used))
        self.phi = np.zeros((len(used) + 1, len(landmarks)), np.float32)
        for ids, number, weight, norm in got:
            np.add.at(self.phi, (self.row[number], ids[:, None]), (weight / norm[:, None]).astype(np.float32))

    def gram(self) -> np.ndarray:
        return (self.phi.T @ self.phi).astype(np.float64)

    def kernel(self, items: list[bytes], block: int = 4_000) -> np.ndarray:
        """(windows, landmarks)"""
        out = np.zeros((len(items), self.phi.shape[1]), np.float32)
        for ids in by_length(items).values():
            for at in range(0, len(ids), block):
                part = ids[at : at + block]
                number, weight, norm = counts([items[i] for i in part])
                acc = np.zeros((len(part), out.shape[1]), np.float32)
                for k in range(len(weight)):
                    acc += self.phi[self.row[number[:, k]]] * np.float32(weight[k])
                out[part] = acc / norm[:, None].astype(np.float32)
        return out

    def nearest(self, items: list[bytes], block: int = 20_000) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.kernel(items[at : at + block]).max(axis=1) for at in range(0, len(items), block))])

    def table(self, weights: np.ndarray) -> np.ndarray:
        """Weights of landmarks as weights of all subsequences."""
        out = np.zeros(ALPHABET**3)
        out[self.used] = self.phi[:-1] @ weights
        return out


RUNS = range(4, 9)
#: Twice the log-likelihood ratio that a run's excess in toxic texts must reach, and times as common there.
EVIDENCE, LIFT = 30.0, 4.0
#: A word that so many clean texts have, and that is not LIFT times as common in toxic ones, is innocent.
OFTEN = 3


def runs(items: list[bytes], chunk: int = 20_000):
    """The letter runs of words with their ends, in chunks: (number of the word, run as a number with its length on top)."""
    length = np.fromiter(map(len, items), np.int64, len(items)) + 2
    for n in np.unique(length[length >= RUNS[0]]).tolist():
        mine = np.flatnonzero(length == n)
        for lo in range(0, len(mine), chunk):
            ids = mine[lo : lo + chunk]
            c = np.frombuffer(b"".join([EDGE + items[i] + EDGE for i in ids]), np.uint8).reshape(-1, n).astype(np.int64) - EDGE[0]
            for k in RUNS:
                for at in range(n - k + 1):
                    yield ids, c[:, at : at + k] @ (ALPHABET ** np.arange(k - 1, -1, -1)) + k * ALPHABET ** RUNS[-1]


def _letters(code: int) -> bytes:
    k, rest = divmod(code, ALPHABET ** RUNS[-1])
    return bytes(EDGE[0] + rest // ALPHABET ** (k - 1 - i) % ALPHABET for i in range(k))


def evidence(g, s, toxic: int, clean: int):
    """Twice the log-likelihood ratio of g toxic and s clean texts against the classes' sizes; 0 if toxic ones lack."""
    part = toxic / (toxic + clean)
    t = np.maximum(g + s, 1e-9)
    e = 2 * (g * np.log(np.maximum(g, 1e-9) / (t * part)) + s * np.log(np.maximum(s, 1e-9) / (t * (1 - part))))
    return np.where(g > t * part, e, 0.0)


def lifted(g, s, toxic: int, clean: int):
    return g * clean >= LIFT * toxic * np.maximum(s, 0.5)


def families(bags: list[set[bytes]], k: int = 4) -> list[int]:
    """For each bag the first one that it is a near copy of: those that share three of the four words of lowest hash."""
    first: dict[tuple, int] = {}
    out = []
    for i, b in enumerate(bags):
        low = sorted(sorted(b, key=lambda w: (zlib.crc32(w), w))[:k])
        keys = list(combinations(low, k - 1)) if len(low) == k else [tuple(low)]
        mine = min((first[x] for x in keys if x in first), default=i)
        for x in keys:
            first.setdefault(x, mine)
        out.append(mine)
    return out


def once(bags: list[set[bytes]], family: list[int]) -> list[set[bytes]]:
    """The words of each family of near copies."""
    out: dict[int, set[bytes]] = {}
    for b, f in zip(bags, family, strict=True):
        out.setdefault(f, set()).update(b)
    return list(out.values())


def landmark_words(toxic: list[set[bytes]], clean: list[set[bytes]], innocent: set[bytes]) -> list[bytes]:
    """Runs of four to eight letters, ends included, that are far more common in toxic bags than in clean ones.

    Innocent words do not count. The best run is taken, the words with it are put aside, and so on while runs pass, so
    that the endings of a taken stem give no runs of their own.
    """
    where: dict[bytes, list[int]] = {}
    for i, b in enumerate(toxic):
        for w in b - innocent:
            where.setdefault(w, []).append(i)
    items = sorted(w for w in where if len(w) <= 32)
    df = np.array([len(where[w]) for w in items], float)
    # a run in fewer texts can't reach EVIDENCE: first counted by a hash, which counts too many only
    least = EVIDENCE / (2 * np.log((len(toxic) + len(clean)) / len(toxic)))
    tally, slot = np.zeros(1 << 22, np.float32), lambda code: (code * np.int64(-7046029254386353131) >> 20) & ((1 << 22) - 1)
    for ids, code in runs(items):
        np.add.at(tally, slot(code), df[ids].astype(np.float32))
    who, code = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for ids, x in runs(items):
        keep = tally[slot(x)] >= least
        who.append(ids[keep]), code.append(x[keep])
    who, code = np.concatenate(who), np.concatenate(code)
    known, back = np.unique(code, return_inverse=True)
    if not len(known):
        return []
    also = Counter(w for b in clean for w in b - innocent)
    others = sorted(w for w in also if len(w) <= 32)
    weight, seen = np.array([also[w] for w in others], float), np.zeros(len(known))
    for ids, x in runs(others):
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        hit = known[at] == x
        seen += np.bincount(at[hit], weights=weight[ids[hit]], minlength=len(known))
    seen = np.minimum(seen, len(clean))
    alive, size, out = np.ones(len(items), bool), 1 + known // ALPHABET ** RUNS[-1] / 20, []
    open_ = np.ones(len(known), bool)
    while True:
        n = np.minimum(np.bincount(back, weights=df[who] * alive[who], minlength=len(known)), len(toxic))
        e = evidence(n, seen, len(toxic), len(clean))
        ok = open_ & (e >= EVIDENCE) & lifted(n, seen, len(toxic), len(clean))
        if not ok.any():
            return out
        best = int(np.argmax(np.where(ok, e * size, -1)))
        open_[best] = False
        with_it = who[back == best]
        texts = len({i for w in with_it[alive[with_it]].tolist() for i in where[items[w]]})  # a text counts once
        if evidence(texts, seen[best], len(toxic), len(clean)) >= EVIDENCE and lifted(texts, seen[best], len(toxic), len(clean)):
            out.append(_letters(int(known[best])))
            alive[with_it] = False


def variants(word: bytes, rng: np.random.Generator, each: int = 16) -> list[set[bytes]]:
    """The word written otherwise, by kind: one, two, three letters set in or doubled; some at one place; one between all; one left out."""
    letter = lambda: bytes([97 + int(rng.integers(26))])

    def grown(n: int) -> bytes:
        w = word
        for _ in range(n):
            i = int(rng.integers(1, len(w)))
            w = w[:i] + (letter() if rng.random() < 0.8 else w[i : i + 1]) + w[i:]
        return w

    def burst() -> bytes:
        i = int(rng.integers(1, len(word)))
        return word[:i] + b"".join(letter() for _ in range(int(rng.integers(2, 4)))) + word[i:]

    kinds = [{grown(n) for _ in range(each * n)} for n in (1, 2, 3)]
    kinds += [{burst() for _ in range(each)}, {letter().join(word[i : i + 1] for i in range(len(word))) for _ in range(each)}]
    return [*kinds, {word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) > 4 else set()]


def near_misses(word: bytes, rng: np.random.Generator, each: int = 48) -> set[bytes]:
    """Other words that look like it: half of its letters, or all but two or three, are others."""
    letter = lambda: 97 + int(rng.integers(26))
    out, half = set(), (len(word) + 1) // 2
    for _ in range(each):
        other = bytes(letter() for _ in range(len(word)))
        out |= {word[:half] + other[half : half + int(rng.integers(1, len(word)))], other[int(rng.integers(half)) : half] + word[half:]}
        w = bytearray(word)
        for i in rng.choice(len(word), min(len(word), 2 + int(len(word) > 5)), replace=False):
            w[i] = letter()
        out.add(bytes(w))
    return out


class Model:
    def __init__(self, table: np.ndarray | None, bias: float, slope: float, shift: float, constant: float = 0.5, marks: tuple[bytes, ...] = ()):
        self.table, self.bias, self.slope, self.shift, self.constant, self.marks = table, bias, slope, shift, constant, marks
        self.head, self.tail = fragments(list(marks))
        self.known: dict[bytes, float] = {}

    def learn(self, new: list[bytes]) -> None:
        """Margins of words, the largest of their windows."""
        cut = [pieces(w) for w in new]
        ends = np.cumsum([0, *map(len, cut)])
        m = weigh([p for c in cut for p in c], self.table) + self.bias
        self.known.update(zip(new, np.maximum.reduceat(m, ends[:-1]).tolist(), strict=True))

    def bag(self, text: str | None) -> set[bytes]:
        line = tokens(text)
        return words(line).union(split_words(line, self.head, self.tail))

    def margins(self, bags: list[set[bytes]]) -> np.ndarray:
        if len(self.known) > 150_000:
            self.known.clear()
        if new := list(set().union(*bags) - self.known.keys()):
            for at in range(0, len(new), 10_000):
                self.learn(new[at : at + 10_000])
        return np.array([max(map(self.known.__getitem__, b), default=self.bias) for b in bags], float)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins([self.bag(t) for t in texts]) + self.shift, -60, 60)))


def _svm(blocks: list[np.ndarray], y: np.ndarray, weight: np.ndarray, c: float = 1000.0, steps: int = 60, chunk: int = 4_000) -> np.ndarray:
    """Squared hinge loss with an L2 norm, by Newton steps on the active rows. The last weight is the bias."""
    ends = np.cumsum([0, *map(len, blocks)])
    parts = [(b[i : i + chunk], slice(at + i, at + min(i + chunk, len(b)))) for b, at in zip(blocks, ends[:-1].tolist(), strict=True) for i in range(0, len(b), chunk)]
    n = blocks[0].shape[1] + 1
    w, last = np.zeros(n), None
    reg = np.diag(np.append(np.ones(n - 1), 1e-6))
    for _ in range(steps):
        active = np.concatenate([y[at] * (x @ w[:-1].astype(np.float32) + w[-1]) < 1 for x, at in parts])
        if last is not None and np.array_equal(active, last):
            break
        last = active
        left, right = reg.copy(), np.zeros(n)
        for x, at in parts:
            on = active[at]
            a = np.hstack([x[on], np.ones((int(on.sum()), 1), np.float32)]).astype(np.float64)
            heavy = a * (weight[at][on, None] * c)
            left += heavy.T @ a
            right += heavy.T @ y[at][on]
        w = np.linalg.solve(left, right)
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit(t: list[set[bytes]], c: list[set[bytes]], share: float | None = None) -> Model:
    """Bags of words of toxic and of clean texts -> model. ``share``: of toxic texts among all, the score where nothing tells them apart."""
    if not t or not c:
        return Model(None, 0.0, 1.0, 0.0, 0.5 if not t and not c else float(bool(t)))
    often, seldom = Counter(w for b in c for w in b), Counter(w for b in t for w in b)
    raised = {w for w, n in seldom.items() if n > 1 and lifted(n, often[w], len(t), len(c))}
    innocent = {w for w, n in often.items() if n >= OFTEN} - raised
    # near copies are one witness
    marks = landmark_words(once(t, families(t)), once(c, families(c)), innocent)
    if not marks:
        return Model(None, 0.0, 1.0, 0.0, share if share is not None else len(t) / (len(t) + len(c)))
    rng = np.random.default_rng(2)
    own = Basis(marks)
    own.phi /= (own.phi**2).sum(axis=0)  # 1 for the mark itself
    texts_with = Counter()
    for w, n in often.items():
        if w not in raised:
            for p in set(pieces(w)):
                texts_with[p] += n
    plain = sorted(texts_with)
    near_plain = own.nearest(plain)
    hard = [plain[i] for i in np.argsort(-near_plain, kind="stable")[: 40 * len(marks) + 2_000]]
    some = [plain[i] for i in rng.permutation(len(plain))[:4_000]]
    least = max(LEAST_LANDMARKS, CLEAN_LANDMARKS * len(marks))
    landmarks = [*marks, *hard[:least], *some[: least // 4]]
    basis = Basis(landmarks)
    values, axes = np.linalg.eigh(basis.gram())
    keep = values > 1e-5 * values[-1]
    root = axes[:, keep] / np.sqrt(values[keep])
    nystroem = lambda items: basis.kernel(items) @ root.astype(np.float32)
    mine = sorted({w for b in t for w in b if w not in innocent and (w in raised or w not in often)})
    cut = [pieces(w) for w in mine]
    all_cut = sorted({p for x in cut for p in x})
    near = dict(zip(all_cut, own.nearest(all_cut).tolist(), strict=True))
    best = Counter()
    for x, w in zip(cut, mine, strict=True):
        p = max(x, key=near.__getitem__)
        if near[p] >= CLOSE and p not in texts_with:
            best[p] += seldom[w]
    positive = sorted(best)
    known = Counter({w: seldom[w] for w in mine})
    models = sorted({w for m in marks for w in sorted((w for w in known if m in EDGE + w + EDGE), key=lambda w: (-known[w], w))[:MODELS]})
    bend: dict[bytes, float] = {}
    for w in models:
        for kind in variants(w, rng):
            for p in (some_kind := {p for v in kind for p in pieces(v)} - texts_with.keys() - best.keys()):
                bend[p] = max(bend.get(p, 0.0), 1 / len(some_kind))
    bent = sorted(bend)
    missed = sorted({p for w in models for v in near_misses(w, rng) for p in pieces(v)} - best.keys() - bend.keys())
    other = list(dict.fromkeys(hard + some))
    px, bx, qx = (nystroem(x) for x in (positive, bent, missed))
    for _ in range(4):
        ox = nystroem(other)
        sizes = [len(positive), len(bent), len(missed), len(other), 1]
        weight = np.concatenate([[POSITIVE * best[p] / len(t) for p in positive], [BENT * bend[p] / (6 * len(models)) for p in bent], np.full(len(missed), MISSED / max(1, len(missed))), [CLEAN * texts_with[p] / len(c) for p in other], [50.0]])
        # a window unlike all landmarks is clean: no features, a heavy weight
        w = _svm([px, bx, qx, ox, np.zeros((1, root.shape[1]), np.float32)], np.repeat([1.0, 1.0, -1.0, -1.0, -1.0], sizes), weight)
        model = Model(basis.table(root @ w[:-1]), float(w[-1]), 1.0, 0.0, marks=tuple(models))
        wrong = np.flatnonzero(weigh(plain, model.table) + model.bias > -0.7)
        new = [plain[i] for i in wrong.tolist()]
        if not set(new) - set(other):
            break
        other = list(dict.fromkeys(other + new))
    m = np.append(model.margins([*t, *c]), model.bias)
    model.slope, shift = _logistic(m, np.repeat([1.0, 0.0], [len(t), len(c) + 1]))
    # texts are rejected from the margin on that FALSE of the clean ones reach, which is lower than the curve's middle
    # where the classes lie apart: words written otherwise have lower margins than those of the labelled texts
    model.shift = -model.slope * min(-shift / model.slope, max(LOWEST, float(np.quantile(m[len(t) :], 1 - FALSE))))
    model.known.clear()
    return model


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE, folds: int = 5, held: int = 0) -> Model:
    """Fit on about ``sample`` texts of each class, those with the lowest hash of doc_id; the held-out fold lends none."""
    y = majority(labels, column).where(fold(F.col("doc_id"), folds) != held)
    n = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return fit([], [])
    part = F.create_map(*[x for c in n for x in (F.lit(c), F.lit(int(min(1.0, sample / n[c]) * (2**31 - 1))))])
    chosen = y.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(2**31)) <= F.element_at(part, F.col("y")))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b" ".join(sorted(words(tokens(t.as_py())))) for t in b.column(1)], pa.binary())], names=["y", "bag"])

    # ids and labels of the sample only are broadcast; of repeated rows of a document one text goes on
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")
    share = n.get(1, 0) / sum(n.values())

    def run_fit(batches):
        import pyarrow as pa

        bags = sorted({(y.as_py(), bag.as_py()) for b in batches for y, bag in zip(*b.columns, strict=True)})
        model = fit([set(b.split()) for y, b in bags if y], [set(b.split()) for y, b in bags if not y], share)
        del bags
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # the sample is bounded, so it fits one task; the driver gets the folded weights only
    got = texts.mapInArrow(run, "y int, bag binary").repartition(1).mapInArrow(run_fit, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([], [])


def score(docs: DataFrame, model: Model, folds: int = 5, held: int = 0) -> DataFrame:
    """-> doc_id, held_out, score, predicted for each row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                s = model.scores([t.as_py() for t in c.column(2)])
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        model.known.clear()
        give_back()

    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns."""
    model = train(docs, labels)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                text = c.schema.get_field_index("text")
                yield c.filter(pa.array(model.scores([t.as_py() for t in c.column(text)]) < 0.5))
        model.known.clear()
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op2(spark, sf_dir) -> DataFrame:
    from .common import read

    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
