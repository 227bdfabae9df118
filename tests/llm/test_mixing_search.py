import tracemalloc
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import documents, empty
from typoforge.llm import common, mixing, search


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in sizes if s not in capped)
        t = {s: most * sizes[s] if s in capped else left * w[s] / free for s in sizes}
        over = {s for s in sizes if s not in capped and t[s] > most * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


def test_mixing(spark):
    df, rows = documents(spark, n=300)
    got = mixing.mix(df, shard_docs=50).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df, shard_docs=50).collect()))
    sizes, taken, size_of = Counter(), Counter(), {}
    for i, t, _, s, _ in rows:
        n = len((t or "").encode().split())
        sizes[s] += n
        size_of[i] = n
    want = brute_targets(dict(sizes))
    for r in got:
        assert r["size"] == size_of[r["doc_id"]] and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(30, 0.03 * t)
    assert mixing.mix(empty(spark)).count() == 0


def test_rows_without_id_are_spread(spark):
    rows = [(None, f"a b c d {k} e", "s") for k in range(2000)] + [(7, f"x y {k}", "t") for k in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_docs=100)
    per = Counter((r["source"], r["shard"]) for r in got.collect())
    assert sum(per.values()) == 2500 and max(per.values()) < 200 and len(per) == 50
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(9), shard_docs=100)
    assert sorted(map(str, again.select("doc_id", "size", "taken").collect())) == sorted(map(str, got.select("doc_id", "size", "taken").collect()))


def brute_seats(votes, seats):
    got = Counter()
    for _ in range(seats):
        got[max(votes, key=lambda k: (votes[k] / (2 * got[k] + 1), -k))] += 1
    return {k: got[k] for k in votes}


def test_sainte_lague(spark):
    rng = np.random.default_rng(1)
    for n, seats in ((3, 10), (40, 7), (25, 1000), (1, 5)):
        votes = {i: float(v) for i, v in enumerate(rng.pareto(1.2, n) + 0.01)}
        df = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "k int, v double, seats long")
        assert {r["k"]: r["quota"] for r in mixing.sainte_lague(df, ["k"], "v", "seats").collect()} == brute_seats(votes, seats)


def test_blocks_are_skipped_and_results_exact():
    rng = np.random.default_rng(4)
    index = search.Index(4000, 20.0)
    common = [f"c{k}" for k in range(30)]
    for i in range(4000):
        near = [f"g{i // 20}x{k}" for k in range(6)] if i % 2 else []
        index.add(i, " ".join([*rng.choice(common, 15), *near]))
    index.close()
    reads = []
    whole = search._spread

    def counted(start, size):
        reads.append(int(size.sum()))
        return whole(start, size)

    search._spread = counted
    try:
        for group in (3, 77, 150):
            q = [index.number[f"g{group}x{k}".encode()] for k in range(6)] + [index.number[c.encode()] for c in common[:8]]
            q = np.array(q)
            post = index.start[index.cut[q + 1]] - index.start[index.cut[q]]
            idf = np.log(1 + (4000 - post + 0.5) / (post + 0.5))
            reads.clear()
            ids, score = index.search(q, idf)
            want = np.zeros(4000)
            for w, x in zip(q.tolist(), idf.tolist(), strict=True):
                a, b = index.start[index.cut[w]], index.start[index.cut[w + 1]]
                want[index.doc[a:b]] += index.part[a:b] * x
            order = np.lexsort((index.id, -want))[:10]
            assert ids.tolist() == index.id[order].tolist() and np.allclose(score, want[order])
            assert sum(reads[1:]) < post.sum() / 2  # postings read, of all
    finally:
        search._spread = whole


def test_search_is_exact(spark):
    df, rows = documents(spark, n=150)
    docs = [(i, Counter(search.words(t))) for i, t, *_ in rows if i is not None]
    n = len(docs)
    length = [sum(c.values()) for _, c in docs]
    mean = sum(length) / n
    df_of = Counter(w for _, c in docs for w in c)
    queries = df.where("doc_id % 20 = 0 or doc_id in (150, 151)").select(df.doc_id.alias("query_id"), "text")
    got = defaultdict(list)
    for r in search.search(df, queries, shard_docs=40).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], round(r["score"], 8)))
    for q in queries.collect():
        score = []
        for (i, c), dl in zip(docs, length, strict=True):
            s = sum(np.log(1 + (n - df_of[w] + 0.5) / (df_of[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * dl / mean)) for w in set(search.words(q["text"])) if w in c)
            if s > 0:
                score.append((-round(float(s), 8), i))
        assert got.get(q["query_id"], []) == [(i, -s) for s, i in sorted(score)[:10]]
    assert search.search(empty(spark), queries).count() == 0
    assert search.search(df, queries.limit(0)).count() == 0


def test_waves_of_shards_are_bounded_and_change_nothing(spark, monkeypatch):
    df, rows = documents(spark, n=150)
    queries = df.where("doc_id % 20 = 0 or doc_id in (150, 151)").select(df.doc_id.alias("query_id"), "text")
    ask = lambda **k: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in search.search(df, queries, **k).collect())
    want = ask(shard_docs=1000)
    waves = []
    whole = type(df).repartitionById
    monkeypatch.setattr(type(df), "repartitionById", lambda self, n, *a: waves.append(n) or whole(self, n, *a))
    assert ask(shard_docs=12) == want and max(waves[:1]) <= 4 and len(waves) > 1
    waves.clear()
    # the copies of the queries for all shards of a wave stay within a part of the texts
    assert ask(shard_docs=30, shard_words=10_000, copies=1e-6) == want and set(waves) == {1}


def test_scores_under_the_floor_are_left_out():
    rng = np.random.default_rng(5)
    index = search.Index(3000, 12.0)
    for i in range(3000):
        index.add(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 12) % 500))
    index.close()
    for dense in (True, False):
        q = np.array([index.number[f"w{k}".encode()] for k in (range(1, 60) if dense else range(300, 303))])
        idf = np.log(1 + 3000 / (1 + index.start[index.cut[q + 1]] - index.start[index.cut[q]]))
        ids, score = index.search(q, idf)
        for at in (0, 4, 9):
            got = index.search(q, idf, floor=float(score[at]))
            keep = score >= score[at]
            assert got[0].tolist() == ids[keep].tolist() and got[1].tolist() == score[keep].tolist()
        assert not len(index.search(q, idf, floor=float(score[0]) + 1)[0])


def _sizes(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])


def test_search_tasks_get_small_batches(spark):
    wide = spark.range(0, 400, 1, 1).select(F.rpad(F.col("id").cast("string"), 100_000, "x").alias("text"))
    sizes = [r["n"] for r in common.materialize(wide.mapInArrow(_sizes, "n long"), "sizes", search.BATCHES).collect()]
    assert sum(sizes) >= 40_000_000 and max(sizes) < 8_000_000
    assert common.CLEANUP not in spark.conf.getAll and not set(search.BATCHES) & set(spark.conf.getAll)  # as before


def test_an_index_is_closed_in_little_memory():
    rng = np.random.default_rng(6)
    index = search.Index(3000, 200.0)
    for i in range(3000):
        index.add(i, " ".join(f"w{k}" for k in rng.integers(0, 40_000, 150)))
    n = len(index.word)
    tracemalloc.start()
    index.close()
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(index.doc) == n and held < 30 * n and peak < 45 * n  # bytes a posting


def test_long_queries_are_scored_by_their_pivots_only():
    rng = np.random.default_rng(7)
    index = search.Index(6000, 150.0)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.25, 150) % 20_000) for _ in range(1500)]
    for i in range(6000):
        index.add(i, texts[i % 1500])  # each four times: ties
    index.close()
    post = np.diff(index.start[index.cut])
    for i in (3, 700, 1400):
        q = np.array([index.number[w] for w in dict.fromkeys(search.words(texts[i]))])
        idf = np.log(1 + (6000 - post[q] + 0.5) / (post[q] + 0.5))
        want = np.zeros(6000)
        for w, x in zip(q.tolist(), idf.tolist(), strict=True):
            a, b = index.start[index.cut[w]], index.start[index.cut[w + 1]]
            want[index.doc[a:b]] += index.part[a:b] * x
        best = np.lexsort((index.id, -want))[:10]
        for floor in (0.0, float(want[best[-1]])):
            ids, score = index.search(q, idf, floor=floor)
            assert ids.tolist() == index.id[best].tolist() and score.tolist() == want[best].tolist()
        pivots, score = index._sharp(q, idf, 10, 0.0, None)
        assert 10 <= len(pivots) <= 16 and score.tolist() == want[pivots].tolist()
        none, score = index._sharp(q, idf, 10, float(want[best[0]]) * 1.01, None)
        assert not len(none) and score.dtype == np.float64
