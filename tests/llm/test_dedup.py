import hashlib
import random

import numpy as np
import xxhash

from tests.llm.cases import documents, empty
from typoforge.llm import esort, simhash, simhash_docs, substring


def brute_fp(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_fingerprints_and_components(spark):
    df, rows = documents(spark)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = {i: brute_fp(t) for i, t, *_ in rows if i is not None}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got if r["doc_id"] is not None} == want
    pairs = [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 3]
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == brute_components(want, pairs)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_trie_and_hot_buckets(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & ((1 << 64) - 1) for b in base for _ in range(25)})
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = brute_components(range(len(fps)), pairs)
    for frontier in (16, 1 << 20):
        got = simhash.trie_components(np.zeros(len(fps), int), np.array(fps, np.uint64), 3, frontier)
        assert dict(enumerate(got.tolist())) == want
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    for bucket in (10, 1 << 15):
        roots = {r["id"]: r["root"] for r in simhash.components(simhash.links(df, bucket=bucket)).collect()}
        assert {i: roots.get(i, i) for i in want} == want


def test_rows_without_id_link_others(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(1, 0), (None, 7), (2, 63), (None, 1 << 60), (3, (1 << 40) - 1), (9, 0), (9, 0), (None, 0)]
    base = [rng.getrandbits(63) for _ in range(6)]
    rows += [(None if rng.random() < 0.5 else 100 + k, base[k % 6] ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4)))) for k in range(150)]
    rows += [(1000 + k, base[0]) for k in range(300)]  # a hot fingerprint
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long").repartition(5)).collect()
    nodes = sorted({f for _, f in rows})
    label = brute_components(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3])
    first = {}
    for i, f in rows:
        if i is not None:
            first[label[f]] = min(i, first.get(label[f], i))
    assert sorted(map(str, got)) == sorted(str(got[0].__class__(doc_id=i, fp=f, component_id=first.get(label[f]))) for i, f in rows)
    assert {r["component_id"] for r in got if r["fp"] in (0, 7, 63)} == {1}


def test_trie_join_is_complete_at_any_budget():
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(8)]
    fps = np.array(sorted(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 30))) for b in base for _ in range(12)) + [5, 5, 5], np.uint64)
    group = np.sort(np.array([rng.randrange(3) for _ in fps]))
    order = np.lexsort((fps, group))
    group, fps = group[order], fps[order]
    label = np.array([rng.randrange(4) for _ in fps])
    for budget in (0, 3, 17, 28):
        for labels in (None, label, np.zeros(len(fps), int)):
            for frontier in (7, 1 << 20):
                got = [(a, b) for x, y in simhash.trie_join(group, fps, budget, frontier, labels) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
                want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if group[a] == group[b] and (int(fps[a]) ^ int(fps[b])).bit_count() <= budget and (labels is None or labels[a] != labels[b])}
                assert len(got) == len(want) and {(min(p), max(p)) for p in got} == want


def test_hot_keys_are_joined_without_a_shuffle(spark):
    from typoforge.llm.common import join_spread

    rows = spark.createDataFrame([(k % 5 if k < 900 else k, f"v{k}") for k in range(1000)] + [(None, "none")], "k long, v string")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "concat('t', k) AS t")
    got = join_spread(rows, table, "k", "n", 1001)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table.drop("n"), "k").collect())) and got.count() == 1000


def test_clusters_must_name_a_shared_folder():
    import pytest

    from typoforge.llm.common import shared_dir

    class Spark:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "local-cluster[3,2,1024]"

    with pytest.raises(ValueError):
        shared_dir(Spark)


def brute_removed(rows):
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if i is not None}, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(left).hexdigest(), left)
    return out


def test_suffix_array_dedup(spark, monkeypatch):
    df, rows = documents(spark)
    want = brute_removed(rows)
    assert sum(x[1] for x in want.values()) > 2000
    for hot, shard in ((20_000, 4 << 20), (3, 4000), (4, 4001)):  # those after the first: every repeated name is hot, many shards
        monkeypatch.setattr(substring, "HOT", hot)
        monkeypatch.setattr(substring, "LOCAL", 2 if hot == 3 else 10**6)
        monkeypatch.setattr(substring, "SORT_SHARD", shard)
        got = substring.dedup(df).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got if r["doc_id"] is not None} == {k: v[:4] for k, v in want.items()}
    texts = substring.dedup(df, texts=True)
    assert texts.columns == df.columns
    left = {r["doc_id"]: r["text"] for r in texts.collect()}
    assert all((left[k] or "") == v[4].decode("utf-8", "ignore") for k, v in want.items())
    assert left[40] is None
    assert substring.dedup(empty(spark)).count() == 0


def test_suffix_array_dedup_with_a_common_line_and_odd_columns(spark, monkeypatch):
    rng = random.Random(17)
    line = "".join(rng.choice("abcdefgh ") for _ in range(160))
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 400))) + (line if k % 9 == 0 else "") + "".join(rng.choice("xyz") for _ in range(90))) for k in range(300)]
    rows += [((1 << 63) - 1, line + "last"), ((1 << 63) - 1, None)]
    want = brute_removed(rows)
    docs = spark.createDataFrame([(i, t, 1, "a", 2, "b", 3, i) for i, t in rows + [(None, line + "none"), (None, line + "last")]], "doc_id long, text string, __id int, __h string, __chunk int, c0 string, n_chars int, __doc long").repartition(7)
    for local, hot in ((64, 2_000), (10**6, 20), (2, 20)):  # no hot names; found when counted exactly; found in batches
        monkeypatch.setattr(substring, "LOCAL", local)
        monkeypatch.setattr(substring, "HOT", hot)
        got = substring.dedup(docs).collect()
        assert len(got) == len(rows) + 2
        assert {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 300} == {(i, v[0]): v[1:4] for i, v in want.items() if i < 300}
        ends = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in got if r["doc_id"] is None or r["doc_id"] > 300)
        assert ends == [(str((1 << 63) - 1), 0, 0), (str((1 << 63) - 1), 164, 160), ("None", 164, 160), ("None", 164, 164)]
    kept = substring.dedup(docs, texts=True)
    assert kept.columns == docs.columns and kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert kept.where("doc_id = __doc or (doc_id is null and __doc is null)").count() == len(rows) + 2


def test_suffix_array_orders_and_spills():
    rng = random.Random(3)
    for _ in range(150):
        s = bytes(rng.randrange(97, 97 + rng.choice([1, 2, 4, 26])) for _ in range(rng.choice([1, 3, 30, 400])))
        text, _ = esort.join_texts([s * rng.randint(1, 3), s])
        sa, lcp = esort.suffix_array(text, limit=rng.choice([40, 1 << 20]))
        b = text.tobytes()
        assert sorted(sa.tolist()) == list(range(len(b)))
        keys = [b[i : i + esort.CAP] for i in sa]
        assert keys == sorted(keys)
        for i in range(1, len(b)):
            n = 0
            while n < esort.CAP and sa[i] + n < len(b) and sa[i - 1] + n < len(b) and b[sa[i] + n] == b[sa[i - 1] + n]:
                n += 1
            assert n == lcp[i]


def test_queue_keeps_order_on_disk():
    q = esort.BucketQueue(8)
    for k in range(50):
        q.push(k % 3, np.array([k], np.int32), np.array([k], np.uint8))
    assert q.spilled
    assert q.take(1)[0].tolist() == list(range(1, 50, 3)) and q.take(1) is None
    q.close()


def test_links_of_a_cluster_are_those_of_all_pairs():
    rng = np.random.default_rng(6)
    for m, swap in ((2, 0.05), (40, 0.08), (150, 0.09), (90, 0.3)):
        base = rng.integers(1, 1 << 40, 120)
        sets = [np.unique(np.where(rng.random(120) < swap * rng.random(), rng.integers(1, 1 << 40, 120), base)) for _ in range(m)]
        keys = rng.permutation(10 * m)[:m]
        a, b = simhash_docs.cluster_links(keys, sets)
        like = [(int(keys[i]), int(keys[j])) for i in range(m) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
        assert len(a) < m and brute_components(keys.tolist(), zip(a.tolist(), b.tolist(), strict=True)) == brute_components(keys.tolist(), like)


def test_pipeline_links_all_pairs_by_jaccard(spark, monkeypatch):
    import corpus_pipeline
    from tests.llm.cases import words

    rng = random.Random(11)
    df, rows = documents(spark)
    more, at = [], 1000
    for _ in range(25):
        base = words(rng, rng.randint(30, 200)).split()
        for k in range(6):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(t) // 40)):
                t[rng.randrange(len(t))] = f"new{rng.randrange(10**6)}"
            more.append((at := at + 1, " ".join(t)))
    line = words(rng, 9)
    more += [(at + 1 + k, " ".join([line] * 3 + [f"u{k}"] * (k % 3))) for k in range(30)]
    more += [(5000 + k, " ".join(f"w{x}" for x in range(k, k + 40))) for k in range(0, 30, 3)]
    docs = df.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    sets = {}
    for i, t in [r[:2] for r in rows] + more:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets.pop(None)
    like = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(a, b) for a in sets for b in sets if a < b and like(sets[a], sets[b])]
    far = [(a, b) for a, b in pairs if (brute_fp(dict(more).get(a, "")) ^ brute_fp(dict(more).get(b, ""))).bit_count() > 3]
    assert len(far) > 50
    want = sorted(set(brute_components(sets, pairs).values()))
    whole, links = simhash_docs.candidates, simhash_docs.links
    for bucket, part in ((1 << 15, 4_000_000), (4, 300)):  # the second ones: many buckets and clusters in parts
        monkeypatch.setattr(simhash_docs, "candidates", lambda rows, b=bucket: whole(rows, b))
        monkeypatch.setattr(simhash_docs, "links", lambda *a, p=part: links(*a, p))
        got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert sorted(r[0] for r in got.where("doc_id is not null").collect()) == want
    assert got.columns == docs.columns
    assert sorted(r[0] for r in got.where("doc_id is not null").collect()) == sorted(set(brute_components(sets, pairs).values()))
    assert got.where("doc_id is null").count() == 1
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_near_copies_leave_no_files_and_no_texts_in_shuffles(spark):
    import time
    from pathlib import Path

    from typoforge.llm.common import materialize, shared_dir

    df, _ = documents(spark)
    root = Path(shared_dir(spark))
    was = {p.name for p in root.iterdir()}
    got = simhash_docs.keep_one(df)
    new = {p.name.split("-")[1] for p in root.iterdir() if p.name not in was and p.name.startswith("near-")}
    assert not new & {"sets", "shared", "members", "whole"}
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, simhash_docs.keep_one(df, broadcast=0).collect())) and len(rows) == len({r["doc_id"] for r in got.collect()})
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    materialize(df.repartition(3, "text"), "near-test")
    end = time.time() + 10
    while files() > before and time.time() < end:
        time.sleep(0.1)
    assert files() <= before
