import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import documents, empty
from typoforge.llm import chat, decontam, quality, toxicity, urlfilter, warc


def test_url_rules_and_cascade(spark):
    rng = random.Random(2)
    listed = [f"bad{i}.example.org" for i in range(300)]
    hosts = listed[::3] + [f"www.{h}" for h in listed[::7]] + [f"ok{i}.example.org" for i in range(2000)] + ["example.org", "x.net", "EXAMPLE.net", "a.example.com"]
    rows = [(i, f"https://{h}{rng.choice(['', '/', '/en/1?x', '/de/2#y', '/fr/3'])}") for i, h in enumerate(hosts)]
    rows += [(-1, None), (-2, ""), (-3, "no scheme"), (-4, "x://"), (-5, "http://A.B://c/d?e"), (-6, "//x.net/"), (rows[0][0], rows[0][1])]
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, host string, key string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, spark.createDataFrame([(h,) for h in [*listed, None, ""]], "key string")).collect()}
    want = set()
    for i, u in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1], m[2]) if m else ("", "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, a) for a, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, act = (max(fit)[1:]) if fit else (None, None)
        bad = any(host == x or host.endswith("." + x) for x in listed)
        want.add((i, host, path, rule, act or ("block" if bad else "allow")))
    assert got == want
    long = urlfilter.judge(pages, spark.createDataFrame([(h,) for h in listed], "key string"), bits_per_key=4, max_bits=512)
    assert {tuple(r) for r in long.collect()} == want
    assert urlfilter.judge(pages.limit(0), spark.createDataFrame([], "key string")).count() == 0


def test_cascade_passes_are_exact(spark):
    keys = [f"k{i}" for i in range(800)]
    universe = spark.createDataFrame([(f"k{i}",) for i in range(6000)], "key string")
    cs = urlfilter.build_cascade(spark.createDataFrame([(k,) for k in keys], "key string"), universe, bits_per_key=3, max_bits=1024)
    assert len(cs) > 1 and max(len(c.levels) for c in cs) > 2
    inside = None
    for c in cs:
        hit = c.contains(universe["key"])
        inside = hit if inside is None else inside | hit
    assert sorted(r["key"] for r in universe.where(inside).collect()) == sorted(keys)


def test_chat_round_trip(spark):
    odd = ["", None, "\\", "a\\", "</turn>", "x</turn>\ny", "### user: hi", "#### z", "\\n \\\\", "### Assistant: </turn> ok", "<\\/turn>", "é</turn", "line\n### x"]
    rows = [(1, i, ("user", "assistant", "a:b", None, "w\\")[i % 5], t) for i, t in enumerate(odd)] + [(2, 0, "user", "hi"), (2, 0, "user", "hi"), (None, None, "assistant", "lost")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, t string, turns string")
    got = {r["conv_id"]: r for r in chat.format_chat(df).withColumn("back", chat.parse(chat.F.col("formatted"))).collect()}
    assert [(x["role"], x["text"]) for x in got[1]["back"]] == [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    assert len(got[2]["back"]) == 2 and len(got[None]["back"]) == 1
    f, spans = got[1]["formatted"], got[1]["loss_spans"]
    assert [re.sub(r"(?s)\\(.)", r"\1", f[s["start"] : s["start"] + s["length"]]) for s in spans] == [r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant"]
    assert "\n### user: hi</turn>" not in f.replace("### user: </turn>", "")
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_with_long_roles_texts_and_many_turns(spark):
    many = [(1, i, "assistant" if i % 2 else "user", f"t{i} ### x") for i in range(20_000)]
    long = [(2, 0, "r" * 200_000, "x"), (2, 1, ":" * 100_000, "y"), (2, 2, "\\" * 100_000, "\\:" * 100_000), (2, 3, "assistant", "</turn>\n### a: " * 30_000)]
    df = spark.createDataFrame(many + long, "conv_id long, turn long, role string, text string")
    for r in chat.format_chat(df).withColumn("back", chat.parse(chat.F.col("formatted"))).collect():
        want = [(x[2], x[3]) for x in (many if r["conv_id"] == 1 else long)]
        assert [(x["role"], x["text"]) for x in r["back"]] == want
        f = r["formatted"]
        assert [re.sub(r"(?s)\\(.)", r"\1", f[s["start"] : s["start"] + s["length"]]) for s in r["loss_spans"]] == [t for who, t in want if who == "assistant"]


def test_decontamination(spark):
    item = "In the summer of 1994 Maria walked 12 km from the old mill to the river bank and rested there with Paul for two hours"
    other = "the quick brown foxes never jumped over those seven lazy dogs because rain fell down hard"
    bench = spark.createDataFrame([(1, item, "k"), (2, other, "k"), (3, None, "k"), (4, "too short", "k"), (5, "five words stand right here", "k")], "item_id long, text string, key string")
    changed = item.replace("1994", "2003").replace("Maria", "Berta").replace("12 km", "30 miles").replace("Paul", "Otto")
    mixed = "we saw Anna walk and then Anna walked past Carl at noon"
    rows = [(10, f"Start. {item} end of it"), (11, f"some words {changed} more words"), (12, other.upper()), (13, "a clean text about nothing at all " * 20), (14, None), (15, ""), (16, f"junk\n{other}!\n junk"), (17, "x five words stand right here y"), (18, " ".join(other.split()[:7])), (19, mixed), (10, f"Start. {item} end of it")]
    docs = spark.createDataFrame([(*r, "c", "d", 1) for r in rows], "doc_id long, text string, key string, window string, n int")
    for most in (200_000, 0):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench, broadcast=most).collect()}
        assert got == {(10, 1), (11, 1), (12, 2), (16, 2), (17, 5)}
    same = {r["doc_id"]: r["same_values"] for r in decontam.matches(docs, bench).collect()}
    assert same[10] and not same[11]
    assert {r["doc_id"] for r in decontam.clean_only(docs, bench).collect()} == {13, 14, 15, 18, 19}
    assert decontam.matches(docs.limit(0), bench).count() == 0 and decontam.matches(docs, bench.limit(0)).count() == 0


def test_verbatim_copies_are_always_found(spark):
    items = {1: "Compute 12 + 34 * 5 - 6 / 2", 2: "Name three primes", 3: "Explain why the sky looks blue today", 4: "1 2 3 4 5 6 7 8 9 10 11 12", 5: "Anna", 6: "Divide 7 by 2 then 9 by 3 and 8 by 4 or 6"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = [(i, f"some words before {t} some words after") for i, t in items.items()] + [(10 + i, f'x "{t}".') for i, t in items.items()] + [(30, "Compute 13 + 34 * 5 - 6 / 2"), (31, "name three even primes"), (32, "annas")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (200_000, 0):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench, broadcast=most).collect()}
        assert got == {(i + k, i) for i in items for k in (0, 10)}
    assert {r["doc_id"] for r in decontam.clean_only(docs, bench).collect()} == {30, 31, 32}


def test_every_window_that_matches_is_sought(spark):
    items = {1: "Who wrote Anna Karenina", 2: "Tom likes 5 apples", 3: "They gave her 120 red coins and then went back home", 4: "Find m of l with s at g", 5: "the green fox jumps over seven lazy brown dogs at dawn", 6: "Paul Anna Maria Otto Berta sang loudly", 7: "m l s 5"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = [(i, f"some words before: {items[i]}. some words after") for i in (1, 2, 4, 6, 7)]
    rows += [(12, "we saw that Berta likes 7 apples now"), (13, items[3].replace("120", "two hundred and five")), (15, f"x {items[5].title()} y"), (25, items[5].replace("fox", "f\u0001ox")), (31, "Who wrote Emma Bovary"), (32, "Tom sells 5 apples"), (17, "so m l s 8 there"), (33, "m l g 5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for kept in (items, {i: t for i, t in items.items() if i != 7}):
        for most in (200_000, 0):
            got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench.where(F.col("item_id").isin(*kept)), broadcast=most).collect()}
            assert got == {(d, d % 10) for d in (1, 2, 4, 6, 7, 12, 13, 15, 17, 25) if d % 10 in kept}


def test_a_changed_value_drops_its_windows_only(spark):
    item = "On 12 of the shelves we keep old books about the sea and its many fish and on another 12 of them we keep new maps of the wide land with all rivers and hills drawn in ink by hand"
    docs = spark.createDataFrame([(1, "w " + item.replace("another 12", "another 13")), (2, "w " + item.replace("12", "14")), (3, "w " + item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for most in (200_000, 0):
        got = {r["doc_id"]: r for r in decontam.matches(docs, bench, broadcast=most).collect()}
        assert set(got) == {1, 2, 3}
        assert got[1]["n_windows"] == got[1]["item_windows"] and not got[1]["same_values"]  # those with the old value are unchanged
        assert got[2]["coverage"] > 0.9 and not got[2]["same_values"] and got[3]["coverage"] > 0.9 and got[3]["same_values"]
    names = "then Anna gave seven red apples to the old farmer and so Anna asked whether he liked what Anna grew there at home"
    docs = spark.createDataFrame([(1, "w " + names.replace("Anna", "Dora").replace("what Dora", "what Emil"))], "doc_id long, text string")
    (r,) = decontam.matches(docs, spark.createDataFrame([(1, names)], "item_id long, text string")).collect()
    assert 6 <= r["n_windows"] < r["item_windows"] and not r["same_values"]


def test_reparameterised_questions(spark):
    items = {
        1: "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have now?",
        2: "A train leaves New York at 9 and covers 1 000 miles in twenty five hours before it gets to Boston",
        3: "What is the capital of France?",
        4: "Mary Ann Smith sold eighty-five cakes and John sold 12 of them back to Mary Ann Smith on the same day",
    }
    rows = [
        (10, "x " + items[1].replace("Tom", "Sam").replace("5", "9")),
        (11, "Sam has twelve apples. Sam buys 3 more. How many apples does Sam have now? End."),
        (12, "so " + items[2].replace("New York", "Chicago").replace("1 000", "750").replace("twenty five", "eleven").replace("Boston", "Salt Lake City").replace("miles", "km")),
        (13, "Well. What is the capital of France? Paris is."), (14, "Rome is the capital of Italy."),
        (15, "Then " + items[4].replace("Mary Ann Smith", "Rob").replace("John", "Al Green").replace("eighty-five", "7")),
        (16, items[4].upper()), (17, items[2].lower()),
        (18, "Tom has a dog. Sam buys food. How many days does the food last?"), (19, "nothing of the kind, only 5 apples and 1 000 miles in New York"),
    ]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (200_000, 0):
        got = {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontam.matches(docs, bench, broadcast=most).collect()}
        assert got == {(10, 1): False, (11, 1): False, (12, 2): False, (13, 3): True, (15, 4): False, (16, 4): True, (17, 2): True}


def _plain_words(text):
    out = []
    for w in (text or "").split():
        core = re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", w.lower())
        out.append(core or w.lower())
    return out


def test_decontamination_finds_what_brute_force_finds(spark):
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    items = {i: " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) for i in range(25)}
    docs = []
    for k in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        if k % 2:
            part = items[rng.randrange(25)].split()
            a = rng.randrange(len(part))
            w[len(w) // 2 : len(w) // 2] = part[a : a + rng.randint(1, 25)] if k % 4 == 1 else part
        docs.append((k, " ".join(w)))
    want = set()
    for d, text in docs:
        mine = _plain_words(text)
        for i, t in items.items():
            it = _plain_words(t)
            n = min(8, len(it))
            have = {tuple(mine[p : p + n]) for p in range(len(mine) - n + 1)}
            wins = [tuple(it[q : q + n]) for q in range(len(it) - n + 1)]
            hits = sum(w in have for w in wins)
            if hits and (2 * hits >= len(wins) or hits >= 6):
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == want and len(want) > 30


def test_slots_must_be_consistent(spark):
    item = "then Anna gave Bert seven apples and so Anna asked whether Bert liked what Anna grew there at home"
    bad = item.replace("Bert", "Carl", 1)
    docs = spark.createDataFrame([(1, "w " + item), (2, "w " + item.replace("Anna", "Dora")), (3, "w " + bad.replace("Anna gave", "Emil gave"))], "doc_id long, text string")
    got = {r["doc_id"] for r in decontam.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert {1, 2} <= got


def test_warc_round_trip(spark, tmp_path):
    html = "<!DOCTYPE html><html><head><title>T &amp; U</title><script>no()</script></head><body><p>One</p><p>Two&nbsp;x</p><a href='/l?a=1&amp;b=2'>link</a><!-- c --></body></html>"
    pages = spark.createDataFrame([(1, "http://a.b/c d", html, "z"), (2, None, None, "z"), (None, "http://x", "", "z"), (1, "http://a.b/c d", html, "z")], "page_id long, url string, html string, block string")
    rows = warc.derivatives(pages).collect()
    assert len(rows) == 12
    for r in rows:
        ((head, block),) = warc.parse(bytes(r["raw"]))
        assert head["WARC-Record-ID"] == r["record_id"] and head.get("WARC-Refers-To") == r["refers_to"]
        assert warc.digest(block) == head["WARC-Block-Digest"] == r["block_digest"] and len(block) == int(head["Content-Length"]) == r["content_length"]
    by = {r["record_type"]: r for r in rows if r["page_id"] == 1}
    assert bytes(by["conversion"]["block"]).decode() == "One\nTwo x\nlink"
    assert by["conversion"]["refers_to"] == by["metadata"]["refers_to"] == by["response"]["record_id"]
    assert b"outlink: /l?a=1&b=2\r\n" in bytes(by["metadata"]["block"]) and by["response"]["payload_digest"].encode() in bytes(by["metadata"]["raw"])
    warc.write_warc(warc.derivatives(pages), str(tmp_path / "w"))
    again = [r for f in (tmp_path / "w").glob("part-*") for r in warc.parse(f.read_bytes())]
    assert sorted(h["WARC-Record-ID"] for h, _ in again) == sorted(r["record_id"] for r in rows)
    assert all(warc.digest(b) == h["WARC-Block-Digest"] for h, b in again)
    assert warc.derivatives(pages.limit(0)).count() == 0


def test_warc_scan_is_linear_and_hides_scripts(spark):
    import time

    for bad in ("<script>", "<!-- ", "<head>", "<title>", "<a href='", "<a ", "<", "<style ", "<noscript>x", "<p", "<title>x</titl", "&", "</"):
        began = time.time()
        warc.derive(1, "u", bad * 200_000)
        assert time.time() - began < 5, bad
    assert warc.plain_text("a<script>var x=1;") == "a" and warc.plain_text("a<style>b{}</style >c") == "a c"
    assert warc.plain_text("x < y <b>bold</b> 1<2 <!-- <p> --> &lt;ok&gt;") == "x < y bold 1<2 <ok>"
    assert warc.scan("<HEAD><TITLE> a\n&amp; b </TITLE><base></HEAD><P>İt<A class=x HREF = 'Q?a&amp;b'>l</A><a href=z>m</a>")[:] == ("İtlm", "a & b", ["Q?a&b", "z"])
    assert warc.scan("<head><p>in head") == ("in head", None, []) and warc.scan("") == ("", None, [])
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>b"), (1, "", "<p>a"), (1, None, "<p>a"), (None, "u", "<p>a"), (1, "u", ""), (1, "u", None)], "page_id long, url string, html string")
    rows = warc.derivatives(pages).collect()
    ids = {(r["page_id"], r["target_uri"], r["payload_digest"] if r["record_type"] == "response" else r["refers_to"], r["record_type"]): r["record_id"] for r in rows}
    assert len(set(ids.values())) == 18  # null and empty html are one payload


def brute_kernel(s, t):
    from itertools import combinations

    return sum(toxicity.DECAY ** (a[2] - a[0] + b[2] - b[0] + 2) for a in combinations(range(len(s)), 3) for b in combinations(range(len(t)), 3) if all(s[x] == t[y] for x, y in zip(a, b, strict=True)))


def test_kernel_is_the_subsequence_kernel():
    a, b = b"stuupid", b"stupid"
    assert abs(toxicity.Basis([a, b]).gram()[0, 1] - brute_kernel(a, b) / (brute_kernel(a, a) * brute_kernel(b, b)) ** (toxicity.SCALE / 2)) < 1e-6


def test_folded_weights_are_the_nystroem_map():
    rng = np.random.default_rng(3)
    marks = [b"`abcde`", b"`fghij`", b"`klmno`", b"`aabaa`"]
    basis = toxicity.Basis(marks)
    values, axes = np.linalg.eigh(basis.gram())
    root = axes / np.sqrt(values)
    x = [b"`abxcde`", b"`zfgij`", b"`qqq`", b"`a`", b"`abaab`"]
    w = rng.normal(size=4)
    scaled = lambda u, v: brute_kernel(u, v) / (brute_kernel(u, u) * brute_kernel(v, v)) ** (toxicity.SCALE / 2)
    kernel = np.array([[scaled(u, v) for v in marks] for u in x])
    assert np.allclose(basis.kernel(x), kernel, atol=1e-5)
    assert np.allclose(kernel @ root @ w, toxicity.weigh(x, basis.table(root @ w)), atol=1e-4)


ALIKE = ("student", "stump", "molar", "trace", "crash", "ideal", "scam", "idol", "more")
INSULTS = ("moron", "stupid", "scum", "idiot", "trash")


def _toxic(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = ["".join(rng.choice(["en", "er", "th", "ou", "la", "ti"]) for _ in range(rng.randint(1, 3))) for _ in range(30)]
        if i % 3 == 0:
            w[rng.randrange(30)] = rng.choice(INSULTS)
        elif i % 5 == 0:
            w[rng.randrange(30)] = rng.choice(ALIKE)
        out.append((i, " ".join(w), int(i % 3 == 0)))
    return out


def test_toxicity_held_out_and_gaps(spark):
    rows = _toxic(1200, 4)
    df, _ = documents(spark)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").unionByName(df.select((df.doc_id + 10_000).alias("doc_id"), "text"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None), (999_999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    y = {i: t for i, _, t in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in y]
    assert len(held) > 60 and sum(r["predicted"] == y[r["doc_id"]] for r in held) / len(held) > 0.98
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def grown(w, n):
        for _ in range(n):
            i = rng.randrange(1, len(w))
            w = w[:i] + rng.choice(letters) + w[i:]
        return w

    def cut(w, by):
        i = rng.randrange(1, len(w))
        return w[:i] + by + w[i:]

    kinds = [lambda w: w, str.upper, lambda w: grown(w, 1), lambda w: grown(w, 2), lambda w: grown(w, 3), lambda w: cut(w, " "), lambda w: cut(w, "-"), "  ".join, ".".join, lambda w: w.replace("o", "0"), lambda w: w[:2] + w[3:]]
    clean = [t for _, t, y in rows if not y and not any(x in t for x in INSULTS)]
    for k, kind in enumerate(kinds):
        texts = []
        for i in range(100):
            w = rng.choice(clean).split()[:12]
            w.insert(rng.randrange(13), kind(INSULTS[i % len(INSULTS)]))
            texts.append(" ".join(w))
        assert (model.scores(texts) >= 0.5).mean() >= 0.9, k
    assert (model.scores(clean) >= 0.5).mean() < 0.02
    assert (model.scores(["the other theory", *ALIKE, "students", "scheme", "moral", "thorough"]) < 0.5).all()
    clean = toxicity.clean_only(docs, labels)
    assert clean.columns == docs.columns and clean.where("text is null").count() == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    twice = toxicity.train(docs.unionByName(docs.where("doc_id < 40")), labels)
    assert np.array_equal(twice.table, model.table) and (twice.bias, twice.slope, twice.shift) == (model.bias, model.slope, model.shift)
    none = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}


def test_quality_score_is_the_density_ratio(spark):
    rng = np.random.default_rng(5)
    x = {c: rng.normal(size=(60, quality.D)) @ rng.normal(size=(quality.D, quality.D)) + c for c in (0, 1)}
    rows = [(c, *map(float, r)) for c in x for r in x[c]]
    model = quality.fit(spark.createDataFrame(rows, "y int, " + ", ".join(f"x{k} double" for k in range(quality.D))))
    cov = [np.cov(x[c].T, bias=True) for c in (0, 1)]
    pooled = (cov[0] + cov[1]) / 2
    log = []
    probe = rng.normal(size=(40, quality.D)) * 3
    for c in (0, 1):
        s = (1 - quality.RIDGE) * ((1 - quality.SHRINK) * cov[c] + quality.SHRINK * pooled) + quality.RIDGE * np.diag(np.diag(pooled) + 1e-3)
        d = probe - x[c].mean(axis=0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1] + np.log(0.5))
    assert np.allclose(model.score(probe), 1 / (1 + np.exp(-np.clip(log[1] - log[0], -700, 700))), atol=1e-9)
    assert np.allclose(model.chol[0] @ quality.solve_lower(model.chol[0], probe.T), probe.T)


def test_quality_with_several_texts_of_a_document_is_the_same_in_each_run(spark):
    rng = random.Random(2)
    rows = [(i % 50, " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 50)))) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    run = lambda n: sorted(map(str, quality.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels).select("doc_id", "predicted").collect()))
    assert run(3) == run(5)


def test_quality_held_out(spark):
    rng = random.Random(9)
    rows = []
    for i in range(500):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
        bad = i % 4 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else ". ".join(" ".join(w[k : k + 6]) for k in range(0, len(w), 6)), int(not bad)))
    df, _ = documents(spark)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").unionByName(df.select((df.doc_id + 10_000).alias("doc_id"), "text"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (2, None), (3, 0), (3, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    y = {i: t for i, _, t in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in y]
    assert len(got) == docs.count() and len(held) > 100
    assert sum(r["predicted"] == y[r["doc_id"]] for r in held) / len(held) > 0.97
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty(spark), labels).count() == 0
