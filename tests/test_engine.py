import random

import pytest

from typoforge.config import Config, platform, register_platform
from typoforge.operators.fixpoint import greedy_losers, kernel
from typoforge.plans import sinks
from typoforge.plans.engine import KEY, Engine
from typoforge.plans.solver import solve


def test_kernel_is_the_ordered_greedy(spark):
    rng = random.Random(1)
    for n in (1, 12, 40):
        nodes = [f"n{i:03}" for i in range(n)]
        edges = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if rng.random() < 0.1]
        gone = set()
        for v in nodes:
            if any(b == v and a not in gone for a, b in edges):
                gone.add(v)
        got = kernel(spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(edges, "u string, v string"))
        assert {r["id"] for r in got.collect()} == set(nodes) - gone


def test_greedy_pairs_are_taken_in_order(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = []
        for k in range(80):
            a, b = rng.sample(range(20), 2)
            edges.append((f"n{a}", f"n{b}", f"n{rng.choice([a, b])}", k))
        out = set()
        for a, b, loser, _ in edges:
            if a not in out and b not in out:
                out.add(loser)
        got = greedy_losers(spark.createDataFrame(edges, "a string, b string, loser string, k int"), ["k"])
        assert {r["x"] for r in got.collect()} == out


def small(spark, **config):
    text = " ".join(["the"] * 60 + ["their"] * 40 + ["other"] * 30 + ["and"] * 50 + ["android"] * 20 + ["train"] * 12 + ["containing"] * 8 + ["maintain"] * 7)
    docs = spark.createDataFrame([("en", text), ("de", "nicht die der"), (None, None)], "lang string, text string")
    bench = spark.createDataFrame([("hello hello hello hello world",)], "text string")
    return Engine(spark, docs, bench, Config(**{"top_n": 10, "platform": "qmk", "max_corrections": 500, "typo_freq_threshold": 3} | config))


def test_rules_on_a_small_text(spark):
    e = small(spark)
    assert {r["word"] for r in e.user.collect()} == {"hello"}
    assert {r["word"] for r in e.source.collect()} == {"the", "their", "other", "and", "android", "train", "containing", "maintain"}
    got = {tuple(r) for r in e.corrections.select(*KEY).collect()}
    assert ("teh", "the", "none") in got and ("tehir", "their", "none") in got
    assert all(t != w for t, w, _ in got)
    kept = {tuple(r) for r in e.unblocked.collect()}
    assert ("teh", "the", "none") in kept and ("tehir", "their", "none") not in kept
    final = [tuple(r) for r in e.final.collect()]
    assert len(final) == len(set(final))
    texts = [(":" if b in ("left", "both") else "") + t + (":" if b in ("right", "both") else "") for t, _, b in final]
    assert not [1 for a in texts for b in texts if a != b and a in b]


def test_long_typos_are_found_inside_longer_words(spark):
    long = "extraordinarily"
    docs = spark.createDataFrame([("en", " ".join([f"un{long[:-1]}", f"{long[:-1]}ness", "other"] * 6))], "lang string, text string")
    e = Engine(spark, docs, spark.createDataFrame([(" ".join([long] * 4),)], "text string"), Config(top_n=5, platform="qmk", max_corrections=500, typo_freq_threshold=3))
    flags = {r["typo"]: r.asDict() for r in e.flags.where("length(typo) > 12").collect()}
    valid, words = ({r["word"] for r in x.collect()} for x in (e.valid, e.words))
    assert flags
    for t, f in flags.items():
        for tag, among in (("v", valid - {t}), ("s", words - {t})):
            assert (f[f"{tag}_start"], f[f"{tag}_end"], f[f"{tag}_sub"]) == (any(w.startswith(t) for w in among), any(w.endswith(t) for w in among), any(t in w for w in among))
    assert any(f["v_start"] for f in flags.values()) and any(f["v_end"] for f in flags.values())
    assert {r["boundary"] for r in e.corrections.where(f"typo = '{long[:-1]}'").collect()} <= {"both"}


def sequential_final(e, rtl, form):
    """The rules left by a pass, pair by pair."""
    valid, words = ({r["word"] for r in x.collect()} for x in (e.valid, e.words))
    rules = [(*tuple(r), form(r["typo"], r["boundary"])) for r in e.unblocked.select(*KEY).collect()]
    tight = {"none": 0, "left": 1, "right": 1, "both": 2}

    def fires(t, w, b):
        among = [x for x in valid | words if x != t] + [w]
        start, end = any(x.startswith(t) and x != t for x in among), any(x.endswith(t) and x != t for x in among)
        inside = any(t in x for x in among if x != t)
        return {"none": inside, "left": start, "right": end, "both": False}[b]

    pairs = sorted((b[3], a[3], b[1], a[1], b[2], a[2], a, b) for a in rules for b in rules if a[3] != b[3] and a[3] in b[3])
    gone = set()
    for *_, a, b in pairs:
        if a in gone or b in gone:
            continue
        s, n = tight[a[2]], tight[b[2]]
        short = not rtl if s == n else fires(*a[:2], a[2]) if s < n else not fires(*b[:2], b[2])
        gone.add(a if short else b)
    return [r[:3] for r in rules if r not in gone], len(gone)


def test_final_queries_run_after_the_pair_removal(spark):
    from typoforge.plans import queries as Q

    e = small(spark, max_corrections=40)
    run = lambda name: [tuple(r) for r in Q.QUERIES[name][0](e).collect()]
    text = lambda t, b: ":" * (b in ("left", "both")) + t + ":" * (b in ("right", "both"))
    left, gone = sequential_final(e, True, text)
    assert gone
    user = {r["word"] for r in e.user.collect()}
    patterns = {(r["typo"], r["word"]) for r in e.patterns.collect()}
    freq = {r["word"]: r["freq"] for r in e.lex.collect()}
    replaced = [tuple(r) for r in e.replacements.select("pattern_typo", "pattern_word", "boundary", "word").collect()]
    rank = []
    for t, w, b in left:
        tier = 0 if w in user else 1 if (t, w) in patterns else 2
        rank.append((tier, -(sum(freq.get(x[3], 0) for x in replaced if x[:3] == (t, w, b)) if tier == 1 else freq.get(w, 0)), t, w, b))
    rank.sort()
    assert sorted(run("final_rank_tiers")) == sorted((t, w, b, tier) for tier, _, t, w, b in rank)
    want = [(k + 1, t, w, b, tier, -s) for k, (tier, s, t, w, b) in enumerate(rank[:40])]
    assert len(rank) > 40 and sorted(run("final_rank_qmk")) == want
    assert sorted(run("final_rank_topk")) == [x[:4] for x in want]
    assert sorted(run("final_out_qmk_lines")) == sorted({(w, f"{text(t, b)} -> {w}") for _, t, w, b, _, _ in want})
    assert {(r[0], r[1]) for r in run("final_rep_qmk")} == {(k, sum(x[4] == k for x in want)) for k in {x[4] for x in want}}
    o = Q._espanso(e)
    left, gone = sequential_final(o, False, lambda t, b: t)
    assert gone and sorted(run("final_rank_espanso")) == sorted(left)
    assert sorted((r[0], r[1]) for r in run("final_out_espanso_rows")) == sorted((t, w) for t, w, _ in left)
    count = {x: sum(w[0] == x for _, w, _ in left) for x in {w[0] for _, w, _ in left}}
    assert dict(run("final_out_by_letter")) == count and {r[0]: r[1] for r in run("final_rep_espanso")} == count
    assert sum(r[2] for r in run("final_out_chunking")) == len(left)


def test_solver_converges(spark):
    r = solve(small(spark), 8)
    assert r.converged and r.rules.count() > 0 and r.graveyard.count() > 0
    assert r.rules.join(r.graveyard, KEY).count() == 0


def test_sinks(spark, tmp_path):
    e = small(spark)
    files = sinks.write_espanso(e.unblocked, str(tmp_path / "y"), 20)
    text = "".join((tmp_path / "y" / f).read_text() for f in files)
    assert text.count("trigger:") >= len(files)
    lines = open(sinks.write_qmk(e.final, str(tmp_path))).read().splitlines()
    assert lines and all(" -> " in x for x in lines) and [x.split(" -> ")[1] for x in lines] == sorted(x.split(" -> ")[1] for x in lines)


def test_config_and_platforms(tmp_path):
    with pytest.raises(ValueError):
        Config(min_word_length=5, max_word_length=4)
    with pytest.raises(ValueError):
        platform("none such")
    register_platform("plain", platform("espanso"))
    assert platform("plain").direction == "ltr" and Config(platform="plain").platform == "plain"
    with pytest.raises(ValueError):
        Config(platform="none such")
    with pytest.raises(ValueError):
        Config(platform="qmk")
    plain = Config()
    assert (plain.top_n, plain.max_corrections, plain.max_entries_per_file, plain.typo_freq_threshold, plain.freq_ratio, plain.platform) == (None, None, 500, 0.0, 10.0, "espanso")
    assert Config(freq_ratio=2.5).freq_ratio == 2.5
    p = tmp_path / "c.json"
    p.write_text('{"top_n": 7, "min_typo_length": 5}')
    assert Config.load(str(p), top_n=9).top_n == 9 and Config.load(str(p)).min_typo_length == 5


def test_files_of_equal_names_are_told_apart(spark, tmp_path):
    rules = [(f"t{i:03}", "word", "none") for i in range(120)] + [(f"x{i}", "wore", "left") for i in range(3)] + [('q"\\', "é\n", "both")]
    df = spark.createDataFrame(rules, "typo string, word string, boundary string")
    names = [r["file"] for r in sinks.chunks(df, 50).collect()]
    assert len(names) == len(set(names)) == 4
    files = sinks.write_espanso(df, str(tmp_path / "y"), 50)
    assert sorted(files) == sorted(names) and not list((tmp_path / "y").glob(".*"))
    text = "".join((tmp_path / "y" / f).read_text() for f in files)
    assert text.count("trigger:") == 124 and '  - trigger: "q\\"\\\\"\n    replace: "é\\n"\n    propagate_case: true\n    word: true\n' in text


def test_all_words_mode(spark):
    e = small(spark, top_n=None)
    assert {r["word"] for r in e.source.collect()} == {"the", "their", "other", "and", "android", "train", "containing", "maintain", "hello"}
    assert {r["word"] for r in small(spark, top_n=None, max_word_length=5).source.collect()} == {"the", "their", "other", "and", "train", "hello"}


def test_corruption_next_to_marks(spark):
    from typoforge.operators import ngrams as N

    words = ["don't", "rock-ish", "plain", "x"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for side in ("prefix", "suffix"):
        got = {r["gram"] for r in N.affixes(N.parts(df, side), side, False).collect()}
        want = set()
        for w in words:
            for i in range(len(w)):
                for k in range(i + 1, len(w) + 1):
                    edge = i == 0 or not w[i - 1].isalpha() if side == "prefix" else k == len(w) or not w[k].isalpha()
                    if edge:
                        want.add(w[i:k])
        assert got == want


def test_passes_can_be_left_out_and_added(spark):
    from typoforge.plans import reports as R
    from typoforge.plans.passes import PASSES, Pass

    e = small(spark)
    rules = lambda x: {tuple(r) for r in x.final.collect()}
    none = Engine(e.spark, e.documents, e.benchmark, e.config, passes=())
    assert rules(none) == {tuple(r) for r in none.rules.collect()} and none.passed[1].count() == 0
    short = Pass("no_short", lambda e, r: (r.where("length(typo) > 3"), r.where("length(typo) <= 3").selectExpr("*", "'short' AS reason", "CAST(NULL AS STRING) AS blocker")))
    more = Engine(e.spark, e.documents, e.benchmark, e.config, passes=(*PASSES, short))
    assert rules(more) == {r for r in rules(e) if len(r[0]) > 3} != rules(e)
    assert more.graveyard.where("pass = 'no_short'").count() == sum(len(r[0]) <= 3 for r in rules(e))
    assert R.history(more).where("pass = 'no_short'").select("pass_no").distinct().collect()[0][0] == 6
    turned = Engine(e.spark, e.documents, e.benchmark, e.config, passes=PASSES[::-1])
    texts = [(":" if b in ("left", "both") else "") + t + (":" if b in ("right", "both") else "") for t, _, b in rules(turned)]
    assert not [1 for a in texts for b in texts if a != b and a in b]


def test_tracing(spark):
    from typoforge.plans import reports as R

    e = small(spark, debug_words=("The",), debug_typos=("adn*", "*zz"))
    all_ = {tuple(r) for r in e.corrections.select(*KEY).collect()}
    assert {tuple(r)[:3] for r in R.debug_corrections(e).select(*KEY).collect()} == {r for r in all_ if r[1] == "the" or r[0].startswith("adn")}
    assert {r["word"] for r in R.lifecycle(e, "words").collect()} == {"the"}
    assert all(r["typo"].startswith("adn") for r in R.lifecycle(e, "typos").collect())
    with pytest.raises(ValueError):
        R.lifecycle(e, "none such")


def test_reports_of_runs_do_not_meet(spark, tmp_path):
    from datetime import datetime

    from typoforge.plans import reports as R

    e = small(spark, debug_words=("the",))
    a = R.write_reports(e, str(tmp_path), "qmk", {"solver": 2.0}, datetime(2024, 1, 2, 3, 4, 5))
    assert all(x.startswith(f"{tmp_path}/2024-01-02_03-04-05_qmk/") for x in a) and len(a) == len(set(a)) == 18
    assert spark.read.option("header", True).csv(f"{tmp_path}/2024-01-02_03-04-05_qmk/times").count() == 2
    n = spark.read.option("header", True).csv(f"{tmp_path}/2024-01-02_03-04-05_qmk/ranking_list").count()
    assert n == e.ranked_rules.count() > 0


def test_command_line(spark, tmp_path, caplog):
    from typoforge import cli

    e = small(spark)
    e.documents.write.parquet(f"{tmp_path}/d.parquet")
    e.benchmark.write.parquet(f"{tmp_path}/b.parquet")
    base = ["--documents", f"{tmp_path}/d.parquet", "--benchmark", f"{tmp_path}/b.parquet"]
    args = cli.create_parser().parse_args([*base, "--freq-ratio", "2.5", "--all-words", "--top-n", "3", "--debug-words", "a, b"])
    c = cli.settings(args)
    assert (c.freq_ratio, c.top_n, c.debug_words, c.platform) == (2.5, None, ("a", "b"), "espanso")
    assert cli.main([*base, "--output", f"{tmp_path}/out", "--max-iterations", "1", "--log-file", f"{tmp_path}/log", "--typo-freq-threshold", "3"]) == 0
    assert list((tmp_path / "out").glob("*.yml")) and "settled" in (tmp_path / "log").read_text()
    assert cli.main([*base, "--include", f"{tmp_path}/none.txt"]) == 1
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\n")
    assert cli.main([*base, "--include", f"{tmp_path}/bad.txt"]) == 1


def test_names():
    from typoforge.functions.names import human_time, safe_name

    assert [human_time(x) for x in (0.0123, 2.34, 125)] == ["12ms", "2.3s", "2m 5.0s"]
    assert safe_name('a/b:*c"') == "a_b__c_" and safe_name("") == "_" and len(safe_name("x" * 300)) == 100
