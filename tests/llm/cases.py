"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, chunk int, shard int, fp string, rep string, word string, size string, n int, key string, q int, y int, x0 int, host string, target string, taken string, order string"


def words(rng, n, stem="abcdefgh"):
    return " ".join("".join(rng.choice(stem) for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, seed=1, n=40):
    rng = random.Random(seed)
    shared = words(rng, 60)
    rows = []
    for i in range(n):
        t = words(rng, rng.randint(5, 120))
        if i % 5 == 0:
            t = t + " " + shared + " " + words(rng, 10)
        if i % 7 == 3:
            t = rows[-1][1]
        rows.append((i, t, "en", rng.choice(["a", "b", "ü", None]), len(t or "")))
    rows += [(n, None, None, None, None), (n + 1, "", "", "", 0), (n + 2, "one", "de", "a", 3), (n + 3, "é" * 300, "fr", "b", 300), (None, "no id here", "en", "a", 10), (n + 4, words(rng, 20_000), "en", "a", None), (n + 5, "twice " * 40, "en", "b", 1), (n + 5, "twice " * 40, "en", "b", 1), (n + 6, "x\t \ny  z\x0b", "en", "a", 1)]
    return spark.createDataFrame([(*r, *["clash" if c not in (7, 8, 13, 15, 16, 17) else 1 for c in range(5, 22)]) for r in rows], DOCS), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)
