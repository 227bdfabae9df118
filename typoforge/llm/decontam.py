r"""Benchmark decontamination by template canonicalisation, with DataFrame expressions only.

Tokens: runs of letters and digits; neighbouring capitalised words are one token ("New York"), as are the groups of a
number ("1 000", "2.5") and spelled-out numbers ("twenty five"). Canonical form, one word for each token: a capitalised
word, at the start of a sentence too, becomes a name slot, if it is none of ``STARTERS`` nor all in capitals; a number in
digits or letters a number slot; a unit after a number a unit slot; the rest is lower-cased. So the form does not hang on
what stands before a passage.

Match: windows of ``WINDOW`` tokens of the benchmark (of the whole item, where it is shorter) are joined by hash with those
of the documents and compared, on two paths:

* templates: windows of ``SHORTEST`` tokens or more, at least half of them literal, as slots match anything. Those of a
  document and an item on one diagonal (document place minus item place) must be consistent in their slots: each raw value
  of the item stands for one value of the document, and the other way round. Where values differ, the pair that most
  windows hold counts for both (of equals the unchanged one, then the greater), and windows with another pair are dropped,
  the rest of the diagonal is not. Windows with all values unchanged always count;
* verbatim: windows of all items as lower-cased words. So a verbatim copy is always found, also in capitals or without any.

An item is leaked where the windows of a path cover half of that path's windows of the item, or ``ENOUGH`` of them (13
tokens in a row); the path that covers more is reported.

Documents are sought in two steps, as most have nothing of the benchmark:

1. All texts are split at once, and hashes of words in a row are joined with one of each benchmark window. Verbatim windows
   are sought in all words, lower-cased: a whole window of ``WINDOW`` words, of shorter items the first ``RUN``. Templates
   are sought in the line of words that can't be part of a slot, by their first ``RUN`` such words, or all they have: a
   window that matches has them in a row, whatever its slots hold. If a template has none, all documents go on.
2. The documents found are canonicalised and their windows joined; what moves is (document key, place, hash). The hits of
   a document are put together and compared with its tokens, one row for each document.

The hashes of the benchmark are counted first: up to ``BROADCAST`` they are broadcast, beyond it both sides are shuffled by
hash, without texts; so are the keys of the documents found.

Cases: null and empty texts match nothing; items under ``SHORTEST`` tokens match verbatim only; rows with a null doc_id are
matched and reported with a null id; repeated rows are matched as one document; an empty table gives an empty result;
other columns of either table are ignored; a text, however long, is one array of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, SHORTEST, ENOUGH, COVER, RUN = 8, 4, 6, 0.5, 4
#: Windows of 8 words take some 300 bytes: 60 MB.
BROADCAST = 200_000
#: Keys of documents take 16 bytes: 16 MB.
BROADCAST_KEYS = 1_000_000
# Units that may follow a number.
UNITS = ("kilometers", "kilometres", "kilograms", "centimeters", "centimetres", "meters", "metres", "grams", "liters", "litres", "miles", "pounds", "dollars", "euros", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "percent", "degrees", "inches", "feet", "yards", "km", "kg", "cm", "mm", "mg", "ml", "mph", "lbs", "lb", "oz", "ft", "hrs", "hr", "min", "sec", "usd", "eur", "m", "g", "l", "s", "h")
# Numbers in letters.
NUMERALS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion")
# Words that are no names where a capital starts a sentence.
STARTERS = ("What", "Who", "Whom", "Whose", "How", "When", "Where", "Why", "Which", "The", "An", "In", "On", "At", "If", "For", "From", "To", "By", "With", "Of", "As", "It", "Its", "He", "She", "They", "We", "You", "His", "Her", "Their", "There", "This", "That", "These", "Those", "Is", "Are", "Was", "Were", "Be", "Do", "Does", "Did", "Has", "Have", "Had", "Can", "Could", "Will", "Would", "Should", "May", "And", "But", "Or", "So", "Then", "Not", "No", "Each", "Every", "All", "Some", "Find", "Compute", "Calculate", "Name", "Explain", "Write", "Solve", "Given", "Let", "Suppose", "After", "Before", "During", "While", "Because", "Since", "Assume", "Determine", "Divide", "Prove", "Show", "List", "Describe")
NUMBER, NAME, UNIT, JOIN = "\u0001", "\u0002", "\u0003", "\u0004"
TEMPLATE, VERBATIM = 0, 1
_WORD = r"\p{L}\p{M}\p{N}"
_NAME = rf"(?<![{_WORD}])(?!(?:{'|'.join(STARTERS)})(?![{_WORD}]))\p{{Lu}}\p{{Ll}}[{_WORD}]*+"
_NUMERAL = rf"(?<![{_WORD}])(?i:{'|'.join(sorted(NUMERALS, key=len, reverse=True))})(?![{_WORD}])"


def split_words(text: Column) -> Column:
    """The runs of letters and digits of a text."""
    return F.array_remove(F.split(text, f"[^{_WORD}]++"), "")


def joined(text: Column) -> Column:
    """The tokens of a text, one space between them; those of several words have ``JOIN`` inside."""
    x = F.regexp_replace(text, r"(?<=\p{Nd})[.,](?=\p{Nd})", JOIN)
    x = F.trim(F.regexp_replace(x, f"[^{_WORD}{JOIN}]++", " "))
    x = F.regexp_replace(x, rf"(?<=(?<!\p{{Nd}})\p{{Nd}}{{1,3}}) (?=\p{{Nd}}{{3}}(?![{_WORD}]))", JOIN)
    x = F.regexp_replace(x, rf"({_NUMERAL}) (?:and )?(?={_NUMERAL})", f"$1{JOIN}")
    return F.regexp_replace(x, rf"({_NAME}) (?={_NAME})", f"$1{JOIN}")


def canonical(joined_text: Column) -> Column:
    """One word for each token."""
    x = F.regexp_replace(joined_text, rf"{_NAME}(?:{JOIN}[{_WORD}]++)*+", NAME)
    x = F.regexp_replace(x, rf"(?<![{_WORD}{JOIN}])\p{{Nd}}++(?:{JOIN}\p{{Nd}}++)*+", NUMBER)
    x = F.regexp_replace(x, rf"{_NUMERAL}(?:{JOIN}[{_WORD}]++)*+", NUMBER)
    return F.regexp_replace(F.lower(x), f"(?<={NUMBER}|{NUMBER} )(?:{'|'.join(UNITS)})(?![{_WORD}])", UNIT)


def unmarked(text: str) -> Column:
    """A text without the characters that stand for slots."""
    return F.regexp_replace(text, "[\u0001-\u0004]", "")


def tokens(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, text) -> keys, raw (tokens), canon, plain: arrays, the first two of one length. Texts without words go."""
    df = df.select(*keys, unmarked("text").alias("text"))
    df = df.select(*keys, joined(F.col("text")).alias("joined"), F.transform(split_words(F.col("text")), F.lower).alias("plain")).where(F.size("plain") > 0)
    return df.select(*keys, F.split("joined", " ").alias("raw"), F.split(canonical(F.col("joined")), " ").alias("canon"), "plain")


def literals(words: Column | str) -> Column:
    """The words that are part of no slot: neither names nor numbers, with the "and" inside them, nor what may be a unit."""

    def loose(w: Column) -> Column:
        name = ((w < "a") | (w >= "{")) & w.rlike(r"^\p{Lu}\p{Ll}") & ~w.isin(*STARTERS)
        return (w >= ":") & ~w.rlike(r"^\p{Nd}") & ~name & ~F.lower(w).isin("and", *NUMERALS, *UNITS)

    return F.filter(words, loose)


def _hashes(words: str, path: int, n: int) -> Column:
    """[(place, hash)] of all windows of n of an array of word hashes."""
    return F.transform(_places(words, n), lambda i: F.struct(i.alias("p"), _hash(words, path, n, i).alias("hash")))


def _run_hashes(words: str, path: int, n: int) -> Column:
    return F.transform(_places(words, n), lambda i: _hash(words, path, n, i))


def _places(words: str, n: int) -> Column:
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def _hash(words: str, path: int, n: int, i: Column) -> Column:
    return F.xxhash64(F.lit(path), F.lit(n), F.slice(words, i + 1, n))


def _word_hashes(words: Column | str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _slots(canon: Column, mine: Column, other: Column) -> Column:
    """Of two raw windows: [(slot and value of mine, slot and value of other)] at the slots."""
    word = lambda kind, w: F.concat(kind, F.lower(w))
    three = F.arrays_zip(canon.alias("c"), mine.alias("m"), other.alias("o"))
    kept = F.filter(three, lambda t: t["c"].rlike(f"[{NUMBER}-{UNIT}]"))
    return F.transform(kept, lambda t: F.struct(word(t["c"], t["m"]).alias("m"), word(t["c"], t["o"]).alias("o")))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """benchmark (item_id, text) -> item_id, path, n, q, hash, window (tokens), item_raw, windows (of the item on the path)."""
    t = tokens(benchmark.select("item_id", "text").distinct(), "item_id")
    rows = None
    for path, column in ((TEMPLATE, "canon"), (VERBATIM, "plain")):
        b = t.withColumn("n", F.least(F.lit(n), F.size(column))).withColumn("words", _word_hashes(column))
        every = F.coalesce(*[F.when(F.col("n") == k, _hashes("words", path, k)) for k in range(1, n + 1)])
        b = b.select("item_id", "n", column, "raw", F.explode(every).alias("w"))
        window = F.slice(column, F.col("w.p") + 1, F.col("n"))
        raw = F.slice("raw", F.col("w.p") + 1, F.col("n")) if path == TEMPLATE else F.array().cast("array<string>")
        b = b.select("item_id", F.lit(path).alias("path"), "n", F.col("w.p").alias("q"), F.col("w.hash").alias("hash"), window.alias("window"), raw.alias("item_raw"))
        if path == TEMPLATE:
            literal = F.size(F.filter("window", lambda w: ~w.rlike(f"[{NUMBER}-{UNIT}]")))
            b = b.where((literal * 2 >= F.col("n")) & (F.col("n") >= SHORTEST))
        rows = b if rows is None else rows.unionByName(b)
    # an item id that several texts have counts the windows of all
    total = rows.groupBy("item_id", "path").agg(F.countDistinct("q").alias("windows"))
    on = F.col("b.item_id").eqNullSafe(F.col("t.item_id")) & (F.col("b.path") == F.col("t.path"))
    return rows.alias("b").join(total.alias("t"), on).select("b.*", "t.windows")


def _few(df: DataFrame, most: int):
    """Broadcast, if the table has few rows."""
    return F.broadcast if df.count() <= most else lambda x: x


def candidates(docs: DataFrame, windows: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """docs (doc_id, key, text) -> (doc_id, key) of those that may hold a window of the benchmark. Step 1."""
    from .common import materialize

    # of verbatim windows the words, of templates the first literal ones of the raw tokens
    full = windows.agg(F.max("n")).first()[0] or WINDOW
    plain = windows.where(F.col("path") == VERBATIM).select(F.lit(VERBATIM).alias("path"), F.when(F.col("n") == full, F.col("n")).otherwise(F.least(F.lit(RUN), "n")).alias("r"), _word_hashes("window").alias("h"))
    raw = windows.where(F.col("path") == TEMPLATE).select(literals(split_words(F.array_join("item_raw", " "))).alias("words"))
    raw = raw.select(F.lit(TEMPLATE).alias("path"), F.least(F.lit(RUN), F.size("words")).alias("r"), _word_hashes("words").alias("h"))
    first = lambda path, r: F.when((F.col("path") == path) & (F.col("r") == r), _hash("h", path, r, F.lit(0)))
    lengths = [(TEMPLATE, r) for r in range(1, RUN + 1)] + [(VERBATIM, r) for r in sorted({*range(1, RUN + 1), full})]
    seed = materialize(raw.unionByName(plain).select("path", "r", F.coalesce(*[first(*x) for x in lengths]).alias("hash")).distinct(), "decontam-seeds")
    runs = sorted(tuple(r) for r in seed.select("path", "r").distinct().collect()) or [(VERBATIM, full)]
    if (TEMPLATE, 0) in runs:
        return materialize(docs.select("doc_id", "key").distinct(), "decontam-found")
    h = docs.select("doc_id", "key", split_words(unmarked("text")).alias("words"))
    h = h.select("doc_id", "key", *[_word_hashes(x).alias(c) for c, path, x in (("h", TEMPLATE, literals("words")), ("w", VERBATIM, F.col("words"))) if path in dict(runs)])
    every = [_run_hashes("h" if path == TEMPLATE else "w", path, r) for path, r in runs]
    seen = h.select("doc_id", "key", F.explode(F.concat(*every) if len(every) > 1 else every[0]).alias("hash"))
    hashes = seed.select("hash").distinct()
    return materialize(seen.join(_few(seed, broadcast)(hashes), "hash", "left_semi").select("doc_id", "key").distinct(), "decontam-found")


def matches(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, text), (item_id, text) -> doc_id, item_id, n_windows, item_windows, coverage, same_values for each leak."""
    from .common import materialize

    b = materialize(benchmark_windows(benchmark, n), "decontam-windows")
    near = _few(b, broadcast)
    kinds = sorted(tuple(r) for r in b.select("path", "n").distinct().collect()) or [(TEMPLATE, n)]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    found = candidates(d, b, broadcast)
    on = d["doc_id"].eqNullSafe(found["doc_id"]) & (d["key"] == found["key"])
    t = d.join(_few(found, BROADCAST_KEYS if broadcast else 0)(found), on, "left_semi").dropDuplicates(["doc_id", "key"])
    t = materialize(tokens(t, "doc_id", "key"), "decontam-tokens")
    hashed = t.select("doc_id", "key", _word_hashes("canon").alias("c"), _word_hashes("plain").alias("v"))
    every = F.concat(*[_hashes("c" if path == TEMPLATE else "v", path, k) for path, k in kinds])
    hit = hashed.select("doc_id", "key", F.explode(every).alias("w")).select("doc_id", "key", "w.p", "w.hash").join(near(b), "hash")
    # the hits of a document go to its tokens together
    hit = hit.groupBy("doc_id", "key").agg(F.collect_list(F.struct("item_id", "path", "windows", "n", "q", "p", "window", "item_raw")).alias("hits"))
    both = hit.alias("f").join(t.alias("x"), F.col("f.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("f.key") == F.col("x.key")))
    part = lambda c, x: F.slice(c, x["p"] + 1, x["n"])
    equal = F.filter("hits", lambda x: F.when(x["path"] == TEMPLATE, part("canon", x)).otherwise(part("plain", x)) == x["window"])
    nothing = F.array().cast("array<struct<m:string,o:string>>")

    def compared(x: Column) -> Column:
        slots = F.when(x["path"] == TEMPLATE, _slots(x["window"], x["item_raw"], part("raw", x))).otherwise(nothing)
        return F.struct(x["item_id"].alias("item_id"), x["path"].alias("path"), x["windows"].alias("windows"), x["q"].alias("q"), (x["p"] - x["q"]).alias("diagonal"), slots.alias("slots"))

    found = both.select("f.doc_id", "f.key", F.transform(equal, compared).alias("hits")).select("doc_id", "key", F.explode("hits").alias("hit")).select("doc_id", "key", "hit.*")
    line = ["doc_id", "key", "item_id", "path", "diagonal"]
    found = found.withColumn("same", F.forall("slots", lambda s: s["m"] == s["o"])).repartition(*line)
    slot = found.select("*", F.explode_outer(F.array_distinct("slots")).alias("slot"))
    votes = slot.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*line, "slot.m", "slot.o"))).withColumn("kept", F.col("slot.m") == F.col("slot.o"))
    first = lambda one, other: F.max(F.struct("n", "kept", other)).over(Window.partitionBy(*line, one))
    votes = votes.withColumn("o", first("slot.m", "slot.o")["o"]).withColumn("m", first("slot.o", "slot.m")["m"])
    fits = F.col("same") | ((F.col("slot.m") == F.col("m")) & (F.col("slot.o") == F.col("o")))
    item = ["doc_id", "key", "item_id", "path", "windows"]
    hit = votes.groupBy(*item, "diagonal", "q", "same").agg(F.bool_and(fits).alias("fits")).where("fits")
    leak = hit.groupBy(*item).agg(F.countDistinct("q").alias("n_windows"), F.bool_and("same").alias("same_values"))
    leak = leak.withColumn("coverage", F.col("n_windows") / F.col("windows")).where((F.col("coverage") >= COVER) | (F.col("n_windows") >= ENOUGH))
    # of two paths that cover the same, unchanged values win
    best = F.max(F.struct("coverage", "same_values", "n_windows", F.col("windows").cast("long").alias("item_windows"))).alias("best")
    return leak.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_windows", "best.item_windows", "best.coverage", "best.same_values")


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leaked item."""
    leaked = matches(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["doc_id"]), "left_anti")


def op10(spark, sf_dir) -> DataFrame:
    from .common import read

    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
