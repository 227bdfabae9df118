"""The interface of whole groups: boundaries chosen word by word, then one correction for each (typo, boundary) group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BOUNDARIES, QUERY_CONFIG
from ..functions import text as T
from . import ngrams as N

C = QUERY_CONFIG
PLACE = "CASE WHEN t.suffix THEN 'suffix' WHEN t.prefix THEN 'prefix' WHEN t.middle THEN 'middle' ELSE 'apart' END"


def strictest(rows: DataFrame, *key: str) -> DataFrame:
    """The strictest boundary of each group; left and right together are both. Combines before the shuffle."""
    has = {b: F.max(F.col("boundary") == b) for b in BOUNDARIES}
    both = F.coalesce(has["both"], F.lit(False)) | (has["left"] & has["right"])
    return rows.groupBy(*key).agg(F.when(both, "both").when(has["left"], "left").when(has["right"], "right").otherwise("none").alias("boundary"))


def _flagged(e) -> DataFrame:
    return e.pairs.join(e.flags, "typo").withColumn("t", T.target_relation("typo", "word"))


def verdicts(e) -> DataFrame:
    """(typo, word, boundary, fires, reason) for all four boundaries."""
    v = _flagged(e).withColumn("boundary", F.explode(F.array(*[F.lit(b) for b in BOUNDARIES])))
    return v.select("typo", "word", "boundary", F.expr(N.false_trigger("boundary")).alias("fires"), F.expr(N.false_trigger_reason("boundary")).alias("reason"))


def target_orders(e) -> DataFrame:
    from ..plans.engine import TARGET_ORDERS

    o = e._rows([(k, i + 1, b) for k, bs in TARGET_ORDERS.items() for i, b in enumerate(bs)], "place string, ord int, boundary string")
    return _flagged(e).withColumn("place", F.expr(PLACE)).join(F.broadcast(o), "place")


def chosen(e) -> DataFrame:
    """(typo, word, boundary): the first boundary of the order that does not fire, else both."""
    ok = target_orders(e).where(~F.expr(N.false_trigger("boundary")))
    ok = ok.groupBy("typo", "word").agg(F.min_by("boundary", "ord").alias("boundary"))
    return e.pairs.join(ok, ["typo", "word"], "left").select("typo", "word", F.coalesce("boundary", F.lit("both")).alias("boundary"))


def overridden(e) -> DataFrame:
    """The same with user words of two letters held to both."""
    u = e.words.where("is_user AND length(word) = 2").select("word", F.lit(True).alias("u"))
    return chosen(e).join(u, "word", "left").select("typo", "word", F.when(F.col("u"), "both").otherwise(F.col("boundary")).alias("boundary"))


def groups(e) -> DataFrame:
    """(typo, boundary, n_words, word, f1, f2, accepted)"""
    g = overridden(e).join(e.lex, "word", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    g = g.withColumn("rk", F.row_number().over(Window.partitionBy("typo", "boundary").orderBy(F.desc("freq"), "word")))
    at = lambda k, c: F.max(F.when(F.col("rk") == k, F.col(c)))
    g = g.groupBy("typo", "boundary").agg(F.count(F.lit(1)).alias("n_words"), at(1, "word").alias("word"), at(1, "freq").alias("f1"), at(2, "freq").alias("f2"))
    return g.withColumn("accepted", (F.col("n_words") == 1) | (F.col("f2") == 0) | (F.col("f1") > e.config.freq_ratio * F.col("f2")))


def short(e) -> DataFrame:
    """Typos too short for their words, by the groups' rule."""
    return e.pairs.where((F.length("typo") <= e.config.min_typo_length) & (F.length("word") > e.config.min_word_length))


def resolved(e) -> DataFrame:
    """(typo, word, boundary, outcome): corrections, ambiguous groups' first words, short and excluded ones."""
    g = groups(e).select("typo", "word", "boundary", "accepted")
    x = e.excluded(g.select("typo", "word", "boundary")).select("typo", "word", "boundary").distinct().withColumn("x", F.lit(True))
    s = short(e).withColumn("s", F.lit(True))
    g = g.join(x, ["typo", "word", "boundary"], "left").join(s, ["typo", "word"], "left")
    return g.select("typo", "word", "boundary", F.when(~F.col("accepted"), "ambiguous").when(F.col("s"), "short").when(F.col("x"), "excluded").otherwise("correction").alias("outcome"))


def examples(e, side: str = "prefix", most: int = 3) -> DataFrame:
    """(typo, words): up to three words that start with the typo, end with it, or have it inside only; validation words
    first, then source words, each by name."""

    def among(words: DataFrame, tag: str, rank: int) -> DataFrame:
        if side == "inside":
            g = words.select("word", F.explode(F.expr("sequence(2, greatest(2, length(word) - 1))")).alias("i"))
            g = g.select("word", "i", F.explode(F.expr("sequence(1, greatest(1, length(word) - i))")).alias("n")).where("i + n - 1 < length(word)")
            g = g.select(F.expr("substring(word, i, n)").alias("typo"), "word").where("NOT startswith(word, typo) AND NOT endswith(word, typo)").distinct()
            hit = e.flags.where(f"{tag}_sub")
        else:
            g = N.affixes(words, side, True).select(F.col("gram").alias("typo"), "word")
            hit = e.flags.where(f"{tag}_start" if side == "prefix" else f"{tag}_end")
        return g.join(hit.select("typo"), "typo", "left_semi").withColumn("from", F.lit(rank))

    a = among(e.valid, "v", 0).unionByName(among(e.words.select("word"), "s", 1)).groupBy("typo", "word").agg(F.min("from").alias("from"))
    a = a.withColumn("rk", F.row_number().over(Window.partitionBy("typo").orderBy("from", "word"))).where(F.col("rk") <= most)
    return a.groupBy("typo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "word"))), lambda x: x["word"]), ",").alias("words"))


def wrong_use(word: str, typo: str, by: str):
    """What the rule typo -> by would make of another word that has the typo: at its start, else at its end, else inside."""
    return F.when(F.expr(f"startswith({word}, {typo})"), T.replace_first(word, typo, by)).when(F.expr(f"endswith({word}, {typo})"), T.replace_last(word, typo, by)).otherwise(T.replace_first(word, typo, by))


def _oracle():
    from ..plans import oracle as O

    return O


def place_sql() -> str:
    O = _oracle()
    return f"CASE WHEN {O.place('typo', 'word', 'suffix')} THEN 'suffix' WHEN {O.place('typo', 'word', 'prefix')} THEN 'prefix' WHEN {O.place('typo', 'word', 'middle')} THEN 'middle' ELSE 'apart' END"


def reason_sql() -> str:
    O = _oracle()
    p, s, m = (O.place("typo", "word", x) for x in ("prefix", "suffix", "middle"))
    return f"CASE boundary WHEN 'none' THEN CASE WHEN {p} OR {s} OR {m} THEN 'target' WHEN v_start OR v_end OR v_sub THEN 'validation' WHEN s_start OR s_end OR s_sub THEN 'source' END WHEN 'left' THEN CASE WHEN {p} THEN 'target' WHEN v_start THEN 'validation' WHEN s_start THEN 'source' END WHEN 'right' THEN CASE WHEN {s} THEN 'target' WHEN v_end THEN 'validation' WHEN s_end THEN 'source' END END"


def _sql() -> dict[str, str]:
    O = _oracle()
    chosen_sql = f"SELECT p.typo, p.word, coalesce(c.boundary, 'both') AS boundary FROM pairs p LEFT JOIN (SELECT typo, word, arg_min(boundary, ord) AS boundary FROM (SELECT *, {place_sql()} AS place FROM pairs JOIN flags USING (typo)) JOIN target_orders USING (place) WHERE NOT {O.fires('boundary', 'typo', 'word')} GROUP BY typo, word) c ON c.typo = p.typo AND c.word = p.word"
    over = f"SELECT typo, word, CASE WHEN word IN (SELECT word FROM words WHERE is_user AND length(word) = 2) THEN 'both' ELSE boundary END AS boundary FROM ({chosen_sql})"
    group = f"SELECT *, n_words = 1 OR f2 = 0 OR f1 > {C.freq_ratio} * f2 AS accepted FROM (SELECT typo, boundary, count(*)::BIGINT AS n_words, max(word) FILTER (rk = 1) AS word, max(freq) FILTER (rk = 1) AS f1, max(freq) FILTER (rk = 2) AS f2 FROM (SELECT o.*, coalesce(freq, 0)::BIGINT AS freq, row_number() OVER (PARTITION BY typo, boundary ORDER BY coalesce(freq, 0) DESC, o.word) AS rk FROM ({over}) o LEFT JOIN lex ON lex.word = o.word) GROUP BY typo, boundary)"
    resolve = f"SELECT typo, word, boundary, CASE WHEN NOT accepted THEN 'ambiguous' WHEN length(typo) < {C.min_typo_length + 1} AND length(word) > {C.min_word_length} THEN 'short' WHEN EXISTS (SELECT 1 FROM typo_rules WHERE typo LIKE {O.like('typo_glob')} ESCAPE '!' AND word LIKE {O.like('word_glob')} ESCAPE '!' AND (required IS NULL OR required = boundary)) THEN 'excluded' ELSE 'correction' END AS outcome FROM ({group})"
    tests = {"": "starts_with(w.word, t.typo)", "SUFFIX_": "suffix(w.word, t.typo)", "INSIDE_": "contains(w.word, t.typo) AND NOT starts_with(w.word, t.typo) AND NOT suffix(w.word, t.typo)"}
    flag = {"": "start", "SUFFIX_": "end", "INSIDE_": "sub"}
    example = {f"{k}EXAMPLES_SQL": f"SELECT typo, string_agg(word, ',' ORDER BY k) AS words FROM (SELECT t.typo, w.word, row_number() OVER (PARTITION BY t.typo ORDER BY w.o, w.word) AS k FROM (SELECT typo FROM flags WHERE v_{flag[k]} OR s_{flag[k]}) t JOIN (SELECT word, min(o) AS o FROM (SELECT word, 0 AS o FROM valid UNION ALL SELECT word, 1 FROM words) GROUP BY word) w ON w.word <> t.typo AND {test}) WHERE k <= 3 GROUP BY typo" for k, test in tests.items()}
    return {"CHOSEN_SQL": chosen_sql, "OVERRIDE_SQL": over, "GROUPS_SQL": group, "RESOLVE_SQL": resolve, **example}


def __getattr__(name: str) -> str:
    if name.endswith("_SQL"):
        return _sql()[name]
    raise AttributeError(name)
