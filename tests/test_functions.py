from typoforge.functions import text as T
from typoforge.operators import typos as Y
from typoforge.sources import files


def _words(spark, *w):
    return spark.createDataFrame([(x,) for x in w], "word string")


def _typos(df):
    return sorted(r["typo"] for r in df.collect())


def test_generators(spark):
    adj = spark.createDataFrame([("a", 0, "x")], "key string, pos int, neighbor string")
    assert _typos(Y.transpositions(_words(spark, "ab", "a", ""))) == ["ba"]
    assert _typos(Y.omissions(_words(spark, "test", "abc"))) == ["est", "tes", "tet", "tst"]
    assert _typos(Y.duplications(_words(spark, "a", ""))) == ["aa"]
    assert _typos(Y.insertions(_words(spark, "a"), adj)) == ["ax", "xa"]
    assert _typos(Y.replacements(_words(spark, "ab"), adj)) == ["xb"]
    assert Y.all_typos(_words(spark, ""), adj).count() == 0


def test_files(spark, tmp_path):
    p = tmp_path / "w.txt"
    p.write_text("# c\n Hello \n\nback\\slash\nhello\n", encoding="utf-8")
    assert [r["word"] for r in files.include_file(spark, str(p)).orderBy("line_no").collect()] == ["hello", "hello"]
    p.write_text("a -> qs\nbad\na -> w\n", encoding="utf-8")
    assert [(r["key"], r["pos"], r["neighbor"]) for r in files.adjacency_file(spark, str(p)).collect()] == [("a", 0, "w")]
    p.write_text("xx*\n xx* \n# no\nTeh -> the\n", encoding="utf-8")
    assert sorted(r["rule"] for r in files.exclusion_file(spark, str(p)).collect()) == ["Teh -> the", "xx*"]


def test_expressions(spark):
    df = spark.createDataFrame([("abcabc", "bc", "X"), ("aaa", "b", "X")], "l string, s string, b string")
    rows = df.select(T.replace_first("l", "s", "b").alias("f"), T.replace_last("l", "s", "b").alias("r")).collect()
    assert [tuple(r) for r in rows] == [("aXabc", "abcaX"), (None, None)]
    g = spark.createDataFrame([("a%b", "a%*"), ("axb", "a_b"), ("teh", "*e*"), ("t", "T")], "t string, g string")
    assert [r[0] for r in g.select(T.glob_match("t", "g")).collect()] == [True, False, True, False]
    m = spark.createDataFrame([(":",), (":a:",), ("a:",), ("a",)], "p string")
    assert [tuple(r) for r in m.select(T.marker_core("p"), T.marker_boundary("p")).collect()] == [("", "both"), ("a", "both"), ("a", "right"), ("a", None)]
