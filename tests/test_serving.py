from pyspark.sql import functions as F

from tagloom.operators import serving as S
from tagloom.operators.search import symbols_lookup, tiered


def one(spark, value, kind, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"x {kind}").select(f(F.col("x"))).collect()]


def test_paths_and_shapes(spark):
    assert one(spark, ["/a/b", "/a/b/c", "/a/bc", "/a/b/../c", "", None], "string", lambda x: S.within(x, "/a/b/")) == [True, True, False, False, False, False]
    assert one(spark, ["a_1", "A::b.c", "a.b::c", "1a", "a b", "", None, "a\n"], "string", S.is_candidate) == [True, True, False, False, False, False, False, False]


def test_plurals(spark):
    words = [["item"], ["items"], ["new"], ["news"], ["as"], [], None]
    assert one(spark, words, "array<string>", lambda x: S.matches_word(x, "items")) == [True, True, False, False, False, False, False]
    assert one(spark, words, "array<string>", lambda x: S.matches_word(x, "new")) == [False, False, True, False, False, False, False]
    assert one(spark, [["a"], ["as"]], "array<string>", lambda x: S.matches_word(x, "as")) == [False, True]


def test_ages_and_cuts(spark):
    assert one(spark, [0.0, 59.9, 60.0, 3599.0, 3600.0, 86400.0 * 3, None], "double", S.age) == ["0s", "59s", "1m", "59m", "1h", "3d", "unknown"]
    texts = ["short", "", None, "line one\n" + "x" * 500, "y" * 500]
    got = one(spark, texts, "string", lambda x: S.cut_text(x, 20))
    assert got[:3] == texts[:3] and got[3] == "line one" + S.CUT_MARK and got[4].endswith(S.CUT_MARK) and len(got[4]) == 80
    assert one(spark, texts[3:], "string", lambda x: S.cut_text(x, 5)) == ["", ""] and one(spark, ["a"], "string", lambda x: S.cut_text(x, 0)) == [""]


def test_hints(spark):
    d = spark.createDataFrame([("detect", 0, None), ("symbols", 0, "fuzzy"), ("query", 0, None), ("detect", 3, "fuzzy"), ("detect", 3, "content"), ("detect", 3, None)], "t string, n long, r string")
    got = [tuple(r[0]) for r in d.select(S.hint(F.col("t"), F.col("n"), F.col("r"))).collect()]
    assert got == [("symbols", "empty"), ("query", "empty"), ("detail", "empty"), ("detail", "fuzzy_verify"), ("detail", "content_verify"), (None, None)]


def test_first_rows_and_unions(spark, rows):
    d = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), (None, 5, "z"), (None, 4, "w")], "k string, o int, _n string").withColumnRenamed("_n", "v")
    assert rows(S.keep_first(d, ["k"], ["o", "v"])) == [("a", 1, "y"), (None, 4, "w")]
    assert S.keep_first(d.limit(0), ["k"], ["o"]).count() == 0
    a, b = (spark.createDataFrame(x, "rel_file string") for x in ([("p",), (None,)], [("p",), ("q",), ("q",)]))
    assert rows(S.files_of_interest(a, b)) == [("p", True), ("q", False)]


def test_walks_in_budget(spark):
    n = spark.createDataFrame([("f", i, f"n{i}", 0) for i in range(9)], "file string, line int, name string, hop int")
    e = spark.createDataFrame([(1, f"a{i}", "f", i, "b", "g", 1) for i in range(9)], "hop int, from_name string, from_file string, from_line int, to_name string, to_file string, to_line int")
    for budget, many in ((0, (9, 9)), (10**6, (9, 9)), (100, (2, 3)), (1, (1, 1))):
        got = S.fit_walk(n, e, budget)
        assert tuple(x.count() for x in got) == many and {r["cut"] for x in got for r in x.collect()} == {many != (9, 9)}


def test_later_tiers_answer_only_where_the_first_do_not(spark):
    t = spark.createDataFrame([("a.py", 1, "load_page", "def")], "rel_file string, line int, name string, kind string")
    more = lambda: spark.createDataFrame([("z.py", 7, "found", 2, 1.0)], "rel_file string, line int, name string, matched long, score double")
    assert [r.quality for r in tiered(t, "page", content=more).collect()] == ["exact"] and [r.quality for r in tiered(t, "loadPage", content=more).collect()] == ["fuzzy"]
    assert [(r.name, r.quality) for r in tiered(t, "qqqqqqqq", content=more).collect()] == [("found", "content")] and tiered(t, "qqqqqqqq").count() == 0
    s = spark.createDataFrame([("a.py", 1, "load_page", "function", None, None)], "file string, line int, name string, type string, signature string, docstring string")
    assert [r.quality for r in symbols_lookup(s, "page").collect()] == ["exact"] and [r.quality for r in symbols_lookup(s, "load_pag_e").collect()] == ["fuzzy"] and symbols_lookup(s, "zzzzzzz").count() == 0
