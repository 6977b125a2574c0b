import pytest
from pyspark.sql import functions as F

from tagloom.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("name", "parts"), [("GetFrameAudio", ["get", "frame", "audio"]), ("load_page-token", ["load", "page", "token"]), ("HTTPServer", ["http", "server"]), ("", []), (None, None), ("a::B", ["a::b"]), ("__x__", ["x"])])
def test_tokens(spark, name, parts):
    assert one(spark, name, T.tokens) == parts
    if name:
        assert T.tokens_of(name) == parts


@pytest.mark.parametrize(("name", "base", "qual", "scope"), [("A::b(int x)", "b", "A::b", "A"), ("A::B::c", "B::c", "A::B::c", "A::B"), ("f", "f", "f", None), (None, None, None, None)])
def test_name_parts(spark, name, base, qual, scope):
    assert (one(spark, name, T.base), one(spark, name, T.qual), one(spark, name, T.scope)) == (base, qual, scope)


def test_edit_distance_is_clipped(spark):
    assert one(spark, "serial", lambda c: T.edit_distance(c, "serialize")) == 3
    assert one(spark, "abc", lambda c: T.edit_distance(c, "xyzzy")) == 3
    assert one(spark, "updte", lambda c: T.edit_distance(c, "update")) == 1


def test_variants_and_rescue():
    assert "fetch_data" in T.query_variants("get_data") and T.query_variants("getData")[0] == "get_data"
    assert T.query_variants("") == [] and all(len(v) >= 2 for v in T.query_variants("a_b"))
    assert T.rescue_tokens("fn parse") == ["parse"] and T.rescue_tokens("class type") == ["class", "type"]


@pytest.mark.parametrize(("token", "head"), [("fetch", "get"), ("dictionaries", "dict"), ("news", "news"), ("reads", "get"), ("zebra", "zebra")])
def test_canonical(spark, token, head):
    assert one(spark, token, T.canonical) == head == T.canonical_of(token)


@pytest.mark.parametrize(("path", "yes"), [("tests/a.py", True), ("a/test/b.c", True), ("test_x.py", True), ("a/test_x.py", True), ("src/x_test.go", True), ("a.test.js", True), ("b_spec.rb", True), ("src/contest/a.py", False), ("latest/a.py", False), (None, False)])
def test_test_paths(spark, path, yes):
    assert one(spark, path, T.is_test) is yes


@pytest.mark.parametrize(("glob", "path", "yes"), [("tests/*", "tests/a/b.py", True), ("*.py", "a/b.py", True), ("?.py", "ab.py", False), ("[!a].py", "b.py", True), ("a.py", "axpy", False)])
def test_globs(spark, glob, path, yes):
    assert one(spark, path, lambda c: T.matches_any(c, [glob])) is yes


def test_boundary_and_doc_head(spark):
    assert [one(spark, n, lambda c: T.boundary_rank(c, "Page")) for n in ("page", "load_page", "pages")] == [0, 1, 2]
    long = "word " * 60
    cut = one(spark, long, T.doc_head)
    assert cut.endswith("…") and len(cut) <= 201 and one(spark, "short", T.doc_head) == "short" and one(spark, None, T.doc_head) is None
    assert one(spark, "  a \n  b ", T.compact) == "a b" and one(spark, "  ", T.compact) is None


def test_budget(spark):
    assert [spark.range(1).select(T.default_budget(F.lit(n))).first()[0] for n in (0, 200, 16000)] == [2048, 2048, 8000]
