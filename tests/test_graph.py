import pytest

from tagloom.operators import edges, rank, resolve, spans, traverse

TAGS = "rel_file string, line int, name string, kind string"


def tags(spark, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], TAGS)


def test_edges_once(spark, rows):
    t = tags(spark, ("a.py", 1, "foo", "def"), ("a.py", 5, "bar", "def"), ("b.py", 2, "foo", "ref"), ("b.py", 3, "baz", "ref"))
    assert rows(edges.bag_edges(t)) == [("b.py", "a.py", "foo")] == rows(edges.bag_edges(t))


def test_edges_to_every_definition(spark, rows):
    t = tags(spark, ("a.py", 1, "foo", "def"), ("a.py", 5, "bar", "def"), ("b.py", 2, "foo", "def"), ("c.py", 3, "foo", "ref"), ("a.py", 4, "baz", "ref"), ("c.py", 5, "qux", "ref"))
    assert rows(edges.bag_edges(t)) == [("c.py", "a.py", "foo"), ("c.py", "b.py", "foo")]


@pytest.mark.parametrize(("n", "stop", "edges_"), [(51, 1, 0), (50, 0, 50)])
def test_stop_names_above_fifty_files(spark, n, stop, edges_):
    t = tags(spark, *((f"f{i}.py", 1, "common", "def") for i in range(n)), ("r.py", 1, "common", "ref"))
    assert edges.stop_names(t).count() == stop and edges.bag_edges(t).count() == edges_


def test_multiplicity_nulls_and_self(spark, rows):
    t = tags(spark, *[("r.py", i, "x", "ref") for i in (1, 2)], *[("d.py", i, "x", "def") for i in (1, 2, 3)], ("r.py", 9, None, "ref"), (None, 1, "x", "def"), ("d.py", 4, "x", "ref"))
    assert rows(edges.weighted_edges(t)) == [("r.py", "d.py", "x", 6)]
    assert rows(edges.weighted_edges(t, distinct=True)) == [("r.py", "d.py", "x", 1)]
    assert edges.bag_edges(t).count() == 6
    assert edges.bag_edges(t.limit(0)).count() == 0


def ranked(spark, es, nodes, **k):
    e = spark.createDataFrame(es, "from_file string, to_file string")
    n = spark.createDataFrame([(x,) for x in nodes], "rel_file string")
    got = {r.rel_file: round(r["rank"], 6) for r in rank.pagerank(e, n, **k).collect()}
    four = {r.rel_file: r["rank"] for r in rank.pagerank(e, n, iterations=4, **k).collect()}
    with pytest.MonkeyPatch.context() as p:
        p.setattr(rank, "SMALL_EDGES", -1)  # the way of large graphs gives the same
        assert {r.rel_file: r["rank"] for r in rank.pagerank(e, n, iterations=4, **k).collect()} == pytest.approx(four, abs=1e-12)
    return got


def test_ranks(spark):
    got = ranked(spark, [("b", "a")], "abc")
    assert got == {"a": 0.480519, "b": 0.25974, "c": 0.25974}
    got = ranked(spark, [("c", "a"), ("c", "b")], "abc")
    assert got == {"a": 0.37013, "b": 0.37013, "c": 0.25974}
    got = ranked(spark, [("c", "a"), ("c", "a"), ("c", "b"), ("d", "b"), ("a", "d")], "abcd")
    assert got == pytest.approx({"a": 0.191909, "b": 0.399978, "c": 0.122495, "d": 0.285618}, abs=2e-6)


def test_ranks_of_nothing_and_of_leaks(spark):
    assert ranked(spark, [("b", "a")], []) == {}
    assert ranked(spark, [], "ab") == {"a": 0.5, "b": 0.5}
    got = ranked(spark, [("a", "outside"), ("a", "b")], "ab")
    assert sum(got.values()) == pytest.approx(1) and got["b"] > got["a"]


def test_start_is_forgotten_and_teleport_is_not(spark):
    es, w = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], spark.createDataFrame([("d", 100.0)], "rel_file string, weight double")
    plain = ranked(spark, es, "abcd", alpha=0.5)
    assert ranked(spark, es, "abcd", alpha=0.5, start=w) == pytest.approx(plain, abs=1e-5)
    assert ranked(spark, es, "abcd", alpha=0.5, teleport=w)["d"] > plain["d"]


def test_boosts_dedupe_and_prefix(spark, rows):
    from pyspark.sql import functions as F

    t = tags(spark, ("a.py", 1, "x", "def"), ("a.py", 1, "x", "def"), ("b.py", 1, "y", "def"), ("b.py", 2, "x", "ref"))
    r = spark.createDataFrame([("a.py", 0.1), ("b.py", 0.3)], "rel_file string, rank double")
    assert rows(rank.boosted(r, t, idents=["x"], chat=["a.py"])) == [(0.3, "b.py", 1, "y", "def"), (20.0, "a.py", 1, "x", "def")]
    b = rank.boosted(r, t)
    for budget in (1, 2, 3, 100):
        got = rank.budget_prefix(b, [F.desc("rank"), "rel_file", "line", "name"], F.lit(2), budget).orderBy("position").collect()
        assert len(got) == max(1, min(2, budget // 2)) and [g.name for g in got] == ["y", "x"][: len(got)]


# Line tables of a three-file call graph.
SYMBOLS = [("main.py", "main", 1, 4), ("main.py", "authenticate", 6, 7), ("main.py", "validate_credentials", 9, 10), ("auth.py", "login", 1, 2), ("auth.py", "authenticate", 4, 5),
           ("auth.py", "validate_credentials", 7, 8), ("config.py", "__init__", 2, 3), ("config.py", "load", 5, 6)]
CALLS = [("main.py", 2, "authenticate"), ("main.py", 3, "Config"), ("main.py", 7, "validate_credentials"), ("auth.py", 2, "authenticate"), ("auth.py", 5, "validate_credentials")]


@pytest.fixture
def calls(spark):
    s = spark.createDataFrame([(f, n, "function", a, b) for f, n, a, b in SYMBOLS], "file string, name string, type string, line int, end_line int")
    t = spark.createDataFrame([(f, f, a, n, "ref") for f, a, n in CALLS] + [(f, f, a, n, "def") for f, n, a, _ in SYMBOLS], "file string, rel_file string, line int, name string, kind string")
    return t, spans.call_edges(t, s)


def test_callers(calls, rows):
    t, c = calls
    nodes, e = traverse.run("callers('authenticate') depth=2", t, c)
    assert rows(e.filter("hop = 1").select("from_name", "from_file")) == [("login", "auth.py"), ("main", "main.py")]
    assert {r.name for r in nodes.collect()} == {"authenticate", "login", "main"}
    _, e = traverse.run("callers('authenticate') exclude=auth.py", t, c)
    assert {r.from_file for r in e.collect()} == {"main.py"}


def test_nodes_are_symbols_not_names(spark):
    s = [("a.py", "run", 1, 5), ("b.py", "run", 1, 5), ("c.py", "top", 1, 9), ("a.py", "low", 7, 9), ("d.py", "other", 1, 3)]
    sym = spark.createDataFrame([(f, n, "function", a, b) for f, n, a, b in s], "file string, name string, type string, line int, end_line int")
    tag = spark.createDataFrame([(f, f, a, n, "def") for f, n, a, _ in s] + [("a.py", "a.py", 2, "low", "ref"), ("b.py", "b.py", 2, "other", "ref"), ("c.py", "c.py", 3, "run", "ref"), ("d.py", "d.py", 2, "run", "ref")], "file string, rel_file string, line int, name string, kind string")
    for way in ({"symbols": sym}, {"edges": spans.call_edges(tag, sym)}):
        nodes, e = traverse.run("callees('top') depth=1", tag, **way)
        assert {(r.hop, r.from_name, r.from_file, r.to_name, r.to_file) for r in e.collect()} == {(1, "top", "c.py", "run", "a.py"), (1, "top", "c.py", "run", "b.py"), (2, "run", "a.py", "low", "a.py"), (2, "run", "b.py", "other", "d.py")}
        assert {(r.file, r.name, r.hop) for r in nodes.collect()} == {("c.py", "top", 0), ("a.py", "run", 1), ("b.py", "run", 1)} and not any(r.truncated for r in nodes.collect())
        nodes, e = traverse.run("callers('low') depth=2", tag, **way)
        assert {(r.hop, r.from_name, r.from_file, r.to_name, r.to_file) for r in e.collect()} == {(1, "run", "a.py", "low", None), (2, "top", "c.py", "run", "a.py"), (2, "other", "d.py", "run", "a.py"), (3, "run", "b.py", "other", "d.py")}
        nodes, e = traverse.run("callees('top') depth=1 limit=2", tag, **way)
        assert nodes.count() == 2 and all(r.truncated for r in nodes.collect()) and traverse.run("callers('none')", tag, **way)[1].count() == 0


def test_chain(calls):
    t, c = calls
    nodes, e = traverse.run("callers('authenticate') | callees('validate_credentials') depth=1", t, c)
    assert nodes.count() and e.filter("step = 1").count()
    nodes, e = traverse.run("defs('authenticate')", t, c)
    assert nodes.count() == 2 and e is None
    assert traverse.references(traverse.Step("refs", "authenticate"), t).count() == 2


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Tables in which a caller of the start and the start call a name that 1,500 functions have, who all call it again."""
    d = str(tmp_path_factory.mktemp("hot"))
    f = [(f"/srv/mirror/r/h{i}.py", "hot", 1) for i in range(1500)] + [("/srv/mirror/r/a.py", "fetch_vabomu_batch", 1), ("/srv/mirror/r/a.py", "top", 11)]
    at = lambda f: (f, f[len("/srv/mirror/") :])
    refs = [(*at(x), line + 1, "hot", "ref") for x, _, line in f] + [(*at(f[-1][0]), 12, "fetch_vabomu_batch", "ref")]
    spark.createDataFrame([(*at(x), line, n, "def") for x, n, line in f] + refs, "file string, rel_file string, line int, name string, kind string").write.parquet(f"{d}/tags.parquet")
    spark.createDataFrame([(x, line, n, "function", line + 2) for x, n, line in f], "file string, line int, name string, type string, end_line int").write.parquet(f"{d}/symbols.parquet")
    return d


def test_callees_of_a_hot_name_are_whole_and_not_stored(spark, hot, monkeypatch):
    from tagloom.plans import catalog

    cut, stored = traverse.cut, []
    monkeypatch.setattr(traverse, "cut", lambda df: stored.append((c := cut(df)).count()) or c)
    e = catalog.QUERIES["bfs_callees"](spark, hot)
    assert max(stored) < 10_000
    assert {r.hop: r["count"] for r in e.groupBy("hop").count().collect()} == {1: 1500, 2: 1500 * 1500} and e.distinct().count() == 1500 + 1500 * 1500


def test_chain_over_a_hot_name_is_whole(spark, hot, monkeypatch):
    from tagloom.plans import catalog

    cut, stored = traverse.cut, []
    monkeypatch.setattr(traverse, "cut", lambda df: stored.append((c := cut(df)).count()) or c)
    e = catalog.QUERIES["chained_query"](spark, hot)
    assert max(stored) < 10_000 and {r.hop: r["count"] for r in e.groupBy("hop").count().collect()} == {1: 1501, 2: 1500 * 1500 + 1500}


def test_calls_of_inner_functions_are_not_the_outer_ones(spark):
    sym = spark.createDataFrame([("a.py", "outer", "function", 1, 400), ("a.py", "inner", "function", 150, 200)], "file string, name string, type string, line int, end_line int")
    t = [("a.py", 1, "outer", "def"), ("a.py", 150, "inner", "def"), ("b.py", 1, "x", "def"), ("b.py", 9, "y", "def"), ("a.py", 160, "x", "ref"), ("a.py", 300, "y", "ref")]
    tag = spark.createDataFrame([(f, f, a, n, k) for f, a, n, k in t], "file string, rel_file string, line int, name string, kind string")
    for name, to in (("outer", "y"), ("inner", "x")):
        assert [(r.from_name, r.to_name) for r in traverse.run(f"callees('{name}')", tag, symbols=sym)[1].collect()] == [(name, to)]


def test_blocks_join_all(spark, rows, monkeypatch):
    c = spark.createDataFrame([(f"f{i}", k) for i in range(9) for k in "abc"[: 1 + i % 3]], "from_file string, key string")
    d = spark.createDataFrame([(f"g{i}", k) for i in range(7) for k in "abz"[: 1 + i % 3]], "to_file string, key string")
    plain = rows(c.join(d, "key").select("key", "from_file", "to_file"))
    for block in (1, 2, 5, 100):
        monkeypatch.setattr(traverse, "BLOCK", block)
        monkeypatch.setattr(traverse, "WHOLE", 0)
        e, n = traverse._meet(c, d)
        assert rows(e.select("key", "from_file", "to_file")) == plain and n == len(plain)
    assert traverse._meet(c, d.filter("key = 'z'"))[1] == 0


def test_limit_none(calls):
    t, c = calls
    assert traverse.parse("callers('x') limit=none")[0].limit is None
    nodes, e = traverse.run("callers('authenticate') depth=2 limit=none", t, c)
    some, f = traverse.run("callers('authenticate') depth=2", t, c)
    assert {*nodes.collect()} == {*some.collect()} and {*e.collect()} == {*f.collect()} and e.count() == f.count()
    assert traverse.run("defs('authenticate') limit=none", t, c)[0].count() == 2


@pytest.mark.parametrize("text", ["", "callers()", "callers('')", "nope('x')", "callers('x') depth=0", "callers('x') wat=1", "callers('x') depth", "callers('a|b')"])
def test_what_is_no_query(text):
    with pytest.raises(ValueError):
        traverse.parse(text)


def test_query_words():
    a, b = traverse.parse("callers(\"x\") depth=2 exclude='tests/*,docs/*' limit=7 | refs('y') type=method")
    assert (a.kind, a.target, a.depth, a.limit, a.exclude) == ("callers", "x", 2, 7, ("tests/*", "docs/*")) and (b.kind, b.type) == ("refs", "method")


def test_scoped_definitions(spark):
    t = tags(spark, ("a.py", 1, "A::run", "def"), ("b.py", 1, "B::run", "def"), ("run.py", 1, "run", "def"))
    assert [r.rel_file for r in traverse.definitions(traverse.Step("defs", "A::run"), t).collect()] == ["a.py"]
    assert traverse.definitions(traverse.Step("defs", "run"), t).count() == 3


def test_innermost(spark, rows):
    s = spark.createDataFrame([("f", "outer", 1, 400), ("f", "inner", 5, 300), ("f", "tie", 5, 300), ("f", "open", 500, None)], "file string, name string, line int, end_line int")
    sp = spans.symbol_spans(s.selectExpr("*", "'function' as type"))
    p = spark.createDataFrame([("f", a, "x") for a in (2, 7, 299, 350, 505, 600)], "file string, at int, name string")
    assert {r.at: r.in_name for r in spans.innermost(p, sp).collect()} == {2: "outer", 7: "inner", 299: "inner", 350: "outer", 505: "open"}


def test_resolution_of_imports(spark):
    def go(refs, imports):
        r = spark.createDataFrame(refs, "source_file string, name string")
        i = spark.createDataFrame(imports, "local_name string, qualified_name string, source_file string, is_from_import boolean")
        return {(x.source_file, x.name): (x.qualified_name, x.confidence) for x in resolve.resolve_imports(r, i).collect()}

    assert go([("/app.py", "Path")], [("Path", "pathlib.Path", "/app.py", True)]) == {("/app.py", "Path"): ("pathlib.Path", 1.0)}
    assert go([("/app.py", "Path"), ("/app.py", None)], []) == {("/app.py", "Path"): ("Path", 0.0)}
    two = [("Path", "pathlib.Path", "/a.py", True), ("Path", "mypackage.Path", "/b.py", True)]
    assert go([("/b.py", "Path"), ("/c.py", "Path")], two) == {("/b.py", "Path"): ("mypackage.Path", 1.0), ("/c.py", "Path"): ("pathlib.Path", 0.5)}
    assert go([("/app.py", "Path")], [("Path", "mypackage.Path", "/app.py", True), ("Path", "pathlib.Path", "/app.py", True)]) == {("/app.py", "Path"): ("pathlib.Path", 0.5)}
    assert go([("/app.py", "P")], [("P", "a.P", "/app.py", True), ("P", "P", "/app.py", False)])[("/app.py", "P")] == ("a.P", 0.8)


def test_bare_fallback_is_flagged(spark, rows):
    t = spark.createDataFrame([("run", "c.py", 1), ("A::go", "d.py", 2), (None, "e.py", 3)], "name string, rel_file string, line int")
    q = spark.createDataFrame([("A::run",), ("A::go",), (None,)], "query string")
    assert rows(resolve.lookup(q, t)) == [("A::go", "A::go", "d.py", 2, False), ("A::run", "run", "c.py", 1, True)]
