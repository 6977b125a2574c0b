import pytest

from tagloom.operators import content, files, render, search, snapshot, spans

TAGS = "rel_file string, line int, name string, kind string"


def tags(spark, rows):
    return spark.createDataFrame(rows, TAGS)


def test_interleave(spark):
    hits = spark.createDataFrame([(f, i, f"{f}{i}", "def", i) for f, i in [("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5)]], TAGS + ", k int")
    names = lambda df: [r.name for r in df.collect()]
    assert names(search.interleave(hits, ["k"], 10)) == ["a1", "b4", "c5", "a2", "a3"]
    assert names(search.interleave(hits, ["k"], 2)) == ["a1", "b4"]
    assert names(search.interleave(hits.limit(0), ["k"], 2)) == []


def test_other_files_get_a_place(spark):
    t = tags(spark, [("a/header.py", i, f"parse_expr_{i:02d}", "def") for i in range(10)] + [("b/impl.py", 1, "parse_expr_impl", "def")])
    got = search.detect(t, "parse_expr", limit=10).collect()
    assert got[0].name == "parse_expr_00" and "b/impl.py" in {r.rel_file for r in got} and len(got) == 10


def test_modes_and_nulls(spark):
    t = tags(spark, [("a.py", 1, "Foo", "def"), ("a.py", 1, "Foo", "def"), ("a.py", 2, "foobar", "ref"), ("a.py", 3, None, "def"), (None, 4, "foo", "def"), ("tests/t.py", 1, "foo", "def")])
    names = lambda *a, **k: [(r.rel_file, r.name) for r in search.detect(t, *a, **k).collect()]
    assert names("foo", "exact") == [("a.py", "Foo"), ("tests/t.py", "foo")]
    assert names("FOO", definitions=False) == [("a.py", "foobar")]
    assert names("^foo.+$", "regex") == [("a.py", "foobar")] and names("") == []
    with pytest.raises(ValueError):
        search.detect(t, "(", "regex")
    assert search.detect(t.limit(0), "foo").count() == 0


def test_clamped_limits():
    assert [search.clamp(n) for n in (-1, 0, 5, 999)] == [1, 1, 5, 200]


def test_strict_majority(spark):
    t = tags(spark, [("a.py", 1, "alphaOne", "def"), ("a.py", 2, "qxTwo", "def"), ("a.py", 3, "alphaQx", "def")])
    assert [r.name for r in search.fuzzy(t, "qxAlpha").collect()] == ["alphaQx"]
    assert [r.name for r in search.tiered(t, "qxAlpha").collect()] == ["alphaQx"]


def test_rescue_puts_tests_last(spark):
    s = spark.createDataFrame([("pkg/builder.py", 1, "HasMany", "class"), ("tests/test_b.py", 1, "BuilderHasMany", "class")], "file string, line int, name string, type string")
    assert [r.file for r in search.symbols_rescue(s, "Builder::HasMany").collect()] == ["pkg/builder.py", "tests/test_b.py"]


def test_symbols(spark):
    s = spark.createDataFrame([("a.py", 1, "page", "function", "def  page( )", "x " * 150), ("a.py", 1, "page", "function", None, None), ("b.py", 2, "load_page", "class", None, None), (None, 3, "page", "class", None, None)],
                              "file string, line int, name string, type string, signature string, docstring string")
    got = search.symbols(s, "page").collect()
    assert [r.name for r in got] == ["page", "load_page"] and got[0].signature == "def page( )" and got[0].docstring.endswith("…") and got[0].docstring_omitted == 100
    assert [r.name for r in search.symbols(s, "", "class").collect()] == ["load_page"]


DOCS = [("pool.py", "def make_pool(n):\n    executor = thread_pool(n)\n    return executor\n\ndef other():\n    pass\n"), ("deps.py", "def _solve_generator(x):\n    stack.enter(context)\n    exit(dependency)\n"), ("args.py", "def request_params_to_args(raw):\n    values = validate(raw)\n    return convert(path, query)\n")]


@pytest.fixture
def corpus(spark):
    from tagloom.sources import extract

    docs = spark.createDataFrame(DOCS, "rel_file string, text string")
    t = extract.tags(docs, "/r")
    return t, docs, spans.call_edges(t, extract.symbols(docs, "/r"))


@pytest.mark.parametrize(("query", "name"), [("enter exit stack context manager dependency", "_solve_generator"), ("validate raw path query values into arguments", "request_params_to_args"), ("executor thread pool", "make_pool"), ("quantum flux capacitor", None), ("the of and", None)])
def test_content(corpus, query, name):
    got = [r.name for r in content.content_search(*corpus, query).collect()]
    assert (got[0] if got else None) == name


def test_snapshots(spark, rows):
    st = "rel_file string, size long, mtime_ns long"
    now, was = spark.createDataFrame([("a", 2, 1), ("c", 1, 1), ("n", None, 5)], st), spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("n", None, 5)], st)
    d = snapshot.diff(now, was)
    assert rows(d) == [("a", "modified"), ("b", "deleted"), ("c", "added")]
    assert rows(snapshot.diff(now, was.limit(0)))[0] == ("a", "added")
    assert rows(snapshot.dirty(now, was)) == [("a",), ("c",)]
    t = tags(spark, [("a", i, f"n{i}", "def") for i in range(201)])
    got = {r.rel_file: r for r in snapshot.tag_heads(d, t).collect()}
    assert (got["a"].tag_count, got["a"].tags_omitted, got["c"].tag_count, got["c"].tags) == (201, 151, 0, "") and got["a"].tags.count(",") == 49
    assert {r.rel_file: r.tags_omitted for r in snapshot.tag_heads(d, t, 0).collect()}["a"] == 0
    one, two = snapshot.signature(now).first(), snapshot.signature(now.orderBy("size")).first()
    assert one == two and snapshot.signature(was).first() != one and snapshot.signature(now.limit(0)).first().files == 0
    assert snapshot.is_fresh(snapshot.signature(now), snapshot.signature(now)).first().fresh and not snapshot.is_fresh(snapshot.signature(was), snapshot.signature(now)).first().fresh
    assert snapshot.chunk_caps(12_000) == [5000, 10000, 12000] and len(snapshot.chunk_caps(10**9)) == 50


def test_chunks_reach_the_last_file(spark, tmp_path):
    import duckdb

    from tagloom.plans import catalog

    f = spark.range(6_001).selectExpr("concat('f', id) as rel_file")
    f.unionByName(f.limit(9)).unionByName(spark.sql("select cast(null as string) as rel_file")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["chunk_resume_plan_all"](spark, str(tmp_path)).collect())
    assert got == [(i, min(6_001, 100 * i), 100 if i < 61 else 1) for i in range(1, 62)]
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.execute(catalog.SQL["chunk_resume_plan_all"]).fetchall()) == got
    assert [tuple(r) for r in snapshot.chunk_plan(f, 10_000).collect()] == [(1, 6_001, 6_001)] and snapshot.chunk_plan(f.limit(0)).count() == 0


def test_flags(spark, rows):
    f = "rel_file string, reason string"
    old, new = spark.createDataFrame([("a.sql", "no-grammar"), ("b", "empty"), (None, "x")], f), spark.createDataFrame([("b", "missing")], f)
    tagged = spark.createDataFrame([("a.sql",)], "rel_file string")
    assert rows(snapshot.sync_flags(old, new, tagged)) == [("b", "missing")]


def test_discovery(spark, rows):
    long = "x" * 3000
    f = spark.createDataFrame([("src/a.py", 10, "x"), ("node_modules/b.js", 10, "x"), (".git/c", 1, "x"), ("d.PNG", 1, "x"), ("e.py", 2 << 20, "x"), ("m.js", 3000, long), ("h-0123456789abcdef.js", 5, "x"), (None, 1, "x"), ("z.py", None, None)], "rel_file string, size long, text string")
    assert [r.rel_file for r in files.discover(f).collect()] == ["src/a.py"]
    assert files.discover(f, exclude=["src/*"]).count() == 0
    assert rows(files.size_prefix(f.select("rel_file", "size"), 15)) == [(".git/c", 1, 1), ("d.PNG", 1, 2), ("h-0123456789abcdef.js", 5, 2 + 2097152 + 5)][:2]


def test_coverage_of_nothing(spark):
    e = tags(spark, []).select("rel_file")
    assert files.coverage(e, tags(spark, [])).first().coverage_pct == 100.0


def test_context_and_trimming(spark, rows):
    docs = spark.createDataFrame([("a.py", "one\n\nthree\n")], "rel_file string, text string")
    h = tags(spark, [("a.py", 3, "x", "def"), ("a.py", 1, "y", "def")])
    assert rows(render.context_lines(h, docs).select("line", "at", "text")) == [(1, 1, "one"), (3, 3, "three")]
    hits = [{"name": f"n{i}", "context": "c" * 400} for i in range(4)]
    for budget in (1000, 150, 60, 4, 1):
        out = render.trim_hits(hits, budget)
        assert out[0]["name"] == "n0" and (len(out) == 1 or sum(-(-len(str(v)) // 4) for h in out for v in h.values()) <= budget)
    r = render.fit_detail({"name": "f", "body": "b" * 9000, "callers": list(range(500)), "callees": list(range(500))}, 300)
    assert r["truncated"] and sum(-(-len(str(v)) // 4) for v in r.values() if v) <= 302
    assert not render.fit_detail({"name": "f"}, 300)["truncated"]
