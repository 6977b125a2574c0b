from collections import Counter

import pytest

from tagloom.operators import incremental, skewed


def test_files_to_process(spark, rows):
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    state = spark.createDataFrame(
        [("same", 1, 1, 2, t), ("same", 9, 9, 1, t), ("same", 1, 1, 2, t), ("grown", 2, 1, 3, t), ("gone", 1, 1, 1, t), ("gone", None, None, 4, t), ("failed", 5, 5, 2, t), ("new", 1, 1, 1, t), ("touched", 1, 2, 1, t), ("half", None, 3, 1, t), (None, 1, 1, 1, t), ("late", 7, 7, 5, t), ("late", 6, 6, 4, t + dt.timedelta(9))],
        "rel_file string, size long, mtime_ns long, scan_id int, received_at timestamp")
    wrote = spark.createDataFrame([("same", 1, 1, 1), ("same", 1, 1, 1), ("grown", 1, 1, 1), ("gone", 1, 1, 1), ("failed", 5, 5, 2), ("touched", 1, 1, 1), ("half", None, 3, 1), ("late", 7, 7, 3), ("late", 6, 6, 1), ("unknown", 1, 1, 9)], "rel_file string, size long, mtime_ns long, run_id int")
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "ok"), (4, None)], "run_id int, status string")
    got = lambda *a: [r[0] for r in rows(incremental.files_to_process(*a).select("rel_file"))]
    assert got(state, wrote, runs) == ["failed", "grown", "new", "touched"]
    assert len(got(state, wrote, runs.limit(0))) == 7 and got(state.limit(0), wrote, runs) == []


def test_manifest_survives_failure(spark, tmp_path):
    cols = "path string, size long, checksum string, junk string"
    one = spark.createDataFrame([("a", 1, "x", "j"), ("b", 1, "x", "j")], cols)
    two = spark.createDataFrame([("a", 2, "y", "j"), ("b", 1, "x", "j"), ("c", 1, "z", None)], cols)
    m = incremental.Manifest(spark, f"file://{tmp_path}/m")
    assert m.results() is None and m.pending(one).count() == 2
    with pytest.raises(RuntimeError):
        m.run(one, lambda df: (_ for _ in ()).throw(RuntimeError("lost")), "0001")
    assert m.committed() == [] and m.pending(one).count() == 2
    m.run(one, lambda df: df, "0001")
    m.run(one, lambda df: df, "0001")  # a repeated batch is no second one
    assert m.results().count() == 2 and m.pending(one).count() == 0
    assert sorted(r.path for r in m.pending(two).collect()) == ["a", "c"]
    m.run(two, lambda df: df)
    assert m.pending(two).count() == 0 and sorted((r.path, r.size) for r in m.results().collect()) == [("a", 2), ("b", 1), ("c", 1)]
    assert m.compact() and m.pending(two).count() == 0 and sorted(r.path for r in m.pending(one).collect()) == ["a"]
    m.run(one, lambda df: df)
    assert sorted((r.path, r.size) for r in m.results().collect()) == [("a", 1), ("b", 1), ("c", 1)] and [r.path for r in m.results(two.filter("path = 'a'")).collect()] == ["a"]


@pytest.mark.parametrize("step", ["data", "manifest", "commits"])
def test_a_crash_at_any_write_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, step):
    from pyspark.sql import DataFrameWriter

    d = spark.createDataFrame([("a", 1, "x"), (None, 1, "x")], "path string, size long, checksum string")
    m = incremental.Manifest(spark, f"file://{tmp_path}/m")
    write, put = DataFrameWriter.parquet, m._put

    def torn(self, path, *a, **k):
        write(self, path, *a, **k)
        if f"/{step}/" in path:
            raise RuntimeError("lost")

    with monkeypatch.context() as p:
        p.setattr(DataFrameWriter, "parquet", torn)
        if step == "commits":
            p.setattr(m, "_put", lambda *a: (_ for _ in ()).throw(OSError("no rename")))
        with pytest.raises((RuntimeError, OSError)):
            m.run(d, lambda df: df, "0001")
    assert m.committed() == [] and m.results() is None and m._put == put
    m.run(d, lambda df: df, "0002")
    assert [r.path for r in m.results().collect()] == ["a"] and m.pending(d.filter("path is not null")).count() == 0


def test_a_file_that_changes_while_it_is_processed_comes_again(spark, tmp_path):
    source = str(tmp_path / "listing")
    state = lambda size: spark.createDataFrame([("a", size, str(size))], "path string, size long, checksum string").write.mode("overwrite").parquet(source)
    state(1)
    listing = spark.read.parquet(source)
    m = incremental.Manifest(spark, f"file://{tmp_path}/m")

    def process(df):
        out = df.select("path", "size")
        out.count()
        state(2)
        return out

    m.run(listing, process)
    now = spark.read.parquet(source)
    assert [r["size"] for r in m.results().collect()] == [1] and m.pending(now).count() == 1
    other = incremental.Manifest(spark, m.root)
    m.run(now, lambda df: other.run(now, lambda x: x) and df)  # two runs at once take the same file
    assert [r["size"] for r in m.results().collect()] == [2] and len(m.committed()) == 3


def test_folder_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x")
    m = incremental.Manifest(spark, f"file://{tmp_path}/m")
    seen = incremental.list_folder(spark, f"file://{tmp_path}/d")
    m.run(seen, lambda df: df)
    (tmp_path / "d" / "b.py").write_text("y")
    assert [r.path.rsplit("/", 1)[-1] for r in m.pending(incremental.list_folder(spark, f"file://{tmp_path}/d")).collect()] == ["b.py"]


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_range_fold_is_a_sum(spark, partitions):
    xs = [("hot" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None, i % 11, i) for i in range(5000)]
    d = spark.createDataFrame(xs, "edge string, s int, n int")
    truth = Counter()
    for k, _, n in xs:
        if k is not None:
            truth[k] += n
    got = {r.edge: r.n for r in skewed.range_fold(d, "edge", "s", ["n"], partitions).collect()}
    assert got == dict(truth)


def test_name_totals(spark, rows):
    t = spark.createDataFrame([("a", "f1", "def"), ("a", "f1", "def"), ("a", "f2", "ref"), ("a", None, "def"), (None, "f1", "def"), ("b", "f1", "ref")] + [("s", f"g{i}", "def") for i in range(51)], "name string, rel_file string, kind string")
    e = spark.createDataFrame([("a", "f9"), ("only", "f1"), (None, "f1")], "name string, from_file string")
    stop = spark.createDataFrame([("a",), ("a",), (None,)], "name string")
    got = {r.name: tuple(r)[1:] for r in skewed.name_totals(t, e, stop).collect()}
    assert got == {"a": (3, 1, 1, 2, 1, False, True), "b": (0, 1, 0, 1, 0, False, False), "only": (0, 0, 0, 0, 1, False, False), "s": (51, 0, 51, 51, 0, True, False)}
    assert skewed.name_totals(t.limit(0), e.limit(0), stop.limit(0)).count() == 0
