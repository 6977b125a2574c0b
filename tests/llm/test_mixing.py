import os

import pytest

pytest.importorskip("tiktoken")
from tagloom.llm import mixing  # noqa: E402
from tagloom.llm.encode import VOCAB  # noqa: E402

if not os.path.exists(VOCAB):
    pytest.skip("no vocabulary", allow_module_level=True)


def docs(spark, sizes):
    rows, i = [], 0
    for s, lens in sizes.items():
        for n in lens:
            rows.append((i, s, " a" * n if n is not None else None, 0.5))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, source string, text string, rate double")


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    d = docs(spark, {"big": [5 + i % 60 for i in range(3000)], "small": [10 + i % 7 for i in range(80)], "tiny": [4] * 30 + [None, 0], "other": [9] * 10, None: [5]})
    t = targets(spark, ("big", 0.6, 1), ("small", 0.3, 4), ("tiny", 0.05, 3), ("none", 0.05, 5), (None, 0.1, 1))
    m = mixing.mix(d, t)
    rows = m.collect()
    assert {r.source for r in rows} == {"big", "small", "tiny"} and all(1 <= r.copies <= {"big": 1, "small": 4, "tiny": 3}[r.source] for r in rows)
    s = {r.source: r for r in mixing.shares(m, t).collect()}
    for k, v in {"big": 0.6, "small": 0.3, "tiny": 0.05}.items():
        assert s[k].share == pytest.approx(v / 0.95, abs=0.01)
    assert s["none"].share == 0 and s["none"].docs == 0 and len(s) == 4
    assert s["tiny"].copies == 90  # the source that limits the mixture gives all it may


def test_size_beyond_what_a_source_can_give(spark):
    d = docs(spark, {"a": [10] * 100, "b": [10] * 10})
    m = mixing.mix(d, targets(spark, ("a", 0.5, 1), ("b", 0.5, 2)), total_tokens=1000)
    got = {r["source"]: r["n"] for r in m.selectExpr("source", "copies").groupBy("source").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect()}
    assert got["b"] == 20 and got["a"] == 50


def test_rates_are_tilted(spark):
    d = docs(spark, {"a": [1] * 50 + [40] * 50, "b": [10]})
    rows = mixing.mix(d, targets(spark, ("a", 0.9, 3), ("b", 0.1, 5))).collect()
    by = {r.tokens: r.rate for r in rows if r.source == "a"}
    total = sum(r.tokens * r.copies for r in rows if r.source == "a")
    assert total == pytest.approx(450, abs=45) and by.get(1, 0) > by.get(40, 0)


def test_nothing(spark):
    d, t = docs(spark, {"a": [1]}), targets(spark, ("a", 1.0, 1))
    assert mixing.mix(d.limit(0), t).count() == 0 and mixing.mix(d, t.limit(0)).count() == 0
    assert [r.share for r in mixing.shares(mixing.mix(d.limit(0), t), t).collect()] == [0.0]
    assert mixing.mix(d, t).first().copies == 1
