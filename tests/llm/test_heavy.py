from collections import Counter

import pytest

from tagloom.llm import heavy


def names(spark, xs, partitions=3):
    return spark.createDataFrame([(x, k, 1) for x, k in xs], "name string, kind string, n int").repartition(partitions)


@pytest.mark.parametrize("hot", [0.001, 0.4])
def test_intervals_hold_the_truth(spark, hot):
    n = 20_000
    xs = [("hot" if i < n * hot else f"x{i % 4000}" if i % 3 else None, "def" if i % 2 else "ref") for i in range(n)]
    truth = Counter(xs)
    found, rows = heavy.frequent_items(names(spark, xs), ["name", "kind"], 0.01, 0.001)
    got = {(r.name, r.kind): (r.count_low, r.count_high) for r in found.collect()}
    assert rows == n and all(got[k][0] <= truth[k] <= got[k][1] for k in got) and all(k in got for k, v in truth.items() if v >= 0.01 * n)
    exact = {(r.name, r.kind): r["_rows"] for r in heavy.frequent_exact(names(spark, xs), ["name", "kind"], 0.01, 0.001).collect()}
    assert exact == {k: v for k, v in truth.items() if v >= 0.01 * n}


def test_frequent_of_nothing_and_clashing_names(spark):
    e, rows = heavy.frequent_items(names(spark, [("a", "b")]).limit(0), ["name"], 0.1)
    assert rows == 0 and e.count() == 0
    d = spark.createDataFrame([("a", "b")] * 5, "n string, total string")
    assert [tuple(r) for r in heavy.frequent_exact(d, ["n", "total"], 0.5).collect()] == [("a", "b", 5)]
    with pytest.raises(ValueError):
        heavy.frequent_items(d, ["n"], 0.1, 0.2)
