"""Most frequent values of a column in bounded memory: lossy counting per partition, summaries merged by key."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.session import cut

#: A summary keeps at most about (1 / EPSILON) * log(EPSILON * N) entries a partition.
EPSILON = 0.0002


def _summaries(cols: list[str], epsilon: float):
    """Arrow batches -> lossy counting entries of the partition, and one row with its total and last bucket."""
    width, keys_in = max(1, int(1 / epsilon)), [f"k{i}" for i in range(len(cols))]

    def run(batches):
        entries: dict[tuple, list[int]] = {}  # value -> [count since entry, most that was missed before]
        seen, bucket = 0, 1
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a slice never crosses a bucket boundary
                part = batch.slice(at, min(batch.num_rows - at, width - seen % width))
                at += part.num_rows
                seen += part.num_rows
                counted = pa.table([part.column(c) for c in cols], names=keys_in).group_by(keys_in).aggregate([([], "count_all")])
                for *key, n in zip(*(counted.column(c).to_pylist() for c in [*keys_in, "count_all"])):
                    e = entries.get(key := tuple(key))
                    if e:
                        e[0] += n
                    else:
                        entries[key] = [n, bucket - 1]
                if seen % width == 0:
                    entries = {k: e for k, e in entries.items() if e[0] + e[1] > bucket}
                    bucket += 1
        schema = pa.schema([*((c, pa.string()) for c in cols), ("_n", pa.int64()), ("_delta", pa.int64()), ("_missed", pa.int64()), ("_total", pa.int64())])
        keys = list(entries)
        missed = bucket - 1  # the most a value without an entry can have had here
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(len(cols))]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([e[0] for e in entries.values()], pa.int64()), pa.array([e[1] for e in entries.values()], pa.int64()),
             pa.array([missed] * len(keys), pa.int64()), pa.nulls(len(keys), pa.int64())], schema=schema)
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(1, pa.string()) for _ in cols), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([missed], pa.int64()), pa.array([seen], pa.int64())], schema=schema)

    return run


def frequent_items(df: DataFrame, cols: list[str], support: float, epsilon: float = EPSILON) -> tuple[DataFrame, int]:
    """Values of ``cols`` that may hold ``support`` of all rows, each with a guaranteed count interval; and the row count.

    Result columns: ``cols``, ``count_low``, ``count_high``: the true count lies between both. Every value with
    ``support * rows`` or more is there; others may be, if their ``count_high`` reaches that. Memory of a task and the
    shuffled rows depend on ``epsilon``, not on the number of different values.

    Nulls are values of their own (two nulls are equal). An empty table gives no rows and 0. Values are compared as
    strings as they stand. ``epsilon`` must be below ``support``.
    """
    if not 0 < epsilon < support:
        raise ValueError("epsilon must be positive and below support")
    slim = df.select(*(F.col(c).cast("string").alias(c) for c in cols))
    names = ", ".join(f"`{c}` string" for c in cols)
    parts = cut(slim.mapInArrow(_summaries(cols, epsilon), f"{names}, _n long, _delta long, _missed long, _total long"))
    head = parts.filter("_total is not null").agg(F.sum("_total").alias("rows"), F.sum("_missed").alias("missed")).first()
    rows, missed = head["rows"] or 0, head["missed"] or 0
    merged = (
        parts.filter("_total is null")
        .groupBy(*cols)
        .agg(F.sum("_n").alias("count_low"), F.sum(F.col("_n") + F.col("_delta") - F.col("_missed")).alias("_above"))
        .withColumn("count_high", F.col("_above") + F.lit(missed))
        .filter(F.col("count_high") >= F.lit(support * rows))
    )
    return merged.select(*cols, "count_low", "count_high"), rows


def frequent_exact(df: DataFrame, cols: list[str], support: float, epsilon: float = EPSILON) -> DataFrame:
    """``cols`` and ``_rows`` of exactly the values that hold ``support`` of all rows or more.

    The candidates are those of ``frequent_items``: at most ``1 / (support - epsilon)`` of them, which bounds what is
    broadcast; only rows of candidates are counted again. Null handling as there.
    """
    found, rows = frequent_items(df, cols, support, epsilon)
    few = found.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(cols)))
    same = None
    for i, c in enumerate(cols):
        eq = F.col(c).cast("string").eqNullSafe(F.col(f"_k{i}"))
        same = eq if same is None else same & eq
    again = df.select(*cols).join(F.broadcast(few), same, "left_semi").groupBy(*cols).agg(F.count("*").alias("_rows"))
    return again.filter(F.col("_rows") >= F.lit(support * rows))
