"""Per-key results over rows where a few keys hold most of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tagloom.session import cut, shuffle_partitions


def _fold(key: str, sums: list[str]):
    """Sorted batches -> one row for each run of equal keys; ``_edge`` marks the first and last key of the partition."""
    schema = pa.schema([(key, pa.string()), *((s, pa.int64()) for s in sums), ("_edge", pa.bool_())])

    def out(keys, states, edge):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(x) for x in states), pa.array(edge, pa.bool_())], schema=schema)

    def run(batches):
        held, first = None, True  # the last key may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            ree = pc.run_end_encode(batch.column(key))
            starts = np.concatenate([[0], np.asarray(ree.run_ends)[:-1]]).astype(np.int64)
            keys = ree.values.to_pylist()
            states = np.stack([np.add.reduceat(np.asarray(batch.column(s)), starts) for s in sums])
            if held is not None:
                if keys[0] == held[0]:
                    states[:, 0] += held[1]
                else:
                    yield out([held[0]], held[1][:, None], [first])
                    first = False
            if len(keys) > 1:
                yield out(keys[:-1], states[:, :-1], [first, *[False] * (len(keys) - 2)])
                first = False
            held = keys[-1], states[:, -1].copy()
        if held is not None:
            yield out([held[0]], held[1][:, None], [True])

    return run


def range_fold(rows: DataFrame, key: str, secondary: str, sums: list[str], partitions: int | None = None) -> DataFrame:
    """Sums of ``sums`` by ``key``, with partitions of even size however unevenly keys hold rows.

    The rows are range-partitioned on (key, secondary) by sampled quantiles, so a heavy key spans as many partitions as
    it needs; each partition is sorted and folded to one partial state a key. Only the first and last key of a partition
    can go on elsewhere: those states, two a partition at most, are stitched by a second sum.

    Null keys are dropped; null in ``secondary`` is one value among others.
    """
    spark = rows.sparkSession
    n = partitions or shuffle_partitions(spark)
    slim = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), F.col(secondary).alias("_2"), *(F.col(s).cast("long").alias(s) for s in sums))
    ranged = slim.repartitionByRange(n, key, "_2").sortWithinPartitions(key, "_2").drop("_2")
    parts = cut(ranged.mapInArrow(_fold(key, sums), f"`{key}` string, " + "".join(f"`{s}` long, " for s in sums) + "_edge boolean"))
    stitched = parts.filter("_edge").groupBy(key).agg(*(F.sum(s).alias(s) for s in sums))
    return parts.filter("not _edge").select(key, *sums).unionByName(stitched)


def name_totals(tags: DataFrame, refs: DataFrame, stop_names: DataFrame, threshold: int = 50) -> DataFrame:
    """Per name: rows of kind def and ref, files that define it, files it occurs in, edges, and stop-name facts.

    Columns ``name, n_defs, n_refs, def_files, files, edges, belongs, listed``: ``belongs`` says that more than
    ``threshold`` files define the name, ``listed`` that ``stop_names`` has it. Repeats count as rows, never as files;
    null names are no names; a null file is no file. Rows are first summed by (name, file), which no hot name can unbalance
    because its files part it; every row of that sum is one file of the name, so distinct files become plain sums. Files go
    through the shuffles as 64-bit hashes of their paths: two files of one name that share a hash would count once (a
    chance below 1 in 30 million for a name in a million files).
    """
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    t = tags.select("name", hashed("rel_file").alias("at"), (F.col("kind") == "def").cast("long").alias("d"), (F.col("kind") == "ref").cast("long").alias("r"), F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("e"))
    e = refs.select("name", hashed("from_file").alias("at"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("t"), F.lit(1).cast("long").alias("e"))
    by_file = (
        t.unionByName(e)
        .filter("name is not null")
        .groupBy("name", "at")
        .agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in "drte"))
        .select(
            "name", "at",
            F.col("d").alias("n_defs"), F.col("r").alias("n_refs"), F.col("e").alias("edges"),
            (F.col("at").isNotNull() & (F.col("d") > 0)).cast("long").alias("def_files"),
            (F.col("at").isNotNull() & (F.col("t") > 0)).cast("long").alias("files"),
        )
    )
    sums = range_fold(by_file, "name", "at", ["n_defs", "n_refs", "def_files", "files", "edges"])
    listed = stop_names.select("name").filter("name is not null").distinct().withColumn("listed", F.lit(True))
    return sums.join(listed, "name", "left").select(
        "name", "n_defs", "n_refs", "def_files", "files", "edges", (F.col("def_files") > threshold).alias("belongs"), F.coalesce("listed", F.lit(False)).alias("listed")
    )
