"""File ranks by power iteration, and tags ranked by them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.session import cut, shuffle_partitions

ALPHA, TOLERANCE, MOST = 0.85, 1e-6, 100
#: A graph of no more different edges and nodes than that, some tens of megabytes, is iterated within one task: a step over it costs less than starting a job.
SMALL_EDGES, SMALL_NODES = 1_000_000, 500_000


def _iterate(alpha: float, steps: int, tolerance: float | None, even: bool):
    """The power iteration of ``pagerank`` over one group of edges and nodes, in arrays."""

    def run(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        index = pd.Index(nodes["rel_file"])
        k = len(index)
        src, dst, n = index.get_indexer(edges["from_file"]), index.get_indexer(edges["to_file"]), edges["n"].to_numpy(np.float64)
        out = np.bincount(src[src >= 0], n[src >= 0], k)
        inside = (src >= 0) & (dst >= 0)
        src, dst = src[inside], dst[inside]
        w = n[inside] / out[src]
        jump, rank = nodes["jump"].to_numpy(), nodes["raw"].to_numpy() / nodes["raw"].sum()
        for _ in range(steps):
            new = (1 - alpha) * jump + alpha * (np.bincount(dst, rank[src] * w, k) + rank[out == 0].sum() * (1.0 / k if even else jump))
            new /= new.sum()
            change, rank = np.abs(new - rank).sum(), new
            if tolerance is not None and change < tolerance:
                break
        return pd.DataFrame({"rel_file": index, "rank": rank})

    return run


def pagerank(
    edges: DataFrame, nodes: DataFrame, alpha: float = ALPHA, iterations: int | None = None, tolerance: float = TOLERANCE, most: int = MOST,
    start: DataFrame | None = None, teleport: DataFrame | None = None,
) -> DataFrame:
    """``rel_file, rank`` of every row of ``nodes(rel_file)`` over the multigraph ``edges(from_file, to_file)``; a column ``n`` of edges is how many parallel edges a row stands for.

    Mass flows along all edges of a node alike, also along those that leave ``nodes``; dangling mass is spread evenly; every step ends by
    normalising to 1. Steps go on until the summed change is below ``tolerance`` (at most ``most``), or ``iterations`` times. ``start(rel_file, weight)`` only seeds the first
    vector, which the fixed point forgets; ``teleport(rel_file, weight)`` replaces the even teleport, which is true personalisation. Null nodes are dropped,
    repeated ones count once. No nodes give no rows.

    Parallel edges are summed to weights once. A graph within SMALL_EDGES and SMALL_NODES goes to one task; of a larger one, weights and vector are laid out by file once: a step is one join without
    shuffle, one aggregation by target, and one small aggregate that gives normaliser, dangling mass and the change of the step before. Each vector is written, which cuts the lineage.
    """
    p = shuffle_partitions(nodes.sparkSession)
    n_ = cut(nodes.select("rel_file").filter("rel_file is not null").distinct())
    n = n_.count()
    if n == 0:
        return n_.withColumn("rank", F.lit(0.0))
    e = cut(edges.filter("from_file is not null").groupBy("from_file", "to_file").agg((F.sum("n") if "n" in edges.columns else F.count("*")).alias("n")))
    small = n <= SMALL_NODES and e.count() <= SMALL_EDGES
    deg = e.groupBy("from_file").agg(F.sum("n").alias("deg"))
    inner = e.join(deg, "from_file").join(n_.select(F.col("rel_file").alias("to_file")), "to_file", "left_semi")
    base = n_.join(deg.select(F.col("from_file").alias("rel_file"), F.lit(False).alias("dangling")), "rel_file", "left").withColumn("dangling", F.coalesce("dangling", F.lit(True)))
    if teleport is not None:
        t = teleport.groupBy("rel_file").agg(F.sum("weight").alias("tw"))
        base = base.join(t, "rel_file", "left").withColumn("tw", F.coalesce("tw", F.lit(0.0)))
        total = base.agg(F.sum("tw")).first()[0] or 0.0
        base = base.withColumn("jump", F.col("tw") / total if total else F.lit(1.0 / n)).drop("tw")
    else:
        base = base.withColumn("jump", F.lit(1.0 / n))
    if start is not None:
        s = start.groupBy("rel_file").agg(F.sum("weight").alias("sw"))
        base = base.join(s, "rel_file", "left").withColumn("raw", F.lit(1.0) + F.coalesce("sw", F.lit(0.0))).drop("sw")
    else:
        base = base.withColumn("raw", F.lit(1.0 / n))
    if small:
        one = lambda df: df.withColumn("_g", F.lit(0)).groupBy("_g")
        run = _iterate(alpha, iterations or most, None if iterations else tolerance, teleport is None)
        return one(e).cogroup(one(base.select("rel_file", "jump", "raw"))).applyInPandas(run, "rel_file string, rank double")
    weights = cut(inner.select("from_file", "to_file", (F.col("n") / F.col("deg")).alias("w")).repartition(p, "from_file"))
    now = cut(base.withColumn("old", F.lit(0.0)).withColumn("older", F.lit(1.0)).repartition(p, "rel_file"))
    sums = lambda v: v.agg(F.sum("raw").alias("total"), F.sum(F.when(F.col("dangling"), F.col("raw"))).alias("mass"), F.sum(F.abs(F.col("old") - F.col("older"))).alias("change")).first()
    s = sums(now)
    for step in range(iterations or most):
        total, mass = s["total"], (s["mass"] or 0.0) / s["total"]
        rank = F.col("raw") / F.lit(total)
        came = weights.join(now.select(F.col("rel_file").alias("from_file"), rank.alias("rank")), "from_file").groupBy(F.col("to_file").alias("rel_file")).agg(F.sum(F.col("rank") * F.col("w")).alias("came"))
        spread = F.lit(mass) * F.col("jump") if teleport is not None else F.lit(mass / n)
        new = now.select("rel_file", "dangling", "jump", rank.alias("old"), F.col("old").alias("older")).join(came, "rel_file", "left").select(
            "rel_file", "dangling", "jump", (F.lit(1 - alpha) * F.col("jump") + F.lit(alpha) * (F.coalesce("came", F.lit(0.0)) + spread)).alias("raw"), "old", "older"
        )
        now = cut(new)
        s = sums(now)
        if iterations is None and step and s["change"] < tolerance:  # the step before changed no more than that: its vector is the result
            return now.select("rel_file", F.col("old").alias("rank"))
    return now.select("rel_file", (F.col("raw") / F.lit(s["total"])).alias("rank"))


def boosted(ranks: DataFrame, tags: DataFrame, idents: list[str] = (), files: list[str] = (), chat: list[str] | Column = (), least: float | None = None) -> DataFrame:
    """``rank, rel_file, line, name, kind``: definitions with the rank of their file, times 10 for a mentioned identifier, 5 for a mentioned file, 20 for a file
    under discussion (``chat``: names, or a condition on ``rel_file``). ``least`` drops files ranked no higher. Repeats keep their first row."""
    kept = ranks.filter(F.col("rank") > least) if least is not None else ranks
    open_ = chat if isinstance(chat, Column) else F.col("rel_file").isin(*chat)
    b = F.col("rank") * F.when(F.col("name").isin(*idents), 10.0).otherwise(1.0) * F.when(F.col("rel_file").isin(*files), 5.0).otherwise(1.0) * F.when(open_, 20.0).otherwise(1.0)
    d = tags.filter("kind = 'def' and name is not null").select("rel_file", "line", "name", "kind").distinct()
    return d.join(kept, "rel_file").select(b.alias("rank"), "rel_file", "line", "name", "kind")


def budget_prefix(rows: DataFrame, order: list, cost, budget: int, keep_first: bool = True) -> DataFrame:
    """The longest prefix of ``rows`` in ``order`` whose summed ``cost`` stays within ``budget``, with ``position`` and ``spent``.

    A row costs 1 at least, so only the first ``budget`` rows can be in it: those are taken by a distributed top-k before the running sum, which then
    is over a bounded number of rows. The first row is kept even if it alone costs more. ``order`` must be total.
    """
    top = rows.withColumn("_cost", F.greatest(F.lit(1), cost).cast("long")).orderBy(*order).limit(max(1, budget))
    w = Window.orderBy(*order)
    run = top.withColumn("position", F.row_number().over(w).cast("long")).withColumn("spent", F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    fits = F.col("spent") <= budget
    return run.filter(fits | (F.col("position") == 1) if keep_first else fits).drop("_cost")


def top_subgraph(ranks: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """``from_file, to_file, n``: the edges among the ``n`` highest ranked files."""
    top = ranks.orderBy(F.desc("rank"), "rel_file").limit(n).select("rel_file")
    e = edges.groupBy("from_file", "to_file").agg(F.count("*").alias("n"))
    return e.join(top.withColumnRenamed("rel_file", "from_file"), "from_file", "left_semi").join(top.withColumnRenamed("rel_file", "to_file"), "to_file", "left_semi")

