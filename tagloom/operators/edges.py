"""From tags to stop names and reference edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

STOP_FILES = 50


def stop_names(tags: DataFrame, most: int = STOP_FILES) -> DataFrame:
    """Names that more than ``most`` files define. Exact: first distinct (name, file), then counted, so that a hot name shuffles once a file."""
    d = tags.filter("kind = 'def' and name is not null and rel_file is not null").select("name", "rel_file").distinct()
    return d.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("name")


def _sides(tags: DataFrame, distinct: bool) -> tuple[DataFrame, DataFrame]:
    """References and definitions by (name, file) with their row counts, stop names left out first: that bounds what a name can multiply to."""
    n = F.lit(1).cast("long") if distinct else F.count("*")
    by = tags.filter("name is not null and rel_file is not null and kind in ('def', 'ref')").groupBy("name", "rel_file", "kind").agg(n.alias("n"))
    kept = by.join(stop_names(tags), "name", "left_anti")
    r = kept.filter("kind = 'ref'").select("name", F.col("rel_file").alias("from_file"), F.col("n").alias("nr"))
    d = kept.filter("kind = 'def'").select("name", F.col("rel_file").alias("to_file"), F.col("n").alias("nd"))
    return r, d


def weighted_edges(tags: DataFrame, distinct: bool = False) -> DataFrame:
    """``from_file, to_file, name, n``: references of one file to a name that another file defines; ``n`` is how many pairs of rows make the edge.

    With ``distinct`` each (name, pair of files) is one edge. Names that more than 50 files define make none, files none to themselves. Rows with a null part
    make none. Repeated rows multiply, as they stand.
    """
    r, d = _sides(tags, distinct)
    return r.join(d, "name").filter("from_file != to_file").select("from_file", "to_file", "name", (F.col("nr") * F.col("nd")).alias("n"))


def bag_edges(tags: DataFrame) -> DataFrame:
    """The same as a multigraph, one row a pair of rows."""
    e = weighted_edges(tags)
    return e.select("from_file", "to_file", "name", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_i")).drop("_i")


def out_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rel_file, degree`` of every node: its edges with multiplicity, 0 for a node without."""
    n = edges.groupBy(F.col("from_file").alias("rel_file")).agg(F.count("*").alias("degree"))
    return nodes.join(n, "rel_file", "left").select("rel_file", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
