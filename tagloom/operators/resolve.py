"""Which imported name a bare reference means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tagloom.functions.text import base


def resolve_imports(refs: DataFrame, imports: DataFrame) -> DataFrame:
    """``source_file, name, qualified_name, confidence`` of each ``refs(source_file, name)``.

    ``imports(local_name, qualified_name, source_file, is_from_import)``. In this order: the file binds the name to one thing (1.0); all files together bind it to one thing (1.0); the file's
    from-imports bind it to one thing (0.8); else the shortest of the file's bindings, or of all where the file has none, the first by text on a tie (0.5);
    nothing binds it: the name itself (0.0). Null names are left out, repeats count once.
    """
    b = imports.filter("local_name is not null and qualified_name is not null").select("local_name", "qualified_name", "source_file", F.coalesce("is_from_import", F.lit(False)).alias("is_from")).distinct()
    shortest = F.min(F.struct(F.length("qualified_name").alias("n"), "qualified_name"))
    own = b.groupBy("source_file", F.col("local_name").alias("name")).agg(
        F.count_distinct("qualified_name").alias("own_n"), F.min("qualified_name").alias("own_one"), shortest.alias("own_short"),
        F.count_distinct(F.when(F.col("is_from"), F.col("qualified_name"))).alias("from_n"), F.min(F.when(F.col("is_from"), F.col("qualified_name"))).alias("from_one"),
    )
    every = b.groupBy(F.col("local_name").alias("name")).agg(F.count_distinct("qualified_name").alias("all_n"), F.min("qualified_name").alias("all_one"), shortest.alias("all_short"))
    r = refs.select("source_file", "name").filter("name is not null").distinct()
    j = r.join(own, ["source_file", "name"], "left").join(every, "name", "left")
    chosen = (
        F.when(F.col("own_n") == 1, F.struct(F.col("own_one").alias("q"), F.lit(1.0).alias("c")))
        .when(F.col("all_n") == 1, F.struct(F.col("all_one").alias("q"), F.lit(1.0).alias("c")))
        .when(F.col("from_n") == 1, F.struct(F.col("from_one").alias("q"), F.lit(0.8).alias("c")))
        .when(F.col("own_n") > 1, F.struct(F.col("own_short.qualified_name").alias("q"), F.lit(0.5).alias("c")))
        .when(F.col("all_n") > 1, F.struct(F.col("all_short.qualified_name").alias("q"), F.lit(0.5).alias("c")))
        .otherwise(F.struct(F.col("name").alias("q"), F.lit(0.0).alias("c")))
    )
    return j.select("source_file", "name", chosen["q"].alias("qualified_name"), chosen["c"].alias("confidence"))


def qualified_fanout(resolved: DataFrame) -> DataFrame:
    """Each reference under its bare name, and under the resolved one where that differs."""
    return resolved.select("source_file", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name"))


def lookup(queries: DataFrame, table: DataFrame) -> DataFrame:
    """``query, name, rel_file, line, fallback``: rows under the queried name; where there are none, rows with the same base name, flagged.

    ``queries(query)``, ``table(name, rel_file, line)``. Null queries find nothing.
    """
    q = queries.select("query").filter("query is not null").distinct()
    t = table.filter("name is not null").select("name", "rel_file", "line").distinct()
    exact = q.join(t, q["query"] == t["name"]).select("query", "name", "rel_file", "line", F.lit(False).alias("fallback"))
    missed = q.join(t.select(F.col("name").alias("query")).distinct(), "query", "left_anti").withColumn("b", base(F.col("query")))
    other = missed.join(t.withColumn("b", base(F.col("name"))), "b").select("query", "name", "rel_file", "line", F.lit(True).alias("fallback"))
    return exact.unionByName(other)


def symbol_ladder(symbols: DataFrame, query: str) -> DataFrame:
    """The one symbol a name means: the very name, else its base name, else one that holds it or that it holds; the first by file and line."""
    low, q = F.lower("name"), query.lower()
    tier = F.when(F.col("name") == query, 0).when(base(F.col("name")) == query.split("::", 1)[-1].split("(")[0], 1).when(low.contains(q) | F.contains(F.lit(q), low), 2)
    hit = symbols.filter("name is not null and name != ''").select("file", "line", "name", "type").distinct().withColumn("tier", tier.cast("long")).filter("tier is not null")
    return hit.orderBy("tier", "file", "line", "name", "type").limit(1)


def ambiguous(imports: DataFrame) -> DataFrame:
    """Local names that stand for more than one thing, with how many."""
    w = Window.partitionBy("local_name")
    b = imports.select("local_name", "qualified_name").filter("local_name is not null and qualified_name is not null").distinct()
    return b.withColumn("n", F.count("*").over(w)).filter("n > 1")
