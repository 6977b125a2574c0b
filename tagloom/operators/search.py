"""Identifier search over tags and symbols: exact, substring, pattern, spelling variants, edit distance and token overlap."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.functions.text import base, boundary_rank, compact, doc_head, edit_distance, is_test, matches_any, query_variants, rescue_tokens, tokens, tokens_of

MOST = 200


def clamp(limit: int) -> int:
    return max(1, min(MOST, limit))


def interleave(hits: DataFrame, key: list[str], limit: int) -> DataFrame:
    """The best hit of each file, then the second best of each, and so on; files in the order of their best hit. ``round`` starts at 1.

    ``key`` are the ordering columns, total together with file, line, name and kind. No window is over all hits: files are compared by their best key, and only
    ``limit`` rounds of a file are kept, which a partial limit does before the shuffle.
    """
    total = [*key, "line", "name", "kind"]
    w = Window.partitionBy("rel_file").orderBy(*total)
    kept = hits.withColumn("round", F.row_number().over(w).cast("long")).filter(F.col("round") <= limit)
    best = F.first(F.struct(*key, "rel_file", *total[len(key) :])).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return kept.withColumn("_best", best).orderBy("round", "_best").limit(limit).drop("_best")


def _kinds(tags: DataFrame, definitions: bool, references: bool) -> DataFrame:
    kinds = ["def"] * definitions + ["ref"] * references
    return tags.filter(F.col("kind").isin(*kinds) & F.col("name").isNotNull() & F.col("rel_file").isNotNull()).select("rel_file", "line", "name", "kind").distinct()


def _match(query: str, mode: str) -> tuple[Column, Column]:
    low, q = F.lower("name"), query.lower()
    if mode == "exact":
        return low == q, F.lit(0)
    if mode == "substring":
        return low.contains(q), F.instr(low, q) - 1
    if mode == "regex":
        try:
            re.compile(query)
        except re.error as e:
            raise ValueError(f"invalid pattern: {e}") from e
        return F.col("name").rlike(f"(?i){query}"), F.lit(-1)
    raise ValueError(f"unknown mode: {mode}")


def detect(tags: DataFrame, query: str, mode: str = "substring", limit: int = 10, definitions: bool = True, references: bool = True) -> DataFrame:
    """``rel_file, line, name, kind, round``: hits, definitions and files outside tests first, then by the place of the query in the name.

    Case is ignored. Repeated rows are one hit; null names and files are none. An empty query gives no rows; an invalid pattern raises ValueError.
    """
    found, at = _match(query, mode)
    hits = _kinds(tags, definitions, references).filter(found if query else F.lit(False))
    keyed = hits.withColumn("t", is_test(F.col("rel_file")).cast("int")).withColumn("nd", (F.col("kind") != "def").cast("int")).withColumn("at", at.cast("int"))
    return interleave(keyed, ["t", "nd", "at"], clamp(limit)).select("rel_file", "line", "name", "kind", "round")


def variants(tags: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Hits of other spellings of the query, by the first spelling that a name contains; ``variant`` is its number."""
    vs = query_variants(query)
    low = F.lower("name")
    which = F.coalesce(*(F.when(low.contains(v), F.lit(i)) for i, v in enumerate(vs))) if vs else F.lit(None).cast("int")
    hits = _kinds(tags, True, True).withColumn("variant", which).filter("variant is not null")
    keyed = hits.withColumn("t", is_test(F.col("rel_file")).cast("int")).withColumn("nd", (F.col("kind") != "def").cast("int"))
    return interleave(keyed, ["variant", "t", "nd"], clamp(limit)).select("rel_file", "line", "name", "kind", F.col("variant").cast("long").alias("variant"), "round")


def close_names(names: DataFrame, query: str) -> DataFrame:
    """``name, d, overlap`` of names within edit distance 2, or that share more than half of the query's parts."""
    q = list(dict.fromkeys(rescue_tokens(query)))
    d = edit_distance(F.lower(base(F.col("name"))), query.lower())
    shared = F.size(F.array_intersect(tokens(F.col("name")), F.array(*map(F.lit, q)))) if q else F.lit(0)
    scored = names.select("name").filter("name is not null").distinct().select("name", d.cast("long").alias("d"), shared.cast("long").alias("overlap"))
    return scored.filter((F.col("d") <= 2) | (F.col("overlap") * 2 > len(q)))


def fuzzy(tags: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Hits of close names: the best ``2 * limit`` by distance and overlap, of these the best ``limit`` by distance. Names are scored once each."""
    k = clamp(limit)
    hits = _kinds(tags, True, True).join(close_names(tags, query), "name")
    nd = (F.col("kind") != "def").cast("int")
    pool = hits.orderBy("d", F.desc("overlap"), nd, "name", "rel_file", "line").limit(2 * k)
    return pool.orderBy("d", nd, "name", "rel_file", "line").limit(k).select("rel_file", "line", "name", "kind", "d", "overlap")


def tiered(tags: DataFrame, query: str, mode: str = "substring", limit: int = 10, content: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The hits of the first tier that has any (``quality`` exact, then fuzzy: variants, close names, then what ``content()`` gives, a search by what code does). Each later tier runs only if the ones before are empty."""
    first = detect(tags, query, mode, limit).withColumn("quality", F.lit("exact"))
    if not first.isEmpty():
        return first
    cols = ["rel_file", "line", "name", "kind"]
    second = variants(tags, query, limit)
    tier = second if not second.isEmpty() else fuzzy(tags, query, limit).withColumn("round", F.lit(1).cast("long"))
    if content is not None and tier.isEmpty():
        return content().select("rel_file", "line", "name", F.lit("def").alias("kind"), F.lit(1).cast("long").alias("round"), F.lit("content").alias("quality"))
    return tier.select(*cols, "round").withColumn("quality", F.lit("fuzzy"))


def symbols(table: DataFrame, query: str = "", type_: str | None = None, file: str | None = None, limit: int = 10) -> DataFrame:
    """Symbols by name substring, type and file substring, ordered by how the query sits in the name, tests last; one row a (file, line, name, type).

    ``signature`` has its white space folded, ``docstring`` is cut at 200 characters with ``docstring_omitted`` the rest. Of rows that disagree the greatest
    values come out. Null names or files are left out.
    """
    t = table.filter("name is not null and file is not null")
    if query:
        t = t.filter(F.lower("name").contains(query.lower()))
    if type_:
        t = t.filter(F.col("type") == type_)
    if file:
        t = t.filter(F.lower("file").contains(file.lower()))
    one = t.groupBy("file", "line", "name", "type").agg(F.max("signature").alias("signature"), F.max("docstring").alias("docstring"))
    keyed = one.withColumn("b", boundary_rank(F.col("name"), query) if query else F.lit(0)).withColumn("t", is_test(F.col("file")).cast("int") if query else F.lit(0))
    top = keyed.orderBy("b", "t", "type", "name", "file", "line").limit(clamp(limit))
    return top.select("file", "line", "name", "type", compact(F.col("signature")).alias("signature"), doc_head(F.col("docstring")).alias("docstring"), F.greatest(F.lit(0), F.length("docstring") - 200).cast("long").alias("docstring_omitted"))


def symbols_rescue(table: DataFrame, query: str, type_: str | None = None, limit: int = 10) -> DataFrame:
    """Symbols whose name is close to the query or holds one of its spellings: by fit, tests last, then distance."""
    vs = query_variants(query)
    t = table.filter("name is not null and file is not null")
    if type_:
        t = t.filter(F.col("type") == type_)
    one = t.select("file", "line", "name", "type").distinct()
    close = close_names(one, query).select("name", "d")
    spelled = one.select("name").distinct().filter(F.exists(F.array(*map(F.lit, vs)), lambda v: F.lower("name").contains(v))) if vs else one.select("name").limit(0)
    names = close.unionByName(spelled.select("name", F.lit(3).cast("long").alias("d"))).groupBy("name").agg(F.min("d").alias("d"))
    keyed = one.join(names, "name").withColumn("b", boundary_rank(F.col("name"), query)).withColumn("t", is_test(F.col("file")).cast("int"))
    return keyed.orderBy("b", "t", "d", "type", "name", "file", "line").limit(clamp(limit)).select("file", "line", "name", "type", "d")


def symbols_lookup(table: DataFrame, query: str, type_: str | None = None, limit: int = 10) -> DataFrame:
    """``file, line, name, type, quality``: symbols whose name holds the query (``exact``), or, only where there are none, close ones (``fuzzy``)."""
    cols = ["file", "line", "name", "type"]
    first = symbols(table, query, type_, limit=limit).select(*cols, F.lit("exact").alias("quality"))
    return first if not first.isEmpty() else symbols_rescue(table, query, type_, limit).select(*cols, F.lit("fuzzy").alias("quality"))


def overlap_counts(names: DataFrame, query: str) -> DataFrame:
    """``name, overlap`` of names that share a part with the query."""
    q = list(dict.fromkeys(tokens_of(query)))
    n = F.size(F.array_intersect(tokens(F.col("name")), F.array(*map(F.lit, q)))).cast("long")
    return names.select("name").filter("name is not null").distinct().select("name", n.alias("overlap")).filter("overlap > 0")


def best_location(tags: DataFrame, query: str) -> DataFrame:
    """The one hit to jump to: a definition before a reference, the very name before others, then by file and line."""
    hits = _kinds(tags, True, True).filter(F.lower("name").contains(query.lower()))
    return hits.orderBy((F.col("kind") != "def").cast("int"), (F.col("name") != query).cast("int"), "rel_file", "line", "name", "kind").limit(1)


def filter_paths(table: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    path = F.col("rel_file")
    kept = table.filter(path.isNotNull())
    if include:
        kept = kept.filter(matches_any(path, list(include)))
    return kept.filter(~matches_any(path, list(exclude)))
