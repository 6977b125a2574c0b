"""Lines within spans: what a definition reaches over, what contains a reference, who calls whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tagloom.functions.text import base

SPAN, BUCKET = 80, 128


def line_counts(docs: DataFrame) -> DataFrame:
    """``rel_file, n_lines`` of each file; of several deliveries the longest."""
    return docs.filter("rel_file is not null and text is not null").groupBy("rel_file").agg(F.max(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("int").alias("n_lines"))


def def_spans(tags: DataFrame, docs: DataFrame) -> DataFrame:
    """``rel_file, name, line, end_line`` of each definition: up to the line before the next one, 80 lines at most, or the file's end.

    Of two definitions on one line, the first by name has an empty span (it ends before it begins). Repeats count once.
    """
    d = tags.filter("kind = 'def' and name is not null and rel_file is not null and line is not null").select("rel_file", "name", "line").distinct()
    w = Window.partitionBy("rel_file").orderBy("line", "name")
    nxt = d.withColumn("next", F.lead("line").over(w)).join(line_counts(docs), "rel_file", "left")
    end = F.coalesce(F.col("next") - 1, "n_lines", F.col("line") + SPAN - 1)
    return nxt.select("rel_file", "name", "line", F.least(end, F.col("line") + SPAN - 1).alias("end_line"))


def symbol_spans(symbols: DataFrame) -> DataFrame:
    """``file, name, type, line, end_line``, one row a (file, line, name); without a later end line the span is ten lines on."""
    s = symbols.filter("file is not null and line is not null and name is not null").groupBy("file", "line", "name").agg(F.max("type").alias("type"), F.max("end_line").alias("e"))
    return s.select("file", "name", "type", "line", F.when(F.col("e") > F.col("line"), F.col("e")).otherwise(F.col("line") + 10).alias("end_line"))


def _bucketed(spans: DataFrame) -> DataFrame:
    return spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("line") / BUCKET), F.floor(F.greatest("line", "end_line") / BUCKET))))


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``points(file, at, ...)`` each with the shortest of ``spans(file, name, line, end_line, ...)`` that contains its line; ties go to the first by line, then name.

    An interval join by equality: spans are laid into line buckets, so that a file with many lines and symbols is not one cross product; each
    point then keeps the least (length, line, name) of its matches by aggregation, without a sort.
    """
    keys = points.columns
    s = _bucketed(spans).select("_b", *(F.col(c).alias(f"s_{c}") for c in spans.columns))
    hit = points.withColumn("_b", F.floor(F.col("at") / BUCKET)).alias("p").join(s.alias("s"), (F.col("p.file") == F.col("s_file")) & (F.col("p._b") == F.col("s._b")) & F.col("at").between(F.col("s_line"), F.col("s_end_line")))
    least = F.min(F.struct((F.col("s_end_line") - F.col("s_line")).alias("len"), "s_line", "s_name", *(f"s_{c}" for c in spans.columns if c not in ("file", "name", "line")))).alias("m")
    return hit.groupBy(*(F.col(f"p.{k}").alias(k) for k in keys)).agg(least).select(*keys, *(F.col(f"m.s_{c}").alias(f"in_{c}") for c in spans.columns if c != "file"))


def within(tags: DataFrame, spans: DataFrame) -> DataFrame:
    """The references of ``tags`` whose line any of ``spans(file, line, end_line)`` contains, by the same buckets."""
    s = _bucketed(spans).select(F.col("file").alias("s_file"), "_b", F.col("line").alias("s_line"), F.col("end_line").alias("s_end_line"))
    p = tags.filter("kind = 'ref'").withColumn("_p", F.floor(F.col("line") / BUCKET))
    return p.join(s, (p["file"] == s["s_file"]) & (p["_p"] == s["_b"]) & p["line"].between(s["s_line"], s["s_end_line"]), "left_semi").drop("_p")


def ref_points(tags: DataFrame) -> DataFrame:
    return tags.filter("kind = 'ref' and name is not null and file is not null and line is not null").select("file", F.col("line").alias("at"), "name").distinct()


def call_edges(tags: DataFrame, symbols: DataFrame) -> DataFrame:
    """``file, at, name, caller, caller_line, caller_type``: each reference with the innermost function or method that contains it."""
    f = symbol_spans(symbols).filter("type in ('function', 'method')")
    return innermost(ref_points(tags), f).select("file", "at", "name", F.col("in_name").alias("caller"), F.col("in_line").alias("caller_line"), F.col("in_type").alias("caller_type"))


def carry_class(symbols: DataFrame) -> DataFrame:
    """``file, line, name, qualified`` of each method: prefixed with the class that the file opened last before it."""
    s = symbols.filter("file is not null and line is not null and name is not null").select("file", "line", "name", "type").distinct()
    w = Window.partitionBy("file").orderBy("line", "name", "type").rowsBetween(Window.unboundedPreceding, 0)
    cls = F.last(F.when(F.col("type") == "class", F.col("name")), ignorenulls=True).over(w)
    q = F.when(F.col("cls").isNotNull() & ~F.col("name").contains("::"), F.concat("cls", F.lit("::"), "name")).otherwise(F.col("name"))
    return s.withColumn("cls", cls).filter("type = 'method'").select("file", "line", "name", q.alias("qualified"))


def top_callers(edges: DataFrame, most: int = 8) -> DataFrame:
    """``name, caller, file, line, nth``: the first callers of each name by file and line. A hot name is cut to ``most`` before the shuffle."""
    c = edges.select("name", "caller", "file", F.col("caller_line").alias("line")).distinct()
    w = Window.partitionBy("name").orderBy("file", "line", "caller")
    return c.withColumn("nth", F.row_number().over(w).cast("long")).filter(F.col("nth") <= most)


def top_callees(edges: DataFrame, most: int = 4) -> DataFrame:
    """``file, caller, caller_line, name, at, nth``: the first distinct names that a function refers to, by line."""
    c = edges.groupBy("file", "caller", "caller_line", "name").agg(F.min("at").alias("at"))
    w = Window.partitionBy("file", "caller", "caller_line").orderBy("at", "name")
    return c.withColumn("nth", F.row_number().over(w).cast("long")).filter(F.col("nth") <= most)


def resolve_definitions(refs: DataFrame, tags: DataFrame) -> DataFrame:
    """``refs(rel_file, name)`` with the definition each means: the first of its own file, else the first of all by file and line; null if there is none.

    Both firsts are aggregated before they are joined, so a name defined in many files costs one row.
    """
    d = tags.filter("kind = 'def' and name is not null and rel_file is not null and line is not null")
    own = d.groupBy("rel_file", "name").agg(F.min("line").alias("own_line"))
    any_ = d.groupBy("name").agg(F.min(F.struct("rel_file", "line")).alias("first"))
    r = refs.select("rel_file", "name").filter("name is not null").distinct()
    j = r.join(own, ["rel_file", "name"], "left").join(any_, "name", "left")
    local = F.col("own_line").isNotNull()
    return j.select("rel_file", "name", F.when(local, F.col("rel_file")).otherwise(F.col("first.rel_file")).alias("def_file"), F.coalesce("own_line", F.col("first.line")).alias("def_line"), local.alias("local"))


def self_references(edges: DataFrame) -> DataFrame:
    """References to a function from within itself."""
    return edges.filter(base(F.col("caller")) == F.col("name")).select("file", "at", "name", "caller_line")


def first_name(symbols: DataFrame) -> DataFrame:
    """The first definition of each name in each file."""
    s = symbols.filter("file is not null and line is not null and name is not null")
    return s.groupBy("file", "name").agg(F.min("line").alias("line"))
