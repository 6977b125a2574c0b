"""Maps as text, JSON and diagrams; contexts of hits; detail of one symbol within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tagloom.functions.text import base, compact, escape_label, token_estimate
from tagloom.operators.rank import budget_prefix, top_subgraph
from tagloom.tables import rel_of


def map_text(tags: DataFrame, docs_lines: DataFrame | None = None) -> DataFrame:
    """``rel_file, block``: the ranked tags of each file as one text block, files by best rank. ``tags`` is a budgeted prefix, so of bounded size."""
    f = tags.groupBy("rel_file").agg(F.max("rank").alias("rank"), F.array_sort(F.collect_set(F.struct("line", "name"))).alias("t"))
    if docs_lines is not None:
        f = f.join(docs_lines, "rel_file", "left")
    head = F.concat(F.col("rel_file"), F.lit(" ("), F.coalesce(F.col("n_lines").cast("string"), F.lit("?")), F.lit(" lines)")) if docs_lines is not None else F.col("rel_file")
    body = F.array_join(F.transform("t", lambda x: F.concat(x["line"].cast("string"), F.lit(": "), x["name"])), "\n")
    return f.orderBy(F.desc("rank"), "rel_file").select("rel_file", F.concat(head, F.lit("\n"), body).alias("block"))


def map_json(tags: DataFrame) -> DataFrame:
    """``rel_file, line, json``: each ranked tag as JSON, ranks with four decimals."""
    return tags.select("rel_file", "line", F.to_json(F.struct(F.round("rank", 4).alias("rank"), "rel_file", "line", "name", "kind")).alias("json"))


def json_prefix(tags: DataFrame, budget: int) -> DataFrame:
    """The longest prefix of ranked tags whose JSON fits the budget."""
    j = map_json(tags).withColumn("rank", F.get_json_object("json", "$.rank").cast("double"))
    return budget_prefix(j, [F.desc("rank"), "rel_file", "line", "json"], token_estimate(F.col("json")), budget).select("rel_file", "line", "json", "position", "spent")


def mermaid(ranks: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """``position, text``: the lines of a diagram of the ``n`` best files and the edges among them."""
    top = ranks.orderBy(F.desc("rank"), "rel_file").limit(n).withColumn("id", F.row_number().over(Window.orderBy(F.desc("rank"), "rel_file")) - 1)
    node = top.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(0).alias("b"), F.concat(F.lit("  N"), "id", F.lit('["'), escape_label(F.col("rel_file")), F.lit('"]')).alias("text"))
    ids = top.select("rel_file", "id")
    e = top_subgraph(ranks, edges, n).join(ids.select(F.col("rel_file").alias("from_file"), F.col("id").alias("a")), "from_file").join(ids.select(F.col("rel_file").alias("to_file"), F.col("id").alias("b")), "to_file")
    edge = e.select(F.lit(2).alias("part"), "a", "b", F.concat(F.lit("  N"), "a", F.lit(" --> N"), "b").alias("text"))
    head = ranks.sparkSession.createDataFrame([(0, 0, 0, "graph LR")], "part int, a int, b int, text string")
    lines = head.unionByName(node).unionByName(edge)
    return lines.select((F.row_number().over(Window.orderBy("part", "a", "b")) - 1).cast("long").alias("position"), "text")


def context_lines(hits: DataFrame, docs: DataFrame, around: int = 1) -> DataFrame:
    """``rel_file, line, at, text, is_hit``: the lines around each hit; blank ones are left out unless they are the hit.

    Only lines that some hit asks for leave the exploded texts: the wanted lines are made first and joined by (file, line).
    """
    want = hits.select("rel_file", "line", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("at"))
    few = docs.filter("rel_file is not null and text is not null").join(hits.select("rel_file").distinct(), "rel_file", "left_semi").groupBy("rel_file").agg(F.max("text").alias("text"))
    lines = few.select("rel_file", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("rel_file", (F.col("i") + 1).alias("at"), F.regexp_replace("text", "\r$", "").alias("text"))
    j = want.join(lines, ["rel_file", "at"]).distinct()
    return j.select("rel_file", "line", "at", "text", (F.col("at") == F.col("line")).alias("is_hit")).filter((F.trim("text") != "") | F.col("is_hit"))


def detail(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """One row for the first symbol of that name: signature, body head of 500 characters, and counts of callers and callees in its own file and in others.

    In-file callers are references to the name from within its own span, that is recursion.
    """
    s = symbols.filter((F.col("name") == name) & F.col("file").isNotNull() & F.col("type").isin("function", "method"))
    one = s.groupBy("file", "line", "name").agg(F.max("type").alias("type"), F.max("signature").alias("signature"), F.max("body").alias("body")).orderBy("file", "line").limit(1)
    to = edges.filter(F.col("name") == base(F.lit(name))).select(F.col("file").alias("cf"), "caller", "caller_line", "at").distinct()
    frm = edges.filter(F.col("caller") == name).select(F.col("file").alias("cf"), "caller_line", F.col("name").alias("callee")).distinct()
    first = one.select("file", "line", F.lit(name).alias("k"))
    callers = first.join(to.withColumn("k", F.lit(name)), "k", "left").groupBy("file", "line").agg(
        F.count_if((F.col("cf") == F.col("file")) & (F.col("caller_line") == F.col("line"))).alias("recursive"), F.count_if(F.col("cf") != F.col("file")).alias("cross_callers"))
    callees = first.join(frm.withColumnRenamed("caller_line", "line").withColumnRenamed("cf", "file"), ["file", "line"], "left").groupBy("file", "line").agg(F.count("callee").alias("callees"))
    return one.join(callers, ["file", "line"], "left").join(callees, ["file", "line"], "left").select(
        rel_of(F.col("file")).alias("rel_file"), "line", "name", "type", compact(F.col("signature")).alias("signature"), F.left("body", F.lit(500)).alias("body"), "recursive", "cross_callers", "callees")


def fit_detail(record: dict, budget: int = 2048, passes: int = 8) -> dict:
    """A detail record cut to a token budget on the driver: bodies and docstrings lose a tenth a pass, then callees, then callers their tails."""
    r = dict(record)
    size = lambda: sum(-(-len(str(v)) // 4) for v in r.values() if v)
    for _ in range(passes):
        if size() <= budget:
            break
        for k in ("body", "docstring"):
            if r.get(k):
                r[k] = r[k][: int(len(r[k]) * 0.9)]
    for k in ("callees", "callers"):
        while size() > budget and r.get(k) and isinstance(r[k], list):
            r[k] = r[k][:-1]
    for k in ("docstring", "body"):
        if size() > budget and r.get(k):
            over = (size() - budget) * 4
            r[k] = r[k][: max(0, len(r[k]) - over)]
    r["truncated"] = r != dict(record)
    return r


def trim_hits(hits: list[dict], budget: int) -> list[dict]:
    """Hits cut to a budget: contexts and docstrings go from the tail first, then whole hits; the first always stays."""
    out = [dict(h) for h in hits]
    size = lambda: sum(-(-len(str(v)) // 4) for h in out for v in h.values())
    for h in reversed(out):
        if size() <= budget:
            return out
        h.pop("context", None)
        h.pop("docstring", None)
    while len(out) > 1 and size() > budget:
        out.pop()
    return out
