"""Search by what code does: query words weighed by rarity over names, spans, callers and callees of definitions."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F

from tagloom.functions.text import CONTENT_SYNONYMS, STOPWORDS, SYNONYMS, canonical, canonical_of, is_test, tokens, tokens_of
from tagloom.operators.search import clamp, interleave
from tagloom.operators.spans import BUCKET, def_spans, top_callees, top_callers
from tagloom.session import cut
from tagloom.tables import nth

FRACTION, SCORE, CALLERS, CALLEES = 0.5, 3.0, 8, 4
WEIGHTS = {"name": 3.0, "near": 1.0, "callee": 0.5}


def query_words(query: str) -> list[str]:
    return list(dict.fromkeys(canonical_of(t) for t in tokens_of(query) if t not in STOPWORDS and len(t) > 1))


def spellings(words: list[str]) -> list[str]:
    """The words and all that stands for them, as they may occur in a line."""
    groups = {g.split()[0]: g.split() for g in SYNONYMS + CONTENT_SYNONYMS}
    return sorted({x for w in words for x in (w, *groups.get(w, ()))})


def token_frequencies(tags: DataFrame, words: list[str]) -> DataFrame:
    """``token, df, idf`` of the words over definitions: in how many names of definitions each stands, smoothed."""
    d = tags.filter("kind = 'def' and name is not null").select("rel_file", "line", "name").distinct()
    n = d.count()
    per = d.select("rel_file", "line", "name", F.explode(F.array_distinct(F.transform(tokens(F.col("name")), canonical))).alias("token")).filter(F.col("token").isin(*words))
    df = per.groupBy("token").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.round(F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0, 9))


def content_search(tags: DataFrame, docs: DataFrame, edges: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """``rel_file, line, name, matched, score``: definitions that at least half of the query's words describe.

    A word counts once, where it weighs most: in the name (3), in the text of the span or the names of callers (1), in the names of callees (0.5), times its idf
    over all definitions. Words are compared by synonym group. ``edges`` are call edges. A query of stop words only, or no definitions, give no rows.
    """
    words = query_words(query)
    empty = "rel_file string, line int, name string, matched long, score double"
    if not words:
        return tags.sparkSession.createDataFrame([], empty)
    spans, edges = cut(def_spans(tags, docs)), cut(edges)  # both are read several times
    hit = lambda name: F.filter(F.array_distinct(F.transform(tokens(name), canonical)), lambda t: t.isin(*words))
    names = spans.select("rel_file", "line", "name", F.explode(hit(F.col("name"))).alias("token"), F.lit(WEIGHTS["name"]).alias("w"))
    told = F.lower("text").rlike("|".join(map(re.escape, spellings(words))))  # texts without any of the words are not taken apart
    lines = nth(docs.filter(F.col("rel_file").isNotNull() & told), tags.sparkSession.sparkContext.defaultParallelism).select("rel_file", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    lines = lines.filter(F.lower("s").rlike("|".join(map(re.escape, spellings(words)))))  # few lines are taken apart
    ident = F.flatten(F.transform(F.regexp_extract_all("s", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1), lambda x: F.transform(tokens(x), canonical)))
    said = lines.select("rel_file", (F.col("i") + 1).alias("at"), F.explode(F.filter(F.array_distinct(ident), lambda t: t.isin(*words))).alias("token")).distinct()
    laid = spans.filter("end_line >= line").withColumn("_b", F.explode(F.sequence(F.floor(F.col("line") / BUCKET), F.floor(F.col("end_line") / BUCKET))))
    near = laid.join(said.withColumn("_b", F.floor(F.col("at") / BUCKET)), ["rel_file", "_b"]).filter(F.col("at").between(F.col("line"), F.col("end_line"))).select("rel_file", "line", "name", "token", F.lit(WEIGHTS["near"]).alias("w"))
    callers = top_callers(edges, CALLERS).select("name", F.explode(hit(F.col("caller"))).alias("token")).distinct()
    from_callers = spans.join(callers, "name").select("rel_file", "line", "name", "token", F.lit(WEIGHTS["near"]).alias("w"))
    callees = top_callees(edges, CALLEES).select(F.regexp_replace("file", "^/srv/mirror/", "").alias("rel_file"), F.col("caller").alias("name"), F.col("caller_line").alias("line"), F.explode(hit(F.col("name"))).alias("token"))
    from_callees = spans.join(callees, ["rel_file", "line", "name"]).select("rel_file", "line", "name", "token", F.lit(WEIGHTS["callee"]).alias("w"))
    best = names.unionByName(near).unionByName(from_callers).unionByName(from_callees).groupBy("rel_file", "line", "name", "token").agg(F.max("w").alias("w"))
    best = cut(best)
    n = spans.count()
    df = {r["token"]: r["df"] for r in best.groupBy("token").agg(F.count("*").alias("df")).collect()}  # a row a word of the query
    idf = F.lit(0.0)
    for t, k in df.items():
        idf = F.when(F.col("token") == t, math.log((n + 1) / (k + 1)) + 1).otherwise(idf)
    scored = best.groupBy("rel_file", "line", "name").agg(F.count("*").alias("matched"), F.round(F.sum(F.col("w") * idf), 6).alias("score"))
    k = clamp(limit)
    good = scored.filter((F.col("matched") >= math.ceil(FRACTION * len(words))) & (F.col("score") >= SCORE))
    pool = good.orderBy(F.desc("matched"), F.desc("score"), is_test(F.col("rel_file")).cast("int"), "name", "rel_file", "line").limit(2 * k)
    keyed = pool.withColumn("m", -F.col("matched")).withColumn("s", -F.col("score")).withColumn("kind", F.lit("def"))
    return interleave(keyed, ["m", "s"], k).select("rel_file", "line", "name", "matched", "score")
