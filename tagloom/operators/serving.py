"""What answers need besides their rows: checks of paths and identifiers, ages, hints where to look next, cuts to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.functions.text import token_estimate

#: Words whose plural is another word, and the mark of a cut text (fixed values).
NO_PLURAL = ("news",)
CUT_MARK = "\n... [truncated to fit max_tokens]"
#: The tool to try after one that found nothing (fixed values).
NEXT_TOOL = {"detect": "symbols", "symbols": "query"}


def within(path: Column, root: str) -> Column:
    """Whether an absolute path lies in ``root`` or is it; ``..`` leads out, null lies nowhere."""
    r = root.rstrip("/")
    return F.coalesce(((path == r) | path.startswith(r + "/")) & ~path.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def is_candidate(name: Column) -> Column:
    """Whether a text is one identifier, maybe qualified by ``::`` and then by dots."""
    word = "[_A-Za-z][_0-9A-Za-z]*"
    return F.coalesce(name.rlike(rf"\A{word}(?:::{word})*(?:\.{word})*\z"), F.lit(False))


def matches_word(words: Column, word: str) -> Column:
    """Whether an array of words holds ``word``, singular and plural being the same but for NO_PLURAL and for words of up to three letters with an s."""
    forms = [word]
    if word + "s" not in NO_PLURAL:
        forms.append(word + "s")
    if len(word) > 3 and word.endswith("s") and word not in NO_PLURAL:
        forms.append(word[:-1])
    return F.coalesce(F.arrays_overlap(words, F.array(*map(F.lit, forms))), F.lit(False))


def age(seconds: Column) -> Column:
    """``59s``, ``2m``, ``1h``, ``3d``; ``unknown`` for null."""
    s = F.floor(seconds)
    unit = lambda n, mark: F.concat(F.floor(s / n).cast("string"), F.lit(mark))
    return F.when(s.isNull(), "unknown").when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def hint(tool: Column, found: Column, rescue: Column) -> Column:
    """``next_rung, reason`` of an answer: after nothing the next tool, after a ``fuzzy`` or ``content`` rescue the detail of what came; null where no more is needed."""
    nxt = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in NEXT_TOOL.items() for x in kv)), tool), F.lit("detail"))
    rung = F.when(found == 0, nxt).when(rescue.isNotNull(), "detail")
    reason = F.when(found == 0, "empty").when(rescue == "content", "content_verify").when(rescue.isNotNull(), "fuzzy_verify")
    return F.struct(rung.alias("next_rung"), reason.alias("reason"))


def cut_text(text: Column, budget: int) -> Column:
    """``text`` within ``budget`` tokens (four characters each), cut at a line where there is one, and marked; empty where the mark alone would not fit."""
    room = budget * 4 - len(CUT_MARK)
    head = F.left(text, F.lit(max(0, room)))
    line = F.when(F.instr(head, "\n") > 0, F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head)
    cut = F.concat(F.regexp_replace(line, r"\s+\z", ""), F.lit(CUT_MARK)) if room > 0 else F.lit("")
    return F.when(F.length(text) <= budget * 4, text).otherwise(cut) if budget > 0 else F.lit("")


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``, which has to be total; nulls are equal. A partial top-k a key goes before the shuffle, so a hot key costs a row a task."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def files_of_interest(chat: DataFrame, other: DataFrame) -> DataFrame:
    """``rel_file, chat``: files under discussion and all others, each once; one that is in both is under discussion. Null names are none."""
    both = chat.select("rel_file", F.lit(True).alias("chat")).unionByName(other.select("rel_file", F.lit(False).alias("chat")))
    return both.filter("rel_file is not null").groupBy("rel_file").agg(F.bool_or("chat").alias("chat"))


def index_line(state: DataFrame, tags: DataFrame, signature: DataFrame) -> DataFrame:
    """One row ``line``: how many files and tags an index holds, and the head of its signature."""
    one = lambda df: df.withColumn("k", F.lit(1))
    n = one(state.filter("rel_file is not null").agg(F.count_distinct("rel_file").alias("files")))
    j = n.join(one(tags.agg(F.count("*").alias("tags"))), "k").join(one(signature.select("signature")), "k")
    return j.select(F.concat(F.col("files").cast("string"), F.lit(" files, "), F.col("tags").cast("string"), F.lit(" tags, sig "), F.left("signature", F.lit(8))).alias("line"))


def fit_walk(nodes: DataFrame, edges: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a walk as they are if their JSON fits ``budget``, else the first ``budget / 50`` nodes and ``budget / 30`` edges, one at least; ``cut`` says which. A budget of 0 or less never cuts."""
    spent = sum(df.agg(F.sum(token_estimate(F.to_json(F.struct(*df.columns))))).first()[0] or 0 for df in (nodes, edges))
    if budget <= 0 or spent <= budget:
        return nodes.withColumn("cut", F.lit(False)), edges.withColumn("cut", F.lit(False))
    n = nodes.orderBy("hop", "file", "line", "name").limit(max(1, budget // 50))
    e = edges.orderBy("hop", "from_file", "from_line", "from_name", "to_file", "to_line", "to_name").limit(max(1, budget // 30))
    return n.withColumn("cut", F.lit(True)), e.withColumn("cut", F.lit(True))
