"""Encoding of texts with a public byte-level BPE vocabulary, long texts in overlapping chunks."""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.llm.common import spread

#: Where the vocabulary lies on every machine; a parameter of each operator.
VOCAB = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pre-token pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern means it, as a character class for Python's re (fixed value).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK, OVERLAP = 4096, 512
#: A worker's memory for segments that it has encoded before.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64


class _Segments(dict):
    """Segment -> ids. A segment is white space and what follows up to the next white space: no pre-token crosses from other
    characters into white space, so segments can be encoded apart, and most were seen before."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, segment: str) -> list[int]:
        ids = self.encode(segment)
        if len(segment) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[segment] = ids
        return ids


@lru_cache(maxsize=4)
def _encoder(vocab: str):
    import tiktoken

    with open(vocab, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    find = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
    return bpe, find, _Segments(bpe.encode_ordinary)


def encode_text(text: str | None, vocab: str = VOCAB) -> list[int]:
    """The ids of one text; none for an empty or null text."""
    _, find, known = _encoder(vocab)
    return list(chain.from_iterable(map(known.__getitem__, find(text)))) if text else []


def count_tokens(text: str | None, vocab: str = VOCAB) -> int:
    _, find, known = _encoder(vocab)
    return sum(map(len, map(known.__getitem__, find(text)))) if text else 0


def decode_ids(ids, vocab: str = VOCAB) -> str:
    """The text of ids: their raw bytes one after the other, read as UTF-8 (a broken sequence gives U+FFFD)."""
    return b"".join(_encoder(vocab)[0].decode_tokens_bytes(list(ids))).decode("utf-8", errors="replace")


def _encode_batches(keys: list[str], vocab: str):
    def run(batches):
        _, find, known = _encoder(vocab)
        for batch in batches:
            ids, ends = array("i"), [0]
            for text in batch.column("text").to_pylist():
                if text:
                    ids.extend(chain.from_iterable(map(known.__getitem__, find(text))))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), lists], names=[*keys, "ids"])

    return run


def _chunk_batches(chunk: int, overlap: int):
    """Texts -> chunks that overlap the next one, with the pre-token boundaries in either overlap."""
    import regex

    find, space = regex.compile(PATTERN), re.compile(f"[{SPACE}]").match
    schema = pa.schema([("doc_id", pa.int64()), ("seq", pa.int32()), ("start", pa.int32()), ("piece", pa.string()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                rows = []
                for seq, start in enumerate(range(0, len(text), chunk)):
                    piece = text[start : start + chunk + overlap]
                    ends = [start + m.start() for m in find.finditer(piece)]
                    head = [e for e in ends if e <= start + overlap]
                    tail = [e for e in ends if e >= start + chunk and not space(text[e - 1])]
                    rows.append((doc, seq, start, piece, head, tail))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def encode(docs: DataFrame, vocab: str = VOCAB, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``ids`` (a list of integers) of every row of ``docs(doc_id, text)``, without special tokens.

    Texts of up to two chunks are encoded as they are read. Longer ones are cut into chunks that overlap; each chunk is
    pre-tokenised on its own, and neighbours are stitched at the first boundary that both have in their overlap: from
    a common boundary on, pre-tokens depend only on what follows, so both go on alike. A stitch never stands behind white
    space, whose pre-tokens also depend on what follows them. The pieces between stitches are encoded in
    parallel and put together in order. Where an overlap has no common boundary (one run longer than the overlap), the
    text is encoded as one piece. The ids are those of the whole text in every case.

    An empty or null text gives an empty list. ``doc_id`` must be unique among long texts.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    is_long = F.coalesce(F.length("text") > 2 * chunk, F.lit(False))
    short = spread(slim.filter(~is_long)).mapInArrow(_encode_batches(["doc_id"], vocab), "doc_id long, ids array<int>")

    chunks = slim.filter(is_long).mapInArrow(_chunk_batches(chunk, overlap), "doc_id long, seq int, start int, piece string, head array<int>, tail array<int>")
    w = Window.partitionBy("doc_id").orderBy("seq")
    stitch: Column = F.array_min(F.array_intersect("head", F.lag("tail").over(w)))
    cuts = chunks.withColumn("cut", F.when(F.col("seq") == 0, F.lit(0)).otherwise(stitch)).withColumn("next", F.lead("cut").over(w))
    whole = Window.partitionBy("doc_id")
    cuts = cuts.withColumn("fits", F.min(F.col("cut").isNotNull()).over(whole)).withColumn("last", F.max("seq").over(whole) == F.col("seq"))
    begin = F.when(F.col("fits"), F.col("cut")).otherwise(F.col("start"))
    end = F.when(F.col("last"), F.lit(2**31 - 1)).when(F.col("fits"), F.col("next")).otherwise(F.col("start") + chunk)
    parts = cuts.select(
        "doc_id", F.when(F.col("fits"), F.col("seq")).otherwise(F.lit(0)).alias("part"), "seq",
        F.substring(F.col("piece"), begin - F.col("start") + 1, end - begin).alias("own"),
    )
    parts = parts.groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "own"))).alias("own"))
    parts = parts.select("doc_id", "part", F.array_join(F.transform("own", lambda x: x["own"]), "").alias("text"))
    coded = parts.mapInArrow(_encode_batches(["doc_id", "part"], vocab), "doc_id long, part int, ids array<int>")
    long = coded.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    return short.unionByName(long.select("doc_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids")))


def decode(encoded: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """``doc_id``, ``text`` of ``encoded(doc_id, ids)``; null or empty ids give an empty text."""

    def run(batches):
        for batch in batches:
            texts = [decode_ids(ids, vocab) if ids else "" for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def token_counts(docs: DataFrame, keep: list[str], vocab: str = VOCAB) -> DataFrame:
    """``keep`` and ``tokens`` of every row of ``docs``; 0 for an empty or null text."""
    schema = docs.select(*keep).schema

    def run(batches):
        for batch in batches:
            n = [count_tokens(t, vocab) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", tokens long")
