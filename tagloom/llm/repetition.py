"""Repetition inside a single document: rule statistics, and an isolation forest over them."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm.common import spread

WORDS = 8
SHARE = 0.4
#: The statistics of a document, in this order; each between 0 and 1 but the last.
STATISTICS = ["repeated_words", "repeated_lines", "repeated_paragraphs", "repeated_starts", "log_words"]
#: Rows the forest is fitted on and thresholds are calibrated with, and the rows and number of its trees.
SAMPLE, TREE_ROWS, TREES = 4096, 256, 32


_ASCII_WORDS, _ANY_WORDS = re.compile("[a-z]+").findall, re.compile(r"[^\W\d_]+").findall


@lru_cache(maxsize=1)
def _other_numbers() -> frozenset[str]:
    """Characters that Python's word class holds besides letters, decimal digits and the underscore."""
    return frozenset(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) in ("Nl", "No"))


def words_of(text: str) -> list[str]:
    """The longest runs of letters of any script, in lower case; marks, digits and other numbers part words."""
    if text.isascii():
        return _ASCII_WORDS(text.lower())
    other = _other_numbers().intersection(text)
    if other:
        text = text.translate(dict.fromkeys(map(ord, other), " "))
    if "İ" in text:  # its lower case ends in a mark
        return [w.lower() for w in _ANY_WORDS(text)]
    return _ANY_WORDS(text.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of small numbers."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(units: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For each position whether it lies in a stretch of ``width`` units that also stands earlier in its document."""
    n = len(units)
    covered = np.zeros(n + 1, np.int32)
    if n < width:
        return covered[:n] > 0
    m = n - width + 1
    inside = doc[:m] == doc[width - 1 :]
    h = np.zeros(m, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x100000001B3) + units[j : j + m]
    h = _mixed(h ^ _mixed(doc[:m].astype(np.uint64) + np.uint64(1 << 40)))
    at = np.flatnonzero(inside)
    order = at[np.argsort(h[at], kind="stable")]
    again = order[1:][h[order[1:]] == h[order[:-1]]]
    np.add.at(covered, again, 1)
    np.add.at(covered, again + width, -1)
    return np.cumsum(covered[:-1]) > 0


def _shares(parts: list[list[str]], width: int, sized: bool) -> np.ndarray:
    """The repeated share of each document, by number of units or by their length."""
    lens = np.array([len(p) for p in parts], np.int64)
    ids: dict = defaultdict(count().__next__)
    units = np.fromiter(map(ids.__getitem__, chain.from_iterable(parts)), np.uint64, int(lens.sum()))
    doc = np.repeat(np.arange(len(parts)), lens)
    weight = np.fromiter(map(len, chain.from_iterable(parts)), np.float64, len(units)) if sized else np.ones(len(units))
    hit = _repeated(_mixed(units), doc, width)
    total = np.bincount(doc, weight, len(parts))
    return np.divide(np.bincount(doc, weight * hit, len(parts)), total, out=np.zeros(len(parts)), where=total > 0)


def statistics_of(texts: list[str | None], width: int = WORDS) -> np.ndarray:
    """A row of STATISTICS for each text; zeros for a null or empty text."""
    texts = [t or "" for t in texts]
    words = [words_of(t) for t in texts]
    lines = [[x for x in map(str.strip, t.splitlines()) if x] for t in texts]
    paragraphs = [[x for x in map(str.strip, t.replace("\r\n", "\n").split("\n\n")) if x] for t in texts]
    starts = [[x[:12] for x in ls] for ls in lines]
    return np.column_stack([
        _shares(words, width, False), _shares(lines, 1, True), _shares(paragraphs, 1, True), _shares(starts, 1, False),
        np.log1p([len(w) for w in words]),
    ])


class Forest:
    """An isolation forest: trees of random splits over a bounded sample, in arrays that are sent to every task."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)] if len(rows) else []

    @staticmethod
    def _norm(n: float) -> float:
        """The mean path length of an unsuccessful search among n rows."""
        return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n > 1)

    def _grow(self, rows, rng):
        most = math.ceil(math.log2(max(2, len(rows))))
        feature, split, left, depth = [], [], [], []
        todo = [(rows, 0, None)]
        while todo:
            part, d, parent = todo.pop(0)
            node = len(feature)
            if parent is not None and left[parent] < 0:
                left[parent] = node  # children are neighbours
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(rows.shape[1]),) * 2
            able = np.flatnonzero(high > low)
            feature.append(-1), split.append(0.0), left.append(-1), depth.append(d + self._norm(len(part)))
            if d < most and len(part) > 1 and len(able):
                f = int(rng.choice(able))
                s = rng.uniform(low[f], high[f])
                feature[node], split[node] = f, s
                todo += [(part[part[:, f] < s], d + 1, node), (part[part[:, f] >= s], d + 1, node)]
        return np.array(feature), np.array(split), np.array(left), np.array(depth)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the easier a row is isolated, the higher."""
        if not self.trees:
            return np.full(len(rows), 1.0)
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, left, depth in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(len(feature)):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[every, np.maximum(f, 0)] >= split[at]
                at = np.where(inner, left[at] + right, at)
            total += depth[at]
        return self._score(total / len(self.trees))

    def _score(self, path):
        return 2.0 ** (-path / max(1e-9, self._norm(self.size)))

    def least_score(self, feature: int, value: float) -> float:
        """No row whose ``feature`` is ``value`` or more can score less: the longest path such a row can take in each tree."""
        if not self.trees:
            return 0.0
        total = 0.0
        for f, split, left, depth in self.trees:
            todo, longest = [0], 0.0
            while todo:
                node = todo.pop()
                if f[node] < 0:
                    longest = max(longest, depth[node])
                else:
                    todo.append(left[node] + 1)
                    if not (f[node] == feature and split[node] <= value):
                        todo.append(left[node])
            total += longest
        return float(self._score(total / len(self.trees)))


def document_statistics(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """``doc_id`` and STATISTICS of every row of ``docs(doc_id, text)``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                stats = statistics_of(part.column("text").to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(stats[:, i]) for i in range(stats.shape[1]))], names=["doc_id", *STATISTICS])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(slim).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


def fit(docs: DataFrame, share: float = SHARE, width: int = WORDS, sample: int = SAMPLE) -> tuple[Forest, float, float]:
    """The forest, a flagging threshold and a safe threshold, from at most ``sample`` rows labelled by the rule.

    The sample is the rows with the smallest hashed ids. Its labels are the rule itself (repeated words of ``share`` or
    more). The flagging threshold is the one with the best F1 on the sample. The safe threshold loses no row that the rule would
    take: it is the lower of the least score of a labelled row and the least score that any such row could have in this forest.
    """
    place = F.xxhash64(F.col("doc_id").cast("long"))
    last = docs.select(place.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # ids only; no text is sorted
    few = document_statistics(docs.filter(place <= F.lit(last)), width) if last is not None else None
    rows = sorted(few.dropDuplicates(["doc_id"]).collect())[:sample] if few else []  # no more than sampled ids
    rows = np.array([r[1:] for r in rows]).reshape(-1, len(STATISTICS))
    forest = Forest(rows)
    scores, labels = forest.scores(rows), rows[:, 0] >= share
    best, flag = -1.0, 1.0
    for t in np.unique(scores[labels]) if labels.any() else []:
        hit = scores >= t
        f1 = 2 * (hit & labels).sum() / (hit.sum() + labels.sum())
        if f1 > best:
            best, flag = f1, float(t)
    safe = min([forest.least_score(0, share), *scores[labels]])
    return forest, flag, float(safe)


def repetition(docs: DataFrame, share: float = SHARE, width: int = WORDS, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, STATISTICS, ``score``, ``anomalous``, ``candidate`` of every row of ``docs(doc_id, text)``.

    ``repeated_words`` is the share of words in a stretch of ``width`` words that also stands earlier in the text, words being
    the longest runs of letters, case ignored; the others are the shares of repeated lines and paragraphs (by length) and line
    starts. ``score`` is the isolation forest's, ``anomalous`` where it reaches the flagging threshold, ``candidate`` where it
    reaches the safe one. Null and empty texts, and texts of fewer than ``width`` + 1 words, have no repeated words.
    An empty table gives no rows.
    """
    forest, flag, safe = fit(docs, share, width, sample)
    sent = docs.sparkSession.sparkContext.broadcast(forest)  # some thousand nodes, whatever the data

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            s = sent.value.scores(pdf[STATISTICS].to_numpy()) if len(pdf) else np.zeros(0)
            out: pd.DataFrame = pdf.assign(score=s, anomalous=s >= flag, candidate=s >= safe - 1e-12)
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    stats = document_statistics(docs, width)
    return stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS) + ", score double, anomalous boolean, candidate boolean")


def exact_share(words: list[str], width: int = WORDS) -> float:
    """The share of words in a stretch of ``width`` words that also stands earlier, by the words themselves instead of hashes."""
    seen, covered, until = set(), 0, 0
    for i in range(len(words) - width + 1):
        g = tuple(words[i : i + width])
        if g in seen:
            covered += i + width - max(i, until)
            until = i + width
        seen.add(g)
    return covered / len(words) if words else 0.0


def repeated_documents(docs: DataFrame, share: float = SHARE, width: int = WORDS, sample: int = SAMPLE) -> DataFrame:
    """``doc_id`` of the documents that the forest isolates early enough to be candidates and whose repeated share, counted on their words, is ``share`` or more.

    The forest scores the statistics of every document, whose shares come from hashes; only the candidates, that is rows which reach the safe threshold, have their
    stretches of words compared themselves. Null and empty texts are never found; repeated rows come out as often as they stand.
    """
    forest, _, safe = fit(docs, share, width, sample)
    sent = docs.sparkSession.sparkContext.broadcast(forest)  # some thousand nodes, whatever the data

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                texts = part.column("text").to_pylist()
                scores = sent.value.scores(statistics_of(texts, width))
                found = [i for i in np.flatnonzero(scores >= safe - 1e-12) if texts[i] and exact_share(words_of(texts[i]), width) >= share]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(found, pa.int64()))], names=["doc_id"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long")
