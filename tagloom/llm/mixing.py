"""Mixing sources to target shares of tokens: entropy balancing with capped repeats."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tagloom.llm.common import spread
from tagloom.llm.encode import VOCAB, token_counts
from tagloom.session import cut

#: About so many documents share one running sum when rates are rounded.
BUCKET = 5000
STEPS, CLOSE = 60, 1e-9


def _targets(targets: DataFrame) -> DataFrame:
    """One row a source; the first by share, where a source is listed twice."""
    t = targets.filter("source is not null and target_share is not null and target_share >= 0")
    return t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))


def _rate(tilt: dict[str, float], mean: dict[str, float], cap: dict[str, int]):
    """The tilted rate of a document, as a column: exp(tilt * tokens / mean of its source), at most its cap."""
    out = F.lit(0.0)
    for s, x in tilt.items():
        raw = F.lit(float(cap[s])) if x == math.inf else F.least(F.lit(float(cap[s])), F.exp(F.least(F.lit(700.0), F.lit(x / mean[s]) * F.col("tokens"))))
        out = F.when(F.col("source") == s, raw).otherwise(out)
    return out


def _solve(hist: DataFrame, goal: dict[str, float], mean: dict[str, float], cap: dict[str, int], full: dict[str, float]) -> dict[str, float]:
    """The tilt of each source at which the expected tokens meet its goal.

    Newton steps on the dual of the entropy problem, one aggregation over all documents a step; the dual parts by source. A
    step that leaves the bracket known so far is replaced by its middle, as the caps make the slope jump.
    """
    tilt = {s: math.inf if goal[s] >= full[s] * (1 - CLOSE) else 0.0 for s in goal}
    low, high = dict.fromkeys(goal, -math.inf), dict.fromkeys(goal, math.inf)
    open_ = {s for s in goal if tilt[s] != math.inf}
    for _ in range(STEPS):
        if not open_:
            break
        w = _rate({s: tilt[s] for s in open_}, mean, cap)
        caps = F.lit(0.0)
        for s in open_:
            caps = F.when(F.col("source") == s, F.lit(float(cap[s]))).otherwise(caps)
        seen = (
            hist.filter(F.col("source").isin(sorted(open_)))
            .withColumn("w", w)
            .groupBy("source")
            .agg(F.sum(F.col("docs") * F.col("w") * F.col("tokens")).alias("got"), F.sum(F.when(F.col("w") < caps, F.col("docs") * F.col("w") * F.col("tokens") * F.col("tokens"))).alias("slope"))
            .collect()
        )  # one row a source of mix_targets
        for r in seen:
            s, gap = r["source"], r["got"] - goal[r["source"]]
            if abs(gap) <= CLOSE * max(1.0, goal[s]):
                open_.discard(s)
                continue
            if gap > 0:
                high[s] = tilt[s]
            else:
                low[s] = tilt[s]
            slope = (r["slope"] or 0.0) / mean[s]
            step = tilt[s] - gap / slope if slope > 0 else math.nan
            if not low[s] < step < high[s]:
                if low[s] == -math.inf:
                    step = min(-1.0, 2 * high[s])
                elif high[s] == math.inf:
                    step = max(1.0, 2 * low[s])
                else:
                    step = (low[s] + high[s]) / 2
            tilt[s] = step
    return tilt


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocab: str = VOCAB) -> DataFrame:
    """``doc_id, source, tokens, rate, copies`` of the documents that come into the mixture, each ``copies`` times.

    ``docs(doc_id, source, text)``; ``targets(source, target_share, max_repeats)``. Sizes are tokens of ``vocab``. Rates minimise the
    relative entropy against taking every document once, under one token constraint a source: they are exponentially tilted
    by the tokens of the document, and capped at ``max_repeats``. Rates are then rounded to whole copies by systematic
    sampling along running sums within parts of a source, ordered by size, so that the tokens of a source are kept closely.

    ``total_tokens`` is the size of the mixture; by default the largest at which every source that has tokens can give its share.
    Shares of sources without tokens are spread over the others in proportion. With a larger total, a source that cannot
    give its share gives all of its documents ``max_repeats`` times.

    Documents with null text, null source or a source without target take no part; documents without tokens add nothing and
    are left out. Empty tables give no rows.
    """
    sized = targeted_tokens(docs, targets, vocab)
    return _mix(sized, targets, total_tokens)


def targeted_tokens(docs: DataFrame, targets: DataFrame, vocab: str = VOCAB) -> DataFrame:
    listed = spread(docs.filter("text is not null and source is not null")).join(_targets(targets).select("source"), "source", "left_semi")
    return cut(token_counts(listed, ["doc_id", "source"], vocab).filter("tokens > 0"))


def _mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    hist = cut(sized.groupBy("source", "tokens").agg(F.count("*").alias("docs")))
    have = {r["source"]: r for r in hist.groupBy("source").agg(F.sum(F.col("docs") * F.col("tokens")).alias("tokens"), F.sum("docs").alias("docs")).collect()}
    want = {r["source"]: r for r in _targets(targets).collect() if r["source"] in have and r["target_share"] > 0 and r["max_repeats"] > 0}
    left = sum(r["target_share"] for r in want.values())
    share = {s: r["target_share"] / left for s, r in want.items()}
    cap = {s: r["max_repeats"] for s, r in want.items()}
    full = {s: float(cap[s] * have[s]["tokens"]) for s in want}
    mean = {s: have[s]["tokens"] / have[s]["docs"] for s in want}
    total = total_tokens or min((full[s] / share[s] for s in want), default=0.0)
    goal = {s: min(full[s], share[s] * total) for s in want}
    tilt = _solve(hist, goal, mean, cap, full)
    parts = F.lit(1)
    for s in want:
        parts = F.when(F.col("source") == s, F.lit(max(1, have[s]["docs"] // BUCKET))).otherwise(parts)
    rated = sized.filter(F.col("source").isin(sorted(want))).withColumn("rate", _rate(tilt, mean, cap)).withColumn("part", F.pmod(F.xxhash64("doc_id"), parts))
    along = Window.partitionBy("source", "part").orderBy("tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64("source", "part"), F.lit(1000)) / 1000.0
    frac = F.col("rate") - F.floor("rate")
    rounded = rated.withColumn("sum", F.round(F.sum(frac).over(along), 9)).withColumn("before", F.round(F.col("sum") - frac, 9))
    extra = F.floor(F.col("sum") + start) - F.floor(F.col("before") + start)
    return (
        rounded.withColumn("copies", (F.floor("rate") + extra).cast("int"))
        .filter("copies > 0")
        .select("doc_id", "source", "tokens", "rate", "copies")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, docs, copies, tokens, share`` of every target source; 0 where nothing came in."""
    got = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    out = _targets(targets).join(got, "source", "left").fillna(0, ["docs", "copies", "tokens"])
    every = F.sum("tokens").over(Window.partitionBy())  # one row a source of mix_targets
    return out.withColumn("share", F.when(every > 0, F.col("tokens") / every).otherwise(F.lit(0.0)))
