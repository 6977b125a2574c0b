"""Snapshots of files: differences, what has to be read again, signatures and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tagloom.operators.incremental import current_state, pending


def latest(log: DataFrame) -> DataFrame:
    """The current state of each file that exists."""
    return current_state(log, "rel_file", "scan_id", ["size", "mtime_ns"], ["received_at"]).filter("size is not null or mtime_ns is not null")


def stored(indexed: DataFrame) -> DataFrame:
    """The state of each file that the newest run wrote, whatever became of the run."""
    return current_state(indexed, "rel_file", "run_id", ["size", "mtime_ns"])


def diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """``rel_file, status`` of what was ``added``, ``modified`` or ``deleted``; null equals null. Both sides hold a file once."""
    b = before.select("rel_file", F.col("size").alias("s0"), F.col("mtime_ns").alias("m0"), F.lit(True).alias("was"))
    j = now.withColumn("is", F.lit(True)).join(b, "rel_file", "full_outer")
    same = F.col("size").eqNullSafe(F.col("s0")) & F.col("mtime_ns").eqNullSafe(F.col("m0"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(~same, "modified")
    return j.select("rel_file", status.alias("status")).filter("status is not null")


def tag_heads(changes: DataFrame, tags: DataFrame, most: int = 50) -> DataFrame:
    """``rel_file, status, tag_count, tags_omitted, tags``: the first ``most`` tags of each changed file that still exists; 0 means all."""
    c = changes.filter("status != 'deleted'")
    t = tags.filter("name is not null").select("rel_file", "line", "name", "kind").distinct().join(c.select("rel_file"), "rel_file", "left_semi")
    n = t.groupBy("rel_file").agg(F.count("*").alias("tag_count"))
    if most:
        t = t.withColumn("_n", F.row_number().over(Window.partitionBy("rel_file").orderBy("line", "name", "kind"))).filter(F.col("_n") <= most).drop("_n")
    heads = t.groupBy("rel_file").agg(F.array_sort(F.collect_list(F.struct("line", "name", "kind"))).alias("tags"))
    out = c.join(n, "rel_file", "left").join(heads, "rel_file", "left")
    count = F.coalesce("tag_count", F.lit(0)).cast("long")
    shown = F.coalesce(F.size("tags"), F.lit(0))
    return out.select("rel_file", "status", count.alias("tag_count"), (count - F.greatest(shown, F.lit(0))).cast("long").alias("tags_omitted"), F.coalesce(F.array_join(F.transform("tags", lambda x: F.concat_ws(":", x["line"].cast("string"), x["name"], x["kind"])), ","), F.lit("")).alias("tags"))


def changed_tags(diffs: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags without those of files that changed: what an index keeps before new tags are added."""
    return tags.join(diffs.select("rel_file"), "rel_file", "left_anti")


def dirty(needed: DataFrame, state: DataFrame) -> DataFrame:
    """Files of ``needed`` that ``state`` lacks or holds with another size or time."""
    return pending(needed, state, "rel_file", ["size", "mtime_ns"]).select("rel_file")


def unmapped(files: DataFrame, mapped: DataFrame) -> DataFrame:
    """Files that no map holds yet, names compared without case."""
    m = mapped.filter("rel_file is not null").select(F.lower("rel_file").alias("k")).distinct()
    return files.filter("rel_file is not null").select("rel_file").distinct().withColumn("k", F.lower("rel_file")).join(m, "k", "left_anti").select("rel_file")


def signature(state: DataFrame, version: int = 3) -> DataFrame:
    """One row ``files, signature`` over (file, size, time) of all rows, whatever their order.

    The rows' digests are summed, not listed: partial sums are of fixed size, so no task sees all files. Repeats count as often as they stand; nulls count as
    empty. No rows have a signature too.
    """
    row = F.concat_ws(":", F.coalesce("rel_file", F.lit("")), F.coalesce(F.col("size").cast("string"), F.lit("")), F.coalesce(F.col("mtime_ns").cast("string"), F.lit("")))
    d = state.select(F.md5(row).alias("d"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("long")), F.lit(0)).cast("long") for i in range(4)]
    s = d.agg(F.count("*").alias("files"), *(p.alias(f"p{i}") for i, p in enumerate(parts)))
    return s.select("files", F.left(F.sha2(F.concat_ws(":", F.lit(str(version)), *(F.col(f"p{i}").cast("string") for i in range(4))), 256), F.lit(16)).alias("signature"))


def is_fresh(stamp: DataFrame, now: DataFrame) -> DataFrame:
    """Whether stored ranks fit the data: one row, false also where there is no stamp."""
    return now.select("signature").join(stamp.select("signature").distinct().withColumn("known", F.lit(True)), "signature", "left").select(F.coalesce("known", F.lit(False)).alias("fresh"))


def chunk_caps(files: int, start: int = 5000, step: int = 5000, most: int = 50) -> list[int]:
    """The rising caps of a resumable scan: until all files are in, ``most`` chunks at most."""
    out, cap = [], start
    while len(out) < most:
        out.append(min(cap, files))
        if cap >= files:
            break
        cap += step
    return out


def chunk_plan(files: DataFrame, step: int = 5000) -> DataFrame:
    """``chunk, cap, new_files`` of a resumable scan in chunks of ``step`` files, as many as it takes: the last cap is the number of different files.

    Null names are no files. No files give no rows.
    """
    n = files.select("rel_file").filter("rel_file is not null").distinct().count()
    cap = lambda i: F.least(F.lit(n), i * F.lit(step)).cast("long")
    return files.sparkSession.range(1, -(-n // step) + 1).select(F.col("id").alias("chunk"), cap(F.col("id")).alias("cap"), (cap(F.col("id")) - cap(F.col("id") - 1)).alias("new_files"))


def replace_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by file: rows of files that ``new`` has replace those of ``old``."""
    return old.join(new.select("rel_file").distinct(), "rel_file", "left_anti").unionByName(new)


def sync_flags(flags: DataFrame, reasons: DataFrame, tagged: DataFrame) -> DataFrame:
    """``rel_file, reason``: new reasons replace old ones, and a file that has tags has no flag."""
    all_ = flags.filter("rel_file is not null and reason is not null").groupBy("rel_file").agg(F.max("reason").alias("reason"))
    fresh = reasons.filter("rel_file is not null and reason is not null").groupBy("rel_file").agg(F.max("reason").alias("reason"))
    return replace_files(all_, fresh).join(tagged.filter("rel_file is not null").select("rel_file").distinct(), "rel_file", "left_anti")
