"""Processing only new or changed records: current state against a manifest of what successful runs wrote."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.session import cut


def current_state(log: DataFrame, key: str, version: str, values: list[str], tiebreak: list[str] = ()) -> DataFrame:
    """The values of the row with the highest ``version`` of each key, whatever order rows arrived in.

    Rows without key or version say nothing and are dropped. Rows that agree in version are settled by ``tiebreak``,
    then by the values themselves, so the result does not depend on row order. Aggregated before the shuffle: a hot key
    costs one row a task.
    """
    order = F.struct(version, *tiebreak, *values)
    newest = log.filter(F.col(key).isNotNull() & F.col(version).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_v"))
    return newest.select(key, *(F.col(f"_v.{v}").alias(v) for v in values))


def manifest_of_runs(written: DataFrame, runs: DataFrame, key: str, values: list[str], ok: str = "ok") -> DataFrame:
    """What the newest successful run that wrote a key left: the manifest that a next run may trust.

    Runs whose status is not ``ok`` (failed, aborted, null) count as if they had not written at all.
    """
    good = runs.filter(F.col("status") == ok).select("run_id").distinct()
    return current_state(written.join(good, "run_id", "left_semi"), key, "run_id", values)


def pending(listing: DataFrame, manifest: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows of ``listing`` that ``manifest`` lacks or holds with another value: an anti-join, null equal to null."""
    m = manifest.select(*(F.col(c).alias(f"_m_{c}") for c in [key, *values]))
    same = F.col(key) == F.col(f"_m_{key}")
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_m_{v}"))
    return listing.join(m, same, "left_anti")


def files_to_process(file_state: DataFrame, indexed_files: DataFrame, index_runs: DataFrame) -> DataFrame:
    """``rel_file``, ``size``, ``mtime_ns`` of every file that exists now and that no trusted record describes.

    A file whose current state is null in both values is gone and is no work. Empty tables: no state gives no rows; no
    runs or no records give every existing file.
    """
    values = ["size", "mtime_ns"]
    now = current_state(file_state, "rel_file", "scan_id", values, ["received_at"]).filter("size is not null or mtime_ns is not null")
    return pending(now, manifest_of_runs(indexed_files, index_runs, "rel_file", values), "rel_file", values)


class Manifest:
    """Committed batches of a folder pipeline: ``root/data/batch=ID`` holds results, ``root/manifest/ID`` what they cover.

    A batch is written under its id by overwriting, then committed by writing its manifest part and, last, an entry
    ``root/commits/ID.json`` that one rename puts there. A run that dies in between leaves no commit: the next run sees the same
    files as pending, and a run with the same id replaces what was half written. Nothing is skipped or repeated: the listing is read once and recorded as it was read,
    so a file that changes while it is processed differs from its record and is pending again, and of several batches with one key only the newest counts.
    Null keys are no files.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "path", values: tuple[str, ...] = ("size", "checksum")):
        self.spark, self.root, self.key, self.values = spark, root.rstrip("/"), key, list(values)
        jvm = spark._jvm
        self._path = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join([self.root, *p]))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _entries(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(n[:-5] for s in self._fs.listStatus(self._path(folder)) if (n := s.getPath().getName()).endswith(".json") and n[0] != ".")

    def committed(self) -> list[str]:
        return self._entries("commits")

    def _record(self) -> DataFrame:
        """Every committed record with its batch: those that the newest compaction covers from one folder, the others from theirs."""
        ids, bases = self.committed(), self._entries("bases")
        covered = set(json.loads(self._text("bases", f"{bases[-1]}.json"))["covers"]) if bases else set()
        folders = [f"{self.root}/base/{b}" for b in bases[-1:]] + [f"{self.root}/manifest/{i}" for i in ids if i not in covered]
        schema = f"`{self.key}` string, " + ", ".join(f"`{v}` string" for v in self.values) + ", batch string"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The newest committed record of each key."""
        return current_state(self._record(), self.key, "batch", self.values)

    def pending(self, listing: DataFrame) -> DataFrame:
        """The rows of ``listing`` that are new or whose values differ from their newest record."""
        slim = listing.select(self.key, *(F.col(v).cast("string").alias(v) for v in self.values))
        changed = pending(slim, self.read(), self.key, self.values).select(self.key).distinct()
        return listing.join(changed, self.key, "left_semi")

    def run(self, listing: DataFrame, process: Callable[[DataFrame], DataFrame], batch: str | None = None) -> str:
        """Process what is pending and commit it; the batch id sorts after all earlier ones unless given. What ``process`` gives has to keep the key."""
        batch = batch or f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        if batch in self.committed():
            return batch
        todo = cut(self.pending(listing))  # read once: data and record come from the same state
        process(todo).write.mode("overwrite").parquet(f"{self.root}/data/batch={batch}")
        record = todo.select(self.key, *(F.col(v).cast("string").alias(v) for v in self.values), F.lit(batch).alias("batch"))
        record.write.mode("overwrite").parquet(f"{self.root}/manifest/{batch}")
        self._put("commits", batch, {"batch": batch, "at": time.time()})
        return batch

    def compact(self) -> str | None:
        """Write the newest record of each key to one folder, so that a later run reads that and what came after; None before the first commit.

        Batches that commit meanwhile are not covered and stay as they are.
        """
        covers = self.committed()
        if not covers:
            return None
        newest = current_state(self._record(), self.key, "batch", [*self.values, "batch"])
        base = f"{time.time_ns():020d}"
        newest.write.mode("overwrite").parquet(f"{self.root}/base/{base}")
        self._put("bases", base, {"covers": covers})
        return base

    def _text(self, *path: str) -> str:
        f = self._fs.open(self._path(*path))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode()
        finally:
            f.close()

    def _put(self, folder: str, name: str, entry: dict) -> None:
        """An entry that is there as a whole or not at all; raises if it could not be put there."""
        self._fs.mkdirs(self._path(folder))
        half = self._path(folder, f".{name}.{uuid.uuid4().hex}")
        out = self._fs.create(half, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not self._fs.rename(half, self._path(folder, f"{name}.json")):
            self._fs.delete(half, False)
            if not self._fs.exists(self._path(folder, f"{name}.json")):  # another attempt of the same batch may have been first
                raise OSError(f"no commit of {name}: the rename failed")

    def results(self, listing: DataFrame | None = None) -> DataFrame | None:
        """The results of the newest committed batch of each key, with ``listing`` only of keys that still exist; None before the first commit."""
        ids = self.committed()
        if not ids:
            return None
        data = self.spark.read.parquet(*[f"{self.root}/data/batch={i}" for i in ids])
        newest = current_state(self._record(), self.key, "batch", ["batch"])
        if listing is not None:
            newest = newest.join(listing.select(self.key).distinct(), self.key, "left_semi")
        newest = newest.select(F.col(self.key).alias("_key"), F.col("batch").alias("_batch"))
        of = data.withColumn("_of", F.regexp_extract("_metadata.file_path", r"/data/batch=([^/]+)/", 1))
        return of.join(newest, (F.col(self.key) == F.col("_key")) & (F.col("_of") == F.col("_batch")), "left_semi").drop("_of")


def list_folder(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path``, ``size``, ``checksum`` (of the bytes) of the files below a folder; read in parallel, one file at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"))

