"""An index that grows with its files: Structured Streaming over landed snapshots of source files.

This goes beyond what the surveyed engine does (it has no streaming); its incremental rescan is the batch form of the same step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.sources.extract import tags

SCHEMA = "rel_file string, text string, size long, mtime_ns long"


def start(spark: SparkSession, landing: str, root: str, once: bool = True):
    """A query that reads new parquet files (``SCHEMA``) below ``landing`` and writes tags and file states of each micro-batch below ``root``.

    A batch lies under its number and is written by overwriting: a batch that is repeated after a failure replaces itself, so every file is
    indexed exactly once. Of several states of a file in one batch the newest counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.filter("rel_file is not null").groupBy("rel_file").agg(F.max_by(F.struct("text", "size", "mtime_ns"), F.struct("mtime_ns", "size", F.hash("text"))).alias("v")).select("rel_file", "v.*")
        tags(newest).write.mode("overwrite").parquet(f"{root}/tags/batch={number}")
        newest.select("rel_file", "size", "mtime_ns").write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    q = spark.readStream.schema(SCHEMA).parquet(landing).writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/progress")
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime="30 seconds")).start()


def current_tags(spark: SparkSession, root: str) -> DataFrame:
    """The tags of the newest batch of each file."""
    state = spark.read.parquet(f"{root}/state")
    newest = state.groupBy("rel_file").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{root}/tags").join(newest, ["rel_file", "batch"], "left_semi").drop("batch")
