"""Source trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.operators.files import discover


def ignored_folders(lines: list[str]) -> list[str]:
    """The folder names of an ignore file: negations, patterns and names with a dot are left out, as are comments."""
    out = []
    for x in lines:
        x = x.strip()
        if x and x[0] not in "#!" and not set(x) & set("*.?["):
            out.append(x.strip("/").split("/")[-1])
    return sorted(set(out))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """``file, rel_file, size, mtime_ns, text`` of every file below ``root``; bytes that are not UTF-8 become U+FFFD.

    Spark lists folders and reads files in parallel; the size filter of ``scan`` reaches the listing, so that larger files are never read.
    """
    base = root.rstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + "/*" + base.split(":", 1)[-1].lstrip("/").replace(".", "\\.") + "/", "")
    return f.select("path", F.col("length").alias("size"), "modificationTime", "content").select(
        F.col("path").alias("file"), rel.alias("rel_file"), "size", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def scan(spark: SparkSession, root: str, exclude: list[str] = (), ignored: list[str] = ()) -> DataFrame:
    """The files of a tree that discovery takes in, by path."""
    return discover(read_tree(spark, root), list(exclude), list(ignored))


def state(files: DataFrame) -> DataFrame:
    """``rel_file, size, mtime_ns``: what the next run compares with."""
    return files.select("rel_file", "size", "mtime_ns")
