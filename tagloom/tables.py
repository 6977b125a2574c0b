"""Table loading: one place that knows where a table lies and which columns an operator may rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.session import ship

MIRROR = "/srv/mirror/"


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name``; with ``columns`` only those, so that a parquet scan reads nothing else."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def nth(df: DataFrame, n: int) -> DataFrame:
    """``df`` on at least ``n`` partitions; a small file is one partition, and Python work on it then uses one core."""
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def rel_of(file_col) -> F.Column:
    """``/srv/mirror/repo/x.py`` -> ``repo/x.py``; a path outside the mirror stays as it is."""
    return F.when(F.startswith(file_col, F.lit(MIRROR)), F.substring(file_col, len(MIRROR) + 1, 1 << 30)).otherwise(file_col)
