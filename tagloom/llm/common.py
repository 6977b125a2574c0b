"""What operators on texts share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tagloom.session import ship


def spread(df: DataFrame) -> DataFrame:
    """``df`` on as many partitions as there are cores, if its files gave fewer: Python work then uses all of them.

    ``df`` must come straight from files: to count the partitions of a shuffled frame Spark would run its shuffle.
    """
    ship(df.sparkSession)
    sc = df.sparkSession.sparkContext
    n = sc.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
