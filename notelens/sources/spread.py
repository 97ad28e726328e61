"""Use all cores when an input arrives in fewer splits than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition a *small* scan by ``key``; scans with enough splits stay as they are.

    A file with one row group is one task however many splits it is cut into.
    Text work on it would leave the other cores idle. Partitioning by the
    document key also serves every later grouping by that key.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df
