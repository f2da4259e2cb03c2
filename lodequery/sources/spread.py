"""Small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over the cores where it comes in fewer partitions than there are; larger inputs are left alone.

    For tables whose rows are dear to work on, as texts are: one file of one row group is else one task.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
