"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Round-robin the rows over ``parts`` partitions (default: the larger of the
    shuffle partitions and the cluster's parallelism), if ``df`` is small beside the
    cluster: an input of at least one full split per core is left as it is.

    Used before CPU-heavy per-row work (Python tasks) on inputs that may arrive in few
    splits, e.g. one Parquet file.  The size is the planner's estimate; no job runs, and
    what is shuffled is less than one split per core.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if parts is None:
        estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
            spark.conf.get("spark.sql.files.maxPartitionBytes"))
        if estimate >= cores * split:
            return df
        parts = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts)
