"""Dense, deterministic row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.session import checkpoint_dir, stored


def dense_index(df: DataFrame, order_cols, name: str = "_idx", start: int = 0) -> DataFrame:
    """Number rows 0,1,2,... (plus ``start``) in the order of ``order_cols``.

    The order columns must form a unique key so the numbering is deterministic.
    The frame is range-partitioned by the order (a hot value of the leading
    column is spread over many partitions), checkpointed to the shared
    checkpoint folder (lineage cut: a lost executor recomputes nothing
    upstream), and each row gets ``offset(partition) + position in partition``.
    The per-partition counts are one row per partition, so the offsets table
    is bounded by the partition count and broadcast.
    """
    checkpoint_dir(df.sparkSession)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    s = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mono", F.monotonically_increasing_id())
         .checkpoint(eager=True))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + local + F.lit(start))
            .drop("_pid", "_mono", "_off"))


def running_count(df: DataFrame, order_cols, counted, name: str = "_upto") -> DataFrame:
    """Rows of ``df`` with ``name``: how many rows up to and including this one, in the
    order of ``order_cols`` (a unique key), satisfy the Column ``counted``.

    As in ``dense_index``, the frame is range-partitioned and written once (as Parquet), and one
    count per partition is added up; a window covers one partition."""
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    s = stored(df.withColumn("_hit", counted.cast("long")).repartitionByRange(*order_cols).withColumn("_pid", F.spark_partition_id()), "running")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = s.groupBy("_pid").agg(F.sum("_hit").alias("_n")).select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    here = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (s.withColumn("_run", F.sum("_hit").over(here)).join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_run")).drop("_pid", "_hit", "_run", "_off"))
