"""Structured Streaming forms of the row-level triage (T1) and cohort KPIs (A1)
over record files that arrive in a folder (new inserts, CSV drops).

The reference has no streaming; these reuse the batch operators unchanged:
triage scoring is a stateless projection + filter, and the running KPIs are a
streaming aggregation whose state is one row per cohort.  Progress and state
live under a checkpoint in the shared checkpoint folder, so a restarted or
relocated job resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.operators.triage import triage_flagged
from casebook.schema import CASE_SCHEMA, CONDITION, COST, LOS, OUTCOME, READMISSION, SATISFACTION
from casebook.session import checkpoint_dir


def record_stream(spark: SparkSession, folder: str, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(CASE_SCHEMA).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


def flagged_stream(stream: DataFrame, rules: list | None = None) -> DataFrame:
    """T1 on a stream: every arriving record with a positive rule score."""
    return triage_flagged(stream, rules)


def running_kpis(stream: DataFrame, by: str = CONDITION) -> DataFrame:
    """A1 on a stream: per-cohort running counts, means and rates (mergeable
    aggregates only; medians need the batch operator)."""
    return (stream.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(COST).alias("avg_cost"),
        F.avg(LOS).alias("avg_length_of_stay"),
        F.count_if(F.col(READMISSION) == "Yes").alias("readmitted"),
        F.count(READMISSION).alias("readmission_known"),
        F.count_if(F.col(OUTCOME) == "Recovered").alias("recovered"),
        F.count(OUTCOME).alias("outcome_known"),
        F.avg(SATISFACTION).alias("avg_satisfaction")))


def run_available(df: DataFrame, name: str, sink: str | None = None, mode: str = "append"):
    """Process everything available now and stop (``availableNow`` trigger).

    ``sink`` = a folder for parquet output (append mode); without it the
    result goes to an in-process memory table named ``name`` (tests)."""
    spark = df.sparkSession
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/casebook-streams/{name}"
    w = df.writeStream.option("checkpointLocation", ckpt).outputMode(mode).trigger(availableNow=True)
    if sink:
        q = w.format("parquet").option("path", sink).start()
    else:
        q = w.format("memory").queryName(name).start()
    q.awaitTermination()
    return q
