"""Record sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.schema import CASE_SCHEMA, VALUE_COLUMNS

CORRUPT = "_corrupt_record"


def scan_records(spark: SparkSession, path: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """The record table with the explicit case schema (no inference).

    ``options`` go to the reader.  A JDBC table (``fmt="jdbc"``, no path) brings its
    own schema; pass ``url``, ``dbtable`` and, to read it in parallel,
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        split = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
        if split & set(options) and not split <= set(options):
            raise ValueError(f"a partitioned read needs all of {sorted(split)}")
        return reader.load().select(*[f.name for f in CASE_SCHEMA.fields])
    return reader.schema(CASE_SCHEMA).load(path)


def csv_schema(extra: list[T.StructField] | None = None) -> T.StructType:
    fields = list(extra or []) + [f for f in CASE_SCHEMA.fields if f.name in VALUE_COLUMNS]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]
                        + [T.StructField(CORRUPT, T.StringType(), True)])


def read_records_csv(spark: SparkSession, path: str,
                     extra: list[T.StructField] | None = None) -> DataFrame:
    """CSV with a header; rows that do not parse keep their text in
    ``_corrupt_record`` (PERMISSIVE) instead of failing the job."""
    return (spark.read.schema(csv_schema(extra))
            .option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .csv(path))


def append_records(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S3: append rows to the record store (the reference appends, not replaces)."""
    df.write.mode("append").format(fmt).save(path)


INTENT_SCHEMA = "text string, intent string"


def write_intents(corpus: DataFrame, path: str) -> None:
    """(text, intent) rows as JSON lines; a NULL is left out of its line."""
    corpus.select(F.col("text").cast("string").alias("text"), F.col("intent").cast("string").alias("intent")).write.json(path)


def read_intents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{text, intent}``."""
    return spark.read.schema(INTENT_SCHEMA).json(path)
