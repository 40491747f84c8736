"""The case-record schema and plan-time column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEY = "Patient_ID"
AGE = "Age"
GENDER = "Gender"
CONDITION = "Condition"
PROCEDURE = "Procedure"
COST = "Cost"
LOS = "Length_of_Stay"
READMISSION = "Readmission"
OUTCOME = "Outcome"
SATISFACTION = "Satisfaction"

CASE_SCHEMA = T.StructType([
    T.StructField(KEY, T.LongType(), False),
    T.StructField(AGE, T.IntegerType(), True),
    T.StructField(GENDER, T.StringType(), True),
    T.StructField(CONDITION, T.StringType(), True),
    T.StructField(PROCEDURE, T.StringType(), True),
    T.StructField(COST, T.DoubleType(), True),
    T.StructField(LOS, T.IntegerType(), True),
    T.StructField(READMISSION, T.StringType(), True),
    T.StructField(OUTCOME, T.StringType(), True),
    T.StructField(SATISFACTION, T.IntegerType(), True),
])

CASE_COLUMNS = [f.name for f in CASE_SCHEMA.fields]
# All columns but the key; all are required on insert.
VALUE_COLUMNS = CASE_COLUMNS[1:]

# Columns a cohort may be grouped by.
GROUPABLE = ("Condition", "Procedure", "Gender", "Outcome", "Readmission")

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, NUMERIC_TYPES)


def check_groupable(cols, allowed=GROUPABLE) -> list[str]:
    """Plan-time whitelist check; raises ``ValueError`` listing valid options."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    bad = [c for c in cols if c not in allowed]
    if bad:
        raise ValueError(f"cannot group by {', '.join(map(str, bad))}; groups may be {', '.join(allowed)}")
    return cols


def check_present(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"the table has no {', '.join(missing)}, only {', '.join(df.columns)}")
