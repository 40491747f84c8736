"""Data-quality anomalies: z-score outliers and rare combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.operators.cohort import COMBINATION, combination_frequency
from casebook.schema import KEY, is_numeric

# Default columns checked for outliers.
NUMERIC_DEFAULT = ("Age", "Cost", "Length_of_Stay", "Satisfaction")
RARE_THRESHOLD = 0.005

# The reasons given, with the threshold in place.
OUTLIER_REASON = "Outlier (Z-score > {})"
RARE_REASON = "Very low frequency combination (< {:.2f}%)"


def zscore_outliers(df: DataFrame, columns=NUMERIC_DEFAULT, threshold: float = 3.0,
                    key: str = KEY) -> DataFrame:
    """Rows whose |x - mean| / std_pop exceeds ``threshold``, in long form
    (key, column, value, reason).  Non-numeric or absent columns are skipped; a
    constant column yields nothing.

    Means and deviations are one aggregate row, broadcast to every row.
    """
    cols = [c for c in columns if c in df.columns and is_numeric(df, c)]
    reason = OUTLIER_REASON.format(threshold)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], f"`{key}` long, `column` string, value double, reason string")
    stats = []
    for i, c in enumerate(cols):
        stats += [F.avg(F.col(c).cast("double")).alias(f"_m{i}"),
                  F.stddev_pop(F.col(c).cast("double")).alias(f"_s{i}")]
    one = F.broadcast(df.agg(*stats))
    j = df.select(key, *cols).crossJoin(one)
    zs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        z = F.abs(F.try_divide(x - F.col(f"_m{i}"), F.col(f"_s{i}")))
        zs.append(F.struct(F.lit(c).alias("column"), x.alias("value"),
                           F.coalesce(z > F.lit(float(threshold)), F.lit(False)).alias("hit")))
    long = j.select(key, F.explode(F.array(*zs)).alias("_e"))
    return long.where("_e.hit").select(key, F.col("_e.column").alias("column"),
                                       F.col("_e.value").alias("value"),
                                       F.lit(reason).alias("reason"))


def rare_combinations(df: DataFrame, columns=COMBINATION, threshold: float = RARE_THRESHOLD,
                      key: str = KEY) -> DataFrame:
    """Rows whose value combination has frequency below ``threshold``.

    The combination counts are an aggregate (partial aggregation absorbs hot
    combinations); joining them back is an equi-join whose strategy AQE picks
    from the runtime size of the rare side.
    """
    cols = [c for c in columns if c in df.columns]
    if len(cols) < 2:
        raise ValueError("Need at least two categorical columns for combinations.")
    freq = combination_frequency(df, cols).where(F.col("frequency") < threshold)
    reason = RARE_REASON.format(threshold * 100)
    rows = df.na.drop(subset=cols).select(key, *cols)
    return rows.join(freq.select(*cols, "frequency"), cols).select(
        key, *cols, F.bround("frequency", 4).alias("frequency"), F.lit(reason).alias("reason"))


def anomaly_report(df: DataFrame, numerical_cols=None, categorical_cols=None,
                   z_score_threshold: float = 3.0) -> dict:
    """Both anomaly frames."""
    return {
        "numerical_outliers": zscore_outliers(df, numerical_cols or NUMERIC_DEFAULT, z_score_threshold),
        "low_frequency_combinations": rare_combinations(df, categorical_cols or COMBINATION),
    }
