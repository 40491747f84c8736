"""Chart data (P5 P6 A11-A16): the aggregated frame behind each chart type.

Drawing is not done here; each function returns the small aggregated
DataFrame a plotting front end would draw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.filters import apply_where
from casebook.functions import quantiles as vc
from casebook.functions.quantiles import ValueCounts
from casebook.schema import check_present, is_numeric

# Metric name -> (column, aggregation).
METRICS = {
    "billing": ("Cost", "sum"),
    "cost": ("Cost", "mean"),
    "admissions": ("Patient_ID", "count"),
    "age": ("Age", "mean"),
    "length_of_stay": ("Length_of_Stay", "mean"),
    "los": ("Length_of_Stay", "mean"),
    "satisfaction": ("Satisfaction", "mean"),
    "readmission_rate": ("Readmission", "custom"),
    "recovery_rate": ("Outcome", "custom"),
}

# Group-by aliases -> column.
GROUP_ALIASES = {
    "medical_condition": "Condition",
    "condition": "Condition",
    "insurance_provider": "Condition",
    "admission_type": "Procedure",
    "procedure": "Procedure",
    "gender": "Gender",
    "outcome": "Outcome",
    "readmission": "Readmission",
}

# What a "custom" rate metric counts.
RATE_EVENTS = {"Readmission": "Yes", "Outcome": "Recovered"}

PLOT_TYPES = ("bar", "line", "pie", "histogram", "boxplot")


def resolve_metric(metric):
    """P5: a metric name (case-insensitive) or an explicit ``(column, agg)`` pair."""
    if isinstance(metric, (tuple, list)):
        col, agg = metric[0], metric[1]
        return col, agg
    m = METRICS.get(str(metric).lower())
    if m is None:
        raise ValueError(f"no such metric: {metric!r}; there are {', '.join(METRICS)}")
    return m


def resolve_group(df: DataFrame, group_by: str) -> str:
    """Alias -> column; anything else passes through if it is a column."""
    g = GROUP_ALIASES.get(group_by.lower(), group_by)
    if g not in df.columns:
        raise ValueError(f"cannot group by {group_by!r}: the columns are {', '.join(df.columns)}")
    return g


def metric_agg(col: str, agg: str) -> F.Column:
    """The aggregate Column for a metric; rates use an all-row denominator."""
    if agg == "custom":
        ev = RATE_EVENTS.get(col)
        if ev is None:
            return F.avg(col)
        return F.count_if(F.col(col) == ev) * 100.0 / F.count(F.lit(1))
    return {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min,
            "max": F.max}[agg](F.col(col))


def _grouped(df: DataFrame, g: str, col: str, agg: str) -> DataFrame:
    return (df.where(F.col(g).isNotNull()).groupBy(g)
            .agg(metric_agg(col, agg).cast("double").alias("value")))


def bar_data(df: DataFrame, group: str, metric, top: int = 15) -> DataFrame:
    """Metric per group, largest first, top 15 (ties by group)."""
    col, agg = resolve_metric(metric)
    g = resolve_group(df, group)
    return _grouped(df, g, col, agg).orderBy(F.desc_nulls_last("value"), F.asc(g)).limit(top)


def line_data(df: DataFrame, group: str, metric) -> DataFrame:
    """Metric per group in group order."""
    col, agg = resolve_metric(metric)
    g = resolve_group(df, group)
    return _grouped(df, g, col, agg).orderBy(g)


def pie_data(df: DataFrame, group: str, metric, top: int = 8) -> DataFrame:
    """Count (or metric) per group, largest 8, with each one's share of the kept total."""
    col, agg = resolve_metric(metric)
    g = resolve_group(df, group)
    d = df.where(F.col(g).isNotNull())
    if agg == "count" or col == "Patient_ID":
        per = d.groupBy(g).agg(F.count(F.lit(1)).cast("double").alias("value"))
    elif agg == "custom":
        raise ValueError("Pie charts do not support rate metrics.")
    else:
        per = d.groupBy(g).agg(metric_agg(col, agg).cast("double").alias("value"))
    kept = per.orderBy(F.desc_nulls_last("value"), F.asc(g)).limit(top)
    # The window spans at most ``top`` rows.
    total = F.sum("value").over(Window.partitionBy(F.lit(0)))
    return kept.select(g, "value", (F.col("value") * 100.0 / total).alias("share_pct"))


def histogram_data(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from min to max (last bin closed), with mean and median.

    Bin assignment follows numpy's histogram: edges ``lo + i*(hi-lo)/bins``, a
    value on an inner edge goes to the upper bin; all-equal data widens to
    +-0.5.  Empty bins are kept with count 0.  One scan counts the values; extremes,
    mean, median and bins follow from the counts.
    """
    check_present(df, [column])
    if not is_numeric(df, column):
        raise ValueError(f"'{column}' holds no numbers, so it has no histogram")
    counts = ValueCounts.of(df, [column])
    stats = counts.stats({column: [0.5]}, {"_mn": F.min("x"), "_mx": F.max("x"), "mean": vc.mean(column)}).select(
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"),
        "mean", F.col(column)[0].alias("median")).where(F.col("lo").isNotNull())
    stats = F.broadcast(stats)  # one row
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))

    def edge(i):
        return F.when(i >= bins, F.col("hi")).otherwise(F.col("lo") + i * step)

    raw = F.least(F.floor((F.col("x") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo"))))
                  .cast("int"), F.lit(bins - 1))
    j = counts.table.where(F.col("x").isNotNull()).crossJoin(stats).withColumn("_i", raw)
    j = j.withColumn("_i", F.when(F.col("x") < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    j = j.withColumn("_i", F.when((F.col("x") >= edge(F.col("_i") + 1)) & (F.col("_i") != bins - 1),
                                  F.col("_i") + 1).otherwise(F.col("_i")))
    found = j.groupBy(F.col("_i").alias("bin")).agg(F.sum("k").alias("count"))
    # The bin domain is the fixed-size range(bins); counts come from the data.
    domain = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = domain.crossJoin(stats).join(found, "bin", "left")
    return out.select("bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"),
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                      F.col("mean").alias("mean"), F.col("median").cast("double").alias("median"))


def boxplot_data(df: DataFrame, group: str, metric, max_groups: int = 10) -> DataFrame:
    """Per group quartiles, whiskers at the furthest point within 1.5 IQR, and
    the number of outliers; the first 10 groups by name (those without a value show no
    box).  One scan counts the values per group; the rest follows from the counts."""
    col, _ = resolve_metric(metric)
    g = resolve_group(df, group)
    check_present(df, [col])
    counts = ValueCounts.of(df.where(F.col(g).isNotNull()), {"v": F.col(col)}, [g])
    first = counts.table.select(g).distinct().orderBy(g).limit(max_groups)
    d = counts.table.join(F.broadcast(first), g).where(F.col("x").isNotNull())
    q = ValueCounts.over(d, [g]).stats({"v": [0.25, 0.5, 0.75]}, {"n": F.sum("k")}).select(
        g, F.col("n").alias("rows"), F.col("v")[0].alias("q1"), F.col("v")[1].alias("median"), F.col("v")[2].alias("q3"))
    # At most ``max_groups`` rows: a broadcast with a proven bound.
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    j = d.join(F.broadcast(q), g)
    inside = (F.col("x") >= lo) & (F.col("x") <= hi)
    return (j.groupBy(g, F.col("rows").alias("n"), "q1", "median", "q3")
            .agg(F.min(F.when(inside, F.col("x"))).alias("whisker_low"), F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
                 F.coalesce(F.sum(F.when(~inside, F.col("k"))), F.lit(0).cast("long")).alias("outliers")).orderBy(g))


def boxplot_outliers(df: DataFrame, group: str, metric, max_groups: int = 10,
                     key: str = "Patient_ID") -> DataFrame:
    """A15 (second frame): the rows drawn as outlier points."""
    col, _ = resolve_metric(metric)
    g = resolve_group(df, group)
    stats = boxplot_data(df, group, metric, max_groups)
    j = df.join(F.broadcast(stats.select(g, "q1", "q3")), g)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(col).cast("double")
    return j.where((v < lo) | (v > hi)).select(key, g, v.alias("value"))


def chart_data(df: DataFrame, plot_type: str, metric, group_by: str | None = None,
               where: dict | None = None) -> DataFrame:
    """Validate, filter, pick the default group, and dispatch."""
    pt = plot_type.lower()
    if pt not in PLOT_TYPES:
        raise ValueError(f"no such chart: {plot_type!r}; there are {', '.join(PLOT_TYPES)}")
    col, _ = resolve_metric(metric)
    d = apply_where(df, where)
    group = group_by or ("Condition" if pt != "histogram" else None)
    if pt == "bar":
        return bar_data(d, group, metric)
    if pt == "line":
        return line_data(d, group, metric)
    if pt == "pie":
        return pie_data(d, group, metric)
    if pt == "histogram":
        return histogram_data(d, col)
    return boxplot_data(d, group, metric)
