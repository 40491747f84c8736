"""Cohort statistics: percentile bands, KPIs, benchmarks, satisfaction drivers,
treatment comparison, procedure options, combination frequency (P1 P2 A1-A10 A17).

Global statistics are one-row aggregates joined back with ``broadcast`` (a
proven one-row size bound), never global windows.  Grouped statistics are plain
``groupBy().agg()`` so Spark does map-side partial aggregation before the
shuffle; a hot group therefore costs one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.filters import apply_where, ci_equals, pattern_match
from casebook.functions import quantiles as vc
from casebook.functions.quantiles import ValueCounts, kept, quantile_rows
from casebook.functions.stats import direction, quantile, r, rate_pct, rq, safe_corr
from casebook.schema import (AGE, CONDITION, COST, GROUPABLE, KEY, LOS, OUTCOME, PROCEDURE,
                             READMISSION, SATISFACTION, check_groupable)

# The percentile cut-offs used for bands.
CUT_POINTS = (0.25, 0.50, 0.75, 0.90)


def percentile_cuts(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row of p25/p50/p75/p90 for Cost and Length_of_Stay (nulls skipped).

    One scan counts the values; no task gathers all distinct ones.  ``exact=False``
    uses a fixed-size sketch."""
    q = list(CUT_POINTS)
    agg = quantile_rows(df.select(COST, LOS), {COST: q, LOS: q}, exact).select(
        F.col(COST).alias("_c"), F.col(LOS).alias("_l"))
    cols = []
    for name, arr in (("cost", "_c"), ("los", "_l")):
        for i, p in enumerate(q):
            cols.append(F.col(arr)[i].cast("double").alias(f"{name}_p{int(p * 100)}"))
    return agg.select(*cols)


def _band(x, cuts, labels):
    e = F.when(x.isNull(), F.lit(None).cast("string"))
    for c, lab in zip(cuts, labels[:-1]):
        e = e.when(x <= F.coalesce(F.col(c), F.lit(float("inf"))), lab)
    return e.otherwise(labels[-1])


def record_summary(df: DataFrame, ids=None, exact: bool = True) -> DataFrame:
    """Bands and flags per record, cut-offs taken over the whole table.

    ``ids`` (list or one-column DataFrame) restricts the records summarised; the
    cut-offs still come from every record.
    """
    cuts = F.broadcast(percentile_cuts(df, exact))
    recs = df
    if ids is not None:
        if isinstance(ids, DataFrame):
            recs = df.join(ids.select(F.col(ids.columns[0]).alias(KEY)).distinct(), KEY, "left_semi")
        else:
            recs = df.where(F.col(KEY).isin([int(i) for i in ids]))
    j = recs.crossJoin(cuts)
    cost, los, sat = F.col(COST), F.col(LOS), F.col(SATISFACTION)
    inf = F.lit(float("inf"))
    return j.select(
        *[F.col(c) for c in df.columns],
        _band(cost, ["cost_p25", "cost_p50", "cost_p75", "cost_p90"],
              ["low", "below_median", "above_median", "high", "very_high"]).alias("cost_band"),
        F.when(cost.isNotNull(), cost > F.coalesce(F.col("cost_p75"), inf)).alias("is_high_cost"),
        _band(los, ["los_p25", "los_p50", "los_p75", "los_p90"],
              ["short", "below_median", "above_median", "long", "very_long"]).alias("los_band"),
        F.when(los.isNotNull(), los > F.coalesce(F.col("los_p75"), inf)).alias("is_long_stay"),
        F.when(sat.isNotNull(), sat <= 2).alias("is_low_satisfaction"),
    )


def kpi_overview(df: DataFrame, where: dict | None = None, by=None, exact: bool = True) -> DataFrame:
    """A1: cohort KPIs.  Rates use non-null denominators; a metric with no data is NULL.

    Ungrouped, an empty cohort gives no row (``n > 0``).  Everything follows from one
    scan that counts the values of five columns per group.
    """
    d = apply_where(df, where)
    keys = check_groupable(by) if by else []
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    if not exact:
        return _kpi_sketch(d, keys)
    counts = ValueCounts.of(d, {
        COST: F.col(COST), LOS: F.col(LOS), SATISFACTION: F.col(SATISFACTION),
        READMISSION: (F.col(READMISSION) == "Yes").cast("int"), OUTCOME: (F.col(OUTCOME) == "Recovered").cast("int")}, keys)
    x = F.col("x")
    one = counts.stats({COST: [0.5], LOS: [0.5]}, {
        "n": vc.rows(COST), "avg_cost": vc.mean(COST), "min_cost": F.min(vc.of(COST)), "max_cost": F.max(vc.of(COST)),
        "avg_length_of_stay": vc.mean(LOS), "readmission_rate": vc.percent(READMISSION), "recovery_rate": vc.percent(OUTCOME),
        "avg_satisfaction": vc.mean(SATISFACTION), "_low": vc.rows(SATISFACTION, x <= 2), "_rated": vc.present(SATISFACTION)})
    return one.where("n > 0").select(
        *keys, "n", r("avg_cost").alias("avg_cost"), rq(F.col(COST)[0]).alias("median_cost"), r("min_cost").alias("min_cost"),
        r("max_cost").alias("max_cost"), r("avg_length_of_stay").alias("avg_length_of_stay"),
        r(F.col(LOS)[0]).alias("median_length_of_stay"), r("readmission_rate").alias("readmission_rate"),
        r("recovery_rate").alias("recovery_rate"), r("avg_satisfaction").alias("avg_satisfaction"),
        F.when(F.col("_rated") > 0, F.col("_low")).alias("low_satisfaction_count"))


def _kpi_sketch(d: DataFrame, keys) -> DataFrame:
    """A1 with approximate medians (a sketch of fixed size), in one aggregate."""
    cost, los, sat = F.col(COST), F.col(LOS), F.col(SATISFACTION)
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(cost)).alias("avg_cost"), rq(quantile(cost, 0.5, False)).alias("median_cost"),
        r(F.min(cost)).alias("min_cost"), r(F.max(cost)).alias("max_cost"), r(F.avg(los)).alias("avg_length_of_stay"),
        r(quantile(los, 0.5, False)).alias("median_length_of_stay"),
        r(rate_pct(F.col(READMISSION) == "Yes", F.count(READMISSION))).alias("readmission_rate"),
        r(rate_pct(F.col(OUTCOME) == "Recovered", F.count(OUTCOME))).alias("recovery_rate"),
        r(F.avg(sat)).alias("avg_satisfaction"),
        F.when(F.count(sat) > 0, F.count_if(sat <= 2)).alias("low_satisfaction_count")).where("n > 0")


def los_benchmark(df: DataFrame, group_by: str = CONDITION, where: dict | None = None) -> DataFrame:
    """A2: Length_of_Stay statistics per group against the global p90.

    n counts rows (NULL stays included); the global p90 is taken after the
    filter, rows without a group included.  Sorted by rounded mean descending,
    ties by group ascending.  One scan counts the stays per group; the global
    threshold and every group's row follow from the counts.
    """
    (g,) = check_groupable([group_by])
    d = apply_where(df, where)
    counts = ValueCounts.of(d, [LOS], [g])
    top = counts.merged().stats({LOS: [0.9]}).select(F.col(LOS)[0].alias("_gp90"))
    x, k = F.col("x"), F.col("k")
    # One row: the threshold rides along with the counts.
    groups = counts.table.where(F.col(g).isNotNull()).crossJoin(F.broadcast(top))
    kind = df.schema[LOS].dataType
    out = ValueCounts.over(groups, [g]).stats({LOS: [0.5, 0.75, 0.9]}, {
        "n": F.sum(k), "_mean": vc.mean(LOS), "min": F.min(x).cast(kind), "max": F.max(x).cast(kind),
        "long_stay_count": F.coalesce(F.sum(F.when(x > F.col("_gp90"), k)), F.lit(0).cast("long")), "_gp90": F.first("_gp90")})
    p50 = r(F.col(LOS)[0])
    return (out.select(
        F.col(g), "n",
        r(F.col("_mean")).alias("mean"),
        p50.alias("p50"),
        r(F.col(LOS)[1]).alias("p75"),
        r(F.col(LOS)[2]).alias("p90"),
        "min", "max",
        F.coalesce(p50 > F.col("_gp90"), F.lit(False)).alias("exceeds_global_p90"),
        "long_stay_count",
        r(F.col("_gp90")).alias("global_p90_threshold"))
        .orderBy(F.desc_nulls_last("mean"), F.asc(g)))


# Numeric columns correlated with satisfaction.
CORRELATED = (COST, LOS, AGE)
# The two-level factors whose mean satisfaction is compared, with the
# answers if the first level's is higher (Outcome) or lower (Readmission).
CONTRASTS = ((OUTCOME, "Recovered", "Stable", "recovery associated with higher satisfaction"),
             (READMISSION, "Yes", "No", "readmission associated with lower satisfaction"))
NO_PATTERN = "no clear pattern"


def _cohort_aggs() -> list:
    sat = F.col(SATISFACTION)
    return [F.avg(sat).alias("_avg"), F.count(sat).alias("satisfaction_count"), F.stddev_samp(sat).alias("_std"),
            F.count(KEY).alias("n")]


def _correlation_aggs() -> list:
    sat = F.col(SATISFACTION)
    return [a for c in CORRELATED for a in (safe_corr(F.col(c), sat).alias(f"c_{c}"),
                                            F.count_if(F.col(c).isNotNull() & sat.isNotNull()).alias(f"n_{c}"))]


def _contrast_aggs() -> list:
    sat = F.col(SATISFACTION)
    return [agg for f, a, b, _ in CONTRASTS for side, level in (("a", a), ("b", b)) for agg in (
        F.avg(F.when(F.col(f) == level, sat)).alias(f"_{f}_{side}"), (F.count_if(F.col(f) == level) > 0).alias(f"_{f}_has_{side}"))]


def _overall_aggs() -> list:
    sat = F.col(SATISFACTION)
    return [F.count(F.lit(1)).alias("_rows"), F.avg(sat).alias("_mean"), F.stddev_samp(sat).alias("_spread"),
            rate_pct(sat <= 2, F.count(sat)).alias("_low")]


def _worst_cohorts(groups: DataFrame, keys, min_n: int, top: int) -> DataFrame:
    return (groups.where(F.col("n") >= min_n).orderBy(F.asc_nulls_last("_avg"), *[F.asc(k) for k in keys]).limit(top)
            .select(*keys, r(F.col("_avg")).alias("avg_satisfaction"), "n", r(F.col("_std")).alias("std"), "satisfaction_count"))


def _correlations(wide: DataFrame, min_support: int) -> DataFrame:
    stack = "stack({}, {}) AS (variable, _corr, support)".format(
        len(CORRELATED), ", ".join(f"'{c}', c_{c}, n_{c}" for c in CORRELATED))
    long = wide.selectExpr(stack).where(F.col("support") > min_support)
    return long.select("variable", r(F.col("_corr"), 3).alias("correlation"),
                       direction(F.col("_corr")).alias("interpretation"), "support")


def _contrasts(wide: DataFrame) -> DataFrame:
    cells = []
    for f, _, _, found in CONTRASTS:
        a, b = F.col(f"_{f}_a"), F.col(f"_{f}_b")
        seen = a > b if f == OUTCOME else a < b
        cells.append(F.struct(F.lit(f).alias("factor"), r(a).alias("level_a_avg"), r(b).alias("level_b_avg"),
                              F.when(F.coalesce(seen, F.lit(False)), found).otherwise(NO_PATTERN).alias("interpretation"),
                              (F.col(f"_{f}_has_a") & F.col(f"_{f}_has_b")).alias("_both")))
    return wide.select(F.explode(F.array(*cells)).alias("_c")).where("_c._both").select(
        *[F.col(f"_c.{c}").alias(c) for c in ("factor", "level_a_avg", "level_b_avg", "interpretation")])


def satisfaction_cohorts(df: DataFrame, group_by=None, min_n: int = 20,
                         where: dict | None = None, top: int = 10) -> DataFrame:
    """A3: the worst cohorts by mean satisfaction among cohorts with n >= min_n."""
    keys = check_groupable(group_by or [CONDITION, PROCEDURE])
    d = apply_where(df, where)
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    return _worst_cohorts(d.groupBy(*keys).agg(*_cohort_aggs()), keys, min_n, top)


def satisfaction_correlations(df: DataFrame, where: dict | None = None,
                              min_support: int = 10) -> DataFrame:
    """A4: Pearson correlation of Cost, LOS, Age with Satisfaction (pairwise complete,
    only when more than ``min_support`` rows), rounded to 3, with a label."""
    return _correlations(apply_where(df, where).agg(*_correlation_aggs()), min_support)


def satisfaction_contrasts(df: DataFrame, where: dict | None = None) -> DataFrame:
    """A5: mean satisfaction for Recovered vs Stable and readmitted vs not, each
    only when both levels occur."""
    return _contrasts(apply_where(df, where).agg(*_contrast_aggs()))


def satisfaction_overall(df: DataFrame, where: dict | None = None) -> DataFrame:
    """Mean, median, sample std and low-score share of Satisfaction, from one scan
    that counts the scores."""
    counts = ValueCounts.of(apply_where(df, where), [SATISFACTION])
    one = counts.stats({SATISFACTION: [0.5]}, {
        "n": vc.rows(SATISFACTION), "mean": vc.mean(SATISFACTION), "std": vc.stddev(SATISFACTION),
        "_low": vc.rows(SATISFACTION, F.col("x") <= 2), "_rated": vc.present(SATISFACTION)})
    return one.where("n > 0").select(
        r("mean").alias("mean"), r(F.col(SATISFACTION)[0]).alias("median"), r("std").alias("std"),
        r(F.try_divide(F.col("_low") * 100.0, F.col("_rated").cast("double"))).alias("low_satisfaction_pct"))


def satisfaction_drivers(df: DataFrame, group_by=None, min_n: int = 20,
                         where: dict | None = None) -> dict:
    """The four parts of the drivers report, from one scan of the filtered input.

    One aggregate over the grouping sets (cohort, score) and () holds the cohorts'
    counts per score and all totals; it is computed once and the parts are read off it:
    a cohort's mean, deviation and size, and the overall median, follow from the counts
    per score (scores are few: their domain is 1 to 5)."""
    keys = check_groupable(group_by or [CONDITION, PROCEDURE])
    d = apply_where(df, where)
    total = [*_correlation_aggs(), *_contrast_aggs(), *_overall_aggs()]
    # Null keys of the data and the keys of the total are told apart by the grouping id.
    sets = kept(d.groupingSets([[F.col(k) for k in (*keys, SATISFACTION)], []], *[F.col(k) for k in (*keys, SATISFACTION)])
                .agg(F.grouping_id().alias("_set"), F.count(KEY).alias("_keyed"), F.count(F.lit(1)).alias("_k"), *total))
    whole = sets.where("_set > 0")
    scores = sets.where("_set = 0").select(*keys, F.lit(SATISFACTION).alias("col"), F.col(SATISFACTION).cast("double").alias("x"),
                                           F.col("_k").alias("k"), "_keyed")
    cohorts = scores
    for key in keys:
        cohorts = cohorts.where(F.col(key).isNotNull())
    groups = cohorts.groupBy(*keys).agg(vc.mean(SATISFACTION).alias("_avg"), vc.present(SATISFACTION).alias("satisfaction_count"),
                                        vc.stddev(SATISFACTION).alias("_std"), F.sum("_keyed").alias("n"))
    median = ValueCounts(scores.groupBy("col", "x").agg(F.sum("k").alias("k"))).stats({SATISFACTION: [0.5]}).select(
        F.col(SATISFACTION)[0].alias("_median"))
    return {
        "bottom_cohorts": _worst_cohorts(groups, keys, min_n, 10),
        "correlations": _correlations(whole, 10),
        "contrasts": _contrasts(whole),
        "overall": whole.crossJoin(F.broadcast(median)).where("_rows > 0").select(
            r("_mean").alias("mean"), r("_median").alias("median"), r("_spread").alias("std"), r("_low").alias("low_satisfaction_pct")),
    }


def satisfaction_report(df: DataFrame, group_by=None, min_n: int = 20, where: dict | None = None) -> DataFrame:
    """A7 as one long table: part, item, metric, value."""
    parts = satisfaction_drivers(df, group_by, min_n, where)
    keys = check_groupable(group_by or [CONDITION, PROCEDURE])

    def long(part: str, frame: DataFrame, item, metrics) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return frame.select(F.lit(part).alias("part"), item.alias("item"), F.explode(cells).alias("_m")).select(
            "part", "item", F.col("_m.metric").alias("metric"), F.col("_m.value").alias("value"))

    return (long("cohort", parts["bottom_cohorts"], F.concat_ws(" / ", *keys), ["avg_satisfaction", "n"])
            .unionByName(long("correlation", parts["correlations"], F.col("variable"), ["correlation", "support"]))
            .unionByName(long("contrast", parts["contrasts"], F.col("factor"), ["level_a_avg", "level_b_avg"]))
            .unionByName(long("overall", parts["overall"], F.lit(SATISFACTION),
                              ["mean", "median", "std", "low_satisfaction_pct"])))


def compare_treatments(df: DataFrame, condition: str, procedures) -> DataFrame:
    """Per procedure pattern (case-insensitive regex) within a condition pattern:
    total cases, recovered %, mean LOS, mean cost.  Patterns with no rows are kept
    with ``no_data = true``.  Duplicate patterns collapse.

    The pattern list is an argument (bounded by the request): every pattern is a
    literal condition, compiled once, and all are counted in one aggregate.
    """
    pats = list(dict.fromkeys(procedures or []))
    if not pats:
        raise ValueError("give at least one procedure pattern")
    aggs = []
    for i, p in enumerate(pats):
        hit = F.col(PROCEDURE).rlike("(?i)" + p)
        n = F.count_if(hit)
        aggs.append(F.struct(
            F.lit(i).alias("pos"), F.lit(p).alias("pattern"), n.alias("total_cases"),
            r(F.try_divide(F.count_if(hit & (F.col(OUTCOME) == "Recovered")) * 100.0, n)).alias("success_rate"),
            r(F.avg(F.when(hit, F.col(LOS)))).alias("average_length_of_stay_days"),
            r(F.avg(F.when(hit, F.col(COST)))).alias("average_cost")).alias(f"p{i}"))
    wide = df.where(pattern_match(CONDITION, condition)).agg(*aggs)
    out = wide.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pats))])).alias("x")).select("x.*")
    return out.select("pattern", "total_cases", "success_rate", "average_length_of_stay_days", "average_cost",
                      (F.col("total_cases") == 0).alias("no_data"))


def procedure_options(df: DataFrame, condition: str | None = None, min_count: int = 5) -> DataFrame:
    """Procedures per condition ranked by readmission rate (all-row denominator),
    keeping procedures seen at least ``min_count`` times.  Without ``condition``,
    all conditions at once (the ranking window runs over the small aggregate)."""
    d = df.where(F.col(CONDITION).isNotNull() & F.col(PROCEDURE).isNotNull())
    if condition is not None:
        d = d.where(ci_equals(CONDITION, condition))
    g = (d.groupBy(F.lower(CONDITION).alias("condition_key"), PROCEDURE)
         .agg(F.count(KEY).alias("count"),
              (F.count_if(F.col(READMISSION) == "Yes") / F.count(F.lit(1))).alias("_rate"))
         .where(F.col("count") >= min_count))
    from pyspark.sql import Window
    w = Window.partitionBy("condition_key").orderBy("_rate", PROCEDURE)
    return g.select("condition_key", PROCEDURE, "count", r(F.col("_rate"), 6).alias("readmission_rate"),
                    F.row_number().over(w).alias("rank"))


# The default combination columns for rare-combination checks.
COMBINATION = (CONDITION, PROCEDURE, OUTCOME)


def combination_frequency(df: DataFrame, cols=COMBINATION) -> DataFrame:
    """A10: normalised counts of value combinations; rows with a NULL in any of the
    columns are excluded from numerator and denominator.  The counts are computed once;
    their total is a sum over them."""
    cols = list(cols)
    g = kept(df.na.drop(subset=cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("count")))
    total = F.broadcast(g.agg(F.sum("count").alias("_total")))  # one row
    return g.crossJoin(total).select(*cols, "count", (F.col("count") / F.col("_total")).alias("frequency"))


def target_stats(df: DataFrame) -> DataFrame:
    """LOS target statistics and readmission label counts, one row, from one scan."""
    counts = ValueCounts.of(df, {LOS: F.col(LOS), "yes": F.when(F.col(READMISSION) == "Yes", 1), "no": F.when(F.col(READMISSION) == "No", 1)})
    kind = df.schema[LOS].dataType
    one = counts.stats({LOS: [0.5]}, {
        "los_mean": vc.mean(LOS), "los_std": vc.stddev(LOS), "los_min": F.min(vc.of(LOS)), "los_max": F.max(vc.of(LOS)),
        "readmission_yes": vc.present("yes"), "readmission_no": vc.present("no")})
    return one.select(r("los_mean", 4).alias("los_mean"), r("los_std", 4).alias("los_std"), F.col("los_min").cast(kind).alias("los_min"),
                      F.col("los_max").cast(kind).alias("los_max"), r(F.col(LOS)[0], 4).alias("los_median"),
                      "readmission_yes", "readmission_no")


__all__ = ["percentile_cuts", "record_summary", "kpi_overview", "los_benchmark",
           "satisfaction_cohorts", "satisfaction_correlations", "satisfaction_contrasts",
           "satisfaction_overall", "satisfaction_drivers", "compare_treatments",
           "procedure_options", "combination_frequency", "target_stats", "GROUPABLE"]
