"""Registered queries for filters, bands, KPIs and cohort statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.filters import (apply_where, ci_equals, drop_incomplete, lookup,
                                        pattern_match)
from casebook.operators import cohort, treatments
from casebook.plans.catalog import register, with_cases
from casebook.sources.tables import case_view, read_table


def _request_ids(spark, sf_dir):
    # A request table of keys derived from the data: every user id in events.
    return read_table(spark, sf_dir, "events").select(F.col("user_id").alias("Patient_ID"))


@register("record_lookup", with_cases(
    "SELECT * FROM cases WHERE Patient_ID IN (SELECT user_id FROM events)"))
def record_lookup(spark, sf_dir):
    return lookup(case_view(spark, sf_dir), patient_id=_request_ids(spark, sf_dir))


@register("strict_filter", with_cases(
    "SELECT * FROM cases WHERE Condition = 'BUILDING' AND Outcome = 'Stable'"))
def strict_filter(spark, sf_dir):
    return lookup(case_view(spark, sf_dir), criteria={"Condition": "BUILDING", "Outcome": "Stable"})


@register("lenient_filter", with_cases(
    "SELECT * FROM cases WHERE Condition = 'MACHINERY' AND Gender = 'F'"))
def lenient_filter(spark, sf_dir):
    # The unknown field is ignored, as the lenient ``where`` does.
    return apply_where(case_view(spark, sf_dir),
                       {"Condition": "MACHINERY", "Gender": "F", "Ward": 3})


@register("pattern_filter", with_cases(
    "SELECT * FROM cases WHERE coalesce(regexp_matches(Procedure, 'prom', 'i'), false) "
    "AND lower(Condition) = lower('building')"))
def pattern_filter(spark, sf_dir):
    c = case_view(spark, sf_dir)
    return c.where(pattern_match("Procedure", "prom") & ci_equals("Condition", "building"))


@register("complete_cases", with_cases(
    "SELECT * FROM cases WHERE Age IS NOT NULL AND Gender IS NOT NULL "
    "AND Condition IS NOT NULL AND Procedure IS NOT NULL"))
def complete_cases(spark, sf_dir):
    return drop_incomplete(case_view(spark, sf_dir), ["Age", "Gender", "Condition", "Procedure"])


_CUTS = """cuts AS (SELECT
  quantile_cont(Cost, 0.25) AS cost_p25, quantile_cont(Cost, 0.5) AS cost_p50,
  quantile_cont(Cost, 0.75) AS cost_p75, quantile_cont(Cost, 0.9) AS cost_p90,
  quantile_cont(Length_of_Stay, 0.25) AS los_p25, quantile_cont(Length_of_Stay, 0.5) AS los_p50,
  quantile_cont(Length_of_Stay, 0.75) AS los_p75, quantile_cont(Length_of_Stay, 0.9) AS los_p90
  FROM cases)"""

_SUMMARY_SELECT = """SELECT cases.*,
  CASE WHEN Cost IS NULL THEN NULL
       WHEN Cost <= coalesce(cost_p25, 'inf'::double) THEN 'low'
       WHEN Cost <= coalesce(cost_p50, 'inf'::double) THEN 'below_median'
       WHEN Cost <= coalesce(cost_p75, 'inf'::double) THEN 'above_median'
       WHEN Cost <= coalesce(cost_p90, 'inf'::double) THEN 'high' ELSE 'very_high' END AS cost_band,
  CASE WHEN Cost IS NOT NULL THEN Cost > coalesce(cost_p75, 'inf'::double) END AS is_high_cost,
  CASE WHEN Length_of_Stay IS NULL THEN NULL
       WHEN Length_of_Stay <= coalesce(los_p25, 'inf'::double) THEN 'short'
       WHEN Length_of_Stay <= coalesce(los_p50, 'inf'::double) THEN 'below_median'
       WHEN Length_of_Stay <= coalesce(los_p75, 'inf'::double) THEN 'above_median'
       WHEN Length_of_Stay <= coalesce(los_p90, 'inf'::double) THEN 'long' ELSE 'very_long' END AS los_band,
  CASE WHEN Length_of_Stay IS NOT NULL THEN Length_of_Stay > coalesce(los_p75, 'inf'::double) END AS is_long_stay,
  CASE WHEN Satisfaction IS NOT NULL THEN Satisfaction <= 2 END AS is_low_satisfaction
FROM cases CROSS JOIN cuts"""


@register("percentile_cuts", with_cases(
    "SELECT " + ", ".join(
        f"round_even(quantile_cont({c}, {q}), 6) AS {n}_p{int(q * 100)}"
        for n, c in (("cost", "Cost"), ("los", "Length_of_Stay"))
        for q in cohort.CUT_POINTS) + " FROM cases"))
def percentile_cuts(spark, sf_dir):
    p = cohort.percentile_cuts(case_view(spark, sf_dir))
    return p.select(*[F.bround(c, 6).alias(c) for c in p.columns])


@register("record_summary", with_cases(f"WITH {_CUTS}\n{_SUMMARY_SELECT}"))
def record_summary(spark, sf_dir):
    return cohort.record_summary(case_view(spark, sf_dir))


@register("lookup_chain", with_cases(
    f"WITH {_CUTS}\n{_SUMMARY_SELECT}\nWHERE Patient_ID IN (SELECT user_id FROM events)"))
def lookup_chain(spark, sf_dir):
    # get_record -> record summary as one lazy plan (semi join on the request keys).
    return cohort.record_summary(case_view(spark, sf_dir), ids=_request_ids(spark, sf_dir))


_KPI_COLS = """count(*) AS n,
  round_even(avg(Cost), 2) AS avg_cost, round_even(round_even(quantile_cont(Cost, 0.5), 9), 2) AS median_cost,
  round_even(min(Cost), 2) AS min_cost, round_even(max(Cost), 2) AS max_cost,
  round_even(avg(Length_of_Stay), 2) AS avg_length_of_stay,
  round_even(quantile_cont(Length_of_Stay, 0.5), 2) AS median_length_of_stay,
  round_even(100.0 * count(*) FILTER (WHERE Readmission = 'Yes') / nullif(count(Readmission), 0), 2) AS readmission_rate,
  round_even(100.0 * count(*) FILTER (WHERE Outcome = 'Recovered') / nullif(count(Outcome), 0), 2) AS recovery_rate,
  round_even(avg(Satisfaction), 2) AS avg_satisfaction,
  CASE WHEN count(Satisfaction) > 0 THEN count(*) FILTER (WHERE Satisfaction <= 2) END AS low_satisfaction_count"""


@register("kpi_overview", with_cases(f"SELECT {_KPI_COLS} FROM cases HAVING count(*) > 0"))
def kpi_overview(spark, sf_dir):
    return cohort.kpi_overview(case_view(spark, sf_dir))


@register("kpi_filtered", with_cases(
    f"SELECT {_KPI_COLS} FROM cases WHERE Readmission = 'Yes' AND Gender = 'O' HAVING count(*) > 0"))
def kpi_filtered(spark, sf_dir):
    return cohort.kpi_overview(case_view(spark, sf_dir), where={"Readmission": "Yes", "Gender": "O"})


@register("kpi_by_group", with_cases(
    f"SELECT Condition, {_KPI_COLS} FROM cases WHERE Condition IS NOT NULL GROUP BY Condition"))
def kpi_by_group(spark, sf_dir):
    return cohort.kpi_overview(case_view(spark, sf_dir), by=["Condition"])


def _bench_sql(g: str) -> str:
    return with_cases(f"""
WITH g AS (SELECT quantile_cont(Length_of_Stay, 0.9) AS gp90 FROM cases)
SELECT {g}, count(*) AS n, round_even(avg(Length_of_Stay), 2) AS mean,
  round_even(quantile_cont(Length_of_Stay, 0.5), 2) AS p50,
  round_even(quantile_cont(Length_of_Stay, 0.75), 2) AS p75,
  round_even(quantile_cont(Length_of_Stay, 0.9), 2) AS p90,
  min(Length_of_Stay) AS "min", max(Length_of_Stay) AS "max",
  coalesce(round_even(quantile_cont(Length_of_Stay, 0.5), 2) > any_value(gp90), false) AS exceeds_global_p90,
  count(*) FILTER (WHERE Length_of_Stay > gp90) AS long_stay_count,
  round_even(any_value(gp90), 2) AS global_p90_threshold
FROM cases CROSS JOIN g WHERE {g} IS NOT NULL GROUP BY {g}
ORDER BY mean DESC NULLS LAST, {g}""")


@register("los_benchmark", _bench_sql("Condition"))
def los_benchmark(spark, sf_dir):
    return cohort.los_benchmark(case_view(spark, sf_dir), "Condition")


@register("los_benchmark_procedure", _bench_sql("Procedure"))
def los_benchmark_procedure(spark, sf_dir):
    return cohort.los_benchmark(case_view(spark, sf_dir), "Procedure")


_COHORTS_SQL = """
SELECT Condition, Procedure, round_even(avg(Satisfaction), 2) AS avg_satisfaction,
  count(Patient_ID) AS n, round_even(stddev_samp(Satisfaction), 2) AS std,
  count(Satisfaction) AS satisfaction_count
FROM cases WHERE Condition IS NOT NULL AND Procedure IS NOT NULL
GROUP BY Condition, Procedure HAVING count(Patient_ID) >= 20
ORDER BY avg(Satisfaction) ASC NULLS LAST, Condition, Procedure LIMIT 10"""


@register("satisfaction_cohorts", with_cases(_COHORTS_SQL))
def satisfaction_cohorts(spark, sf_dir):
    return cohort.satisfaction_cohorts(case_view(spark, sf_dir), ["Condition", "Procedure"], 20)


def _corr_body() -> str:
    parts = []
    for v in cohort.CORRELATED:
        parts.append(f"""SELECT '{v}' AS variable,
  round_even(CASE WHEN stddev_pop(x_{v}) * stddev_pop(y_{v}) > 0
    THEN covar_pop(x_{v}, y_{v}) / (stddev_pop(x_{v}) * stddev_pop(y_{v})) END, 3) AS correlation,
  CASE WHEN covar_pop(x_{v}, y_{v}) / nullif(stddev_pop(x_{v}) * stddev_pop(y_{v}), 0) < -0.1 THEN 'negative'
       WHEN covar_pop(x_{v}, y_{v}) / nullif(stddev_pop(x_{v}) * stddev_pop(y_{v}), 0) > 0.1 THEN 'positive'
       ELSE 'weak/none' END AS interpretation,
  count(x_{v}) AS support
FROM p HAVING count(x_{v}) > 10""")
    cols = ", ".join(
        f"CASE WHEN {v} IS NOT NULL AND Satisfaction IS NOT NULL THEN CAST({v} AS double) END AS x_{v}, "
        f"CASE WHEN {v} IS NOT NULL AND Satisfaction IS NOT NULL THEN CAST(Satisfaction AS double) END AS y_{v}"
        for v in cohort.CORRELATED)
    return f"WITH p AS (SELECT {cols} FROM cases)\n" + "\nUNION ALL\n".join(parts)


@register("satisfaction_correlations", with_cases(_corr_body()))
def satisfaction_correlations(spark, sf_dir):
    return cohort.satisfaction_correlations(case_view(spark, sf_dir))


_CONTRASTS_SQL = """
WITH w AS (SELECT
  avg(Satisfaction) FILTER (WHERE Outcome = 'Recovered') AS rec,
  avg(Satisfaction) FILTER (WHERE Outcome = 'Stable') AS stb,
  count(*) FILTER (WHERE Outcome = 'Recovered') > 0 AS has_rec,
  count(*) FILTER (WHERE Outcome = 'Stable') > 0 AS has_stb,
  avg(Satisfaction) FILTER (WHERE Readmission = 'Yes') AS yes,
  avg(Satisfaction) FILTER (WHERE Readmission = 'No') AS no,
  count(*) FILTER (WHERE Readmission = 'Yes') > 0 AS has_yes,
  count(*) FILTER (WHERE Readmission = 'No') > 0 AS has_no
  FROM cases)
SELECT 'Outcome' AS factor, round_even(rec, 2) AS level_a_avg, round_even(stb, 2) AS level_b_avg,
  CASE WHEN coalesce(rec > stb, false) THEN 'recovery associated with higher satisfaction'
       ELSE 'no clear pattern' END AS interpretation FROM w WHERE has_rec AND has_stb
UNION ALL
SELECT 'Readmission', round_even(yes, 2), round_even(no, 2),
  CASE WHEN coalesce(yes < no, false) THEN 'readmission associated with lower satisfaction'
       ELSE 'no clear pattern' END FROM w WHERE has_yes AND has_no"""


@register("satisfaction_contrasts", with_cases(_CONTRASTS_SQL))
def satisfaction_contrasts(spark, sf_dir):
    return cohort.satisfaction_contrasts(case_view(spark, sf_dir))


_OVERALL_SQL = """
SELECT round_even(avg(Satisfaction), 2) AS mean,
  round_even(quantile_cont(Satisfaction, 0.5), 2) AS median,
  round_even(stddev_samp(Satisfaction), 2) AS std,
  round_even(100.0 * count(*) FILTER (WHERE Satisfaction <= 2) / nullif(count(Satisfaction), 0), 2) AS low_satisfaction_pct
FROM cases HAVING count(*) > 0"""


@register("satisfaction_overall", with_cases(_OVERALL_SQL))
def satisfaction_overall(spark, sf_dir):
    return cohort.satisfaction_overall(case_view(spark, sf_dir))


def _report_sql() -> str:
    def long(part, item, metrics, source):
        return "\nUNION ALL\n".join(
            f"SELECT '{part}' AS part, {item} AS item, '{m}' AS metric, CAST({m} AS double) AS value FROM ({source})" for m in metrics)

    return with_cases("\nUNION ALL\n".join([
        long("cohort", "Condition || ' / ' || Procedure", ["avg_satisfaction", "n"], _COHORTS_SQL),
        long("correlation", "variable", ["correlation", "support"], _corr_body()),
        long("contrast", "factor", ["level_a_avg", "level_b_avg"], _CONTRASTS_SQL),
        long("overall", "'Satisfaction'", ["mean", "median", "std", "low_satisfaction_pct"], _OVERALL_SQL)]))


@register("satisfaction_report", _report_sql())
def satisfaction_report(spark, sf_dir):
    return cohort.satisfaction_report(case_view(spark, sf_dir), ["Condition", "Procedure"], 20)


# The treatment-comparison request used by the registered query.
TREATMENT_CONDITION = "build"
TREATMENT_PATTERNS = ["prom", "econ", "nosuch", "STAN", "prom"]


@register("treatment_comparison", with_cases("""
WITH pats(pattern_pos, pattern) AS (VALUES (0, 'prom'), (1, 'econ'), (2, 'nosuch'), (3, 'STAN')),
r AS (SELECT * FROM cases WHERE coalesce(regexp_matches(Condition, 'build', 'i'), false)),
m AS (SELECT p.pattern, r.* FROM r JOIN pats p ON regexp_matches(r.Procedure, p.pattern, 'i')),
a AS (SELECT pattern, count(*) AS total_cases,
  round_even(count(*) FILTER (WHERE Outcome = 'Recovered') * 100.0 / count(*), 2) AS success_rate,
  round_even(avg(Length_of_Stay), 2) AS average_length_of_stay_days,
  round_even(avg(Cost), 2) AS average_cost FROM m GROUP BY pattern)
SELECT p.pattern, coalesce(a.total_cases, 0) AS total_cases, a.success_rate,
  a.average_length_of_stay_days, a.average_cost, a.total_cases IS NULL AS no_data
FROM pats p LEFT JOIN a ON p.pattern = a.pattern"""))
def treatment_comparison(spark, sf_dir):
    return cohort.compare_treatments(case_view(spark, sf_dir), TREATMENT_CONDITION, TREATMENT_PATTERNS)


def treatment_request_table(spark, sf_dir):
    """Requests derived from customers and parts: the beginning of the customer's segment
    (2 to 4 letters) against 3 letters of the part type with the customer's number; every
    ninth asks for a procedure that no case has."""
    c, p = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "part")
    n = F.col("c_custkey") % 3
    return c.join(p, c.c_custkey == p.p_partkey).select(
        F.lower(F.substring("c_mktsegment", F.lit(1), (n + 2).cast("int"))).alias("condition"),
        F.when(F.col("c_custkey") % 9 == 0, F.lit("no such ward"))
        .otherwise(F.lower(F.substring("p_type", (n + 1).cast("int"), F.lit(3)))).alias("pattern"))


@register("treatment_requests", with_cases("""
WITH req AS (SELECT DISTINCT lower(substring(c_mktsegment, 1, CAST(c_custkey % 3 + 2 AS int))) AS condition,
    CASE WHEN c_custkey % 9 = 0 THEN 'no such ward' ELSE lower(substring(p_type, CAST(c_custkey % 3 + 1 AS int), 3)) END AS pattern
  FROM customer JOIN part ON c_custkey = p_partkey),
a AS (SELECT r.condition, r.pattern, count(*) AS total_cases,
    round_even(count(*) FILTER (WHERE c.Outcome = 'Recovered') * 100.0 / count(*), 2) AS success_rate,
    round_even(avg(c.Length_of_Stay), 2) AS average_length_of_stay_days, round_even(avg(c.Cost), 2) AS average_cost
  FROM req r JOIN cases c ON regexp_matches(c.Condition, r.condition, 'i') AND regexp_matches(c.Procedure, r.pattern, 'i')
  GROUP BY r.condition, r.pattern)
SELECT r.condition, r.pattern, coalesce(a.total_cases, 0) AS total_cases, a.success_rate, a.average_length_of_stay_days,
  a.average_cost, a.total_cases IS NULL AS no_data, printf('%.2f%%', a.success_rate) AS success_rate_text,
  printf('%.2f', a.average_length_of_stay_days) AS average_length_of_stay_text, '$' || printf('%.2f', a.average_cost) AS average_cost_text
FROM req r LEFT JOIN a ON a.condition = r.condition AND a.pattern = r.pattern"""))
def treatment_requests(spark, sf_dir):
    return treatments.compare_treatment_requests(case_view(spark, sf_dir), treatment_request_table(spark, sf_dir), texts=True)


@register("procedure_options", with_cases("""
SELECT lower(Condition) AS condition_key, Procedure, count(Patient_ID) AS "count",
  round_even(count(*) FILTER (WHERE Readmission = 'Yes') / count(*), 6) AS readmission_rate,
  CAST(row_number() OVER (PARTITION BY lower(Condition)
    ORDER BY count(*) FILTER (WHERE Readmission = 'Yes') / count(*), Procedure) AS INTEGER) AS "rank"
FROM cases WHERE Condition IS NOT NULL AND Procedure IS NOT NULL
GROUP BY lower(Condition), Procedure HAVING count(Patient_ID) >= 5"""))
def procedure_options(spark, sf_dir):
    return cohort.procedure_options(case_view(spark, sf_dir))


@register("combination_frequency", with_cases("""
WITH d AS (SELECT * FROM cases WHERE Condition IS NOT NULL AND Procedure IS NOT NULL AND Outcome IS NOT NULL)
SELECT Condition, Procedure, Outcome, count(*) AS "count",
  round_even(count(*) / (SELECT count(*) FROM d), 6) AS frequency
FROM d GROUP BY Condition, Procedure, Outcome"""))
def combination_frequency(spark, sf_dir):
    f = cohort.combination_frequency(case_view(spark, sf_dir))
    return f.withColumn("frequency", F.bround("frequency", 6))


@register("target_stats", with_cases("""
SELECT round_even(avg(Length_of_Stay), 4) AS los_mean, round_even(stddev_samp(Length_of_Stay), 4) AS los_std,
  min(Length_of_Stay) AS los_min, max(Length_of_Stay) AS los_max,
  round_even(quantile_cont(Length_of_Stay, 0.5), 4) AS los_median,
  count(*) FILTER (WHERE Readmission = 'Yes') AS readmission_yes,
  count(*) FILTER (WHERE Readmission = 'No') AS readmission_no
FROM cases"""))
def target_stats(spark, sf_dir):
    return cohort.target_stats(case_view(spark, sf_dir))
