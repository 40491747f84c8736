"""Registered queries: charts, triage, anomalies, similar cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.filters import lookup
from casebook.operators import anomaly, charts, cohort, similar, triage
from casebook.plans.catalog import register, with_cases
from casebook.session import stored
from casebook.sources.tables import case_view, read_table

# Doubles from order-dependent arithmetic (sums, means, interpolation) are
# rounded to 6 places in both engines before comparison.
R6 = 6


def _r6(df, cols, k: int = R6):
    return df.select(*[F.bround(c, k).alias(c) if c in cols else F.col(c) for c in df.columns])


def _r6_sql(sql: str, keep, cols, k: int = R6) -> str:
    sel = ", ".join([f'"{c}"' for c in keep] + [f'round_even("{c}", {k}) AS "{c}"' for c in cols])
    return f"SELECT {sel} FROM ({sql}) AS q"


# Sums of cent amounts: the exact sum has two decimals, so rounding to 2 removes
# summation-order noise without ever meeting a tie.
R2 = 2


# ---------------------------------------------------------------- charts

_BAR_SQL = """
SELECT Condition, CAST(count(*) FILTER (WHERE Readmission = 'Yes') * 100.0 / count(*) AS double) AS value
FROM cases WHERE Condition IS NOT NULL GROUP BY Condition
ORDER BY value DESC NULLS LAST, Condition LIMIT 15"""


@register("chart_bar", _r6_sql(with_cases(_BAR_SQL), ['Condition'], ['value']))
def chart_bar(spark, sf_dir):
    return _r6(charts.chart_data(case_view(spark, sf_dir), "bar", "readmission_rate", "medical_condition"), ['value'])


@register("chart_bar_billing", _r6_sql(with_cases("""
SELECT Procedure, CAST(sum(Cost) AS double) AS value FROM cases WHERE Procedure IS NOT NULL
GROUP BY Procedure ORDER BY value DESC NULLS LAST, Procedure LIMIT 15"""), ['Procedure'], ['value'], R2))
def chart_bar_billing(spark, sf_dir):
    return _r6(charts.chart_data(case_view(spark, sf_dir), "bar", "billing", "procedure"), ['value'], R2)


@register("chart_line", _r6_sql(with_cases("""
SELECT Gender, CAST(avg(Cost) AS double) AS value FROM cases WHERE Gender IS NOT NULL
GROUP BY Gender ORDER BY Gender"""), ['Gender'], ['value']))
def chart_line(spark, sf_dir):
    return _r6(charts.chart_data(case_view(spark, sf_dir), "line", "cost", "gender"), ['value'])


@register("chart_pie", _r6_sql(with_cases("""
WITH k AS (SELECT Procedure, CAST(count(*) AS double) AS value FROM cases WHERE Procedure IS NOT NULL
  GROUP BY Procedure ORDER BY value DESC, Procedure LIMIT 8)
SELECT Procedure, value, value * 100.0 / sum(value) OVER () AS share_pct FROM k"""), ['Procedure'], ['value', 'share_pct']))
def chart_pie(spark, sf_dir):
    return _r6(charts.chart_data(case_view(spark, sf_dir), "pie", "admissions", "admission_type"), ['value', 'share_pct'])


def _hist_sql(source: str, col: str) -> str:
    return f"""
WITH d AS (SELECT CAST({col} AS double) AS x FROM {source} WHERE {col} IS NOT NULL),
s0 AS (SELECT min(x) AS mn, max(x) AS mx, avg(x) AS mean, quantile_cont(x, 0.5) AS median FROM d),
s AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
             CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi, mean, median FROM s0 WHERE mn IS NOT NULL),
b0 AS (SELECT x, lo, hi, (hi - lo) / 20.0 AS step,
        least(CAST(floor((x - lo) * (20.0 / (hi - lo))) AS int), 19) AS i FROM d CROSS JOIN s),
b1 AS (SELECT x, lo, hi, step,
        CASE WHEN x < (CASE WHEN i >= 20 THEN hi ELSE lo + i * step END) THEN i - 1 ELSE i END AS i FROM b0),
b2 AS (SELECT CASE WHEN x >= (CASE WHEN i + 1 >= 20 THEN hi ELSE lo + (i + 1) * step END) AND i <> 19
        THEN i + 1 ELSE i END AS i FROM b1),
c AS (SELECT i AS bin, count(*) AS cnt FROM b2 GROUP BY i),
dom AS (SELECT CAST(range AS int) AS bin FROM range(20))
SELECT dom.bin,
  CASE WHEN dom.bin >= 20 THEN hi ELSE lo + dom.bin * ((hi - lo) / 20.0) END AS bin_start,
  CASE WHEN dom.bin + 1 >= 20 THEN hi ELSE lo + (dom.bin + 1) * ((hi - lo) / 20.0) END AS bin_end,
  coalesce(c.cnt, 0) AS "count", mean, CAST(median AS double) AS median
FROM dom CROSS JOIN s LEFT JOIN c ON c.bin = dom.bin"""


@register("chart_histogram", _r6_sql(with_cases(_hist_sql("cases", "Length_of_Stay")), ['bin', 'count'], ['bin_start', 'bin_end', 'mean', 'median']))
def chart_histogram(spark, sf_dir):
    return _r6(charts.chart_data(case_view(spark, sf_dir), "histogram", "los"), ['bin_start', 'bin_end', 'mean', 'median'])


@register("chart_histogram_cost", _r6_sql(with_cases(_hist_sql("cases", "Cost")), ['bin', 'count'], ['bin_start', 'bin_end', 'mean', 'median']))
def chart_histogram_cost(spark, sf_dir):
    return _r6(charts.histogram_data(case_view(spark, sf_dir), "Cost"), ['bin_start', 'bin_end', 'mean', 'median'])


@register("events_histogram", _r6_sql(_hist_sql("events", "value"), ['bin', 'count'], ['bin_start', 'bin_end', 'mean', 'median']))
def events_histogram(spark, sf_dir):
    # The same operator over a second table: event values.
    return _r6(charts.histogram_data(read_table(spark, sf_dir, "events"), "value"), ['bin_start', 'bin_end', 'mean', 'median'])


def _box_sql(source: str, g: str, v: str) -> str:
    return f"""
WITH grp AS (SELECT DISTINCT {g} FROM {source} WHERE {g} IS NOT NULL ORDER BY {g} LIMIT 10),
d AS (SELECT s.{g}, CAST(s.{v} AS double) AS v FROM {source} s JOIN grp ON s.{g} = grp.{g}
      WHERE s.{v} IS NOT NULL),
q AS (SELECT {g}, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
      quantile_cont(v, 0.75) AS q3 FROM d GROUP BY {g}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q)
SELECT f.{g}, any_value(n) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
  min(v) FILTER (WHERE v >= lo_f AND v <= hi_f) AS whisker_low,
  max(v) FILTER (WHERE v >= lo_f AND v <= hi_f) AS whisker_high,
  count(*) FILTER (WHERE NOT (v >= lo_f AND v <= hi_f)) AS outliers
FROM d JOIN f ON d.{g} = f.{g} GROUP BY f.{g}"""


@register("chart_boxplot", _r6_sql(with_cases(_box_sql("cases", "Condition", "Length_of_Stay")), ['Condition', 'n', 'outliers'], ['q1', 'median', 'q3', 'whisker_low', 'whisker_high']))
def chart_boxplot(spark, sf_dir):
    return _r6(charts.chart_data(case_view(spark, sf_dir), "boxplot", "length_of_stay", "condition"), ['q1', 'median', 'q3', 'whisker_low', 'whisker_high'])


@register("events_boxplot", _r6_sql(_box_sql("events", "event_type", "value"), ['event_type', 'n', 'outliers'], ['q1', 'median', 'q3', 'whisker_low', 'whisker_high']))
def events_boxplot(spark, sf_dir):
    return _r6(charts.boxplot_data(read_table(spark, sf_dir, "events"), "event_type", ("value", "mean")), ['q1', 'median', 'q3', 'whisker_low', 'whisker_high'])


def _box_outlier_sql(source: str, key: str, g: str, v: str) -> str:
    stats = _box_sql(source, g, v)
    return f"""SELECT s.{key}, s.{g}, CAST(s.{v} AS double) AS value
FROM {source} s JOIN ({stats}) q ON s.{g} = q.{g}
WHERE s.{v} < q.q1 - 1.5 * (q.q3 - q.q1) OR s.{v} > q.q3 + 1.5 * (q.q3 - q.q1)"""


@register("chart_boxplot_outliers", with_cases(_box_outlier_sql("cases", "Patient_ID", "Condition", "Length_of_Stay")))
def chart_boxplot_outliers(spark, sf_dir):
    return charts.boxplot_outliers(case_view(spark, sf_dir), "condition", "length_of_stay")


@register("events_chart_bar", _r6_sql("""
SELECT event_type, CAST(sum(value) AS double) AS value FROM events WHERE event_type IS NOT NULL
GROUP BY event_type ORDER BY value DESC NULLS LAST, event_type LIMIT 15""", ['event_type'], ['value'], R2))
def events_chart_bar(spark, sf_dir):
    return _r6(charts.bar_data(read_table(spark, sf_dir, "events"), "event_type", ("value", "sum")), ['value'], R2)


# ---------------------------------------------------------------- triage

# The default rules with thresholds suited to the case view
# (the defaults of 7 days / 25,000 flag nearly every row there).
TRIAGE_RULES = [dict(r) for r in triage.DEFAULT_RULES]
TRIAGE_RULES[0].update(value=45, description="Extended stay (>45 days)")
TRIAGE_RULES[1].update(value=450000)


def _rule_sql(rule) -> str:
    f, op, v = rule["field"], rule["operator"], rule["value"]
    lit = f"'{v}'" if isinstance(v, str) else str(v)
    sqlop = {"==": "=", "!=": "<>"}.get(op, op)
    return f"coalesce({f} {sqlop} {lit}, false)"


def triage_sql(limit: int | None) -> str:
    score = " + ".join(f"CASE WHEN {_rule_sql(r)} THEN CAST({float(r['score'])} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
                       for r in TRIAGE_RULES)
    reasons = ", ".join(f"CASE WHEN {_rule_sql(r)} THEN '{r['description']}' END" for r in TRIAGE_RULES)
    body = f"""
WITH s AS (SELECT *, {score} AS raw_score, concat_ws('; ', {reasons}) AS reasons FROM cases)
SELECT Patient_ID, round_even(raw_score, 2) AS score, reasons, Age, Gender, Condition, Procedure,
  Length_of_Stay, Cost, Satisfaction, Outcome, Readmission
FROM s WHERE raw_score > 0"""
    if limit:
        body += f"\nORDER BY score DESC, Patient_ID LIMIT {limit}"
    return body


def _joined(df):
    return df.withColumn("reasons", F.array_join("reasons", "; "))


@register("triage_queue", with_cases(triage_sql(20)))
def triage_queue(spark, sf_dir):
    return _joined(triage.triage_queue(case_view(spark, sf_dir), TRIAGE_RULES, limit=20))


@register("triage_flagged", with_cases(triage_sql(None)))
def triage_flagged(spark, sf_dir):
    return _joined(triage.triage_flagged(case_view(spark, sf_dir), TRIAGE_RULES))


@register("triage_default_rules", with_cases("""
WITH s AS (SELECT *,
  CASE WHEN coalesce(Length_of_Stay > 7, false) THEN 2.0 ELSE 0.0 END
  + CASE WHEN coalesce(Cost > 25000, false) THEN 1.5 ELSE 0.0 END
  + CASE WHEN coalesce(Satisfaction <= 2, false) THEN 2.5 ELSE 0.0 END
  + CASE WHEN coalesce(Readmission = 'Yes', false) THEN 3.0 ELSE 0.0 END
  + CASE WHEN coalesce(Outcome = 'Stable', false) THEN 1.0 ELSE 0.0 END AS raw_score FROM cases)
SELECT count(*) AS total_flagged, least(count(*), 20) AS returned, 5 AS rules_applied
FROM s WHERE raw_score > 0"""))
def triage_default_rules(spark, sf_dir):
    return triage.triage_totals(case_view(spark, sf_dir), None, limit=20)


# One rule for each operator, and one whose literal is a boolean.
ALL_OPERATORS = [
    {"field": "Length_of_Stay", "operator": ">", "value": 40, "score": 1.0, "description": "a"},
    {"field": "Age", "operator": ">=", "value": 30, "score": 2.0, "description": "b"},
    {"field": "Cost", "operator": "<", "value": 100000, "score": 4.0, "description": "c"},
    {"field": "Satisfaction", "operator": "<=", "value": 2, "score": 8.0, "description": "d"},
    {"field": "Readmission", "operator": "==", "value": "Yes", "score": 16.0, "description": "e"},
    {"field": "Outcome", "operator": "!=", "value": "Stable", "score": 32.0, "description": "f"},
    {"field": "Procedure", "operator": "in", "value": ["PROMO", "LARGE"], "score": 64.0, "description": "g"},
    {"field": "Satisfaction", "operator": "==", "value": True, "score": 128.0, "description": "h"},
]


@register("triage_all_operators", with_cases("""
WITH s AS (SELECT *, [(coalesce(Length_of_Stay > 40, false)), (coalesce(Age >= 30, false)), (coalesce(Cost < 100000, false)),
    (coalesce(Satisfaction <= 2, false)), (coalesce(Readmission = 'Yes', false)), (coalesce(Outcome <> 'Stable', false)),
    (coalesce(Procedure IN ('PROMO', 'LARGE'), false)), (coalesce(Satisfaction = 1, false))] AS hits FROM cases)
SELECT Patient_ID, CAST(list_sum([CASE WHEN hits[i] THEN 2 ** (i - 1) ELSE 0 END FOR i IN range(1, 9)]) AS double) AS score,
  array_to_string([chr(CAST(96 + i AS int)) FOR i IN range(1, 9) IF hits[i]], '; ') AS reasons
FROM s WHERE list_bool_or(hits)"""))
def triage_all_operators(spark, sf_dir):
    flagged = triage.triage_flagged(case_view(spark, sf_dir), ALL_OPERATORS)
    return _joined(flagged).select("Patient_ID", "score", "reasons")


# ---------------------------------------------------------------- anomalies

def _z_sql(source: str, key: str, cols) -> str:
    stats = ", ".join(f"avg(CAST({c} AS double)) AS m_{c}, stddev_pop(CAST({c} AS double)) AS s_{c}"
                      for c in cols)
    parts = [f"""SELECT {key}, '{c}' AS "column", CAST({c} AS double) AS value,
  'Outlier (Z-score > 3.0)' AS reason FROM {source} CROSS JOIN st
WHERE s_{c} <> 0 AND abs((CAST({c} AS double) - m_{c}) / s_{c}) > 3.0""" for c in cols]
    return f"WITH st AS (SELECT {stats} FROM {source})\n" + "\nUNION ALL\n".join(parts)


@register("zscore_outliers", with_cases(_z_sql("cases", "Patient_ID", anomaly.NUMERIC_DEFAULT)))
def zscore_outliers(spark, sf_dir):
    return anomaly.zscore_outliers(case_view(spark, sf_dir))


@register("events_zscore", _z_sql("events", "event_id", ["value"]))
def events_zscore(spark, sf_dir):
    return anomaly.zscore_outliers(read_table(spark, sf_dir, "events"), ["value"], key="event_id")


_RARE_SQL = """
WITH d AS (SELECT * FROM cases WHERE Condition IS NOT NULL AND Procedure IS NOT NULL AND Outcome IS NOT NULL),
f AS (SELECT Condition, Procedure, Outcome, count(*) / (SELECT count(*) FROM d) AS frequency
      FROM d GROUP BY Condition, Procedure, Outcome)
SELECT d.Patient_ID, d.Condition, d.Procedure, d.Outcome, round_even(f.frequency, 4) AS frequency,
  'Very low frequency combination (< 0.50%)' AS reason
FROM d JOIN f ON d.Condition = f.Condition AND d.Procedure = f.Procedure AND d.Outcome = f.Outcome
WHERE f.frequency < 0.005"""


@register("rare_combinations", with_cases(_RARE_SQL))
def rare_combinations(spark, sf_dir):
    return anomaly.rare_combinations(case_view(spark, sf_dir))


@register("anomaly_report", with_cases(f"""
SELECT 'numerical' AS kind, Patient_ID, "column" AS what, value, reason FROM ({_z_sql("cases", "Patient_ID", anomaly.NUMERIC_DEFAULT)})
UNION ALL
SELECT 'combination', Patient_ID, concat_ws(' / ', Condition, Procedure, Outcome), frequency, reason FROM ({_RARE_SQL})"""))
def anomaly_report(spark, sf_dir):
    parts = anomaly.anomaly_report(stored(case_view(spark, sf_dir), "cases"))
    single = parts["numerical_outliers"].select(F.lit("numerical").alias("kind"), "Patient_ID", F.col("column").alias("what"), "value", "reason")
    rare = parts["low_frequency_combinations"].select(
        F.lit("combination").alias("kind"), "Patient_ID", F.concat_ws(" / ", *cohort.COMBINATION).alias("what"),
        F.col("frequency").alias("value"), "reason")
    return single.unionByName(rare)


# ---------------------------------------------------------------- similar cases

def _similar_sql(x: str, asked: str) -> str:
    """Brute force over all pairs of a distinct target profile and a record."""
    return with_cases(f"""
WITH pop AS (SELECT * FROM cases WHERE {x} IS NOT NULL AND Gender IS NOT NULL AND Condition IS NOT NULL
        AND Procedure IS NOT NULL),
st AS (SELECT CAST(count(*) AS double) AS n, avg(CAST({x} AS double)) AS m,
       var_pop(CAST({x} AS double)) AS v FROM pop),
asked AS (SELECT * FROM pop{asked}),
t AS (SELECT DISTINCT {x} AS t_x, Gender AS t_Gender, Condition AS t_Condition, Procedure AS t_Procedure FROM asked),
t2 AS (SELECT t.*, CASE WHEN var_t > 0 THEN sqrt(var_t) ELSE 1.0 END AS sigma
       FROM (SELECT t.*, (n * v + n / (n + 1) * (CAST(t_x AS double) - m) ^ 2) / (n + 1) AS var_t FROM t CROSS JOIN st) t),
pr AS (SELECT t2.t_x, t2.t_Gender, t2.t_Condition, t2.t_Procedure, pop.*,
        ((CAST(pop.{x} AS double) - CAST(t_x AS double)) / sigma) ^ 2
        + 2.0 * ((pop.Gender <> t_Gender)::int + (pop.Condition <> t_Condition)::int
                 + (pop.Procedure <> t_Procedure)::int) AS d2
      FROM t2 CROSS JOIN pop),
rk AS (SELECT *, row_number() OVER (PARTITION BY t_x, t_Gender, t_Condition, t_Procedure ORDER BY d2, Patient_ID) AS rank
       FROM pr QUALIFY rank <= 5)
SELECT q.Patient_ID AS target_id, CAST(rk.rank AS int) AS rank, round_even(sqrt(d2), 6) AS distance,
  rk.Patient_ID, rk.Age, rk.Gender, rk.Condition, rk.Procedure, rk.Cost, rk.Length_of_Stay, rk.Readmission, rk.Outcome, rk.Satisfaction
FROM asked q JOIN rk ON q.{x} = t_x AND q.Gender = t_Gender AND q.Condition = t_Condition AND q.Procedure = t_Procedure""")


@register("similar_cases", _similar_sql("Age", ""))
def similar_cases(spark, sf_dir):
    # Every complete case is a target.
    cases = case_view(spark, sf_dir)
    return similar.similar_cases(cases, cases.select(F.col("Patient_ID").alias("target_id"), "Age", "Gender", "Condition", "Procedure"), n=5)


@register("lookup_similar", _similar_sql("Cost", " WHERE Patient_ID IN (SELECT user_id FROM events)"))
def lookup_similar(spark, sf_dir):
    """Record ids -> their records -> the nearest cases, by cost (a continuous feature)."""
    cases = stored(case_view(spark, sf_dir), "cases")
    ids = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("Patient_ID"))
    asked = lookup(cases, patient_id=ids).select(F.col("Patient_ID").alias("target_id"), "Cost", "Gender", "Condition", "Procedure")
    return similar.similar_cases(cases, asked, n=5, numeric="Cost")
