"""Rule-based triage queue (F9 T1 T2; T3 lives in casebook.ml.scoring).

All rules compile into one projection: a score sum and a reasons array, no
per-row Python.  The queue is a global top-k (TakeOrdered).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.filters import apply_where, rule_predicate
from casebook.schema import CASE_COLUMNS, KEY

# The default triage rules.
DEFAULT_RULES = [
    {"field": "Length_of_Stay", "operator": ">", "value": 7, "score": 2.0,
     "description": "Extended stay (>7 days)"},
    {"field": "Cost", "operator": ">", "value": 25000, "score": 1.5,
     "description": "High cost case"},
    {"field": "Satisfaction", "operator": "<=", "value": 2, "score": 2.5,
     "description": "Low satisfaction"},
    {"field": "Readmission", "operator": "==", "value": "Yes", "score": 3.0,
     "description": "Previous readmission"},
    {"field": "Outcome", "operator": "==", "value": "Stable", "score": 1.0,
     "description": "Non-recovered outcome"},
]

SUMMARY_COLUMNS = ["Age", "Gender", "Condition", "Procedure", "Length_of_Stay", "Cost",
                   "Satisfaction", "Outcome", "Readmission"]


def _py_text(c: Column) -> Column:
    """Text of a value as Python's ``str`` would print it, for common cases."""
    return c.cast("string")


def _reason(df: DataFrame, rule: dict) -> Column:
    if "description" in rule:
        return F.lit(rule["description"]).cast("string")
    field, op = rule.get("field"), rule.get("operator", ">")
    actual = _py_text(F.col(field)) if field in df.columns else F.lit("None")
    return F.concat(F.lit(f"{field} {op} {rule.get('value')} (actual: "), actual, F.lit(")"))


def score_rules(df: DataFrame, rules: list | None = None) -> DataFrame:
    """Adds ``score`` (sum of matched rule scores) and ``reasons`` (in rule order)."""
    rules = DEFAULT_RULES if rules is None else rules
    if not isinstance(rules, list):
        raise ValueError("give the rules as a list, one dictionary each")
    score = F.lit(0.0)
    parts = []
    for rule in rules:
        pred = rule_predicate(df, rule.get("field"), rule.get("operator", ">"), rule.get("value"))
        s = float(rule.get("score", 1.0))
        score = score + F.when(pred, F.lit(s)).otherwise(F.lit(0.0))
        parts.append(F.when(pred, F.array(_reason(df, rule))).otherwise(F.array().cast("array<string>")))
    reasons = F.flatten(F.array(*parts)) if parts else F.array().cast("array<string>")
    return df.withColumn("score", score).withColumn("reasons", reasons)


def triage_flagged(df: DataFrame, rules: list | None = None, where: dict | None = None) -> DataFrame:
    """Every row with a positive score, score rounded to 2 places."""
    d = score_rules(apply_where(df, where), rules)
    cols = [c for c in [KEY] if c in df.columns]
    summary = [c for c in SUMMARY_COLUMNS if c in df.columns]
    return (d.where(F.col("score") > 0)
            .select(*cols, F.bround("score", 2).alias("score"), "reasons", *summary))


def triage_queue(df: DataFrame, rules: list | None = None, limit: int = 20,
                 where: dict | None = None) -> DataFrame:
    """The ``limit`` highest scores; ties by key ascending."""
    f = triage_flagged(df, rules, where)
    return f.orderBy(F.desc("score"), F.asc(KEY)).limit(limit)


def triage_totals(df: DataFrame, rules: list | None = None, limit: int = 20,
                  where: dict | None = None) -> DataFrame:
    """T1 totals: flagged, returned, rules applied (one row)."""
    rules = DEFAULT_RULES if rules is None else rules
    f = triage_flagged(df, rules, where)
    return f.agg(F.count(F.lit(1)).alias("total_flagged")).select(
        "total_flagged", F.least(F.col("total_flagged"), F.lit(limit)).alias("returned"),
        F.lit(len(rules)).alias("rules_applied"))


__all__ = ["DEFAULT_RULES", "score_rules", "triage_flagged", "triage_queue", "triage_totals",
           "CASE_COLUMNS"]
