from pyspark.sql import functions as F

import casebook.plans.catalog  # noqa: F401  (before the modules it gathers)
from casebook.plans import q_ops


def some_cases(spark):
    return spark.range(0, 300, 1, 3).select(
        F.col("id").alias("Patient_ID"), (F.col("id") % 60).cast("int").alias("Age"),
        F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("Gender"), F.concat(F.lit("c"), F.col("id") % 3).alias("Condition"),
        F.when(F.col("id") == 7, "rare").otherwise(F.concat(F.lit("p"), F.col("id") % 4)).alias("Procedure"),
        F.when(F.col("id") == 9, 1e6).otherwise((F.col("id") % 97).cast("double")).alias("Cost"),
        (F.col("id") % 11).cast("int").alias("Length_of_Stay"), F.when(F.col("id") % 5 < 2, "Yes").otherwise("No").alias("Readmission"),
        F.lit("Stable").alias("Outcome"), (F.col("id") % 5).cast("int").alias("Satisfaction"))


def watched(spark, monkeypatch):
    """The case view of the queries is a small one that counts how often its rows are computed."""
    cases, seen = some_cases(spark), spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    monkeypatch.setattr(q_ops, "case_view", lambda *_: cases.mapInArrow(run, cases.schema))
    return seen


def test_anomaly_report_computes_the_cases_once(spark, monkeypatch):
    seen = watched(spark, monkeypatch)
    found = {(r["kind"], r["Patient_ID"], r["what"]) for r in q_ops.anomaly_report(spark, "none").collect()}
    assert found == {("numerical", 9, "Cost"), ("combination", 7, "c1 / rare / Stable")} and seen.value == 300


def test_lookup_similar_computes_the_cases_once(spark, monkeypatch):
    seen = watched(spark, monkeypatch)
    monkeypatch.setattr(q_ops, "read_table", lambda *_: spark.range(5).select(F.col("id").alias("user_id")))
    found = q_ops.lookup_similar(spark, "none").collect()
    assert {r["target_id"] for r in found} == set(range(5)) and len(found) == 25 and seen.value == 300
    assert all(r["distance"] == 0.0 and r["Patient_ID"] == r["target_id"] for r in found if r["rank"] == 1)
