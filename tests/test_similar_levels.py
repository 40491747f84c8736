import numpy as np
from pyspark.sql import functions as F

from casebook.operators import similar

CATS = similar.CATEGORICAL_FEATURES


def some_cases(spark, n):
    """One in 50 has a procedure that few others have."""
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    return spark.range(0, n, 1, 3).select(
        F.col("id").alias("Patient_ID"), F.when(h % 2 == 0, "F").otherwise("O").alias("Gender"), F.concat(F.lit("c"), h % 3).alias("Condition"),
        F.when(F.col("id") % 50 == 7, F.concat(F.lit("rare"), F.col("id") % 4)).otherwise("p").alias("Procedure"), (h % 5003).cast("double").alias("Cost"))


def watched(monkeypatch):
    """The rows that are put in order, by search."""
    numbered, count = [], similar.running_count

    def run(df, *args):
        numbered.append(df.count())
        return count(df, *args)
    monkeypatch.setattr(similar, "running_count", run)
    return numbered


def test_a_target_with_enough_of_its_kind_is_searched_there_alone(spark, monkeypatch):
    numbered = watched(monkeypatch)
    cases = some_cases(spark, 1200).where("Procedure = 'p' AND Gender = 'F'")
    t = cases.where("Patient_ID < 40").withColumnRenamed("Patient_ID", "target_id")
    assert similar.similar_cases(cases, t, n=5, numeric="Cost").count() == 5 * t.count()
    assert len(numbered) == 1 and numbered[0] <= cases.count() + t.count()


def test_rare_targets_are_searched_as_far_as_needed(spark, monkeypatch):
    numbered = watched(monkeypatch)
    cases = some_cases(spark, 600)
    t = cases.where("Patient_ID % 50 < 9").withColumnRenamed("Patient_ID", "target_id")
    got = {}
    for r in similar.similar_cases(cases, t, n=5, numeric="Cost").collect():
        got.setdefault(r["target_id"], {})[r["rank"]] = (r["distance"], r["Patient_ID"])
    pop = cases.toPandas()
    x = pop.Cost.to_numpy()
    for _, r in t.toPandas().iterrows():
        var = np.var(np.append(x, r.Cost))
        d2 = (x - r.Cost) ** 2 / var + 2.0 * sum((pop[c] != r[c]).to_numpy().astype(int) for c in CATS)
        want = sorted(zip(np.sqrt(d2).round(6), pop.Patient_ID))[:5]
        assert [got[r.target_id][k][1] for k in range(1, 6)] == [k for _, k in want]
        assert np.allclose([got[r.target_id][k][0] for k in range(1, 6)], [d for d, _ in want], atol=2e-6)
    assert len(numbered) > 1
