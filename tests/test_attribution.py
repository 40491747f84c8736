import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from casebook.ml import forest, models, scoring
from casebook.ml.features import LOS_FEATURES
from casebook.plans import q_models
from tests.conftest import SF_SMALL


def test_stay_attribution_explains_every_complete_case(spark, small_cases, monkeypatch):
    b = models.train_los_model(small_cases, num_trees=4, max_depth=4)
    monkeypatch.setattr(q_models, "bundle", lambda *_: b)
    got = q_models.los_attribution(spark, SF_SMALL)
    complete = small_cases.na.drop(subset=list(LOS_FEATURES))
    assert got.count() == 5 * complete.count()
    assert got.select("Patient_ID").distinct().exceptAll(complete.select("Patient_ID")).count() == 0


def test_blocks_give_the_same_values(spark, small_cases):
    """One block of the grid, many blocks, and many blocks brought together by Spark."""
    b = models.train_los_model(small_cases, num_trees=9, max_depth=7)
    ff = b.flat(spark)
    assert (ff.set_row >= 0).any()
    asked = scoring._inputs(b, small_cases).where("_complete").select("*", F.col("_own.Patient_ID").alias("Patient_ID"))
    X = b.numeric_inputs(asked).select(*b.model_columns()).toPandas().to_numpy(float)[:300]
    whole, cut = forest.Game(ff), forest.Game(ff, 20_000)
    assert whole.blocks == 1 < cut.blocks
    want = whole.shapley(X)
    assert np.allclose(cut.shapley(X), want, atol=1e-10) and np.isclose(whole.base, cut.base)
    assert np.allclose(whole.base + want.sum(1), forest.tree_values(ff, X).mean(1), atol=1e-9)

    def values(cells):
        a = forest.attributions(b, asked, ["Patient_ID"], spark, cells)
        return a.groupBy("Patient_ID", "feature").agg(F.round(F.first("shap_value"), 8).alias("v"), F.count(F.lit(1)).alias("n"))

    one, many = values(forest.TABLE_CELLS), values(20_000)
    assert one.join(many.withColumnsRenamed({"v": "w", "n": "m"}), ["Patient_ID", "feature"], "full").where(
        "v IS NULL OR w IS NULL OR abs(v - w) > 1e-7 OR n <> 1 OR m <> 1").count() == 0


def shuffled(node) -> int:
    """The rows that the exchanges of an executed plan wrote."""
    name = node.getClass().getSimpleName()
    inner = "executedPlan" if name == "AdaptiveSparkPlanExec" else "plan" if name.endswith("QueryStageExec") else None
    if inner:
        return shuffled(getattr(node, inner)())
    if name == "ReusedExchangeExec":
        return 0
    mine = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return mine + sum(shuffled(node.children().apply(i)) for i in range(node.children().size()))


def test_requests_are_ranked_before_they_become_a_row_per_feature(spark, small_cases):
    """The same rows as ranking the long form, keys repeated or null, and no shuffle of a row per feature."""
    b = models.train_risk_model(small_cases, num_trees=4, max_depth=4)
    some = small_cases.where("Patient_ID <= 40")
    asked = (some.unionByName(some.where("Patient_ID % 4 = 0")).unionByName(some.where("Patient_ID % 4 = 1").withColumn("Age", F.col("Age") + 7))
             .withColumn("Patient_ID", F.when(F.col("Patient_ID") % 10 != 7, F.col("Patient_ID")))).localCheckpoint()
    r = scoring._inputs(b, asked).where("_complete").select("*", F.col("_own.Patient_ID").alias("Patient_ID"))
    w = Window.partitionBy("Patient_ID").orderBy(F.desc(F.abs(F.bround("shap_value", 9))), "feature")
    ranked = forest.attributions(b, r, ["Patient_ID"], spark).withColumn("rank", F.row_number().over(w))
    for top in (2, 5):
        got = scoring.attribution_report(b, asked, ["Patient_ID"], top)
        want = ranked.where(F.col("rank") <= top)
        shown = ["Patient_ID", "rank", "feature", F.bround(F.bround("shap_value", 9), 4).alias("shap_value")]
        a, z = got.select(*shown), want.select(*shown)
        assert a.exceptAll(z).count() == z.exceptAll(a).count() == 0 < got.count()
        assert got.where("Patient_ID IS NULL").count() == top

    once = some.na.drop(subset=list(b.features)).localCheckpoint()
    plan = scoring.attribution_report(b, once, ["Patient_ID"])
    plan.collect()
    assert shuffled(plan._jdf.queryExecution().executedPlan()) == once.count() > 0
