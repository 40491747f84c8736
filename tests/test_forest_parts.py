import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from casebook.ml import forest, models, scoring


def some_cases(spark, n=600):
    return spark.range(0, n, 1, 3).select(
        F.col("id").alias("Patient_ID"), (F.col("id") % 60).cast("int").alias("Age"),
        F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("Gender"), F.concat(F.lit("c"), F.col("id") % 3).alias("Condition"),
        F.concat(F.lit("p"), F.col("id") % 4).alias("Procedure"), (F.col("id") % 97).cast("double").alias("Cost"),
        (F.col("id") % 11).cast("int").alias("Length_of_Stay"), F.when(F.col("id") % 7 < 3, "Yes").otherwise("No").alias("Readmission"))


@pytest.fixture
def small_parts(monkeypatch):
    """Two trees of depth 3 a part."""
    monkeypatch.setattr(models, "PART_NODES", 32)
    monkeypatch.setattr(models, "PART_ROWS", 200)
    monkeypatch.setattr(models, "FIT_ROWS", 200)


def trained(spark, kind, num_trees=5):
    train = models.train_los_model if kind == "los" else models.train_risk_model
    return train(some_cases(spark), num_trees=num_trees, max_depth=3)


@pytest.mark.parametrize("kind", ["los", "risk"])
def test_a_forest_in_parts_has_all_its_trees_and_scores_as_they_do(spark, small_parts, tmp_path, kind):
    cases, b = some_cases(spark), trained(spark, kind)
    assert len(b.parts) == 3 and len(b.pipeline.stages) == 3
    parts = [models._part_model(kind, p) for p in b.parts]
    assert sum(m.getNumTrees for m in parts) == 5 and all(m.getNumTrees <= 2 for m in parts)
    assert len({m.toDebugString.split("\n", 1)[1] for m in parts}) == 3  # other draws in each
    ff = b.flat(spark)
    assert len(ff.roots) == 5 and b.flat(spark) is ff
    # What Spark's own models of the parts say, by trees.
    x = models._cast_features(cases, b.features)
    want = np.zeros(600)
    for m in parts:
        p = m.transform(b.pipeline.transform(x))
        p = p.select("Patient_ID", (F.col("prediction") if kind == "los" else vector_to_array("probability")[1]).alias("v"))
        want += np.array([r["v"] for r in p.orderBy("Patient_ID").collect()]) * m.getNumTrees / 5
    out = "_prediction" if kind == "los" else "_p"
    got = b.scored(x).orderBy("Patient_ID").toPandas()
    assert np.allclose(got[out], want, rtol=0, atol=1e-12)
    if kind == "risk":
        assert ((got["_prediction"] == 1.0) == (got["_p"] > 0.5)).all()
    # Its saved and loaded copy scores alike and needs none of the first one's folders.
    models.fill_training_meta(b, cases)
    models.save_bundle(b, str(tmp_path / "m"), spark)
    back = models.load_bundle(str(tmp_path / "m"), spark)
    assert len(back.parts) == 3 and not set(back.parts) & set(b.parts)
    assert back.scored(x).orderBy("Patient_ID").toPandas()[out].equals(got[out])
    assert models.model_info(str(tmp_path / "m"), spark).first()["trained_on_n"] == 600
    imp = {r["feature"]: r["importance"] for r in models.feature_importances(b, spark).collect()}
    assert list(imp) == b.features and abs(sum(imp.values()) - 1) < 1e-9


def test_ranges_and_attributions_of_a_forest_in_parts(spark, small_parts):
    cases, b = some_cases(spark), trained(spark, "los")
    models.fill_training_meta(b, cases)
    s = scoring.los_scores(b, cases, ["Patient_ID"])
    assert s.count() == 600 and s.where("lower_bound_days > upper_bound_days").isEmpty()
    got = {r["Patient_ID"]: r["prediction"] for r in forest.attributions(b, models._cast_features(cases, b.features), ["Patient_ID"], spark).collect()}
    want = {r["Patient_ID"]: r["_prediction"] for r in b.scored(models._cast_features(cases, b.features)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_only_large_fits_of_large_forests_are_in_parts(spark, small_parts, monkeypatch):
    assert not trained(spark, "los", num_trees=2).parts
    monkeypatch.setattr(models, "PART_ROWS", 600)
    b = trained(spark, "los")
    assert not b.parts and b.forest.getNumTrees == 5


def test_the_parts_of_the_registered_forests():
    from pyspark.ml.regression import RandomForestRegressor
    stay = models._part_sizes(RandomForestRegressor(numTrees=100, maxDepth=15), models.PART_ROWS + 1)
    assert sum(stay) == 100 and max(stay) * 2 ** 16 <= models.PART_NODES
    assert models._part_sizes(RandomForestRegressor(numTrees=100, maxDepth=10), 60_000) == [100]
    assert models._part_sizes(RandomForestRegressor(numTrees=100, maxDepth=15), models.PART_ROWS) == [100]
