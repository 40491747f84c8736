import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.ml import grow, models


def some_cases(spark, n):
    """The stay follows age, procedure and cost; a sixth of the rows come twice but for their id."""
    i = F.when(F.col("id") % 6 == 0, F.col("id") - F.col("id") % 12).otherwise(F.col("id"))
    h = F.pmod(F.xxhash64(i), F.lit(1 << 20))
    return spark.range(0, n, 1, 3).select(
        F.col("id").alias("Patient_ID"), (h % 60).cast("int").alias("Age"), F.when(h % 2 == 0, "F").otherwise("O").alias("Gender"),
        F.concat(F.lit("c"), h % 3).alias("Condition"), F.concat(F.lit("p"), F.shiftright(h, 5) % 4).alias("Procedure"), (h % 9973).cast("double").alias("Cost"),
        (F.when(h % 60 < 20, 3).otherwise(9) + F.when(F.shiftright(h, 5) % 4 == 2, 8).otherwise(0) + F.when(h % 9973 > 5000, 1).otherwise(0)).cast("int").alias("Length_of_Stay"),
        F.when((h % 60 < 20) != (F.shiftright(h, 9) % 16 == 0), "Yes").otherwise("No").alias("Readmission"))


def rules(bins, arity, **other):
    return grow.Rules(**{"cuts": [[] if a >= 0 else [i + 0.5 for i in range(b - 1)] for b, a in zip(bins, arity)], "arity": arity, "tried": len(bins),
                         "depth": 4, "least": 2, "seed": 1, "classes": False} | other)


def test_draws_are_poisson_and_the_same_in_every_pass():
    ids = np.arange(200_000)
    for n in (1, 3, 31, 32, 100):
        w = grow.drawn(ids, np.full(len(ids), n, np.int32), 5, 42)
        assert abs(w.mean() / n - 1) < 0.01 and abs(w.var() / n - 1) < 0.02
        back = grow.drawn(ids[::-1][:1000], np.full(1000, n, np.int32), 5, 42)
        assert np.array_equal(back, w[::-1][:1000])
    one = np.ones(len(ids), np.int32)
    a, b = (grow.drawn(ids, one, t, 42) for t in (0, 1))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01 and abs((a == 0).mean() - np.exp(-1)) < 0.005


def test_the_best_split_is_that_of_all_splits():
    """Against every threshold and every set of labels."""
    rng = np.random.default_rng(3)
    for arity in ([-1, 5], [-1, -1]):
        r = rules([7, 5], arity)
        codes = np.stack([rng.integers(0, 7, 60), rng.integers(0, 5, 60)], axis=1)
        y, w = rng.integers(0, 9, 60).astype(float), rng.poisson(1, 60).astype(float)
        sums = grow.histograms(codes, np.zeros(60, np.int64), 1, w, w * y, r.bins)
        (feature,), (left,), (gain,) = grow.best_splits(sums, np.array([(w * y * y).sum()]), r, rng)

        def took(j, bins):
            here = np.isin(codes[:, j], bins)
            if min(w[here].sum(), w[~here].sum()) < 2:
                return -1.0
            return sum((w * y)[s].sum() ** 2 / w[s].sum() for s in (here, ~here)) - (w * y).sum() ** 2 / w.sum()
        every = [(0, list(range(i))) for i in range(1, 7)] + ([(1, list(range(i))) for i in range(1, 5)] if arity[1] < 0 else
                                                             [(1, [b for b in range(5) if s >> b & 1]) for s in range(1, 31)])
        assert np.isclose(gain, max(took(j, b) for j, b in every)) and np.isclose(gain, took(feature, np.flatnonzero(left)))


def test_a_pure_or_small_node_is_a_leaf():
    r = rules([3, 2], [-1, -1])
    pure = grow.grown(np.array([[0, 0], [1, 1], [2, 0]] * 5, np.uint8), np.full(15, 0.1), np.ones(15), 1, r, 0)
    assert len(pure) == 1 and pure[0][1].tolist() == [-1]
    small = grow.grown(np.array([[0, 0], [1, 1], [2, 0]], np.uint8), np.arange(3.0), np.ones(3), 1, r, 0)
    assert len(small) == 1 and small[0][1].tolist() == [-1]


def trees(spark, nodes):
    return {(r["treeID"], r["id"]): r for r in nodes.collect()}


@pytest.mark.parametrize("classes", [False, True])
def test_groups_and_passes_give_the_same_trees(spark, monkeypatch, classes):
    """Trees grown whole by a task, split by passes down to small groups, and by passes alone, several to a level."""
    cases = some_cases(spark, 3000).withColumn("label", F.when(F.col("Readmission") == "Yes", 1.0).otherwise(0.0) if classes else F.col("Length_of_Stay").cast("double"))
    coded = cases.select("Age", (F.col("Procedure").substr(2, 1).cast("double")).alias("p"), "Cost", "label").withColumn("Age", F.col("Age").cast("double"))
    r = grow.Rules([grow.thresholds(coded, "Age", 32), [], grow.thresholds(coded, "Cost", 32)], [-1, 4, -1], 3, 4, 2, 42, classes)
    rows = grow.binned(coded, ["Age", "p", "Cost"], r, 3)
    assert rows.agg(F.sum("_n")).first()[0] == 3000 > rows.count()
    whole = trees(spark, grow.grow(rows, 3, r))
    monkeypatch.setattr(grow, "GROUP_ROWS", 300)
    monkeypatch.setattr(grow, "BLOCK_ROWS", 500)
    monkeypatch.setattr(grow, "LEVEL_CELLS", 500)
    some = trees(spark, grow.grow(rows, 3, r))
    monkeypatch.setattr(grow, "GROUP_ROWS", 0)
    assert whole == some == trees(spark, grow.grow(rows, 3, r)) and len({t for t, _ in whole}) == 3 and len(whole) > 20


@pytest.mark.parametrize("kind", ["los", "risk"])
def test_a_grown_forest_predicts_as_well_as_spark_ml_s(spark, monkeypatch, kind):
    cases = some_cases(spark, 4000)
    train = models.train_los_model if kind == "los" else models.train_risk_model
    small = models.fill_training_meta(train(cases, num_trees=10, max_depth=6), cases)
    monkeypatch.setattr(models, "PART_ROWS", 1000)
    monkeypatch.setattr(models, "FIT_ROWS", 1000)
    large = models.fill_training_meta(train(cases, num_trees=10, max_depth=6), cases)
    assert large.meta["fitted_on_n"] == small.meta["fitted_on_n"] == models.labelled(large, cases).where("_train").count()
    if kind == "los":
        assert large.meta["test_r2"] > small.meta["test_r2"] - 0.02 > 0.9
    else:
        assert large.meta["test_accuracy"] > small.meta["test_accuracy"] - 0.02 > 0.85
    a, b = ({r["feature"]: r["importance"] for r in models.feature_importances(x, spark).collect()} for x in (small, large))
    assert max(a, key=a.get) == max(b, key=b.get) and abs(sum(b.values()) - 1) < 1e-9
    # Spark ML reads the trees: every row's prediction is that of its own model.
    x = models._cast_features(cases, large.features)
    p = large.pipeline.transform(x).select("Patient_ID", F.col("prediction").alias("p"))
    q = large.scored(x).select("Patient_ID", F.col("_prediction").alias("q"))
    assert p.join(q, "Patient_ID").where(F.abs(F.col("p") - F.col("q")) > 1e-9).isEmpty()


def test_the_risk_model_is_fitted_on_every_training_row(spark, monkeypatch):
    cases = some_cases(spark, 70_000)
    b = models.train_risk_model(cases, num_trees=2, max_depth=2)
    want = models.labelled(b, cases).where("_train").count()
    ff = b.flat(spark)
    assert want > 50_000 and b.meta["fitted_on_n"] == want
    assert all(abs(ff.cover[root] / want - 1) < 0.05 for root in ff.roots)
