import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from casebook.ml import forest, intent, models, scoring
from casebook.ml.features import RISK_FEATURES, split_flag


@pytest.fixture(scope="module")
def risk(small_cases):
    return models.fill_training_meta(models.train_risk_model(small_cases, num_trees=8, max_depth=4),
                                     small_cases)


@pytest.fixture(scope="module")
def los(small_cases):
    return models.fill_training_meta(models.train_los_model(small_cases, num_trees=8, max_depth=5),
                                     small_cases)


def _inputs(bundle, df):
    x = bundle.numeric_inputs(df.na.drop(subset=bundle.features))
    cols = bundle.model_columns()
    return x, cols


def test_label_codes_alphabetical_unseen_zero(spark, risk):
    codes = {(r["column"], r["value"]): r["code"] for r in
             __import__("casebook.ml.features", fromlist=["x"]).label_codes(risk.encoder, spark).collect()}
    for col in ("Gender", "Condition", "Procedure"):
        vals = sorted(v for (c, v) in codes if c == col)
        assert [codes[(col, v)] for v in vals] == list(range(len(vals)))
    req = spark.createDataFrame([(1, 30.0, "Q", "NEWCOND", "NEWPROC", 5.0)],
                                "id long, Age double, Gender string, Condition string, Procedure string, "
                                "Length_of_Stay double")
    x = risk.numeric_inputs(req).first()
    assert x["Gender_code"] == 0.0 and x["Condition_code"] == 0.0


def test_split_is_deterministic(small_cases):
    a = small_cases.select("Patient_ID", split_flag().alias("f")).collect()
    b = small_cases.repartition(7).select("Patient_ID", split_flag().alias("f")).collect()
    assert dict(map(tuple, a)) == dict(map(tuple, b))
    share = np.mean([r["f"] for r in a])
    assert 0.7 < share < 0.9


def test_tree_walk_equals_spark(spark, risk, los, small_cases):
    for b, col in ((risk, "probability"), (los, "prediction")):
        x, cols = _inputs(b, small_cases)
        p = b.pipeline.stages[2].transform(x)
        p = b.forest.transform(p)
        out = p.select(*cols, (vector_to_array(col)[1] if col == "probability" else F.col(col)).alias("y")
                       ).toPandas()
        ff = forest.flatten_forest(b.forest, spark)
        mine = forest.tree_values(ff, out[cols].to_numpy(float)).mean(axis=1)
        assert np.allclose(mine, out.y, atol=1e-9)


def test_shapley_additivity_and_symmetry(spark, risk, small_cases):
    x, cols = _inputs(risk, small_cases)
    X = x.select(*cols).limit(25).toPandas().to_numpy(float)
    ff = forest.flatten_forest(risk.forest, spark)
    game = forest.Game(ff)
    phi = game.shapley(X)
    pred = forest.tree_values(ff, X).mean(axis=1)
    assert np.allclose(game.base + phi.sum(axis=1), pred, atol=1e-9)
    # base value = expected prediction under the training cover
    assert 0.0 <= game.base <= 1.0


def test_attribution_report(spark, risk, small_cases):
    req = small_cases.limit(5)
    a = scoring.attribution_report(risk, req, ["Patient_ID"]).toPandas()
    assert a.groupby("Patient_ID")["rank"].max().max() <= 5
    assert set(a.direction) <= {"increases_risk", "decreases_risk"}
    for _, g in a.groupby("Patient_ID"):
        assert list(g.sort_values("rank").abs_importance) == sorted(g.abs_importance, reverse=True)


def test_los_range(los, small_cases):
    s = scoring.los_scores(los, small_cases, ["Patient_ID"], los.meta["target_mean"]).toPandas()
    assert (s.lower_bound_days <= s.predicted_length_of_stay_days + 1e-9).all()
    assert (s.predicted_length_of_stay_days <= s.upper_bound_days + 1e-9).all()
    assert (s.lower_bound_days >= 1.0).all()


def test_reports(risk, los, small_cases):
    r = risk.meta
    assert 0 <= r["train_accuracy"] <= 1 and r["trained_on_n"] > 0
    rep = models.classifier_report(risk, small_cases).toPandas()
    assert set(rep["class"]) == {"Yes", "No"} and set(rep.split) == {"train", "test"}
    g = models.regression_report(los, small_cases).toPandas()
    assert (g.mae <= g.rmse + 1e-9).all()


def test_save_load_info(spark, los, tmp_path):
    path = str(tmp_path / "m")
    models.save_bundle(los, path, spark)
    back = models.load_bundle(path, spark)
    assert back.kind == "los" and back.features == los.features
    info = models.model_info(path, spark).first()
    assert info["kind"] == "los" and info["trained_on_n"] == los.meta["trained_on_n"]


def test_risk_scores_and_triage_with_risk(spark, risk, small_cases):
    from casebook.operators import triage
    s = scoring.risk_scores(risk, small_cases).toPandas()
    assert s.probability_of_readmission.between(0, 1).all()
    flagged = triage.triage_flagged(small_cases, None)
    t = scoring.triage_with_risk(risk, flagged, limit=10).toPandas()
    assert len(t) == 10 and list(t.score) == sorted(t.score, reverse=True)
    hi = t[t.readmission_probability > 0.5]
    assert all(r[-1].startswith("High readmission risk (") for r in hi.reasons)


def test_counterfactuals(spark, risk, small_cases):
    req = small_cases.select(F.col("Patient_ID").alias("request_id"), *RISK_FEATURES)
    c = scoring.counterfactuals(risk, small_cases, req, 0.2).toPandas()
    assert (c.probability_reduction > 0).all()
    assert (c.estimated_probability < c.current_probability).all()
    assert (c.current_probability > 0.2).all()
    for _, g in c.groupby("request_id"):
        g = g.sort_values("rank")
        assert len(g) <= 10 and list(g.probability_reduction) == sorted(g.probability_reduction, reverse=True)
    s = scoring.counterfactual_summary(risk, small_cases, req, 0.2).toPandas().set_index("request_id")
    assert len(s) == req.count()
    for k, g in c.groupby("request_id"):
        assert s.suggestions[k] == len(g) <= s.total_options_explored[k]
        assert s.target_achievable[k] == g.meets_target.any()
    silent = s.drop(index=c.request_id.unique())
    assert (silent.suggestions == 0).all() and not silent.target_achievable.any()
    assert scoring.rejected_requests(risk, req).count() == (~s.scored).sum() > 0
    comb = c[c.change_type == "combined"]
    assert (comb.estimated_probability < comb.current_probability * 0.9).all()
    with pytest.raises(ValueError):
        scoring.counterfactuals(risk, small_cases, req, 1.5)


def test_text_intents_and_routing(spark):
    corpus = spark.createDataFrame(
        [("hi there", "greeting"), ("hello", "greeting"), ("good morning", "greeting"),
         ("hey", "greeting"), ("show average cost by condition", "hospital"),
         ("how many patients were readmitted", "hospital"), ("length of stay for diabetes", "hospital"),
         ("patient record 5", "hospital"), ("what is the weather", "unrelated"),
         ("tell me a joke", "unrelated"), ("who won the football match", "unrelated")],
        "text string, intent string")
    m = intent.train_text_intents(corpus)
    msgs = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "x"),
                                  (1, 2, "user", "average cost of patients by condition")],
                                 "conv_id long, turn long, role string, text string")
    r = {x["turn"]: x for x in intent.route_messages(m, msgs).collect()}
    assert set(r) == {0, 2}
    assert r[0]["route"] == "welcome" and r[0]["reply"] == intent.WELCOME
    assert r[2]["route"] == "analyse" and r[2]["reply"] is None


def test_vector_intents(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    train, test = intent.split(emb, "vec_id")
    m = intent.train_vector_classifier(train, max_iter=50)
    out = intent.classify_vectors(m, test)
    assert out.count() == test.count()


def test_stratified_split_keeps_every_label_at_80_percent(spark, small_cases):
    from casebook.ml.features import stratified_split
    d = small_cases.na.drop(subset=["Readmission"])
    a = stratified_split(d, "Readmission")
    counts = {(r["Readmission"], r["_train"]): r["count"] for r in a.groupBy("Readmission", "_train").count().collect()}
    for label in ("Yes", "No"):
        n = counts[label, True] + counts[label, False]
        assert abs(counts[label, True] - round(0.8 * n)) <= 1
    b = stratified_split(d.repartition(7), "Readmission")
    assert sorted(a.select("Patient_ID", "_train").collect()) == sorted(b.select("Patient_ID", "_train").collect())
    tiny = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "Patient_ID long, label string")
    assert stratified_split(tiny, "label").count() == 3


TREES = [(0, 1.0, (1, 2.0, (1.0, 3), (5.0, 2)), (0, 3.0, (2.0, 4), (9.0, 1))), (2, 0.5, (4.0, 5), (1, 1.0, (7.0, 2), (3.0, 3)))]
SETS = [(2, frozenset({0, 2, 5}), (0, 1.5, (1.0, 4), (3.0, 2)), (2, frozenset({1, 4, 0}), (8.0, 3), (6.0, 5))),
        (1, 2.0, (2, frozenset({3}), (2.0, 1), (4.0, 6)), (2, frozenset({0, 1, 2, 3, 4, 5}), (5.0, 4), (7.0, 0)))]


@pytest.mark.parametrize("trees", [TREES, SETS, TREES[:1] + SETS])
def test_shapley_equals_the_definition(trees):
    """Threshold and set splits, one block of the grid and many."""
    import itertools
    import math

    from casebook.ml.fixed import flat_forest
    if trees is not TREES and trees is not SETS:
        trees = [trees[0], (1, 0.5, (0, 2.0, (1.0, 1), (2.0, 2)), (2, frozenset({4, 1}), (3.0, 3), (9.0, 4)))]
    ff = flat_forest(trees, 3, codes=6)
    rng = np.random.default_rng(0)
    X = rng.uniform(0, 4, (40, 3))
    if trees is not TREES:
        X[:, 2] = rng.integers(0, 6, 40)

    def goes_left(x, t):
        return x in t if isinstance(t, frozenset) else x <= t

    def expect(tree, x, known):
        if len(tree) == 2:
            return tree[0]
        f, t, a, b = tree
        if f in known:
            return expect(a if goes_left(x[f], t) else b, x, known)
        cover = lambda n: n[1] if len(n) == 2 else cover(n[2]) + cover(n[3])
        return (expect(a, x, known) * cover(a) + expect(b, x, known) * cover(b)) / (cover(a) + cover(b))

    want = np.zeros((40, 3))
    for i, x in enumerate(X):
        value = {s: sum(expect(t, x, s) for t in trees) / len(trees) for r in range(4) for s in map(frozenset, itertools.combinations(range(3), r))}
        for j in range(3):
            for s, v in value.items():
                if j not in s:
                    w = math.factorial(len(s)) * math.factorial(2 - len(s)) / 6
                    want[i, j] += w * (value[s | {j}] - v)
    for cells in (forest.TABLE_CELLS, 40, 1):
        game = forest.Game(ff, cells)
        assert np.allclose(game.shapley(X), want) and (game.blocks > 1) == (cells < 1000)
    assert np.allclose(forest.tree_values(ff, X).mean(1), game.base + want.sum(1))


def test_forests_split_categories_by_sets(spark, small_cases):
    """A target that no order of the codes explains: one set split does."""
    rows = [(i, 40, "F", c, "P", 10.0, 9 if c in ("a", "c", "e") else 2) for i in range(120) for c in ["abcde"[i % 5]]]
    cases = spark.createDataFrame(rows, "Patient_ID long, Age int, Gender string, Condition string, Procedure string, Cost double, Length_of_Stay int")
    b = models.train_los_model(cases, num_trees=5, max_depth=1)
    ff = b.flat(spark)
    assert (ff.set_row >= 0).any() and set(ff.feature[ff.set_row >= 0].tolist()) == {2}
    scored = b.scored(models._cast_features(cases, b.features)).select("Length_of_Stay", "_prediction").toPandas()
    assert np.allclose(scored.Length_of_Stay, scored._prediction)
    ordered = models.train_los_model(cases, num_trees=5, max_depth=1, nominal=False)
    assert (ordered.flat(spark).set_row < 0).all()
    # Labels beyond the bins stay ordered instead of failing the fit.
    assert (models.train_los_model(cases, num_trees=2, max_depth=1, max_bins=4).flat(spark).set_row < 0).all()


def test_requests_keep_their_own_columns(spark, risk, tiny_cases):
    s = scoring.risk_scores(risk, tiny_cases)
    assert [f.dataType for f in s.schema.fields][:len(tiny_cases.columns)] == [f.dataType for f in tiny_cases.schema.fields]
    bad = scoring.rejected_requests(risk, tiny_cases)
    assert s.count() + bad.count() == tiny_cases.count() and bad.count() > 0


def test_stay_forest_is_fitted_on_every_training_row(spark):
    n = 30_000
    cases = spark.range(n).select(
        F.col("id").alias("Patient_ID"), (F.col("id") % 80).cast("int").alias("Age"), F.lit("F").alias("Gender"),
        F.lit("Flu").alias("Condition"), F.lit("Rest").alias("Procedure"), (F.col("id") % 977).cast("double").alias("Cost"),
        (F.col("id") % 9 + 1).cast("int").alias("Length_of_Stay"),
        F.when(F.col("id") % 3 == 0, "Yes").otherwise("No").alias("Readmission"))
    b = models.train_los_model(cases, num_trees=1, max_depth=2)
    want = models.labelled(b, cases).where("_train").count()
    ff = b.flat(spark)
    # A tree sees a bootstrap sample: as many rows as the fit has, give or take a few standard deviations.
    assert want > 20_000 and want == b.meta["fitted_on_n"] and abs(ff.cover[ff.roots[0]] / want - 1) < 0.05
    bounded = models.train_risk_model(cases, num_trees=1, max_depth=2, max_rows=5_000)
    ff = bounded.flat(spark)
    assert bounded.meta["fitted_on_n"] < 6_000 and abs(ff.cover[ff.roots[0]] / bounded.meta["fitted_on_n"] - 1) < 0.1
    assert models.fill_training_meta(bounded, cases).meta["trained_on_n"] == n


def test_hashed_ngrams_are_words_and_grams(spark):
    df = spark.createDataFrame([(1, "Ab ab"), (2, None), (3, ""), (4, "xy")], "id int, text string")
    from pyspark.ml.functions import vector_to_array
    got = {r["id"]: sum(r["v"]) for r in intent.hashed_ngrams(df, num_features=64).select("id", vector_to_array("features").alias("v")).collect()}
    assert got == {1: 2 + 3, 2: 0, 3: 0, 4: 1}


def test_text_model_on_held_out_documents(spark, tmp_path):
    """JSON lines in, a model of hashed n-grams, the languages of texts it has not seen; the
    saved model answers as the one in memory."""
    from casebook.sources.records import read_intents, write_intents
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = str(tmp_path / "corpus")
    write_intents(docs.select("text", F.col("lang").alias("intent")), path)
    corpus = read_intents(spark, path)
    assert corpus.count() == docs.count()
    held = F.pmod(F.xxhash64("text"), F.lit(3)) == 0
    m = intent.train_text_intents(corpus.where(~held), num_features=1 << 12, max_iter=25)
    out = intent.classify_texts(m, corpus)
    assert out.where(held).agg(F.avg((F.col("intent") == F.col("predicted_intent")).cast("double"))).first()[0] > 0.9
    m.save(str(tmp_path / "model"), spark)
    again = intent.classify_texts(intent.TextIntents.load(str(tmp_path / "model"), spark), corpus)
    assert out.exceptAll(again).count() == 0 and again.count() == docs.count()
    with pytest.raises(ValueError, match="no labelled text"):
        intent.train_text_intents(corpus.where("intent IS NULL"))


def test_a_saved_forest_scores_as_before(spark, risk, los, small_cases, tmp_path):
    for b in (risk, los):
        path = str(tmp_path / b.kind)
        models.save_bundle(b, path, spark)
        loaded = models.load_bundle(path, spark)
        rows = models._cast_features(small_cases.na.drop(subset=b.features), b.features)
        once, twice = (x.scored(rows).select("Patient_ID", "_prediction") for x in (b, loaded))
        assert once.exceptAll(twice).count() == 0 and once.count() > 0
        assert loaded.features == b.features and loaded.meta["num_trees"] == b.meta["num_trees"]
