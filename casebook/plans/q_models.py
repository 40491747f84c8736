"""Registered queries: models, scoring, attributions, counterfactuals.

The results of a trained forest cannot be restated in SQL: those queries are checked
by row counts and by property tests in ``tests/``.  Beside them the same code runs
over a small forest of constants on the whole case view; there the oracles restate
the trees as CASE expressions.  Candidates, split and code tables have oracles too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casebook.functions.filters import lookup
from casebook.ml import intent, models, scoring
from casebook.ml.features import LOS_FEATURES, RISK_FEATURES, split_flag, stratified_split
from casebook.ml.fixed import FixedForest
from casebook.operators import triage
from casebook.plans.catalog import ORACLE, register, with_cases
from casebook.plans.q_ops import TRIAGE_RULES, triage_sql
from casebook.plans.q_text import language_detect
from casebook.session import checkpoint_dir, stored
from casebook.sources.records import read_intents, write_intents
from casebook.sources.tables import case_view, read_table

_CACHE: dict = {}


def model_and_cases(spark, sf_dir: str, kind: str):
    """The model, trained once per session and data folder (training reads the whole table),
    and the case view.  Where the model is trained the view is computed once, into the shared
    folder, for the training, its metrics and the query."""
    k = (spark.sparkContext.applicationId, sf_dir, kind)
    cases = case_view(spark, sf_dir)
    if k not in _CACHE:
        for old in [x for x in _CACHE if x[:2] != k[:2]]:
            del _CACHE[old]  # bundles of another session or folder
        cases = stored(cases, "cases")
        b = models.train_risk_model(cases) if kind == "risk" else models.train_los_model(cases)
        _CACHE[k] = models.fill_training_meta(b, cases)
    return _CACHE[k], cases


def bundle(spark, sf_dir: str, kind: str) -> models.ModelBundle:
    return model_and_cases(spark, sf_dir, kind)[0]


@register("risk_scores")
def risk_scores(spark, sf_dir):
    return scoring.risk_scores(*model_and_cases(spark, sf_dir, "risk"))


@register("risk_report")
def risk_report(spark, sf_dir):
    return models.classifier_report(*model_and_cases(spark, sf_dir, "risk"))


@register("los_scores")
def los_scores(spark, sf_dir):
    return scoring.los_scores(*model_and_cases(spark, sf_dir, "los"), ["Patient_ID"])


@register("los_report")
def los_report(spark, sf_dir):
    return models.regression_report(*model_and_cases(spark, sf_dir, "los"))


@register("risk_attribution")
def risk_attribution(spark, sf_dir):
    return scoring.attribution_report(*model_and_cases(spark, sf_dir, "risk"), ["Patient_ID"])


@register("los_attribution")
def los_attribution(spark, sf_dir):
    return scoring.attribution_report(*model_and_cases(spark, sf_dir, "los"), ["Patient_ID"])


@register("triage_with_risk")
def triage_with_risk(spark, sf_dir):
    model, cases = model_and_cases(spark, sf_dir, "risk")
    t = scoring.triage_with_risk(model, triage.triage_flagged(cases, TRIAGE_RULES), limit=20)
    return t.withColumn("reasons", F.array_join("reasons", "; "))


def _requests(cases):
    return cases.select(F.col("Patient_ID").alias("request_id"), *RISK_FEATURES)


@register("counterfactual")
def counterfactual(spark, sf_dir):
    # Every complete case is a request (target 20%).
    model, cases = model_and_cases(spark, sf_dir, "risk")
    return scoring.counterfactuals(model, cases, _requests(cases), 0.20)


_OPTS_SQL = """opts AS (
  SELECT lower(Condition) AS condition_key, Procedure,
    row_number() OVER (PARTITION BY lower(Condition)
      ORDER BY count(*) FILTER (WHERE Readmission = 'Yes') / count(*), Procedure) AS rnk
  FROM cases WHERE Condition IS NOT NULL AND Procedure IS NOT NULL
  GROUP BY lower(Condition), Procedure HAVING count(Patient_ID) >= 5)"""


_CANDIDATES_SQL = f"""
WITH {_OPTS_SQL},
req AS (SELECT Patient_ID AS request_id, Age, Gender, Condition, Procedure, Length_of_Stay FROM cases),
d(delta, pos) AS (VALUES (-3, 1), (-2, 2), (-1, 3), (1, 4), (2, 5), (3, 6)),
l AS (SELECT req.*, Length_of_Stay + delta AS new_los, pos,
        row_number() OVER (PARTITION BY request_id ORDER BY pos) AS lrank
      FROM req CROSS JOIN d WHERE Length_of_Stay + delta BETWEEN 1 AND 30),
alt AS (SELECT req.*, opts.Procedure AS alt_proc, opts.rnk FROM req JOIN opts
        ON lower(req.Condition) = opts.condition_key WHERE opts.Procedure <> req.Procedure),
best AS (SELECT request_id, arg_min(alt_proc, rnk) AS best_proc FROM alt GROUP BY request_id)
SELECT request_id, 'length_of_stay' AS change_type, Age, Gender, Condition, Procedure,
  new_los AS Length_of_Stay, 1 AS type_order, CAST(pos AS int) AS option_order FROM l
UNION ALL
SELECT request_id, 'procedure', Age, Gender, Condition, alt_proc, Length_of_Stay, 2, CAST(rnk AS int) FROM alt
UNION ALL
SELECT l.request_id, 'combined', Age, Gender, Condition, best.best_proc, new_los, 3, CAST(pos AS int)
FROM l JOIN best ON l.request_id = best.request_id WHERE lrank <= 3"""


@register("counterfactual_candidates", with_cases(_CANDIDATES_SQL))
def counterfactual_candidates(spark, sf_dir):
    cases = case_view(spark, sf_dir)
    return scoring.counterfactual_candidates(cases, _requests(cases))


_RISK_CLEAN = " AND ".join(f"{c} IS NOT NULL" for c in [*RISK_FEATURES, "Readmission"])


@register("train_split_counts", with_cases(f"""
WITH h AS (SELECT Readmission, ('0x' || substr(md5(CAST(Patient_ID AS varchar)), 1, 8))::BIGINT AS hash
           FROM cases WHERE {_RISK_CLEAN}),
r AS (SELECT *, row_number() OVER (PARTITION BY Readmission ORDER BY hash) AS rn, count(*) OVER (PARTITION BY Readmission) AS n FROM h),
t AS (SELECT Readmission, max(hash) AS last FROM r WHERE rn <= greatest(1, round(n * 80 / 100.0)) GROUP BY Readmission)
SELECT CASE WHEN hash <= last THEN 'train' ELSE 'test' END AS split, Readmission, count(*) AS count
FROM h JOIN t USING (Readmission) GROUP BY ALL"""))
def train_split_counts(spark, sf_dir):
    clean = case_view(spark, sf_dir).na.drop(subset=[*RISK_FEATURES, "Readmission"])
    d = stratified_split(clean, "Readmission")
    return d.groupBy(F.when(F.col("_train"), "train").otherwise("test").alias("split"), "Readmission").count()


@register("risk_rejected", with_cases(f"""
SELECT Patient_ID, concat_ws(',', {", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in RISK_FEATURES)}) AS missing
FROM cases WHERE {" OR ".join(f"{c} IS NULL" for c in RISK_FEATURES)}"""))
def risk_rejected(spark, sf_dir):
    bad = scoring.rejected_requests(RISK_FOREST, case_view(spark, sf_dir))
    return bad.select("Patient_ID", F.array_join("missing", ",").alias("missing"))


# Forests of constants: (feature, threshold, left, right), leaves (value, cover).
CODES = {"Gender": ["F", "O"], "Condition": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
         "Procedure": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]}
RISK_FOREST = FixedForest("risk", list(RISK_FEATURES), CODES, [
    (4, 25, (0, 30, (0.125, 30), (0.5, 20)), (3, 2.5, (0.625, 25), (0.875, 25))),
    (2, 1.5, (4, 20, (0.25, 40), (0.75, 10)), (1, 0.5, (0.375, 25), (0.9375, 25)))])
LOS_FOREST = FixedForest("los", list(LOS_FEATURES), CODES, [
    (4, 200000, (0, 25, (30, 40), (35, 20)), (0, 35, (40, 25), (45, 15))),
    (3, 2.5, (2, 1.5, (33, 30), (37, 20)), (2, 2.5, (39, 30), (44, 20)))],
    {"model_version": "fixed", "target_mean": 36.0, "target_std": 12.0, "trained_on_n": 100, "test_mae": 1.25})

# The second tree splits the procedure and the condition by sets of codes.
SET_FOREST = FixedForest("los", list(LOS_FEATURES), CODES, [
    (4, 200000, (0, 25, (30, 40), (35, 20)), (0, 35, (40, 25), (45, 15))),
    (3, frozenset({0, 3, 5}), (2, frozenset({1, 4}), (33, 30), (37, 20)), (2, frozenset({0, 2}), (39, 30), (44, 20)))],
    {"model_version": "fixed", "target_mean": 36.0, "target_std": 12.0, "trained_on_n": 100, "test_mae": 1.25})

_CODED = ", ".join(f"greatest(coalesce(list_position({CODES[c]!r}, {c}), 0) - 1, 0) AS {c[0].lower()}c" for c in CODES)
_RISK_P = """((CASE WHEN Length_of_Stay <= 25 THEN CASE WHEN Age <= 30 THEN 0.125 ELSE 0.5 END
    ELSE CASE WHEN pc <= 2.5 THEN 0.625 ELSE 0.875 END END
  + CASE WHEN cc <= 1.5 THEN CASE WHEN Length_of_Stay <= 20 THEN 0.25 ELSE 0.75 END
    ELSE CASE WHEN gc <= 0.5 THEN 0.375 ELSE 0.9375 END END)::DOUBLE / 2)"""


def _complete(features) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in features)


_RISK_SQL = f"""
WITH x AS (SELECT *, {_CODED} FROM cases WHERE {_complete(RISK_FEATURES)}), s AS (SELECT *, {_RISK_P} AS p FROM x)
SELECT * EXCLUDE (gc, cc, pc, p), CASE WHEN p > 0.5 THEN 'Yes' ELSE 'No' END AS predicted_readmission,
  round_even(p, 4) AS probability_of_readmission, format('{{:.1f}}', round_even(p * 100, 1)) || '%' AS probability_of_readmission_pct
FROM s"""


@register("fixed_risk_scores", with_cases(_RISK_SQL))
def fixed_risk_scores(spark, sf_dir):
    return scoring.risk_scores(RISK_FOREST, case_view(spark, sf_dir))


_T1 = "CASE WHEN Cost <= 200000 THEN CASE WHEN Age <= 25 THEN 30.0 ELSE 35.0 END ELSE CASE WHEN Age <= 35 THEN 40.0 ELSE 45.0 END END::DOUBLE"
_T2 = "CASE WHEN pc <= 2.5 THEN CASE WHEN cc <= 1.5 THEN 33.0 ELSE 37.0 END ELSE CASE WHEN cc <= 2.5 THEN 39.0 ELSE 44.0 END END::DOUBLE"


def _los_sql(t2: str) -> str:
    return f"""
WITH x AS (SELECT *, {_CODED} FROM cases WHERE {_complete(LOS_FEATURES)}),
t AS (SELECT Patient_ID, {_T1} AS a, {t2} AS b FROM x),
s AS (SELECT Patient_ID, (a + b) / 2 AS p, sqrt(((a - (a + b) / 2) ^ 2 + (b - (a + b) / 2) ^ 2) / 2) AS s FROM t)
SELECT Patient_ID, round_even(p, 1) AS predicted_length_of_stay_days, round_even(greatest(1.0, p - 1.645::DOUBLE * s), 1) AS lower_bound_days,
  round_even(p + 1.645::DOUBLE * s, 1) AS upper_bound_days, 36.0::DOUBLE AS population_mean_days, 12.0::DOUBLE AS population_std_days,
  CASE WHEN p > 36 THEN 'above_average' ELSE 'below_average' END AS vs_population, 'fixed' AS model_version,
  100::BIGINT AS trained_on_n, 1.25::DOUBLE AS test_mae
FROM s"""


_LOS_SQL = _los_sql(_T2)
_T2_SET = ("CASE WHEN pc IN (0, 3, 5) THEN CASE WHEN cc IN (1, 4) THEN 33.0 ELSE 37.0 END "
           "ELSE CASE WHEN cc IN (0, 2) THEN 39.0 ELSE 44.0 END END::DOUBLE")


@register("fixed_set_scores", with_cases(_los_sql(_T2_SET)))
def fixed_set_scores(spark, sf_dir):
    return scoring.los_scores(SET_FOREST, case_view(spark, sf_dir), ["Patient_ID"])


@register("fixed_los_scores", with_cases(_LOS_SQL))
def fixed_los_scores(spark, sf_dir):
    return scoring.los_scores(LOS_FOREST, case_view(spark, sf_dir), ["Patient_ID"])


def _game(a: str, ab: str, root: tuple, kids: tuple, values: tuple, first: str, second: str) -> str:
    """Shapley values of a two-feature tree in SQL: E[root only], E[second only]."""
    (cl, cr), (l1, l2, r1, r2), (v1, v2, v3, v4) = root, kids, values
    n = cl + cr
    left = f"({v1} * {l1} + {v2} * {l2}) / {cl}"
    right = f"({v3} * {r1} + {v4} * {r2}) / {cr}"
    e0 = f"(({left}) * {cl} + ({right}) * {cr}) / {n}"
    ea = f"CASE WHEN {first} THEN {left} ELSE {right} END"
    eb = f"(CASE WHEN {second[0]} THEN {v1} ELSE {v2} END * {cl} + CASE WHEN {second[1]} THEN {v3} ELSE {v4} END * {cr}) / {n}"
    both = f"CASE WHEN {first} THEN CASE WHEN {second[0]} THEN {v1} ELSE {v2} END ELSE CASE WHEN {second[1]} THEN {v3} ELSE {v4} END END"
    return f"(0.5::DOUBLE * (({ea}) - ({e0}) + ({both}) - ({eb})))::DOUBLE AS {a}, (0.5::DOUBLE * (({eb}) - ({e0}) + ({both}) - ({ea})))::DOUBLE AS {ab}"


_G1 = _game("cost", "age", (60, 40), (40, 20, 25, 15), ("30.0::DOUBLE", "35.0::DOUBLE", "40.0::DOUBLE", "45.0::DOUBLE"),
            "v_cost <= 200000", ("v_age <= 25", "v_age <= 35"))
_G2 = _game("proc", "cond", (50, 50), (30, 20, 30, 20), ("33.0::DOUBLE", "37.0::DOUBLE", "39.0::DOUBLE", "44.0::DOUBLE"),
            "pc <= 2.5", ("cc <= 1.5", "cc <= 2.5"))
_BASE = "((30.0 * 40 + 35.0 * 20 + 40.0 * 25 + 45.0 * 15)::DOUBLE / 100 + (33.0 * 30 + 37.0 * 20 + 39.0 * 30 + 44.0 * 20)::DOUBLE / 100) / 2"


_G2_SET = _game("proc", "cond", (50, 50), (30, 20, 30, 20), ("33.0::DOUBLE", "37.0::DOUBLE", "39.0::DOUBLE", "44.0::DOUBLE"),
                "pc IN (0, 3, 5)", ("cc IN (1, 4)", "cc IN (0, 2)"))


def _attribution_sql(g2: str) -> str:
    return f"""
WITH x AS (SELECT Patient_ID, Age AS v_age, Cost AS v_cost, Gender, Condition, Procedure, {_CODED} FROM cases WHERE {_complete(LOS_FEATURES)}),
g AS (SELECT *, {_G1}, {g2} FROM x),
f AS (SELECT Patient_ID, unnest(['Age', 'Gender', 'Condition', 'Procedure', 'Cost']) AS feature,
        unnest([age / 2, 0.0::DOUBLE, cond / 2, proc / 2, cost / 2]) AS phi FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY Patient_ID ORDER BY abs(round(phi, 9)) DESC, feature) AS rank FROM f)
SELECT Patient_ID, CAST(rank AS int) AS rank, feature, round_even(phi, 4) + 0.0 AS shap_value,
  CASE WHEN round(phi, 9) > 0 THEN 'increases_los' ELSE 'decreases_los' END AS direction,
  round_even(abs(phi), 4) AS abs_importance, round_even({_BASE}, 4) AS base_value
FROM r"""


_ATTRIBUTION_SQL = _attribution_sql(_G2)


@register("fixed_set_attribution", with_cases(_attribution_sql(_G2_SET)))
def fixed_set_attribution(spark, sf_dir):
    a = scoring.attribution_report(SET_FOREST, case_view(spark, sf_dir), ["Patient_ID"]).drop("value")
    return a.withColumn("shap_value", F.col("shap_value") + F.lit(0.0))


@register("lookup_attribution", with_cases(f"SELECT * FROM ({_ATTRIBUTION_SQL}) WHERE Patient_ID IN (SELECT user_id FROM events)"))
def lookup_attribution(spark, sf_dir):
    """Record ids -> their records -> what drives each predicted stay."""
    ids = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("Patient_ID"))
    found = lookup(case_view(spark, sf_dir), patient_id=ids)
    a = scoring.attribution_report(LOS_FOREST, found, ["Patient_ID"]).drop("value")
    return a.withColumn("shap_value", F.col("shap_value") + F.lit(0.0))


@register("fixed_los_attribution", with_cases(_ATTRIBUTION_SQL))
def fixed_los_attribution(spark, sf_dir):
    a = scoring.attribution_report(LOS_FOREST, case_view(spark, sf_dir), ["Patient_ID"]).drop("value")
    return a.withColumn("shap_value", F.col("shap_value") + F.lit(0.0))


@register("fixed_triage_with_risk", with_cases(f"""
WITH f AS ({triage_sql(None).strip()}),
x AS (SELECT *, {_CODED} FROM f),
s AS (SELECT *, CASE WHEN {_complete(RISK_FEATURES)} THEN round_even({_RISK_P}, 4) END AS readmission_probability FROM x)
SELECT * EXCLUDE (gc, cc, pc) REPLACE (
  CASE WHEN coalesce(readmission_probability > 0.5, false) THEN score + 2.0 ELSE score END AS score,
  CASE WHEN coalesce(readmission_probability > 0.5, false)
    THEN reasons || '; High readmission risk (' || CAST(CAST(round_even(readmission_probability * 100, 0) AS int) AS varchar) || '%)'
    ELSE reasons END AS reasons)
FROM s ORDER BY score DESC, Patient_ID LIMIT 20"""))
def fixed_triage_with_risk(spark, sf_dir):
    flagged = triage.triage_flagged(case_view(spark, sf_dir), TRIAGE_RULES)
    t = scoring.triage_with_risk(RISK_FOREST, flagged, limit=20)
    return t.withColumn("reasons", F.array_join("reasons", "; "))


_CHANGES_SQL = f"""
WITH c AS ({_CANDIDATES_SQL.strip()}),
own AS (SELECT Patient_ID AS request_id, round_even({_RISK_P}, 4) AS current FROM (SELECT *, {_CODED} FROM cases WHERE {_complete(RISK_FEATURES)})),
n AS (SELECT request_id, type_order, option_order, change_type, Procedure, Length_of_Stay, round_even({_RISK_P}, 4) AS new
      FROM (SELECT *, {_CODED} FROM c WHERE {_complete(RISK_FEATURES)})),
k AS (SELECT n.*, own.current, row_number() OVER (PARTITION BY n.request_id
        ORDER BY round_even(own.current - n.new, 4) DESC, type_order, option_order) AS rank
      FROM n JOIN own ON n.request_id = own.request_id
      WHERE own.current > 0.2 AND (CASE WHEN type_order = 3 THEN n.new < own.current * 0.9::DOUBLE ELSE n.new < own.current END))"""


@register("fixed_counterfactual", with_cases(f"""{_CHANGES_SQL}
SELECT k.request_id, CAST(rank AS int) AS rank, change_type, r.Procedure AS from_procedure, k.Procedure,
  r.Length_of_Stay AS from_length_of_stay, k.Length_of_Stay, current AS current_probability, new AS estimated_probability,
  round_even(current - new, 4) AS probability_reduction, new <= 0.2 AS meets_target
FROM k JOIN cases r ON r.Patient_ID = k.request_id WHERE rank <= 10"""))
def fixed_counterfactual(spark, sf_dir):
    cases = case_view(spark, sf_dir)
    return scoring.counterfactuals(RISK_FOREST, cases, _requests(cases), 0.20).drop("description")


_SUMMARY_SQL = f"""{_CHANGES_SQL}
SELECT r.Patient_ID AS request_id, own.current AS current_probability, own.current IS NOT NULL AS scored,
  coalesce(own.current <= 0.2, false) AS already_at_target, count(k.rank) AS total_options_explored,
  count(k.rank) FILTER (WHERE k.rank <= 10) AS suggestions,
  coalesce(bool_or(k.rank <= 10 AND k.new <= 0.2), false) AS target_achievable
FROM cases r LEFT JOIN own ON own.request_id = r.Patient_ID LEFT JOIN k ON k.request_id = r.Patient_ID
GROUP BY ALL"""


@register("counterfactual_summary", with_cases(_SUMMARY_SQL))
def counterfactual_summary(spark, sf_dir):
    cases = case_view(spark, sf_dir)
    return scoring.counterfactual_summary(RISK_FOREST, cases, _requests(cases), 0.20)


@register("counterfactual_texts", with_cases(f"""
SELECT request_id, scored, target_achievable, printf('%.1f%%', round_even(current_probability * 100, 1)) AS current_probability_pct,
  '20.0%' AS target_probability_pct FROM ({_SUMMARY_SQL})"""))
def counterfactual_texts(spark, sf_dir):
    """The summary's probabilities as they are shown."""
    cases = case_view(spark, sf_dir)
    s = scoring.counterfactual_summary(RISK_FOREST, cases, _requests(cases), 0.20, texts=True)
    return s.select("request_id", "scored", "target_achievable", "current_probability_pct", "target_probability_pct")


@register("lookup_models", with_cases(f"""
SELECT c.Patient_ID, r.probability_of_readmission, l.predicted_length_of_stay_days, s.total_options_explored, s.target_achievable
FROM cases c LEFT JOIN ({_RISK_SQL}) r USING (Patient_ID) LEFT JOIN ({_LOS_SQL}) l USING (Patient_ID)
JOIN ({_SUMMARY_SQL}) s ON s.request_id = c.Patient_ID
WHERE c.Patient_ID IN (SELECT user_id FROM events)"""))
def lookup_models(spark, sf_dir):
    """Record ids -> their records -> risk, stay and counterfactual answers."""
    cases = case_view(spark, sf_dir)
    ids = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("Patient_ID"))
    found = lookup(cases, patient_id=ids)
    risk = scoring.risk_scores(RISK_FOREST, found).select("Patient_ID", "probability_of_readmission")
    stay = scoring.los_scores(LOS_FOREST, found, ["Patient_ID"]).select("Patient_ID", "predicted_length_of_stay_days")
    asked = found.select(F.col("Patient_ID").alias("request_id"), *RISK_FEATURES)
    answer = scoring.counterfactual_summary(RISK_FOREST, cases, asked, 0.20).select(
        F.col("request_id").alias("Patient_ID"), "total_options_explored", "target_achievable")
    return answer.join(risk, "Patient_ID", "left").join(stay, "Patient_ID", "left").select(
        "Patient_ID", "probability_of_readmission", "predicted_length_of_stay_days", "total_options_explored", "target_achievable")


def _codes_sql() -> str:
    clean = " AND ".join(f"{c} IS NOT NULL" for c in [*RISK_FEATURES, "Readmission"])
    parts = [f"""SELECT '{c}' AS "column", {c} AS value,
  CAST(row_number() OVER (ORDER BY {c}) - 1 AS int) AS code
FROM (SELECT DISTINCT {c} FROM cases WHERE {clean})""" for c in ("Gender", "Condition", "Procedure")]
    return with_cases("\nUNION ALL\n".join(parts))


@register("label_codes", _codes_sql())
def label_codes(spark, sf_dir):
    from casebook.ml.features import fit_label_encoder
    from casebook.ml.features import label_codes as codes
    clean = case_view(spark, sf_dir).na.drop(subset=[*RISK_FEATURES, "Readmission"])
    return codes(fit_label_encoder(clean), spark)


@register("feature_importances")
def feature_importances(spark, sf_dir):
    return models.feature_importances(bundle(spark, sf_dir, "risk"), spark)


@register("model_info")
def model_info(spark, sf_dir):
    path = f"{checkpoint_dir(spark).rstrip('/')}/casebook-models/{uuid.uuid4().hex}"
    b = bundle(spark, sf_dir, "los")
    models.save_bundle(b, path, spark)
    loaded = models.load_bundle(path, spark)
    assert loaded.kind == "los"
    return models.model_info(path, spark)


@register("intent_classify")
def intent_classify(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    train, _ = intent.split(emb, "vec_id")
    model = intent.train_vector_classifier(train)
    from pyspark.ml.functions import vector_to_array
    return intent.classify_vectors(model, emb.withColumn("train", split_flag("vec_id"))).select(
        "vec_id", "label", "train", F.col("prediction").cast("int").alias("predicted_label"),
        F.bround(F.array_max(vector_to_array("probability")), 4).alias("confidence"))


_SPLIT_SQL = f"""h AS (SELECT Patient_ID, Readmission, Length_of_Stay, {", ".join(RISK_FEATURES[:4])}, Cost,
    ('0x' || substr(md5(CAST(Patient_ID AS varchar)), 1, 8))::BIGINT AS hash FROM cases),
rl AS (SELECT *, row_number() OVER (PARTITION BY Readmission ORDER BY hash) AS rn, count(*) OVER (PARTITION BY Readmission) AS n
       FROM h WHERE {_RISK_CLEAN}),
rt AS (SELECT Readmission, max(hash) AS last FROM rl WHERE rn <= greatest(1, round(n * 80 / 100.0)) GROUP BY Readmission),
risk AS (SELECT rl.*, hash <= last AS train FROM rl JOIN rt USING (Readmission)),
los AS (SELECT *, hash < 4294967296 * 80 // 100 AS train FROM h WHERE {_complete(LOS_FEATURES)} AND Length_of_Stay IS NOT NULL)"""


@register("risk_report_supports", with_cases(f"""
WITH {_SPLIT_SQL}
SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS split, CASE WHEN Readmission = 'Yes' THEN 'Yes' ELSE 'No' END AS class, count(*) AS support
FROM risk GROUP BY ALL"""))
def risk_report_supports(spark, sf_dir):
    """M4: what the trained classifier's report says of the rows it is judged on."""
    return models.classifier_report(*model_and_cases(spark, sf_dir, "risk")).select("split", "class", "support")


@register("model_info_fields", with_cases(f"""
WITH {_SPLIT_SQL}
SELECT 'risk' AS kind, 'spark-rf-1' AS version, count(*) AS trained_on_n, '["Age","Gender","Condition","Procedure","Length_of_Stay"]' AS features,
  count(*) FILTER (WHERE Readmission = 'Yes') AS readmission_yes, count(*) FILTER (WHERE Readmission = 'No') AS readmission_no,
  CAST(NULL AS double) AS target_mean, CAST(NULL AS double) AS target_std FROM risk
UNION ALL
SELECT 'los', 'spark-rf-1', count(*), '["Age","Gender","Condition","Procedure","Cost"]', NULL, NULL,
  round_even(avg(Length_of_Stay), 4), round_even(stddev_samp(Length_of_Stay), 4) FROM los"""))
def model_info_fields(spark, sf_dir):
    """What the saved metadata of both models says of their data."""
    parts = []
    for kind in ("risk", "los"):
        path = f"{checkpoint_dir(spark).rstrip('/')}/casebook-models/{uuid.uuid4().hex}"
        models.save_bundle(bundle(spark, sf_dir, kind), path, spark)
        parts.append(models.model_info(path, spark).select(
            "kind", "version", "trained_on_n", "features", "readmission_yes", "readmission_no", "target_mean", "target_std"))
    return parts[0].unionByName(parts[1])


@register("risk_model_info")
def risk_model_info(spark, sf_dir):
    path = f"{checkpoint_dir(spark).rstrip('/')}/casebook-models/{uuid.uuid4().hex}"
    models.save_bundle(bundle(spark, sf_dir, "risk"), path, spark)
    return models.model_info(path, spark)


@register("loaded_model_scores", with_cases(f"""
SELECT Patient_ID, 0.0::DOUBLE AS difference, true AS same_class FROM cases WHERE {_complete(RISK_FEATURES)}"""))
def loaded_model_scores(spark, sf_dir):
    """Every complete case scored by the model and by its saved and loaded copy."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/casebook-models/{uuid.uuid4().hex}"
    b, cases = model_and_cases(spark, sf_dir, "risk")
    models.save_bundle(b, path, spark)
    cases = cases.na.drop(subset=list(RISK_FEATURES)).select("Patient_ID", *RISK_FEATURES)
    once = b.scored(cases).select("Patient_ID", *RISK_FEATURES, F.col("_p").alias("p"), F.col("_prediction").alias("c"))
    twice = models.load_bundle(path, spark).scored(once)
    return twice.select("Patient_ID", F.abs(F.col("_p") - F.col("p")).alias("difference"), (F.col("_prediction") == F.col("c")).alias("same_class"))


def _intent_corpus(spark, sf_dir):
    """The documents as (text, intent) JSON lines, the language as the intent."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/casebook-intents/{uuid.uuid4().hex}"
    write_intents(read_table(spark, sf_dir, "documents").select("text", F.col("lang").alias("intent")), path)
    return read_intents(spark, path)


@register("jsonl_roundtrip", """
SELECT md5(coalesce(text, '')) AS text_md5, length(text) AS chars, lang AS intent, count(*) AS n FROM documents GROUP BY ALL""")
def jsonl_roundtrip(spark, sf_dir):
    return _intent_corpus(spark, sf_dir).groupBy(
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("chars"), "intent").agg(
        F.count(F.lit(1)).alias("n"))


@register("text_classify")
def text_classify(spark, sf_dir):
    """Hashed n-grams and a multinomial model, trained on the rows of the JSON lines
    whose text hash is not divisible by 5, applied to every document."""
    corpus = _intent_corpus(spark, sf_dir)
    held_out = F.coalesce(F.pmod(F.xxhash64("text"), F.lit(5)) == 0, F.lit(True))
    model = intent.train_text_intents(corpus.where(~held_out), num_features=1 << 13, max_iter=40)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return intent.classify_texts(model, docs.withColumn("held_out", held_out)).drop("text")


@register("message_route", f"""
WITH l AS ({ORACLE["language_detect"]}),
r AS (SELECT conv_id, turn, CASE lang WHEN 'en' THEN 'hospital' WHEN 'fr' THEN 'greeting' ELSE 'unrelated' END AS predicted_intent FROM l)
SELECT conv_id, turn, predicted_intent,
  CASE predicted_intent WHEN 'hospital' THEN 'analyse' WHEN 'greeting' THEN 'welcome' ELSE 'not_understood' END AS route,
  CASE predicted_intent WHEN 'hospital' THEN NULL WHEN 'greeting' THEN '{intent.WELCOME}' ELSE '{intent.NOT_UNDERSTOOD.replace("'", "''")}' END AS reply
FROM r""")
def message_route(spark, sf_dir):
    """M12 over every user message.  The tables hold no intent-labelled text, so the intent
    is taken from the message's language: en asks, fr greets, the others are unrelated."""
    found = language_detect(spark, sf_dir)
    asked = found.withColumn("predicted_intent", F.when(F.col("lang") == "en", "hospital").when(F.col("lang") == "fr", "greeting").otherwise("unrelated"))
    return intent.with_routes(asked).drop("lang")
