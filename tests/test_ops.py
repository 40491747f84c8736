import math

import numpy as np
import pytest

from casebook.operators import anomaly, charts, similar, triage
from tests.conftest import pdf


# ---------------------------------------------------------------- charts

def test_metric_and_group_resolution(tiny_cases):
    assert charts.resolve_metric("LOS")[0] == "Length_of_Stay"
    assert charts.resolve_group(tiny_cases, "medical_condition") == "Condition"
    with pytest.raises(ValueError):
        charts.resolve_metric("xyz")
    with pytest.raises(ValueError):
        charts.chart_data(tiny_cases, "scatter", "cost")
    with pytest.raises(ValueError):
        charts.resolve_group(tiny_cases, "ward")


def test_bar_rate_all_row_denominator(tiny_cases):
    b = {r["Condition"]: r["value"] for r in charts.bar_data(tiny_cases, "condition", "readmission_rate").collect()}
    assert b["Heart Disease"] == pytest.approx(200 / 3)
    assert b["Diabetes"] == pytest.approx(100 / 3)


def test_pie_shares_sum_to_100(tiny_cases):
    p = pdf(charts.pie_data(tiny_cases, "procedure", "admissions"))
    assert len(p) <= 8 and math.isclose(p.share_pct.sum(), 100.0)
    with pytest.raises(ValueError):
        charts.pie_data(tiny_cases, "procedure", "recovery_rate")


def test_histogram_counts_and_numpy_bins(small_cases):
    h = pdf(charts.histogram_data(small_cases, "Cost"), "bin")
    vals = np.array([r[0] for r in small_cases.select("Cost").dropna().collect()])
    counts, edges = np.histogram(vals, bins=20)
    assert list(h["count"]) == list(counts)
    assert np.allclose(h.bin_start, edges[:-1])
    with pytest.raises(ValueError):
        charts.histogram_data(small_cases, "Gender")


def test_histogram_constant_column(one_case):
    h = pdf(charts.histogram_data(one_case, "Cost"), "bin")
    counts, edges = np.histogram(np.array([1000.0]), bins=20)
    assert list(h["count"]) == list(counts) and np.allclose(h.bin_start, edges[:-1])


def test_boxplot_whiskers(small_cases):
    b = pdf(charts.boxplot_data(small_cases, "condition", "cost"))
    p = small_cases.select("Condition", "Cost").toPandas().dropna()
    for _, row in b.iterrows():
        v = p[p.Condition == row.Condition].Cost
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert row.whisker_low == v[v >= lo].min() and row.whisker_high == v[v <= hi].max()
        assert row.outliers == ((v < lo) | (v > hi)).sum()


# ---------------------------------------------------------------- triage

def test_default_triage(tiny_cases):
    q = {r["Patient_ID"]: r for r in triage.triage_queue(tiny_cases, limit=20).collect()}
    assert q[3]["score"] == 2.0 + 1.5 + 2.5 + 3.0 + 1.0
    assert q[3]["reasons"] == ["Extended stay (>7 days)", "High cost case", "Low satisfaction",
                               "Previous readmission", "Non-recovered outcome"]
    assert 9 not in q  # nothing matches
    scores = [r["score"] for r in triage.triage_queue(tiny_cases, limit=5).collect()]
    assert scores == sorted(scores, reverse=True) and len(scores) == 5


def test_rule_without_description(tiny_cases):
    rules = [{"field": "Age", "operator": ">=", "value": 66, "score": 1.25}]
    q = triage.triage_queue(tiny_cases, rules).collect()
    assert [r["Patient_ID"] for r in q] == [6, 10]
    assert q[0]["reasons"] == ["Age >= 66 (actual: 72)"] and q[0]["score"] == 1.25


def test_triage_totals(tiny_cases):
    t = triage.triage_totals(tiny_cases, limit=3).first()
    assert t["total_flagged"] == 7 and t["returned"] == 3 and t["rules_applied"] == 5


# ---------------------------------------------------------------- anomalies

def test_zscore_matches_numpy(small_cases):
    z = pdf(anomaly.zscore_outliers(small_cases, ["Cost", "Length_of_Stay", "Gender"], 2.0))
    p = small_cases.toPandas()
    for c in ["Cost", "Length_of_Stay"]:
        v = p[c].dropna()
        zz = ((v - v.mean()) / v.std(ddof=0)).abs()
        assert sorted(p.loc[zz[zz > 2.0].index, "Patient_ID"]) == sorted(z[z.column == c].Patient_ID)
    assert set(z.column) <= {"Cost", "Length_of_Stay"}


def test_zscore_constant_column(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(10)], "Patient_ID long, v double")
    assert anomaly.zscore_outliers(df, ["v"], 0.0).count() == 0


def test_rare_combinations(tiny_cases):
    r = pdf(anomaly.rare_combinations(tiny_cases, threshold=0.1))
    # 10 complete rows; combinations seen once have frequency 0.1 (not < 0.1).
    assert len(r) == 0
    r = pdf(anomaly.rare_combinations(tiny_cases, threshold=0.15))
    assert set(r.frequency) == {0.1} and r.reason.iloc[0] == "Very low frequency combination (< 15.00%)"


# ---------------------------------------------------------------- similar cases

def brute_force(p, target, n):
    feats = ["Age", "Gender", "Condition", "Procedure"]
    q = p.dropna(subset=feats).copy()
    ages = np.append(q.Age.to_numpy(float), float(target["Age"]))
    sd = ages.std() or 1.0
    cols = []
    for c in ["Gender", "Condition", "Procedure"]:
        cats = sorted(set(q[c]) | {target[c]})
        m = np.array([[1.0 if v == k else 0.0 for k in cats] for v in list(q[c]) + [target[c]]])
        cols.append(m)
    z = ((ages - ages.mean()) / sd)[:, None]
    X = np.hstack([z, *cols])
    d = np.linalg.norm(X[:-1] - X[-1], axis=1)
    q["distance"] = d
    return q.sort_values(["distance", "Patient_ID"]).head(n)


def test_similar_matches_one_hot_brute_force(spark, small_cases):
    p = small_cases.toPandas()
    targets = [
        {"target_id": 1, "Age": 20, "Gender": "F", "Condition": "BUILDING", "Procedure": "PROMO"},
        {"target_id": 2, "Age": 45, "Gender": "O", "Condition": "UNSEEN", "Procedure": "LARGE"},
    ]
    t = spark.createDataFrame(targets)
    got = pdf(similar.similar_cases(small_cases, t, n=7), ["target_id", "rank"])
    for tg in targets:
        exp = brute_force(p, tg, 7)
        g = got[got.target_id == tg["target_id"]]
        assert list(g.Patient_ID) == list(exp.Patient_ID)
        assert np.allclose(g.distance, exp.distance.round(6), atol=1e-6)


def test_similar_equal_record_distance_zero(spark, tiny_cases):
    t = spark.createDataFrame([(99, 60, "Male", "Heart Disease", "Angioplasty")],
                              "target_id long, Age int, Gender string, Condition string, Procedure string")
    r = similar.similar_cases(tiny_cases, t, n=1).first()
    assert r["Patient_ID"] == 3 and r["distance"] == 0.0
    with pytest.raises(ValueError):
        similar.similar_cases(tiny_cases, t.drop("Age"), n=1)
