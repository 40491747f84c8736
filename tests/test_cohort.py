import math

import pandas as pd
import pytest

from casebook.operators import cohort
from tests.conftest import CASE_ROWS, pdf

COLS = ["Patient_ID", "Age", "Gender", "Condition", "Procedure", "Cost", "Length_of_Stay",
        "Readmission", "Outcome", "Satisfaction"]


@pytest.fixture(scope="module")
def ref():
    return pd.DataFrame(CASE_ROWS, columns=COLS)


def test_kpi_matches_pandas(tiny_cases, ref):
    k = cohort.kpi_overview(tiny_cases).first().asDict()
    assert k["n"] == 12
    assert k["avg_cost"] == round(ref.Cost.mean(), 2)
    assert k["median_cost"] == round(ref.Cost.median(), 2)
    assert k["median_length_of_stay"] == round(ref.Length_of_Stay.median(), 2)
    r = ref.Readmission.dropna()
    assert k["readmission_rate"] == round((r == "Yes").sum() / len(r) * 100, 2)
    o = ref.Outcome.dropna()
    assert k["recovery_rate"] == round((o == "Recovered").sum() / len(o) * 100, 2)
    assert k["low_satisfaction_count"] == int((ref.Satisfaction.dropna() <= 2).sum())


def test_kpi_empty_and_filtered(tiny_cases, empty_cases):
    assert cohort.kpi_overview(empty_cases).count() == 0
    assert cohort.kpi_overview(tiny_cases, where={"Condition": "Nope"}).count() == 0
    k = cohort.kpi_overview(tiny_cases, where={"Condition": "Fracture"}).first()
    assert k["n"] == 2 and k["avg_length_of_stay"] == 2.5


def test_los_benchmark(tiny_cases, ref):
    b = pdf(cohort.los_benchmark(tiny_cases, "Condition"))
    gp90 = ref.Length_of_Stay.quantile(0.9)
    exp = ref.dropna(subset=["Condition"]).groupby("Condition")["Length_of_Stay"]
    for _, row in b.iterrows():
        g = exp.get_group(row.Condition)
        assert row.n == len(g)
        assert row["mean"] == round(g.mean(), 2)
        assert row.p75 == round(g.quantile(0.75), 2)
        assert row.long_stay_count == int((g > gp90).sum())
        assert row.exceeds_global_p90 == (round(g.quantile(0.5), 2) > gp90)
    assert list(b["mean"]) == sorted(b["mean"], reverse=True)
    with pytest.raises(ValueError):
        cohort.los_benchmark(tiny_cases, "Age")


def test_cohorts_min_n_and_std(tiny_cases, one_case):
    c = pdf(cohort.satisfaction_cohorts(tiny_cases, ["Condition"], min_n=3))
    assert set(c.Condition) == {"Diabetes", "Heart Disease", "Cancer"}
    one = cohort.satisfaction_cohorts(one_case, ["Condition"], min_n=1).first()
    assert one["std"] is None and one["n"] == 1


def test_correlations_constant_and_support(spark, tiny_cases):
    from casebook.schema import CASE_SCHEMA
    rows = [(i, 40, "M", "C", "P", 100.0, i % 5, "No", "Stable", (i * 7) % 5 + 1) for i in range(20)]
    df = spark.createDataFrame(rows, CASE_SCHEMA)
    c = {r["variable"]: r for r in cohort.satisfaction_correlations(df).collect()}
    assert c["Age"]["correlation"] is None and c["Age"]["interpretation"] == "weak/none"
    assert c["Cost"]["correlation"] is None
    assert c["Length_of_Stay"]["correlation"] is not None
    # tiny_cases: Age and Cost have 10 complete pairs (not > 10), stay has 11.
    got = [r["variable"] for r in cohort.satisfaction_correlations(tiny_cases).collect()]
    assert got == ["Length_of_Stay"]


def test_contrasts_need_both_levels(tiny_cases):
    c = {r["factor"]: r for r in cohort.satisfaction_contrasts(tiny_cases).collect()}
    assert set(c) == {"Outcome", "Readmission"}
    only = cohort.satisfaction_contrasts(tiny_cases, where={"Outcome": "Stable"}).collect()
    assert [r["factor"] for r in only] == ["Readmission"]


def test_overall(tiny_cases, ref):
    o = cohort.satisfaction_overall(tiny_cases).first()
    s = ref.Satisfaction.dropna()
    assert o["mean"] == round(s.mean(), 2) and o["std"] == round(s.std(), 2)
    assert o["low_satisfaction_pct"] == round((s <= 2).sum() / len(s) * 100, 2)


def test_record_summary_bands_monotone(small_cases):
    s = pdf(cohort.record_summary(small_cases))
    order = ["low", "below_median", "above_median", "high", "very_high"]
    s = s.dropna(subset=["Cost"])
    s["b"] = s.cost_band.map(order.index)
    assert (s.sort_values("Cost").b.diff().dropna() >= 0).all()
    assert (s.is_high_cost == (s.b >= 3)).all()


def test_record_summary_subset_uses_whole_table_cuts(tiny_cases):
    full = {r["Patient_ID"]: r["cost_band"] for r in cohort.record_summary(tiny_cases).collect()}
    part = {r["Patient_ID"]: r["cost_band"] for r in cohort.record_summary(tiny_cases, ids=[3, 9]).collect()}
    assert part == {3: full[3], 9: full[9]}


def test_treatment_comparison(tiny_cases):
    t = {r["pattern"]: r for r in cohort.compare_treatments(
        tiny_cases, "cancer", ["surg", "chemo", "xyz", "surg"]).collect()}
    assert set(t) == {"surg", "chemo", "xyz"}
    assert t["surg"]["total_cases"] == 1 and t["surg"]["success_rate"] == 100.0
    assert t["chemo"]["total_cases"] == 2 and t["chemo"]["success_rate"] == 0.0
    assert t["xyz"]["no_data"] and t["xyz"]["total_cases"] == 0
    with pytest.raises(ValueError):
        cohort.compare_treatments(tiny_cases, "cancer", [])


def test_procedure_options_rate_all_rows(tiny_cases):
    p = pdf(cohort.procedure_options(tiny_cases, "heart disease", min_count=1))
    a = p[p.Procedure == "Angioplasty"].iloc[0]
    assert a["count"] == 2 and math.isclose(a.readmission_rate, 0.5)
    assert list(p.sort_values("rank").readmission_rate) == sorted(p.readmission_rate)


def test_combination_frequency_excludes_nulls(tiny_cases, ref):
    f = pdf(cohort.combination_frequency(tiny_cases))
    complete = ref.dropna(subset=["Condition", "Procedure", "Outcome"])
    assert f["count"].sum() == len(complete)
    assert math.isclose(f.frequency.sum(), 1.0)
