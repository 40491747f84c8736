import pytest

from casebook.operators import treatments
from casebook.operators.cohort import compare_treatments


def requests(spark, rows):
    return spark.createDataFrame(rows, "condition string, pattern string")


def test_requests_equal_the_list_form(spark, small_cases):
    asked = [("build", "prom"), ("build", "econ"), ("BUILD|mach", "an"), ("", "s"), ("house", "nosuch"), ("build", "prom")]
    found = treatments.compare_treatment_requests(small_cases, requests(spark, asked))
    got = {(r["condition"], r["pattern"]): tuple(r)[2:] for r in found.collect()}
    assert len(got) == 5 == found.count()
    for condition, pattern in asked:
        assert got[(condition, pattern)] == tuple(compare_treatments(small_cases, condition, [pattern]).first())[1:]


def test_null_and_unmatched_requests_stay(spark, tiny_cases):
    found = treatments.compare_treatment_requests(tiny_cases, requests(spark, [(None, "x"), ("diab", None), ("diab", "nosuch"), ("diab", "insulin")]), texts=True)
    got = {(r["condition"], r["pattern"]): r for r in found.collect()}
    assert len(got) == 4
    for key in ((None, "x"), ("diab", None), ("diab", "nosuch")):
        assert got[key]["no_data"] and got[key]["total_cases"] == 0 and got[key]["success_rate_text"] is None
    hit = got[("diab", "insulin")]
    assert (hit["total_cases"], hit["success_rate"], hit["success_rate_text"], hit["average_cost_text"]) == (2, 50.0, "50.00%", "$1500.00")


def test_dictionary_in_slices(spark, small_cases):
    values, patterns = small_cases.select("Procedure"), requests(spark, [("a", "prom"), ("a", "an"), ("a", "(?-i)prom")]).select("pattern")
    whole = sorted(tuple(r) for r in treatments.pattern_hits(values, patterns).collect())
    assert whole and whole == sorted(tuple(r) for r in treatments.pattern_hits(values, patterns, slice_rows=2).collect())


def test_bad_pattern_is_an_error(spark, tiny_cases):
    with pytest.raises(Exception, match="(?i)regex|pattern"):
        treatments.compare_treatment_requests(tiny_cases, requests(spark, [("diab", "(")])).collect()


def test_no_loop_over_case_rows(spark, small_cases):
    """Nested loops have the dictionary on one side and the patterns on the other."""
    found = treatments.compare_treatment_requests(small_cases, requests(spark, [("build", "prom")]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_requests(spark, tiny_cases):
    assert treatments.compare_treatment_requests(tiny_cases, requests(spark, [])).collect() == []
