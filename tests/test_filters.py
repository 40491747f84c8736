import pytest

from casebook.functions.filters import (apply_where, ci_equals, equality_predicate, lookup,
                                        pattern_match, rule_predicate)


def ids(df):
    return sorted(r[0] for r in df.select("Patient_ID").collect())


def test_lookup_key_beats_criteria(tiny_cases):
    assert ids(lookup(tiny_cases, 3, {"Gender": "Female"})) == [3]


def test_lookup_zero_id_counts_as_absent(tiny_cases):
    assert ids(lookup(tiny_cases, 0, {"Condition": "Fracture"})) == [9, 11]
    with pytest.raises(ValueError):
        lookup(tiny_cases, 0, None)


def test_lookup_many_ids(tiny_cases, spark):
    req = spark.createDataFrame([(2,), (5,), (99999,)], "id long")
    assert ids(lookup(tiny_cases, req)) == [2, 5]


def test_strict_filter_unknown_field_and_null(tiny_cases):
    with pytest.raises(ValueError):
        equality_predicate(tiny_cases, {"Ward": 1}, strict=True)
    assert ids(lookup(tiny_cases, None, {"Gender": None})) == [6]
    with pytest.raises(ValueError):
        equality_predicate(tiny_cases, {"Age": "old"}, strict=True)


def test_lenient_filter(tiny_cases):
    assert ids(apply_where(tiny_cases, {"Condition": "Diabetes", "Ward": 3})) == [1, 2, 8]
    assert ids(apply_where(tiny_cases, {"Gender": None})) == []
    assert ids(apply_where(tiny_cases, {"Age": "sixty"})) == []
    assert len(ids(apply_where(tiny_cases, {}))) == 12


def test_pattern_and_case_insensitive(tiny_cases):
    assert ids(tiny_cases.where(pattern_match("Procedure", "SURG"))) == [5, 7, 11]
    assert ids(tiny_cases.where(pattern_match("Procedure", "^chemo|cast$"))) == [6, 9, 12]
    assert ids(tiny_cases.where(ci_equals("Condition", "heart disease"))) == [3, 4, 10]


@pytest.mark.parametrize("field,op,value,expected", [
    ("Length_of_Stay", ">", 9, [5, 10]),
    ("Length_of_Stay", ">=", 9, [3, 4, 5, 10]),
    ("Satisfaction", "<", 2, [3, 12]),
    ("Satisfaction", "<=", 2, [2, 3, 10, 12]),
    ("Readmission", "==", "Yes", [2, 3, 5, 10, 12]),
    ("Outcome", "!=", "Stable", [1, 4, 5, 7, 9, 11]),          # NULL never matches
    ("Condition", "in", ["Cancer", "Fracture"], [5, 6, 9, 11, 12]),
    ("Procedure", "in", "Heart Angioplasty Surgery", [3, 4, 5, 7, 11]),  # substring
    ("Cost", "~", 5, []),                                        # unknown operator
    ("Ward", ">", 1, []),                                        # unknown field
    ("Gender", ">", 5, []),                                      # type clash
    ("Gender", "!=", 5, [1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12]),   # clash: unequal types differ
    ("Age", "in", "60", []),                                     # number in string
])
def test_rule_predicate(tiny_cases, field, op, value, expected):
    assert ids(tiny_cases.where(rule_predicate(tiny_cases, field, op, value))) == expected


def test_boolean_literals_compare_as_numbers(spark, tiny_cases):
    from casebook.functions.filters import apply_where, equality_predicate, rule_predicate
    n = lambda p: tiny_cases.where(p).count()
    assert n(equality_predicate(tiny_cases, {"Satisfaction": True}, strict=True)) == 2
    assert apply_where(tiny_cases, {"Satisfaction": True}).count() == 2
    assert n(rule_predicate(tiny_cases, "Satisfaction", ">", True)) == 9
    assert n(rule_predicate(tiny_cases, "Satisfaction", "in", [True, 3])) == 4
    assert n(rule_predicate(tiny_cases, "Satisfaction", "!=", False)) == 11
