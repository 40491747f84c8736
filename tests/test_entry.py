import __spark_entry__ as E
from casebook.operators import similar, triage
from casebook.sources.tables import case_view
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["Condition", "n"]
    assert df.count() > 0


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 50


def test_case_view_plan_has_no_cartesian(spark):
    p = plan(case_view(spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_topk_is_take_ordered(spark):
    q = triage.triage_queue(case_view(spark, SF_SMALL), limit=20)
    assert "TakeOrderedAndProject" in plan(q)


def test_similar_uses_group_limit(spark):
    cases = case_view(spark, SF_SMALL)
    t = cases.limit(3).select(cases.Patient_ID.alias("target_id"), "Age", "Gender", "Condition", "Procedure")
    q = similar.similar_cases(cases, t, n=5)
    q.explain()
    txt = q._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in txt
    assert "CartesianProduct" not in plan(q)


def test_scans_are_pruned(spark):
    # Only the columns the view needs are read from lineitem.
    p = plan(case_view(spark, SF_SMALL))
    li = [line for line in p.splitlines() if "lineitem" in line and "ReadSchema" in line]
    assert li and all("l_shipdate" not in line and "l_extendedprice" not in line for line in li)


def test_checkpoint_dir_comes_from_session(spark):
    from casebook.session import checkpoint_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    d = checkpoint_dir(spark)
    if configured:
        assert configured.rstrip("/") in d
    assert spark.sparkContext.getCheckpointDir()
