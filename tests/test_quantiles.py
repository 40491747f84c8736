import numpy as np
from pyspark.sql import functions as F

from casebook.functions.quantiles import global_quantiles


def test_bucketed_path_is_exact(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(100, 30, 3000).round(2), np.full(1500, 42.0),  # a hot value
                           rng.exponential(500, 1500).round(3)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(5)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    got = global_quantiles(df, "x", qs).first()["q"]
    ref = df.agg(F.percentile("x", F.array(*[F.lit(q) for q in qs])).alias("p")).first()["p"]
    assert got == ref
    assert np.allclose(got, np.percentile(vals, [q * 100 for q in qs]), rtol=0, atol=1e-9)


def test_empty_and_single(spark):
    e = spark.createDataFrame([], "x double")
    assert global_quantiles(e, "x", [0.5]).first()["q"] == [None]
    one = spark.createDataFrame([(3.5,), (None,)], "x double")
    assert global_quantiles(one, "x", [0.1, 0.9]).first()["q"] == [3.5, 3.5]


def test_grouped_bucketed_is_exact(spark):
    from casebook.functions.quantiles import grouped_quantiles
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.normal(0, 1, 3000).round(3)] + [("hot", 7.0)] * 1500 + \
           [(f"g{i}", float(x)) for i in range(15) for x in rng.exponential(3, 25).round(2)] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    qs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in grouped_quantiles(df, ["g"], "x", qs).collect()}
    ref = {r["g"]: r["p"] for r in df.groupBy("g").agg(
        F.percentile("x", F.array(*[F.lit(q) for q in qs])).alias("p")).collect()}
    assert got == ref


def test_partitions_do_not_change_the_answer(spark):
    from casebook.functions.quantiles import quantile_table
    rng = np.random.default_rng(3)
    rows = [(None if i % 7 == 0 else f"g{i % 3}", float(x), int(x) % 11 if i % 5 else None)
            for i, x in enumerate(rng.normal(50, 20, 2000).round(1))] + [("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, k int")
    spec = {"x": [0.0, 0.01, 0.5, 0.505, 0.99, 1.0], "k": [0.1, 0.9]}
    ref = {r["g"]: r for r in df.groupBy("g").agg(*[
        F.percentile(c, F.array(*[F.lit(q) for q in qs])).alias(c) for c, qs in spec.items()]).collect()}
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = {r["g"]: r for r in quantile_table(df, spec, ["g"]).collect()}
            assert set(got) == set(ref)
            for g in ref:
                for c, qs in spec.items():
                    assert got[g][c] == (ref[g][c] if ref[g][c] is not None else [None] * len(qs))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_missed_rank_is_an_error(spark):
    """A table whose spans have a hole must not answer NULL."""
    import pytest

    from casebook.functions.quantiles import ValueCounts
    df = spark.createDataFrame([(float(i),) for i in range(9)], "x double")
    whole = ValueCounts.of(df, ["x"])
    with pytest.raises(Exception, match="no value of x"):
        ValueCounts.over(whole.table.where("x <> 4"), []).stats({"x": [0.5]}).collect()


def test_coarser_groups_add_up(spark):
    from casebook.functions.quantiles import ValueCounts
    df = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 5.0), ("b", "p", 3.0), (None, "p", 9.0), ("a", "p", None)], "g string, h string, x double")
    fine = ValueCounts.of(df, ["x"], ["g", "h"])
    assert fine.merged().stats({"x": [0.0, 0.5, 1.0]}).first()["x"] == [1.0, 4.0, 9.0]
    got = {r["g"]: r["x"] for r in fine.merged(["g"]).stats({"x": [0.5]}).collect()}
    assert got == {"a": [3.0], "b": [3.0], None: [9.0]}
