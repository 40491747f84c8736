from pyspark.sql import functions as F

from casebook.ml import models
from casebook.ml.features import stratified_split


def some_cases(spark, n, parts):
    return spark.range(0, n, 1, parts).select(
        F.col("id").alias("Patient_ID"), (F.col("id") % 60).cast("int").alias("Age"),
        F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("Gender"), F.concat(F.lit("c"), F.col("id") % 3).alias("Condition"),
        F.concat(F.lit("p"), F.col("id") % 4).alias("Procedure"), (F.col("id") % 97).cast("double").alias("Cost"),
        (F.col("id") % 11).cast("int").alias("Length_of_Stay"), F.when(F.col("id") % 5 < 2, "Yes").otherwise("No").alias("Readmission"))


def counted(spark, cases):
    """``cases`` with a count of how often its rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return cases.mapInArrow(run, cases.schema), seen


def test_a_fit_has_no_more_partitions_than_cores(spark):
    cases = some_cases(spark, 1000, 40).withColumn("label", F.lit(0.0))
    rows, n = models._fit_rows(cases, ["Age", "Gender"], "Patient_ID")
    assert n == 1000 and rows.rdd.getNumPartitions() == 1 and rows.count() == 1000
    many = some_cases(spark, 90_000, 40).withColumn("label", F.lit(0.0))
    rows, n = models._fit_rows(many, ["Age", "Gender"], "Patient_ID")
    assert n == 90_000 and rows.count() == 90_000
    assert 1 < rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_training_reads_the_cases_once(spark):
    for train in (models.train_risk_model, models.train_los_model):
        cases, seen = counted(spark, some_cases(spark, 600, 3))
        train(cases, num_trees=2, max_depth=2)
        assert seen.value == 600


def test_metrics_read_the_cases_once(spark):
    for train in (models.train_risk_model, models.train_los_model):
        bundle = train(some_cases(spark, 600, 3), num_trees=2, max_depth=2)
        cases, seen = counted(spark, some_cases(spark, 600, 3))
        models.fill_training_meta(bundle, cases)
        assert seen.value == 600 and bundle.meta["trained_on_n"] == 600


def test_a_split_reads_its_input_once(spark):
    rows, seen = counted(spark, some_cases(spark, 600, 3))
    assert stratified_split(rows, "Readmission").where("_train").count() == 480 and seen.value == 600


def test_statistics_of_a_pass_fit_beside_each_other():
    # four running tasks of an executor, twice each (kept and sent), within a third of 3 GB
    assert models.TRAIN_OPTS["maxMemoryInMB"] * 4 * 2 <= 1024


def test_a_report_scores_each_distinct_row_once(spark, monkeypatch):
    cases = some_cases(spark, 600, 3)
    few = cases.withColumns({c: F.lit(1) for c in ("Age", "Length_of_Stay")})
    bundle = models.train_risk_model(few, num_trees=2, max_depth=2)
    scored, sizes = models.ModelBundle.scored, []

    def watched(self, df):
        sizes.append(df.count())
        return scored(self, df)
    monkeypatch.setattr(models.ModelBundle, "scored", watched)
    report = models.classifier_report(bundle, few).collect()
    assert sum(r["support"] for r in report) == 600 and sizes[0] <= 2 * 3 * 4 * 2 * 2
    rows = scored(bundle, models.labelled(bundle, few)).collect()
    for r in report:
        mine = [x for x in rows if x["_train"] == (r["split"] == "train")]
        assert r["accuracy"] == sum(x["_prediction"] == x["label"] for x in mine) / len(mine)
