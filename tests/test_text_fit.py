from pyspark.sql import functions as F

from casebook.ml import intent


def test_the_text_model_is_fitted_on_every_labelled_row(spark):
    """No label is lost, however rare and however many rows there are."""
    corpus = spark.range(25_000).select(F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 500 == 0, F.concat(F.lit("rare"), "id")).otherwise("often").alias("intent"))
    assert len(intent.train_text_intents(corpus, num_features=1 << 4, max_iter=1).labels) == 51
