from pyspark.sql import functions as F

from casebook.llm import quality

SF = "/root/testdata/sf0.01"


def test_the_ratio_finds_low_quality_but_not_toxic_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ratio = quality.fit_ratio(quality.with_trust(docs, labels), F.col("trusted"))
    judged = quality.judge(docs, ratio).join(labels.select("doc_id", "quality", "toxic"), "doc_id")
    low, toxic = F.col("quality") == 0, (F.col("quality") == 1) & (F.col("toxic") == 1)
    r = judged.agg(*[F.count_if(c & k).alias(n) for c, a in ((low, "low"), (toxic, "toxic"))
                     for k, n in ((F.lit(True), a), (~F.col("kept"), f"{a}_gone"))]).first()
    assert r.low and r.low_gone >= 0.9 * r.low
    assert r.toxic and r.toxic_gone <= 0.2 * r.toxic  # a known limit, stated in the README
