"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for edges (u, v).

    Every round links each node to the smallest label among its neighbours and
    follows the label's own label, until nothing changes.  The rounds work on
    tables in the shared folder; only a count of changes reaches the driver.
    """
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "cc-edges")
    labels = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root"))
                    .select(F.col("u").alias("node"), "root"), "cc-labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("v"), "root"), "v")
                .groupBy("u").agg(F.min("root").alias("near")))
        hop = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = (labels.join(near.select(F.col("u").alias("node"), "near"), "node")
                .withColumn("low", F.least("root", "near")).withColumnRenamed("root", "old"))
        step = step.join(hop.withColumnRenamed("root", "low"), "low", "left")
        step = stored(step.select("node", "old", F.least("low", F.coalesce("far", "low")).alias("root")), "cc-labels")
        labels = step.select("node", "root")
        if step.where("root <> old").isEmpty():
            return labels
