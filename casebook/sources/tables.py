"""Readers for the driver's parquet tables and the case view over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# Explicit schemas of the tables behind the case view: no inference job per scan.
SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; column pruning and filter pushdown reach this scan."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def case_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case record per order, in the casebook schema (FIXTURES.md section 2).

    lineitem is joined to part and pre-aggregated per order (partial aggregation
    before the shuffle), orders are joined to customer, and the per-order line
    summary is left-joined so orders without lines keep NULL line fields.  All
    joins are equi-joins; the planner/AQE chooses broadcast only for sides whose
    runtime size is under ``spark.sql.autoBroadcastJoinThreshold``.

    The least procedure name and line status of an order are taken as least numbers
    (the name's rank among the distinct part types, the status's character code):
    numbers are aggregated by hash, strings would be sorted first.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")

    # The distinct part types, numbered in order (a fixed vocabulary).
    types = part.agg(F.array_sort(F.collect_set("p_type")).alias("_types")).select(
        F.posexplode("_types").alias("_rank", "_type"))
    ranked = part.join(types, part.p_type == types["_type"], "left").select("p_partkey", "p_size", "_rank")
    lines = (li.join(ranked, li.l_partkey == ranked.p_partkey)
             .groupBy(F.col("l_orderkey").alias("_k"))
             .agg(F.max("p_size").alias("_age"),
                  F.min(F.ascii("l_linestatus")).alias("_status"),
                  F.min("_rank").alias("_rank"),
                  F.max("l_quantity").cast("int").alias("_los"),
                  F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("_rd"))
             .join(types, "_rank", "left")
             .select("_k", "_age", "_los", "_rd", F.char("_status").alias("_gender"), F.col("_type").alias("_proc")))

    base = orders.join(cust, orders.o_custkey == cust.c_custkey)
    joined = base.join(lines, base.o_orderkey == lines._k, "left")
    return joined.select(
        F.col("o_orderkey").alias("Patient_ID"),
        F.col("_age").alias("Age"),
        F.col("_gender").alias("Gender"),
        F.col("c_mktsegment").alias("Condition"),
        F.col("_proc").alias("Procedure"),
        F.col("o_totalprice").alias("Cost"),
        F.col("_los").alias("Length_of_Stay"),
        F.when(F.col("_rd") == 1, "Yes").when(F.col("_rd") == 0, "No").alias("Readmission"),
        F.when(F.col("o_orderstatus") == "F", "Recovered").otherwise("Stable").alias("Outcome"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("Satisfaction"),
    )


# The same view as SQL text, for DuckDB oracles (a CTE named ``cases``).
CASES_CTE = """cases AS (
  WITH li AS (
    SELECT l.l_orderkey AS k, max(p.p_size) AS age, min(l.l_linestatus) AS gender,
           min(p.p_type) AS proc, CAST(max(l.l_quantity) AS int) AS los,
           max(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS rd
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey)
  SELECT o.o_orderkey AS Patient_ID, li.age AS Age, li.gender AS Gender,
         c.c_mktsegment AS Condition, li.proc AS Procedure, o.o_totalprice AS Cost,
         li.los AS Length_of_Stay,
         CASE WHEN li.rd = 1 THEN 'Yes' WHEN li.rd = 0 THEN 'No' END AS Readmission,
         CASE WHEN o.o_orderstatus = 'F' THEN 'Recovered' ELSE 'Stable' END AS Outcome,
         CAST(substr(o.o_orderpriority, 1, 1) AS int) AS Satisfaction
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN li ON li.k = o.o_orderkey)"""
