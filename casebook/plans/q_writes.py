"""Registered queries: CSV import, validated inserts, keyed updates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.operators import writes
from casebook.plans.catalog import register, with_cases
from casebook.schema import VALUE_COLUMNS
from casebook.session import checkpoint_dir
from casebook.sources.records import append_records, read_records_csv, scan_records
from casebook.sources.store import RecordStore
from casebook.sources.tables import case_view, read_table

_V = ", ".join(VALUE_COLUMNS)


def _imported(spark, sf_dir):
    """The case rows exported as CSV to the shared folder and read back.

    ``seq`` (the source row's key) keeps the file order explicit."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/casebook-csv/{uuid.uuid4().hex}"
    src = case_view(spark, sf_dir).select(F.col("Patient_ID").alias("seq"), *VALUE_COLUMNS)
    src.write.mode("overwrite").option("header", True).csv(path)
    return _read_back(spark, path)


def _imported_with_bad_lines(spark, sf_dir):
    """The import plus, for every 100th case, a line with a surplus field."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/casebook-csv/{uuid.uuid4().hex}"
    src = case_view(spark, sf_dir).select(F.col("Patient_ID").alias("seq"), *VALUE_COLUMNS)
    src.write.option("header", True).csv(path)
    bad = src.where("seq % 100 = 0").select((-1 - F.col("seq")).alias("seq"), *VALUE_COLUMNS, F.lit("surplus").alias("more"))
    bad.write.mode("append").option("header", True).csv(path)
    return _read_back(spark, path)


def _read_back(spark, path):
    return read_records_csv(spark, path, [T.StructField("seq", T.LongType(), True)])


@register("csv_import", with_cases(f"SELECT Patient_ID AS seq, {_V} FROM cases"))
def csv_import(spark, sf_dir):
    return _imported(spark, sf_dir).drop("_corrupt_record")


_ALL_SET = " AND ".join(f"{c} IS NOT NULL" for c in VALUE_COLUMNS)
_ANY_NULL = " OR ".join(f"{c} IS NULL" for c in VALUE_COLUMNS)


@register("insert_accepted", with_cases(f"""
WITH b AS (SELECT Patient_ID AS seq, {_V} FROM cases)
SELECT (SELECT max(Patient_ID) FROM cases) + row_number() OVER (ORDER BY seq) AS Patient_ID, seq, {_V}
FROM b WHERE {_ALL_SET}"""))
def insert_accepted(spark, sf_dir):
    store = case_view(spark, sf_dir)
    batch = _imported_with_bad_lines(spark, sf_dir)
    _, accepted, _ = writes.insert_records(store, batch, ["seq"])
    return accepted.select("Patient_ID", "seq", *VALUE_COLUMNS)


@register("insert_rejected", with_cases(f"""
SELECT Patient_ID AS seq, concat_ws(',', {", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in VALUE_COLUMNS)}) AS missing,
  false AS bad_line
FROM cases WHERE {_ANY_NULL}
UNION ALL
SELECT -1 - Patient_ID, concat_ws(',', {", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in VALUE_COLUMNS)}), true
FROM cases WHERE Patient_ID % 100 = 0"""))
def insert_rejected(spark, sf_dir):
    _, rejected = writes.validate_inserts(_imported_with_bad_lines(spark, sf_dir))
    return rejected.select("seq", F.array_join("missing", ",").alias("missing"),
                           F.col("_corrupt_record").isNotNull().alias("bad_line"))


def update_requests(spark, sf_dir):
    """A keyed update batch derived from ``events``: each event updates the case
    whose key is 120 times the event's user id, in event-id order (some keys are
    beyond the table).  The event type picks the field; ``error`` events set Outcome
    to NULL explicitly; ``signup`` events also name a field that does not exist."""
    e = read_table(spark, sf_dir, "events")
    et, v = F.col("event_type"), F.col("value")
    none = F.lit(None)
    return e.select(
        (F.col("user_id") * 120).alias("Patient_ID"), F.col("event_id").alias("seq"),
        F.when(et == "view", F.array(F.lit("Satisfaction")))
         .when(et == "purchase", F.array(F.lit("Cost")))
         .when(et == "click", F.array(F.lit("Length_of_Stay")))
         .when(et == "error", F.array(F.lit("Outcome")))
         .when(et == "signup", F.array(F.lit("Readmission"), F.lit("Ward")))
         .otherwise(F.array().cast("array<string>")).alias("set_fields"),
        none.cast("int").alias("Age"), none.cast("string").alias("Gender"),
        none.cast("string").alias("Condition"), none.cast("string").alias("Procedure"),
        F.when(et == "purchase", v).alias("Cost"),
        F.when(et == "click", (F.floor(v).cast("int") % 50) + 1).alias("Length_of_Stay"),
        F.when(et == "signup", F.lit("No")).alias("Readmission"),
        none.cast("string").alias("Outcome"),
        F.when(et == "view", (F.floor(v).cast("int") % 5) + 1).alias("Satisfaction"),
    )


_UPD_CTE = """u AS (SELECT user_id * 120 AS Patient_ID, event_id AS seq, event_type, value FROM events),
f AS (SELECT Patient_ID, count(*) AS n_updates,
  arg_max({'v': CAST(CAST(floor(value) AS int) % 5 + 1 AS int)}, seq) FILTER (WHERE event_type = 'view') AS s_sat,
  arg_max({'v': value}, seq) FILTER (WHERE event_type = 'purchase') AS s_cost,
  arg_max({'v': CAST(CAST(floor(value) AS int) % 50 + 1 AS int)}, seq) FILTER (WHERE event_type = 'click') AS s_los,
  arg_max({'v': CAST(NULL AS varchar)}, seq) FILTER (WHERE event_type = 'error') AS s_out,
  arg_max({'v': 'No'}, seq) FILTER (WHERE event_type = 'signup') AS s_re
  FROM u GROUP BY Patient_ID)"""


@register("update_applied", with_cases(f"""
WITH {_UPD_CTE}
SELECT c.Patient_ID, c.Age, c.Gender, c.Condition, c.Procedure,
  CASE WHEN f.s_cost IS NOT NULL THEN f.s_cost.v ELSE c.Cost END AS Cost,
  CASE WHEN f.s_los IS NOT NULL THEN f.s_los.v ELSE c.Length_of_Stay END AS Length_of_Stay,
  CASE WHEN f.s_re IS NOT NULL THEN f.s_re.v ELSE c.Readmission END AS Readmission,
  CASE WHEN f.s_out IS NOT NULL THEN f.s_out.v ELSE c.Outcome END AS Outcome,
  CASE WHEN f.s_sat IS NOT NULL THEN f.s_sat.v ELSE c.Satisfaction END AS Satisfaction
FROM cases c LEFT JOIN f ON c.Patient_ID = f.Patient_ID"""))
def update_applied(spark, sf_dir):
    updated, _ = writes.apply_updates(case_view(spark, sf_dir), update_requests(spark, sf_dir))
    return updated


@register("update_unmatched", with_cases(f"""
WITH {_UPD_CTE}
SELECT Patient_ID, n_updates FROM f WHERE Patient_ID NOT IN (SELECT Patient_ID FROM cases)"""))
def update_unmatched(spark, sf_dir):
    _, unmatched = writes.apply_updates(case_view(spark, sf_dir), update_requests(spark, sf_dir))
    return unmatched


@register("update_rejected", """
SELECT user_id * 120 AS Patient_ID, event_id AS seq, 'Ward' AS unknown FROM events WHERE event_type = 'signup'""")
def update_rejected(spark, sf_dir):
    bad = writes.rejected_updates(update_requests(spark, sf_dir))
    return bad.withColumn("unknown", F.array_join("unknown", ","))


@register("insert_store", with_cases(f"""
WITH b AS (SELECT Patient_ID AS seq, {_V} FROM cases)
SELECT * FROM cases
UNION ALL
SELECT (SELECT max(Patient_ID) FROM cases) + row_number() OVER (ORDER BY seq) AS Patient_ID, {_V}
FROM b WHERE {_ALL_SET}"""))
def insert_store(spark, sf_dir):
    """S1 + S3 + S4: the store is written to the shared folder, the accepted
    batch is appended to it, and the store is scanned back with the schema."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/casebook-store/{uuid.uuid4().hex}"
    store = case_view(spark, sf_dir)
    append_records(store, path)
    batch = _imported(spark, sf_dir)
    _, accepted, _ = writes.insert_records(scan_records(spark, path), batch, ["seq"])
    append_records(accepted.select(*store.columns), path)
    return scan_records(spark, path)


@register("update_store", with_cases(f"""
WITH b AS (SELECT Patient_ID AS seq, {_V} FROM cases),
grown AS (SELECT Patient_ID, {_V} FROM cases UNION ALL
  SELECT (SELECT max(Patient_ID) FROM cases) + row_number() OVER (ORDER BY seq) AS Patient_ID, {_V} FROM b WHERE {_ALL_SET}),
{_UPD_CTE}
SELECT c.Patient_ID, c.Age, c.Gender, c.Condition, c.Procedure,
  CASE WHEN f.s_cost IS NOT NULL THEN f.s_cost.v ELSE c.Cost END AS Cost,
  CASE WHEN f.s_los IS NOT NULL THEN f.s_los.v ELSE c.Length_of_Stay END AS Length_of_Stay,
  CASE WHEN f.s_re IS NOT NULL THEN f.s_re.v ELSE c.Readmission END AS Readmission,
  CASE WHEN f.s_out IS NOT NULL THEN f.s_out.v ELSE c.Outcome END AS Outcome,
  CASE WHEN f.s_sat IS NOT NULL THEN f.s_sat.v ELSE c.Satisfaction END AS Satisfaction
FROM grown c LEFT JOIN f ON c.Patient_ID = f.Patient_ID"""))
def update_store(spark, sf_dir):
    """S1 + S3 + S4 + S5 through the versioned store: created, grown by a batch, updated
    file by file, and read back."""
    store = RecordStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/casebook-records/{uuid.uuid4().hex}")
    store.create(case_view(spark, sf_dir))
    store.insert(_imported(spark, sf_dir), ["seq"])
    store.update(update_requests(spark, sf_dir))
    return store.read()
