"""Validated batch inserts and keyed batch updates.

Both work on request *tables*; one request is a one-row table.  Results are new
DataFrames (copy-on-write); writing them is the caller's ``df.write``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.indexing import dense_index
from casebook.schema import CASE_COLUMNS, KEY, VALUE_COLUMNS
from casebook.sources.records import CORRUPT


def validate_inserts(batch: DataFrame, required=VALUE_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """S4 check: a row is accepted when none of the required fields is NULL
    (an absent field in a table is NULL) and, for an imported batch, the line
    parsed (``_corrupt_record`` is NULL).  Rejected rows carry ``missing``, the
    fields that are missing, and an imported batch keeps the text of a bad line."""
    req = list(required)
    absent = [c for c in req if c not in batch.columns]
    b = batch
    for c in absent:
        b = b.withColumn(c, F.lit(None))
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in req]),
                       lambda x: x.isNotNull())
    m = b.withColumn("missing", missing)
    good = F.size("missing") == 0
    if CORRUPT in batch.columns:
        good = good & F.col(CORRUPT).isNull()
    accepted = m.where(good).drop("missing", CORRUPT)
    rejected = m.where(~good)
    return accepted, rejected


def assign_ids(store: DataFrame, accepted: DataFrame, order_cols, key: str = KEY) -> DataFrame:
    """S4 ids: ``max(existing key) + 1, + 2, ...`` in the batch order.

    The max is a one-row aggregate; the numbering is a distributed dense index
    (no global window).
    """
    top = store.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_max"))
    idx = dense_index(accepted, order_cols, "_i")
    return (idx.crossJoin(F.broadcast(top))
            .withColumn(key, F.col("_max") + F.col("_i") + 1)
            .drop("_max", "_i"))


def assign_ids_from(highest: int, accepted: DataFrame, order_cols, key: str = KEY) -> DataFrame:
    """S4 ids when the highest existing one is known, e.g. from a store's manifest."""
    return dense_index(accepted, order_cols, key, start=highest + 1)


def insert_records(store: DataFrame, batch: DataFrame, order_cols,
                   key: str = KEY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (new store = store + accepted rows, accepted with ids, rejected)."""
    accepted, rejected = validate_inserts(batch)
    with_ids = assign_ids(store, accepted, order_cols, key)
    cols = [c for c in store.columns]
    new_store = store.unionByName(with_ids.select(*cols))
    return new_store, with_ids, rejected


def fold_updates(updates: DataFrame, fields=VALUE_COLUMNS, key: str = KEY,
                 seq: str = "seq", set_col: str = "set_fields") -> DataFrame:
    """S5 fold: one row per key; for each field the value of the latest update
    (highest ``seq``) that sets it.  ``set_fields`` tells "set to NULL" from
    "not given": a field is applied when ``_set_<field>`` is true.

    ``max_by`` is partially aggregated before the shuffle, so a key with very
    many updates costs one partial row per map task.
    """
    aggs = [F.count(F.lit(1)).alias("_n_updates")]
    for f in fields:
        given = F.array_contains(F.col(set_col), f)
        aggs.append(F.max_by(F.struct(F.col(f).alias("v")), F.when(given, F.col(seq))).alias(f"_u_{f}"))
        aggs.append(F.bool_or(given).alias(f"_set_{f}"))
    return updates.groupBy(key).agg(*aggs)


def rejected_updates(updates: DataFrame, fields=VALUE_COLUMNS, key: str = KEY, seq: str = "seq",
                     set_col: str = "set_fields") -> DataFrame:
    """Updates that name a field the table does not have: key, seq and the
    unknown names.  Their known fields are still applied."""
    known = F.array(*[F.lit(f) for f in fields])
    unknown = F.array_except(F.col(set_col), known)
    return updates.where(F.size(unknown) > 0).select(key, seq, unknown.alias("unknown"))


def named_fields(updates: DataFrame, fields=VALUE_COLUMNS, set_col: str = "set_fields") -> list[str]:
    """Those of ``fields`` that some update of the batch sets (field names are few)."""
    named = {r[0] for r in updates.select(F.explode(set_col)).distinct().collect()}
    return [f for f in fields if f in named]


def apply_updates(base: DataFrame, updates: DataFrame, fields=VALUE_COLUMNS, key: str = KEY,
                  seq: str = "seq", set_col: str = "set_fields") -> tuple[DataFrame, DataFrame]:
    """(updated table, unmatched update keys).  Only fields that occur in the batch are
    folded.

    The folded updates are left-joined on the key (AQE broadcasts them when the
    batch is small); unmatched keys come from an anti join.
    """
    fields = named_fields(updates, fields, set_col)
    folded = fold_updates(updates, fields, key, seq, set_col)
    unmatched = folded.join(base.select(key), key, "left_anti").select(
        key, F.col("_n_updates").alias("n_updates"))
    return apply_folded(base, folded, fields, key), unmatched


def apply_folded(base: DataFrame, folded: DataFrame, fields, key: str = KEY) -> DataFrame:
    """``base`` with the folded updates (see ``fold_updates``) set."""
    j = base.join(folded, key, "left")
    out = []
    for c in base.columns:
        if c in fields:
            out.append(F.when(F.coalesce(F.col(f"_set_{c}"), F.lit(False)), F.col(f"_u_{c}.v"))
                       .otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


__all__ = ["validate_inserts", "assign_ids", "assign_ids_from", "insert_records", "fold_updates",
           "apply_updates", "apply_folded", "named_fields", "rejected_updates",
           "CASE_COLUMNS"]
