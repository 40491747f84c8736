"""Predicate builders (F1-F9).  Each returns a ``Column`` or a filtered DataFrame.

Type clashes between a literal and its column are resolved when the plan is
built, never by a runtime cast (Spark 4 runs with ANSI casts, where
``'Yes' > 5`` raises).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.schema import KEY, NUMERIC_TYPES


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, NUMERIC_TYPES):
        return "num"
    if isinstance(dt, T.StringType):
        return "str"
    return "other"


def _val_kind(v) -> str:
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float)):
        return "num"
    if isinstance(v, str):
        return "str"
    return "other"


def _compatible(df: DataFrame, col: str, v) -> bool:
    ck, vk = _kind(df.schema[col].dataType), _val_kind(v)
    if ck == vk:
        return True
    # Python treats bools as 0/1 in numeric comparisons.
    return ck == "num" and vk == "bool"


def _literal(df: DataFrame, col: str, v) -> Column:
    """The literal as the column compares it: a boolean against a number is 0 or 1."""
    if isinstance(v, bool) and _kind(df.schema[col].dataType) == "num":
        v = int(v)
    return F.lit(v)


def _all(preds) -> Column:
    preds = list(preds)
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def equality_predicate(df: DataFrame, criteria: dict | None, strict: bool = False) -> Column:
    """Conjunctive field = value filter.

    strict (F2, store semantics): unknown field or type clash raises
    ``ValueError``; ``None`` means ``IS NULL``.
    lenient (F3, ``where`` semantics): unknown fields are ignored, ``None``
    matches nothing, a type clash matches nothing, empty dict = no filter.
    """
    preds = []
    for c, v in (criteria or {}).items():
        if c not in df.columns:
            if strict:
                raise ValueError(f"no such column: {c!r}")
            continue
        if v is None:
            preds.append(F.col(c).isNull() if strict else F.lit(False))
            continue
        if not _compatible(df, c, v):
            if strict:
                raise ValueError(f"Value {v!r} does not match the type of '{c}'")
            preds.append(F.lit(False))
            continue
        preds.append(F.col(c) == _literal(df, c, v))
    return _all(preds)


def apply_where(df: DataFrame, where: dict | None) -> DataFrame:
    """the lenient ``where`` filter shared by the analytic operators."""
    if not where:
        return df
    return df.where(equality_predicate(df, where, strict=False))


def lookup(df: DataFrame, patient_id=None, criteria: dict | None = None, key: str = KEY) -> DataFrame:
    """a key (or list/DataFrame of keys) beats criteria; id 0 counts as not given."""
    if isinstance(patient_id, DataFrame):
        ids = patient_id.select(F.col(patient_id.columns[0]).alias(key))
        # The id list is a request table; a semi join never duplicates rows and
        # lets AQE broadcast it when it is small.
        return df.join(ids, key, "left_semi")
    if isinstance(patient_id, (list, tuple, set)):
        ids = [int(i) for i in patient_id if i]
        if ids:
            return df.where(F.col(key).isin(ids))
        patient_id = None
    if patient_id:
        return df.where(F.col(key) == F.lit(int(patient_id)))
    if criteria:
        return df.where(equality_predicate(df, criteria, strict=True))
    raise ValueError("give a record id, a table of ids, or criteria")


def pattern_match(c, pattern: str, literal: bool = False) -> Column:
    """case-insensitive regular-expression containment; NULL -> false."""
    col = F.col(c) if isinstance(c, str) else c
    if literal:
        return F.coalesce(F.contains(F.lower(col), F.lower(F.lit(pattern))), F.lit(False))
    return F.coalesce(col.rlike("(?i)" + pattern), F.lit(False))


def ci_equals(c, value: str) -> Column:
    """case-insensitive equality."""
    col = F.col(c) if isinstance(c, str) else c
    return F.lower(col) == F.lower(F.lit(value))


def drop_incomplete(df: DataFrame, cols) -> DataFrame:
    """drop rows with a NULL in any of ``cols``."""
    return df.na.drop(subset=list(cols))


RULE_OPERATORS = (">", ">=", "<", "<=", "==", "!=", "in")


def rule_predicate(df: DataFrame, field: str, op: str, value) -> Column:
    """a comparison rule as a never-NULL boolean Column.

    A NULL or absent field, an unknown operator, or a comparison the values'
    types do not support gives no match.  ``in`` against a string is substring
    containment; against a list it is membership.
    """
    if field not in df.columns or op not in RULE_OPERATORS:
        return F.lit(False)
    col = F.col(field)
    notnull = col.isNotNull()
    kind = _kind(df.schema[field].dataType)
    if op == "in":
        if isinstance(value, str):
            if kind != "str":
                return F.lit(False)
            return notnull & (F.instr(F.lit(value), col) > 0)
        if isinstance(value, (list, tuple, set)):
            items = [_literal(df, field, v) for v in value if v is not None and _compatible(df, field, v)]
            if not items:
                return F.lit(False)
            return F.coalesce(col.isin(items), F.lit(False))
        return F.lit(False)
    if value is None or not _compatible(df, field, value):
        # Unequal types: ``!=`` is true, ``==`` false, ordering comparisons fail.
        return notnull if op == "!=" else F.lit(False)
    v = _literal(df, field, value)
    cmp = {">": col > v, ">=": col >= v, "<": col < v, "<=": col <= v,
           "==": col == v, "!=": col != v}[op]
    return F.coalesce(cmp, F.lit(False))
