"""Registered queries: name -> (spark plan builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables.  Oracles are ANSI SQL over the same parquet views; column
names match the Spark output exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.sources.tables import CASES_CTE, case_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def with_cases(body: str) -> str:
    """Prefix an oracle statement with the ``cases`` CTE (and optional more CTEs)."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {CASES_CTE},\n{body[5:]}"
    return f"WITH {CASES_CTE}\n{body}"


# Import the modules that register queries (each appends to QUERIES/ORACLE).
from casebook.plans import q_cohort  # noqa: E402,F401
from casebook.plans import q_ops  # noqa: E402,F401
from casebook.plans import q_text  # noqa: E402,F401
from casebook.plans import q_writes  # noqa: E402,F401
from casebook.plans import q_models  # noqa: E402,F401

__all__ = ["QUERIES", "ORACLE", "register", "with_cases", "case_view", "F"]
