"""casebook: case-record analytics as lazy Spark DataFrame operators.

Every public operator takes a DataFrame (plus plain parameters) and returns a
DataFrame.  Nothing is collected to the driver; Catalyst plans the work.
"""

from casebook.schema import CASE_SCHEMA, CASE_COLUMNS, GROUPABLE  # noqa: F401
from casebook.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["CASE_SCHEMA", "CASE_COLUMNS", "GROUPABLE", "get_spark", "checkpoint_dir"]
