"""Treatment comparison for a table of requests.

A request is a pair of case-insensitive regular expressions: a condition and a procedure
pattern.  Patterns meet the *dictionary* of distinct values, never the case rows:

1. one scan sums the cases per (condition, procedure);
2. each distinct pattern is matched once with each distinct value, in slices of the
   dictionary of bounded size (a slice is broadcast, patterns stay distributed);
3. the hits are equi-joined with the sums, first on the condition, then on the
   procedure, and added up per request.

Patterns may overlap; a request that matches nothing is kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.quantiles import kept
from casebook.functions.stats import fixed_text, r
from casebook.schema import CONDITION, COST, LOS, OUTCOME, PROCEDURE

#: Distinct values that meet the patterns at once.
DICTIONARY_SLICE = 100_000


def pattern_hits(values: DataFrame, patterns: DataFrame, slice_rows: int = DICTIONARY_SLICE) -> DataFrame:
    """(pattern, value) of the distinct ``patterns`` found in the distinct ``values``
    (one string column each; NULLs match nothing).

    The dictionary's size is counted first; each slice holds about ``slice_rows`` of its
    values, by hash, and is broadcast to the patterns.  A pattern is compiled once per
    slice, for it is the outer side of the loop."""
    values = kept(values.select(F.col(values.columns[0]).alias("value")).where("value IS NOT NULL").distinct())
    patterns = kept(patterns.select(F.col(patterns.columns[0]).alias("pattern")).where("pattern IS NOT NULL").distinct())
    slices = max(1, -(-values.count() // slice_rows))
    parts = []
    for i in range(slices):
        part = values.where(F.pmod(F.xxhash64("value"), F.lit(slices)) == i)
        parts.append(patterns.join(F.broadcast(part), F.expr("value RLIKE concat('(?i)', pattern)")))
    return kept(reduce(DataFrame.unionByName, parts))


def compare_treatment_requests(df: DataFrame, requests: DataFrame, condition: str = "condition", pattern: str = "pattern",
                               texts: bool = False) -> DataFrame:
    """For each distinct (``condition``, ``pattern``) of ``requests``: total_cases, success_rate
    (recovered, of all rows), average_length_of_stay_days, average_cost, no_data.

    A NULL pattern on either side matches nothing; an empty one matches every value.  Cases
    with a NULL condition or procedure match nothing.  A pattern that is no regular expression
    is an error.  ``texts`` adds the three numbers as texts, e.g. 87.50% and $1234.50.
    """
    asked = requests.select(F.col(condition).cast("string").alias("condition"), F.col(pattern).cast("string").alias("pattern")).distinct()
    asked = kept(asked)
    sums = {"total_cases": F.count(F.lit(1)), "recovered": F.count_if(F.col(OUTCOME) == "Recovered"),
            "days": F.sum(F.col(LOS).cast("double")), "stays": F.count(LOS), "money": F.sum(F.col(COST).cast("double")), "costs": F.count(COST)}
    cells = kept(df.where(F.col(CONDITION).isNotNull() & F.col(PROCEDURE).isNotNull())
                 .groupBy(F.col(CONDITION).alias("_condition"), F.col(PROCEDURE).alias("_procedure"))
                 .agg(*[v.alias(c) for c, v in sums.items()]))

    def added(frame: DataFrame, *keys: str) -> DataFrame:
        return frame.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])

    of_condition = pattern_hits(cells.select("_condition"), asked.select("condition"))
    of_procedure = pattern_hits(cells.select("_procedure"), asked.select("pattern"))
    # Per condition pattern and procedure, then per request.
    some = added(cells.join(of_condition.select(F.col("pattern").alias("condition"), F.col("value").alias("_condition")), "_condition"),
                 "condition", "_procedure")
    wanted = asked.join(of_procedure.withColumnRenamed("value", "_procedure"), "pattern")
    found = added(wanted.join(some, ["condition", "_procedure"]), "condition", "pattern")
    out = asked.alias("a").join(found.alias("f"), F.expr("a.condition = f.condition AND a.pattern = f.pattern"), "left").select(
        "a.condition", "a.pattern", F.coalesce("total_cases", F.lit(0).cast("long")).alias("total_cases"),
        r(F.try_divide(F.col("recovered") * 100.0, F.col("total_cases"))).alias("success_rate"),
        r(F.try_divide(F.col("days"), F.col("stays"))).alias("average_length_of_stay_days"),
        r(F.try_divide(F.col("money"), F.col("costs"))).alias("average_cost"),
        F.col("total_cases").isNull().alias("no_data"))
    if not texts:
        return out
    return out.select("*", fixed_text("success_rate", 2, after="%").alias("success_rate_text"),
                      fixed_text("average_length_of_stay_days", 2).alias("average_length_of_stay_text"),
                      fixed_text("average_cost", 2, before="$").alias("average_cost_text"))
