"""Exact statistics from one table of value counts.

Spark's exact ``percentile`` merges a value->count map of *all* distinct values of a
group into one task: fine for day counts, unbounded for a continuous column.  Here one
scan of the input counts every (group, column, value); a hot value or group shrinks
in the map-side aggregate.  The counts are range-partitioned by (group, column, value)
and kept in the shared folder, and the running count within a group comes from sums per
partition: no task holds a group, and every rank is found exactly.  Means, quantiles,
histograms, whiskers and counts beyond a threshold all follow from this table.

Results equal ``percentile`` (same linear interpolation, same arithmetic).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.session import checkpoint_dir


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed now, once, into the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def same_keys(a: DataFrame, b: DataFrame, keys) -> Column:
    """Null-safe equality of the key columns of two frames."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


class ValueCounts:
    """Counts of the values of some columns, as doubles, per group (NULL keys are a group).

    ``table``: the keys, ``col`` (name), ``x`` (value, NULL for the NULLs), ``k`` (rows),
    ``start`` and ``end`` (rows of the group's column with a smaller value, and with
    one at most as large; NULL for NULLs) and ``n`` (rows with a value).
    """

    def __init__(self, counts: DataFrame, keys=()):
        """``counts``: keys, ``col``, ``x`` and ``k``, one row per value."""
        self.keys = list(keys)
        group = [*self.keys, "col"]
        placed = kept(counts.select(*group, "x", "k").repartitionByRange(*group, "x").withColumn("_pid", F.spark_partition_id()))
        has = F.col("x").isNotNull()
        # One row per partition and group that begins or ends in it.
        sums = placed.where(has).groupBy("_pid", *group).agg(F.sum("k").alias("_k"))
        whole = Window.partitionBy(*group)
        before = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("_pid", *group, F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.sum("_k").over(whole).alias("n"))
        here = Window.partitionBy("_pid", *group).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = placed.withColumn("_run", F.sum(F.when(has, F.col("k"))).over(here))
        joined = local.join(sums, same_keys(local, sums, ["_pid", *group]), "left")
        end = F.when(local["x"].isNotNull(), F.col("_before") + F.col("_run"))
        self.table = kept(joined.select(*[local[c] for c in (*group, "x", "k")], (end - local["k"]).alias("start"), end.alias("end"), "n"))

    @classmethod
    def over(cls, table: DataFrame, keys) -> ValueCounts:
        """A table of this form as it is, e.g. some groups of another's."""
        out = cls.__new__(cls)
        out.keys, out.table = list(keys), table
        return out

    @classmethod
    def of(cls, df: DataFrame, cols, keys=()) -> ValueCounts:
        """One scan of ``df``.  ``cols``: names, or a dict of name -> Column."""
        cols = cols if isinstance(cols, dict) else {c: F.col(c) for c in cols}
        cells = F.array(*[F.struct(F.lit(name).alias("col"), value.cast("double").alias("x")) for name, value in cols.items()])
        long = df.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.col", "_c.x")
        return cls(long.groupBy(*keys, "col", "x").agg(F.count(F.lit(1)).alias("k")), keys)

    def merged(self, keys=()) -> ValueCounts:
        """The counts of coarser groups: only ``keys`` of the keys stay."""
        return ValueCounts(self.table.groupBy(*keys, "col", "x").agg(F.sum("k").alias("k")), keys)

    def column(self, name: str) -> DataFrame:
        """The keys, x, k, start, end and n of one column."""
        return self.table.where(F.col("col") == name).drop("col")

    def stats(self, spec: dict, extra: dict | None = None) -> DataFrame:
        """One row per group (no keys: one row, even of an empty input): for each column
        of ``spec = {column: [q, ...]}`` an ``array<double>`` of exact quantiles named like
        it, NULLs where a group has no value.  ``extra``: name -> aggregate over the table's
        rows.  All of it is one aggregate."""
        picks, out = [], []
        for i, (c, qs) in enumerate(spec.items()):
            mine = F.col("col") == c
            picks.append(F.max(F.when(mine, F.col("n"))).alias(f"_n{i}"))
            values = []
            for j, q in enumerate(float(q) for q in qs):
                place = (F.col("n") - 1).cast("double") * F.lit(q)
                for name, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
                    picks.append(F.max(F.when(mine & (F.col("start") <= rank) & (rank < F.col("end")), F.col("x"))).alias(f"_{name}{i}_{j}"))
                p = (F.col(f"_n{i}") - 1).cast("double") * F.lit(q)
                lo, hi, vlo, vhi = F.floor(p), F.ceil(p), F.col(f"_lo{i}_{j}"), F.col(f"_hi{i}_{j}")
                # Every rank below n lies in one value's span; a miss must not pass for NULL.
                found = F.col(f"_n{i}").isNull() | (vlo.isNotNull() & vhi.isNotNull())
                value = F.when((lo == hi) | (vlo == vhi), vlo).otherwise((hi.cast("double") - p) * vlo + (p - lo.cast("double")) * vhi)
                values.append(F.when(found, value).otherwise(F.raise_error(F.lit(f"no value of {c} at the rank of quantile {q}")).cast("double")))
            out.append(F.array(*values).alias(c))
        more = extra or {}
        return (self.table.groupBy(*self.keys).agg(*picks, *[v.alias(f"_more_{c}") for c, v in more.items()])
                .select(*self.keys, *out, *[F.col(f"_more_{c}").alias(c) for c in more]))


def of(name: str, value: Column | None = None) -> Column:
    """Within aggregates over a value-count table: ``value`` (default x) of column ``name``."""
    return F.when(F.col("col") == name, F.col("x") if value is None else value)


def rows(name: str, cond: Column | None = None) -> Column:
    """Aggregate: rows of column ``name`` (that satisfy ``cond`` on x), NULLs included."""
    here = F.col("col") == name
    return F.coalesce(F.sum(F.when(here if cond is None else here & cond, F.col("k"))), F.lit(0).cast("long"))


def present(name: str) -> Column:
    """Aggregate: rows of column ``name`` that are not NULL."""
    return rows(name, F.col("x").isNotNull())


def percent(name: str) -> Column:
    """Aggregate: of the values 0 and 1 of column ``name``, the percentage of 1."""
    return F.try_divide(F.sum(of(name, F.col("x") * F.col("k"))) * 100.0, present(name).cast("double"))


def stddev(name: str) -> Column:
    """Aggregate: the sample standard deviation of column ``name``; NULL below two values."""
    n = present(name).cast("double")
    first, second = F.sum(of(name, F.col("x") * F.col("k"))), F.sum(of(name, F.col("x") * F.col("x") * F.col("k")))
    return F.when(n > 1, F.sqrt(F.greatest(F.try_divide(second - F.try_divide(first * first, n), n - 1), F.lit(0.0))))


def mean(name: str) -> Column:
    """Aggregate: the mean of column ``name``; NULL without values."""
    return F.try_divide(F.sum(of(name, F.col("x") * F.col("k"))), present(name).cast("double"))


def quantile_table(df: DataFrame, spec: dict, keys=()) -> DataFrame:
    """``spec = {column: [q, ...]}`` -> the keys (one row a group; no keys: one row)
    and one ``array<double>`` per column, NULLs where a group has no value."""
    return ValueCounts.of(df, list(spec), keys).stats(spec)


def multi_quantiles(df: DataFrame, spec: dict) -> DataFrame:
    """One row: an array of exact quantiles per column of ``spec``."""
    return quantile_table(df, spec)


def global_quantiles(df: DataFrame, col: str, qs) -> DataFrame:
    """One row with one column ``q`` = array of exact quantiles (linear
    interpolation at (n-1)*q, as ``percentile``); NULLs when there is no value."""
    return multi_quantiles(df, {col: qs}).withColumnRenamed(col, "q")


def global_quantile_row(df: DataFrame, col: str, qs, exact: bool = True, name: str = "q",
                        accuracy: int = 100_000) -> DataFrame:
    """One-row frame with array column ``name``: exact (above) or a sketch."""
    if exact:
        return global_quantiles(df, col, qs).withColumnRenamed("q", name)
    return df.agg(F.percentile_approx(F.col(col).cast("double"), [float(q) for q in qs], accuracy)
                  .cast("array<double>").alias(name))


def quantile_rows(df: DataFrame, spec: dict, exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """``multi_quantiles`` (exact) or one sketch aggregate (approx); columns are
    named after the input columns."""
    if exact:
        return multi_quantiles(df, spec)
    return df.agg(*[F.percentile_approx(F.col(c).cast("double"), [float(q) for q in qs], accuracy)
                    .cast("array<double>").alias(c) for c, qs in spec.items()])


def grouped_quantiles(df: DataFrame, keys, col: str, qs, out: str = "q") -> DataFrame:
    """Exact per-group quantiles: ``keys..., out array<double>``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return quantile_table(df, {col: qs}, keys).withColumnRenamed(col, out)


def grouped_quantile_frame(df: DataFrame, keys, col: str, qs, exact: bool = True,
                           out: str = "q", accuracy: int = 100_000) -> DataFrame:
    """Per-group quantiles as ``keys..., out``: exact, or one sketch aggregate."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if exact:
        return grouped_quantiles(df, keys, col, qs, out=out)
    return df.groupBy(*keys).agg(F.percentile_approx(F.col(col).cast("double"), [float(q) for q in qs], accuracy)
                                 .cast("array<double>").alias(out))
