"""Statistics helpers as Column expressions (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r(c, k: int = 2) -> Column:
    """Half-even rounding, as Python's ``round``."""
    return F.bround(col_(c), k)


def rq(c, k: int = 2) -> Column:
    """Half-even rounding of an interpolated quantile.

    Interpolating between two cent values gives an exact tie (x.xx5) whose
    binary form lands either side of it depending on the engine's arithmetic;
    rounding to 9 places first removes that noise so the tie rounds to even.
    """
    return F.bround(F.bround(col_(c), 9), k)


def fixed_text(c, places: int, before: str = "", after: str = "") -> Column:
    """A number as text with ``places`` decimals, ties to even; NULL stays NULL."""
    x = F.bround(col_(c).cast("double"), places)
    return F.when(x.isNotNull(), F.concat(F.lit(before), F.format_string(f"%.{places}f", x), F.lit(after)))


def quantile(c, q, exact: bool = True, accuracy: int = 100000) -> Column:
    """Quantile with linear interpolation (exact) or a bounded sketch (approx).

    ``exact`` uses Spark's ``percentile``; its partial state is a value->count
    map, so memory is bounded by the number of *distinct* values per group
    (small for day counts, ages, scores).  For continuous columns at very large
    scale pass ``exact=False``: ``percentile_approx`` keeps a fixed-size sketch
    with rank error ``1/accuracy``.
    """
    if exact:
        return F.percentile(col_(c), F.lit(q) if not isinstance(q, (list, tuple))
                            else F.array(*[F.lit(float(x)) for x in q]))
    qq = F.array(*[F.lit(float(x)) for x in q]) if isinstance(q, (list, tuple)) else F.lit(float(q))
    return F.percentile_approx(col_(c).cast("double"), qq, accuracy)


def rate_pct(cond: Column, denom: Column) -> Column:
    """``100 * count_if(cond) / denom``; NULL when the denominator is 0."""
    return F.try_divide(F.count_if(cond) * F.lit(100.0), denom.cast("double"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over pairwise-complete rows; NULL for a constant column.

    Spark's ``corr`` raises DIVIDE_BY_ZERO on zero variance under ANSI mode, so it
    is built from population moments with ``try_divide``.
    """
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x.cast("double"))
    yy = F.when(both, y.cast("double"))
    den = F.stddev_pop(xx) * F.stddev_pop(yy)
    return F.when(den > 0, F.try_divide(F.covar_pop(xx, yy), den))


def direction(c: Column, lo: float = -0.1, hi: float = 0.1) -> Column:
    return (F.when(c < lo, "negative").when(c > hi, "positive").otherwise("weak/none"))
