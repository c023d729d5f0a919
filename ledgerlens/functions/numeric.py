"""Numeric guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(num, den) -> Column:
    """Num / den, null when den is 0 or null (ANSI-safe; the policy for 0 price)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct_diff(base, other) -> Column:
    """|base - other| / base * 100, 0 when base is 0 (divides by the signed base, T21)."""
    b, o = _c(base), _c(other)
    return F.when(b != 0, F.abs(b - o) / b * 100).otherwise(F.lit(0.0))


def guarded_corr(x, y) -> Column:
    """Pearson correlation over rows where both sides are non-null.

    Built from population covariance / variances so a constant column yields null
    instead of raising DIVIDE_BY_ZERO under ANSI mode (T12). Aggregate expression.
    """
    x, y = _c(x).cast("double"), _c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    den = F.sqrt(F.var_pop(xs) * F.var_pop(ys))
    return F.try_divide(F.covar_pop(xs, ys), F.when(den > 0, den))


def pair_count(x, y) -> Column:
    """Number of rows where both x and y are non-null (aggregate)."""
    return F.count(F.when(_c(x).isNotNull() & _c(y).isNotNull(), F.lit(1)))
