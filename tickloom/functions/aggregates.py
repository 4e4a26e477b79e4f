"""Aggregate columns that Spark does not name, safe under the ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalar import c


def both(a, b):
    """The two columns, NULL where either is NULL."""
    a, b = c(a), c(b)
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, a), F.when(known, b)


def corr(a, b, flat: float = 0.0) -> Column:
    """Pearson correlation over complete pairs; NULL when a side is flat."""
    a, b = both(a, b)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sa > flat) & (sb > flat), F.try_divide(F.covar_pop(a, b), sa * sb))


def skew(x) -> Column:
    """Bias-corrected skewness."""
    x = c(x)
    n = F.count(x).cast("double")
    factor = F.try_divide(F.sqrt(F.greatest(n * (n - 1), F.lit(0.0))), F.when(n > 2, n - 2))
    return F.when(F.stddev_pop(x) > 0, F.skewness(x)) * factor


def kurt(x) -> Column:
    """Bias-corrected excess kurtosis."""
    x = c(x)
    n = F.count(x).cast("double")
    factor = F.try_divide(n - 1, F.when(n > 3, (n - 2) * (n - 3)))
    return factor * ((n + 1) * F.when(F.stddev_pop(x) > 0, F.kurtosis(x)) + 6)


def share(cond) -> Column:
    """Share of rows where the condition holds; unknown counts as false."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def match_rate(a, b, where=None) -> Column:
    """Share of rows with equal signs."""
    hit = F.when(F.signum(c(a)) == F.signum(c(b)), 1.0).otherwise(0.0)
    return F.avg(F.when(where, hit) if where is not None else hit)


def issues(*pairs) -> Column:
    """Array of the codes whose condition holds."""
    return F.filter(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]), lambda v: v.isNotNull())
