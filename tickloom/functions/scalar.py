"""Row-level column helpers.

The engine keeps missing values as NULL. Division follows IEEE rules except that
0/0 gives NULL, so that the ANSI mode of the session does not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

INF = float("inf")
GUARD = 1e-10


def c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def fdiv(num, den) -> Column:
    """num / den with infinities for a zero divisor and NULL for 0/0."""
    num, den = c(num).cast("double"), c(den).cast("double")
    return (
        F.when(den != 0, F.try_divide(num, den))
        .when((den == 0) & (num > 0), F.lit(INF))
        .when((den == 0) & (num < 0), F.lit(-INF))
    )


def guarded(num, den, eps: float = GUARD) -> Column:
    """num / (den + eps): the guarded ratio that most features use; NULL should den be -eps."""
    return F.try_divide(c(num).cast("double"), c(den).cast("double") + F.lit(eps))


def ratio_or(num, den, default) -> Column:
    """num / den, or the default where den is 0."""
    return F.when(c(den) == 0, F.lit(default)).otherwise(fdiv(num, den))


def clip(x, lo, hi) -> Column:
    """Bound both sides; NULL stays NULL."""
    x = c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, c(lo)), c(hi)))


def maximum(a, b) -> Column:
    """Element-wise maximum that is NULL when either side is NULL."""
    a, b = c(a), c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def minimum(a, b) -> Column:
    a, b = c(a), c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def flag(cond) -> Column:
    """Comparison as 0/1 where an unknown comparison counts as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def choose(cases, default) -> Column:
    """First matching (condition, value); unknown conditions do not match."""
    first, *rest = cases
    out = F.when(first[0], c(first[1]))
    for cond, value in rest:
        out = out.when(cond, c(value))
    return out.otherwise(c(default))


def logistic(x, center, steepness=4.0) -> Column:
    return 1.0 / (1.0 + F.exp(-F.lit(float(steepness)) * (c(x) - c(center))))


def finite_or_null(x) -> Column:
    """NaN and infinities become NULL."""
    x = c(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(INF)), x)


def is_inf(x) -> Column:
    return F.abs(c(x)) == F.lit(INF)


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def add_all(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns of a table, without the excluded ones."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [n for n, t in df.dtypes if (t in kinds or t.startswith("decimal")) and n not in exclude]


def safe_z(x, mean, sd) -> Column:
    """Absolute z-score; NULL where the deviation is 0."""
    return F.abs(F.try_divide(c(x) - c(mean), F.when(c(sd) > 0, c(sd))))
