"""Gap filling and as-of lookups in two levels.

Inside a calendar span a window finds the neighbour; across spans one row per
(group, span) carries the last or next known value. No task holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def _neighbour(df: DataFrame, keys, values: dict, forward: bool, span: str, order: str) -> DataFrame:
    """Add columns with the nearest non-null value at or before (after) each row."""
    keys = list(keys)
    cut = df.withColumn("_span", F.date_trunc(span, F.col(order)))
    inside = W.partitionBy(*keys, "_span").orderBy(order)
    inside = inside.rowsBetween(W.unboundedPreceding, 0) if forward else inside.rowsBetween(0, W.unboundedFollowing)
    pick = F.last if forward else F.first
    edge = F.max_by if forward else F.min_by
    ends = cut.groupBy(*keys, "_span").agg(
        *[edge(v, F.when(v.isNotNull(), F.col(order))).alias(f"_e_{n}") for n, v in values.items()]
    )
    over = W.partitionBy(*keys).orderBy("_span")
    over = over.rowsBetween(W.unboundedPreceding, -1) if forward else over.rowsBetween(1, W.unboundedFollowing)
    carry = ends.select(
        *keys, "_span", *[pick(f"_e_{n}", ignorenulls=True).over(over).alias(f"_c_{n}") for n in values]
    )
    found = cut.select("*", *[pick(v, ignorenulls=True).over(inside).alias(f"_l_{n}") for n, v in values.items()])
    merged = found.join(carry, keys + ["_span"], "left")
    return merged.select(
        *[c for c in df.columns if c not in values],
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values],
    )


def forward_fill(df: DataFrame, columns, keys=("symbol",), span: str = "year", order: str = "ts") -> DataFrame:
    return _neighbour(df, keys, {c: F.col(c) for c in columns}, True, span, order).select(df.columns)


def backward_fill(df: DataFrame, columns, keys=("symbol",), span: str = "year", order: str = "ts") -> DataFrame:
    return _neighbour(df, keys, {c: F.col(c) for c in columns}, False, span, order).select(df.columns)


def fill_both(df: DataFrame, columns, keys=("symbol",), span: str = "year") -> DataFrame:
    return backward_fill(forward_fill(df, columns, keys, span), columns, keys, span)


def interpolate(df: DataFrame, columns, keys=("symbol",), span: str = "year") -> DataFrame:
    """Fill gaps on a line over row positions; trailing gaps repeat the last value."""
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(c).alias("v"))) for c in columns}
    out = _neighbour(df, keys, {f"_b_{c}": v for c, v in known.items()}, True, span, "ts")
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(c).alias("v"))) for c in columns}
    out = _neighbour(out, keys, {f"_a_{c}": v for c, v in known.items()}, False, span, "ts")

    def line(c):
        b, a = F.col(f"_b_{c}"), F.col(f"_a_{c}")
        step = (F.col("pos") - b.p) / (a.p - b.p)
        return (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(b.isNotNull() & a.isNotNull(), b.v + (a.v - b.v) * step)
            .when(b.isNotNull(), b.v)
            .alias(c)
        )

    return out.select(*[line(c) if c in columns else F.col(c) for c in df.columns])


def asof_join(left: DataFrame, right: DataFrame, values, keys=(), span: str = "month", order: str = "ts") -> DataFrame:
    """For each left row the right row at or before its time (same keys).

    The lookup runs on the distinct times of the left side, so the work does not
    grow with the number of left groups, and there is no inequality join.
    """
    keys = list(keys)
    group = keys or ["_all"]
    times = left.select(*keys, order).distinct().withColumn("_hit", F.lit(None).cast("int"))
    marks = right.select(*keys, order, *values).withColumn("_hit", F.lit(1))
    for v in values:
        times = times.withColumn(v, F.lit(None).cast(dict(right.dtypes)[v]))
    both = times.select(marks.columns).unionByName(marks)
    # one row per time, so that a right row on the same time is seen by it
    both = both.groupBy(*keys, order).agg(
        *[F.max(v).alias(v) for v in values], F.max("_hit").alias("_hit")
    )
    if not keys:
        both = both.withColumn("_all", F.lit(0))
    packed = F.when(F.col("_hit") == 1, F.struct(*values))
    seen = _neighbour(both.select(*group, order, packed.alias("_m")), group, {"_m": F.col("_m")}, True, span, order)
    found = seen.select(*keys, order, *[F.col(f"_m.{v}").alias(v) for v in values])
    return left.join(found, keys + [order], "left")
