"""Exact quantiles and ranks of groups of any size.

No group is ever sorted in one task. Values are first collapsed to distinct
values with counts (so a value that repeats a billion times is one row), cut
into bins at sketched quantiles, and ranked inside bins; bin totals shift the
ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialize
from .layout import attach

BINS = 256


def ranked_values(df: DataFrame, keys, column: str) -> DataFrame:
    """Distinct values per group: keys, _x, _c (rows), _before (rows below), _n (rows of the group)."""
    keys = list(keys)
    x = F.col(column).cast("double")
    live = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("_x"))
    points = [i / BINS for i in range(1, BINS)]
    cuts = live.groupBy(*keys).agg(
        F.percentile_approx("_x", points, 20 * BINS).alias("_cuts"), F.count(F.lit(1)).alias("_n")
    )
    counts = live.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    # Written once: bins and totals must see the same values, and sums of floats
    # can differ in the last digit when a shuffle is repeated.
    binned = materialize(
        attach(counts, cuts, keys)
        .withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_x"))))
        .drop("_cuts")
    )
    totals = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_t"))
    earlier = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select(*keys, "_bin", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(W.unboundedPreceding, -1)
    return (
        binned.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
        .join(shift, keys + ["_bin"])
        .select(*keys, "_x", "_c", (F.col("_in") + F.col("_off")).alias("_before"), "_n")
    )


def exact_quantiles(df: DataFrame, keys, column: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with a column per named probability (linear interpolation)."""
    keys = list(keys)
    ranked = ranked_values(df, keys, column)
    picks = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("_n") - 1)
        low = F.floor(h)
        high = F.least(low + 1, F.col("_n") - 1)
        holds = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_c"))
        picks += [
            F.max(F.when(holds(low), F.col("_x"))).alias(f"_lo_{name}"),
            F.max(F.when(holds(high), F.col("_x"))).alias(f"_hi_{name}"),
            F.max(h - low).alias(f"_f_{name}"),
        ]
    return ranked.groupBy(*keys).agg(*picks).select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probs
        ],
    )


def nth_values(df: DataFrame, keys, column: str, ranks: dict) -> DataFrame:
    """Value at a 0-based rank per group; each rank is a column expression over _n."""
    ranked = ranked_values(df, list(keys), column)
    return ranked.groupBy(*keys).agg(
        *[
            F.max(
                F.when((F.col("_before") <= r) & (r < F.col("_before") + F.col("_c")), F.col("_x"))
            ).alias(n)
            for n, r in ranks.items()
        ]
    )


def average_ranks(df: DataFrame, keys, column: str, name: str) -> DataFrame:
    """Add the 1-based rank of the column inside its group, ties averaged.

    Ranks are looked up by (group, value); Spark splits hot values at run time.
    """
    keys = list(keys)
    ranks = ranked_values(df, keys, column).select(
        *keys, F.col("_x").alias("_key"), (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(name)
    )
    out = df.withColumn("_key", F.col(column).cast("double"))
    return out.join(ranks, keys + ["_key"], "left").drop("_key")
