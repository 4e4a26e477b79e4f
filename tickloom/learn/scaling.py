"""Feature scaling with a parameter table that can be stored and reused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import numeric_columns
from ..operators.layout import attach
from ..operators.order_stats import exact_quantiles

RAW = ("symbol", "ts", "pos", "open", "high", "low", "close", "volume")


def features_to_scale(df: DataFrame, exclude=()) -> list[str]:
    return numeric_columns(df, (*RAW, *exclude))


def _long(df: DataFrame, columns, keys):
    cells = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return cells.unpivot(list(keys), list(columns), "feature", "value")


def fit_scaler(df: DataFrame, columns, method: str = "robust", keys=("symbol",), least: int = 10) -> DataFrame:
    """One row per group and feature: centre, scale and statistics. Nulls count as 0 in the
    fit; features with at most ``least`` known values are left alone."""
    group = [*keys, "feature"]
    long = _long(df, columns, keys)
    zero = long.withColumn("value", F.coalesce("value", F.lit(0.0)))
    stats = long.groupBy(*group).agg(
        F.avg("value").alias("original_mean"), F.stddev_samp("value").alias("original_std"),
        F.min("value").alias("original_min"), F.max("value").alias("original_max"),
        F.sum(F.col("value").isNull().cast("long")).alias("missing_count"), F.count("value").alias("_known"),
    )
    if method == "robust":
        fit = exact_quantiles(zero, group, "value", {"_a": 0.25, "center": 0.5, "_b": 0.75}).select(
            *group, "center", (F.col("_b") - F.col("_a")).alias("scale")
        )
    elif method == "standard":
        fit = zero.groupBy(*group).agg(F.avg("value").alias("center"), F.stddev_pop("value").alias("scale"))
    elif method == "minmax":
        fit = zero.groupBy(*group).agg(F.min("value").alias("center"), (F.max("value") - F.min("value")).alias("scale"))
    else:
        raise ValueError(f"Unknown scaling method: {method}")
    return (
        stats.join(fit, group)
        .where(F.col("_known") > least)
        .withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))
        .withColumn("method", F.lit(method))
        .drop("_known")
    )


def _wide(params: DataFrame, columns, keys, fields) -> DataFrame:
    return params.groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == c, F.col(v))).alias(f"_{v}_{c}") for c in columns for v in fields]
    )


def scale(df: DataFrame, params: DataFrame, columns, keys=("symbol",)) -> DataFrame:
    joined = attach(df, _wide(params, columns, keys, ["center", "scale"]), list(keys))

    def value(c):
        x = (F.coalesce(F.col(c), F.lit(0.0)) - F.col(f"_center_{c}")) / F.col(f"_scale_{c}")
        return F.when(F.col(f"_scale_{c}").isNotNull(), x).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) if c in columns else F.col(c) for c in df.columns])


def unscale(df: DataFrame, params: DataFrame, columns, keys=("symbol",)) -> DataFrame:
    joined = attach(df, _wide(params, columns, keys, ["center", "scale"]), list(keys))
    value = lambda c: F.when(
        F.col(f"_scale_{c}").isNotNull(), F.col(c) * F.col(f"_scale_{c}") + F.col(f"_center_{c}")
    ).otherwise(F.col(c)).alias(c)
    return joined.select(*[value(c) if c in columns else F.col(c) for c in df.columns])


def fit_scale(df: DataFrame, columns=None, method: str = "robust", keys=("symbol",)) -> DataFrame:
    columns = columns or features_to_scale(df)
    return scale(df, fit_scaler(df, columns, method, keys), columns, keys)


def scale_by_group(df: DataFrame, groups: dict, methods: dict, keys=("symbol",)) -> DataFrame:
    """A scaling method per feature group (robust where none is named)."""
    for name, columns in groups.items():
        found = [c for c in columns if c in df.columns]
        if found:
            df = fit_scale(df, found, methods.get(name, "robust"), keys)
    return df


def clip_bounds(df: DataFrame, columns, method: str = "quantile", limit: float = 0.01, keys=("symbol",)) -> DataFrame:
    """Outlier bounds per group and feature, and how many values lie outside."""
    group = [*keys, "feature"]
    long = _long(df, columns, keys)
    if method == "quantile":
        bounds = exact_quantiles(long, group, "value", {"lower_bound": limit, "upper_bound": 1 - limit})
    elif method == "zscore":
        mean, sd = F.avg("value"), F.stddev_pop("value")
        bounds = long.groupBy(*group).agg((mean - limit * sd).alias("lower_bound"), (mean + limit * sd).alias("upper_bound"))
    else:
        raise ValueError(f"Unknown outlier method: {method}")
    x, lo, hi = F.col("value"), F.col("lower_bound"), F.col("upper_bound")
    inside = F.least(F.greatest(x, lo), hi)
    return attach(long, bounds, group).groupBy(*group).agg(
        F.min(x).alias("original_min"), F.max(x).alias("original_max"),
        F.min(inside).alias("clipped_min"), F.max(inside).alias("clipped_max"),
        F.max(lo).alias("lower_bound"), F.max(hi).alias("upper_bound"),
        F.count_if((x < lo) | (x > hi)).alias("outliers_clipped"),
    )


def clip_values(df: DataFrame, bounds: DataFrame, columns, keys=("symbol",)) -> DataFrame:
    joined = attach(df, _wide(bounds, columns, keys, ["lower_bound", "upper_bound"]), list(keys))
    value = lambda c: F.when(
        F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_lower_bound_{c}")), F.col(f"_upper_bound_{c}"))
    ).alias(c)
    return joined.select(*[value(c) if c in columns else F.col(c) for c in df.columns])


def fit_clip_scale(df: DataFrame, columns, outliers: str = "quantile", limit: float = 0.01, method: str = "robust",
                   keys=("symbol",)):
    """Clip then scale; returns the table and both parameter tables for reuse."""
    bounds = clip_bounds(df, columns, outliers, limit, keys)
    clipped = clip_values(df, bounds, columns, keys)
    params = fit_scaler(clipped, columns, method, keys)
    return scale(clipped, params, columns, keys), bounds, params


def save_scaler(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
