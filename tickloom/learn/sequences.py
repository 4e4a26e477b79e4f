"""Sequence windows: one row per window, an array of feature rows, and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.clean import clean_sequences
from ..operators.layout import attach
from ..plans.registry import Registry


def windows(df: DataFrame, features, length: int = 20, horizon: int = 1, stride: int = 1, targets=(),
            exclude_last: bool = False, fill: str = "zero", whole_only: bool = False) -> DataFrame:
    """Windows of ``length`` rows that start every ``stride`` rows of a symbol.

    The target of the window that starts at row i is the value at row
    i + length + horizon - 1, which must exist (one row more with
    ``exclude_last``). Without targets the horizon is ignored. ``fill``: "zero"
    replaces nulls by 0, "series" fills forward, backward, then 0, "keep"
    leaves them; ``whole_only`` drops windows that hold a null.
    """
    features, targets = list(features), list(targets)
    if fill == "series":
        df = clean_sequences(df, features)
    reg = Registry()

    def rows(f):
        cells = [F.coalesce(f[c].cast("double"), F.lit(0.0)) if fill == "zero" else f[c].cast("double") for c in features]
        return f.window_list(F.array(*cells), 0, length - 1)

    ahead = length - 1 + (horizon if targets else 0)
    reg.add("window", window=rows, _last=lambda f: f.lead("pos", ahead + (1 if exclude_last else 0)))
    for t in targets:
        reg.add("window", **{f"y_{t}": lambda f, t=t: F.coalesce(f.lead(t, ahead).cast("double"), F.lit(0.0))})
    out = reg.compute(df, ["window", "_last", *[f"y_{t}" for t in targets]])
    out = out.where((F.col("pos") % stride == 0) & F.col("_last").isNotNull()).drop("_last")
    if whole_only:
        out = out.where(~F.exists("window", lambda r: F.exists(r, lambda v: v.isNull())))
    return out.withColumnRenamed("pos", "start")


def swing_windows(df, features, target):
    return windows(df, features, 20, 5, 5, [target])


def portfolio_windows(df, features, length=20, stride=5):
    """Windows without a target; symbols that are too short give none."""
    return windows(df, features, length, 0, stride)


def training_windows(df, features, targets, length=20, stride=1):
    """Windows with the target on the next row; one or several targets."""
    return windows(df, features, length, 1, stride, targets, exclude_last=True, fill="series")


def test_windows(df, features, target, length=20, stride=20):
    """Windows that do not overlap, made like the training windows."""
    return training_windows(df, features, [target], length, stride)


def whole_windows(df, features, target, length=20, horizon=5):
    return windows(df, features, length, horizon, 1, [target], fill="keep", whole_only=True)


def fixed_windows(df, features, length=30):
    return windows(df, features, length, 0, 1)


def overlapping_rows(df: DataFrame, size: int = 30, overlap: float = 0.5) -> DataFrame:
    """Each row once per window it belongs to, with the window number."""
    if not 0 <= overlap < 1:
        raise ValueError("Overlap must be between 0 and 1 (exclusive)")
    step = int(size * (1 - overlap))
    sizes = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_rows"))
    first = F.greatest(F.ceil((F.col("pos") - (size - 1)) / step), F.lit(0)).cast("long")
    last = F.least(F.floor(F.col("pos") / step), F.floor((F.col("_rows") - size) / step)).cast("long")
    out = attach(df, sizes, ["symbol"]).withColumn("_first", first).withColumn("_last", last)
    ids = F.explode(F.sequence("_first", "_last"))
    return out.where("_last >= _first").withColumn("window_id", ids).drop("_rows", "_first", "_last")


def overlap_statistics(df: DataFrame, length: int, stride: int) -> DataFrame:
    """Window count, overlap share and training multiplier per symbol."""
    n = F.col("total_samples")
    count = F.greatest(F.floor((n - length) / stride) + 1, F.lit(0))
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("total_samples")).select(
        "symbol", "total_samples", count.alias("n_sequences"), F.lit(length - stride).alias("overlap_length"),
        F.lit((length - stride) / length * 100.0).alias("overlap_percentage"),
        (count / F.greatest(n - length + 1, F.lit(1))).alias("training_multiplier"),
    )


def preparation_statistics(df: DataFrame, target: str, length: int = 20, stride: int = 1) -> DataFrame:
    """Rows, dates, price range, windows and target moments per symbol."""
    y = F.col(target)
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min("close").alias("min_close"), F.max("close").alias("max_close"),
        F.avg(y).alias("target_mean"), F.stddev_pop(y).alias("target_std"),
        F.min(y).alias("target_min"), F.max(y).alias("target_max"),
    ).withColumn("n_windows", F.greatest(F.ceil((F.col("n_rows") - length - 1) / stride), F.lit(0)).cast("long"))
