"""Row checks, filters and cleaning of bar and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import INF, finite_or_null, safe_z
from .fill import backward_fill, fill_both, forward_fill, interpolate
from .layout import attach, with_positions
from .order_stats import exact_quantiles

OHLCV = ["open", "high", "low", "close", "volume"]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in all floating columns: the engine has one kind of missing value."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def lower_names(df: DataFrame, required=OHLCV) -> DataFrame:
    """Lower-case column names and NULL for NaN; raise if a required column is missing."""
    out = df.toDF(*[c.lower() for c in df.columns])
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return nan_to_null(out)


def broken_counts(bars: DataFrame, by=("symbol",)) -> DataFrame:
    """Rows per OHLC rule that is broken."""
    c = F.col
    return bars.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(c("high") < c("low")).alias("high_below_low"),
        F.count_if((c("high") < c("open")) | (c("high") < c("close"))).alias("high_below_price"),
        F.count_if((c("low") > c("open")) | (c("low") > c("close"))).alias("low_above_price"),
        F.count_if(c("volume") < 0).alias("negative_volume"),
    )


def assert_ohlcv(bars: DataFrame) -> DataFrame:
    """Raise if any bar breaks an OHLC rule (one aggregate row reaches the driver)."""
    missing = [c for c in OHLCV if c not in bars.columns]
    if missing:
        raise ValueError(f"Missing required OHLCV columns: {missing}")
    row = broken_counts(bars, ()).first()
    broken = [k for k, v in row.asDict().items() if k != "n_rows" and v]
    if broken:
        raise ValueError(f"Invalid OHLCV data: {broken}")
    return bars


def valid_bar():
    c = F.col
    highest = F.greatest("open", "close", "low")
    lowest = F.least("open", "close", "high")
    positive = (c("open") > 0) & (c("high") > 0) & (c("low") > 0) & (c("close") > 0)
    return (c("high") >= highest) & (c("low") <= lowest) & positive & (c("volume") >= 0)


def valid_bars(bars: DataFrame) -> DataFrame:
    return bars.where(valid_bar())


def column_scores(df: DataFrame, columns, keys=("symbol",)) -> DataFrame:
    """Add mean and population deviation of each column over its group."""
    stats = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in columns]
    )
    return attach(df, stats, list(keys))


def _far(columns, limit):
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(safe_z(F.col(c), F.col(f"_mean_{c}"), F.col(f"_sd_{c}")) > limit, F.lit(False))
    return hit


def drop_outliers(df: DataFrame, columns=OHLCV, limit: float = 5.0) -> DataFrame:
    """Drop rows where a column is more than ``limit`` population deviations out."""
    return column_scores(df, columns).where(~_far(columns, limit)).select(df.columns)


def null_outliers(df: DataFrame, columns, limit: float = 5.0, fill: bool = True) -> DataFrame:
    """Null outlying values and carry the last good value forward."""
    scored = column_scores(df, columns)
    out = scored.select(
        *[F.when(_far([c], limit), None).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns]
    )
    return forward_fill(out, columns) if fill else out


def fill_gaps(df: DataFrame, columns, method: str = "ffill") -> DataFrame:
    if method == "ffill":
        return forward_fill(df, columns)
    if method == "bfill":
        return backward_fill(df, columns)
    if method == "both":
        return fill_both(df, columns)
    if method == "interpolate":
        return interpolate(df, columns)
    if method == "drop":
        return df.dropna(subset=list(columns))
    raise ValueError(f"Unknown fill method: {method}")


def clean_bars(bars: DataFrame, limit: float = 5.0, method: str = "ffill", causal: bool = False) -> DataFrame:
    """Valid bars without outliers, gaps filled, positions renewed."""
    kept = drop_outliers(valid_bars(bars), OHLCV, limit)
    filled = fill_gaps(kept, OHLCV, method)
    if method == "ffill" and not causal:
        filled = backward_fill(filled, OHLCV)
    return with_positions(filled.drop("pos"), "year")


def cleaning_stats(bars: DataFrame, limit: float = 5.0) -> DataFrame:
    """Rows before and after each cleaning step, and the share kept, per symbol."""
    valid = bars.withColumn("_ok", valid_bar())
    kept = drop_outliers(valid.where("_ok"), OHLCV, limit)
    first = valid.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows_in"), F.count_if("_ok").alias("rows_valid"))
    last = kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows_kept"))
    out = first.join(last, "symbol", "left").fillna(0, ["rows_kept"])
    return out.withColumn("outliers_removed", F.col("rows_valid") - F.col("rows_kept")).withColumn(
        "retention", F.col("rows_kept") / F.col("rows_in")
    )


def infinities_to_null(df: DataFrame, columns=None) -> DataFrame:
    columns = columns or [n for n, t in df.dtypes if t in ("double", "float")]
    return df.select(*[finite_or_null(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def clean_features(df: DataFrame, columns, causal: bool = False) -> DataFrame:
    """Model-input clean: fill forward and backward, then medians, then 0;
    infinities become the 99th percentile of the finite values, with their sign."""
    columns = list(columns)
    out = forward_fill(df, columns) if causal else fill_both(df, columns)
    if causal:
        return out.fillna(0.0, columns)
    long = out.select("symbol", *columns).unpivot(["symbol"], columns, "feature", "value")
    finite = long.withColumn("value", finite_or_null("value"))
    stats = exact_quantiles(finite, ["symbol", "feature"], "value", {"mid": 0.5, "top": 0.99})
    wide = stats.groupBy("symbol").agg(
        *[F.max(F.when(F.col("feature") == c, F.col("mid"))).alias(f"_mid_{c}") for c in columns],
        *[F.max(F.when(F.col("feature") == c, F.col("top"))).alias(f"_top_{c}") for c in columns],
    )
    joined = attach(out, wide, ["symbol"])

    def value(c):
        x, top = F.col(c), F.col(f"_top_{c}")
        filled = F.coalesce(x, F.col(f"_mid_{c}"), F.lit(0.0))
        capped = F.when(filled == INF, F.coalesce(top, filled)).when(filled == -INF, F.coalesce(-top, filled))
        return capped.otherwise(filled).alias(c)

    return joined.select(*[value(c) if c in columns else F.col(c) for c in df.columns])


def clean_sequences(df: DataFrame, columns) -> DataFrame:
    """Model-input fill: forward, backward, then 0."""
    return fill_both(df, columns).fillna(0.0, list(columns))


def fill_median(df: DataFrame, columns) -> DataFrame:
    """Forward, backward, then the median of the column."""
    return clean_features(infinities_to_null(df, columns), columns)


def with_fallbacks(df: DataFrame, pairs={"rsi_14": "rsi", "rsi": "rsi_14"}) -> DataFrame:
    """Use the named substitute for a missing column."""
    for want, other in pairs.items():
        if want not in df.columns and other in df.columns:
            df = df.withColumn(want, F.col(other))
    return df


def zero_columns(df: DataFrame, columns) -> DataFrame:
    """Add each missing column as 0."""
    return df.select("*", *[F.lit(0.0).alias(c) for c in columns if c not in df.columns])


def normalize(df: DataFrame, column: str, method: str = "zscore", keys=("symbol",)) -> DataFrame:
    """z-score, min-max or median/MAD normalisation of a column per group."""
    keys, x, out = list(keys), F.col(column), f"{column}_norm"
    if method == "zscore":
        s = df.groupBy(*keys).agg(F.avg(x).alias("_a"), F.stddev_samp(x).alias("_b"))
    elif method == "minmax":
        s = df.groupBy(*keys).agg(F.min(x).alias("_a"), (F.max(x) - F.min(x)).alias("_b"))
    elif method == "robust":
        mid = exact_quantiles(df, keys, column, {"_a": 0.5})
        dev = attach(df, mid, keys).withColumn("_d", F.abs(x - F.col("_a")))
        s = mid.join(exact_quantiles(dev, keys, "_d", {"_b": 0.5}), keys)
    else:
        raise ValueError(f"Unknown normalization method: {method}")
    return attach(df, s, keys).withColumn(out, (x - F.col("_a")) / (F.col("_b") + F.lit(1e-10))).drop("_a", "_b")


def weekdays(spark, start: str, end: str) -> DataFrame:
    """Business-day calendar between two dates with the next business day."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS day").where(F.weekday("day") < 5)
    return days.withColumn("next_day", next_weekday(F.col("day")))


def is_weekday(day):
    return F.weekday(day) < 5


def next_weekday(day):
    jump = F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1)
    return F.date_add(day, jump)


def feature_share_check(df: DataFrame, columns, limit: float = 0.1) -> DataFrame:
    """Per symbol: expected columns present, and the share of missing values."""
    present = [c for c in columns if c in df.columns]
    cells = [F.sum(F.col(c).isNull().cast("long")) for c in present]
    total = cells[0]
    for cell in cells[1:]:
        total = total + cell
    out = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), total.alias("null_cells"))
    share = F.col("null_cells") / (F.col("n_rows") * len(present))
    return (
        out.withColumn("null_share", share)
        .withColumn("features_found", F.lit(len(present)))
        .withColumn("passed", (share <= limit) & F.lit(len(present) == len(columns)))
    )
