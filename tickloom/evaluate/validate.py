"""Data, feature, window, prediction and history checks: one row per symbol (and feature)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.aggregates import corr, issues, kurt, match_rate, share, skew
from ..functions.scalar import INF, is_inf
from ..learn.gram import pair_products
from ..operators.align import date_overlap, missing_symbols
from ..operators.clean import column_scores
from ..operators.layout import attach, attach_scalar
from ..operators.order_stats import exact_quantiles
from ..plans.core_features import CORE
from ..plans.registry import Registry

OHLCV = ["open", "high", "low", "close", "volume"]
PRICES = OHLCV[:4]


def _steps(bars: DataFrame) -> DataFrame:
    """Row-to-row change, time gap and repeated values."""
    reg = Registry(parent=CORE)
    reg.add("v", _gap=lambda f: (F.unix_seconds(f["ts"].cast("timestamp")) - F.unix_seconds(f.lag("ts").cast("timestamp"))).cast("double"),
            **{f"_same_{c}": lambda f, c=c: F.when(f[c] == f.lag(c), 1).otherwise(0) for c in PRICES})
    return reg.compute(bars, ["_gap", "daily_return", *[f"_same_{c}" for c in PRICES]], keep=OHLCV)


def _with_median_gap(steps: DataFrame) -> DataFrame:
    return attach(steps, exact_quantiles(steps, ["symbol"], "_gap", {"_mid": 0.5}), ["symbol"])


def quality_report(bars: DataFrame) -> DataFrame:
    """Rule breaks, missing values, outliers, continuity and the quality score per symbol."""
    table = column_scores(_with_median_gap(_steps(bars)), OHLCV)
    c = F.col
    far = [
        F.count_if(F.abs(F.try_divide(c(x) - c(f"_mean_{x}"), F.when(c(f"_sd_{x}") > 0, c(f"_sd_{x}")))) > 5).alias(f"{x}_outliers")
        for x in OHLCV
    ]
    out = table.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if(c("high") < c("open")).alias("_b1"), F.count_if(c("high") < c("close")).alias("_b2"),
        F.count_if(c("high") < c("low")).alias("_b3"), F.count_if(c("low") > c("open")).alias("_b4"),
        F.count_if(c("low") > c("close")).alias("_b5"), F.count_if(c("volume") < 0).alias("_b6"),
        *[F.count_if(c(p) <= 0).alias(f"_np_{p}") for p in PRICES],
        *[F.count_if(c(x).isNull()).alias(f"{x}_missing") for x in OHLCV], *far,
        F.count_if(c("_gap") > c("_mid") * 3).alias("large_gaps"),
        *[F.sum(f"_same_{p}").alias(f"_same_{p}") for p in PRICES],
    )
    n = c("total_rows")
    found = issues(
        (c("_b1") > 0, "high<open"), (c("_b2") > 0, "high<close"), (c("_b3") > 0, "high<low"),
        (c("_b4") > 0, "low>open"), (c("_b5") > 0, "low>close"), (c("_b6") > 0, "negative volume"),
        *[(c(f"_np_{p}") > 0, f"non-positive {p}") for p in PRICES],
    )
    warned = issues((c("large_gaps") > 0, "time gaps"), *[(c(f"_same_{p}") > n * 0.05, f"repeated {p}") for p in PRICES])
    missing = sum((c(f"{x}_missing") for x in OHLCV[1:]), c("open_missing")) / (n * 5) * 100
    outliers = sum((c(f"{x}_outliers") for x in OHLCV[1:]), c("open_outliers")) / n * 100 / 5
    score = 1.0 - F.size("issues") * 0.2 - F.size("warnings") * 0.05 - c("missing_pct") / 100 * 0.5 - c("outlier_pct") / 100 * 0.3
    return (
        out.withColumn("issues", found).withColumn("warnings", warned).withColumn("missing_pct", missing)
        .withColumn("outlier_pct", outliers)
        .withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
        .select("symbol", "total_rows", "first_ts", "last_ts", "issues", "warnings", "missing_pct", "outlier_pct",
                "large_gaps", "quality_score")
    )


def raw_checks(bars: DataFrame, extreme: float = 0.5, gap: float = 7.0) -> DataFrame:
    """OHLC breaks, non-positive values, extreme moves and large gaps per symbol."""
    c = F.col
    out = _with_median_gap(_steps(bars)).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if((c("high") < c("low")) | (c("high") < c("open")) | (c("high") < c("close"))
                   | (c("low") > c("open")) | (c("low") > c("close"))).alias("invalid_ohlc"),
        *[F.count_if(c(x) <= 0).alias(f"bad_{x}") for x in OHLCV],
        F.count_if(F.abs("daily_return") > extreme).alias("extreme_moves"),
        F.count_if(c("_gap") > c("_mid") * gap).alias("large_gaps"),
    )
    found = issues((c("invalid_ohlc") > 0, "ohlc"), *[(c(f"bad_{x}") > 0, f"non-positive {x}") for x in OHLCV],
                   (c("extreme_moves") > 0, "extreme moves"), (c("large_gaps") > 0, "time gaps"))
    return out.withColumn("issues", found).withColumn("is_valid", F.size("issues") == 0)


def feature_moments(df: DataFrame, features, by=("symbol",)) -> DataFrame:
    """Per group and feature: counts, infinities, moments and range."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(list(by), list(features), "feature", "value")
    v = F.when(~is_inf("value"), F.col("value"))
    return long.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("nan_count"),
        F.count_if(is_inf("value")).alias("inf_count"), F.count(v).alias("n_known"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("lowest"), F.max(v).alias("highest"),
        skew(v).alias("skewness"), kurt(v).alias("kurtosis"), F.count_if(v == 0).alias("zeros"),
    )


def outlier_counts(df: DataFrame, features, limit: float, by=("symbol",)) -> DataFrame:
    """Values beyond ``limit`` sample deviations, per group and feature."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(list(by), list(features), "feature", "value")
    stats = long.groupBy(*by, "feature").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = F.abs(F.try_divide(F.col("value") - F.col("_m"), F.when(F.col("_s") > 0, F.col("_s"))))
    return attach(long, stats, [*by, "feature"]).groupBy(*by, "feature").agg(F.count_if(z > limit).alias("outliers"))


def pair_correlations(df: DataFrame, features, by=("symbol",)) -> DataFrame:
    """Correlation of every pair of features over the rows where both are known; NULL where one is flat.

    All pairs come from the products of one pass, whatever their number.
    """
    features = list(features)
    rows, names = pair_products(df, features, by), F.array(*[F.lit(f) for f in features])
    n = F.when(F.col("n") > 0, F.col("n"))
    spread = {}
    for side in "ij":
        mean, square = F.col(f"s{side}") / n, F.col(f"q{side}") / n
        var = square - mean * mean
        spread[side] = F.when((var > 1e-20) & (var > square * 1e-14), F.sqrt(var))
    shared = F.col("p") / n - F.col("si") / n * (F.col("sj") / n)
    value = F.greatest(F.least(shared / (spread["i"] * spread["j"]), F.lit(1.0)), F.lit(-1.0))
    known = spread["i"].isNotNull() & spread["j"].isNotNull()
    return rows.select(*by, names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.when(known, value).alias("corr"))


def correlated_features(df: DataFrame, features, limit: float = 0.95, by=("symbol",)) -> DataFrame:
    return pair_correlations(df, features, by).where(F.abs("corr") > limit)


def feature_checks(df: DataFrame, features, max_null: float = 0.05, limit: float = 6.0, max_corr: float = 0.95) -> DataFrame:
    """Per symbol: features with nulls, infinities, no variance, outliers, skew; correlated pairs."""
    m = feature_moments(df, features).join(outlier_counts(df, features, limit), ["symbol", "feature"])
    c = F.col
    out = m.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_features"),
        F.count_if(c("nan_count") > c("n_rows") * max_null).alias("nan_features"),
        F.count_if(c("inf_count") > 0).alias("infinite_features"),
        F.count_if((c("lowest") == c("highest")) | (c("n_known") == 0)).alias("constant_features"),
        F.count_if(c("outliers") > 0).alias("outlier_features"),
        F.count_if(F.abs("skewness") > 3).alias("skewed_features"),
    )
    pairs = correlated_features(df, features, max_corr).groupBy("symbol").agg(F.count(F.lit(1)).alias("correlated_pairs"))
    out = out.join(pairs, "symbol", "left").fillna(0, ["correlated_pairs"])
    found = issues(
        (c("nan_features") > 0, "nulls"), (c("infinite_features") > 0, "infinite"), (c("constant_features") > 0, "constant"),
        (c("outlier_features") > 0, "outliers"), (c("correlated_pairs") > 0, "correlated"),
        (c("skewed_features") > c("total_features") * 0.5, "skewed"),
    )
    return out.withColumn("issues", found).withColumn("is_valid", F.size("issues") == 0)


def window_checks(windows: DataFrame, target: str) -> DataFrame:
    """Null, infinite and flat windows and extreme targets per symbol."""
    y = F.col(target)
    bad = lambda test: F.exists("window", lambda r: F.exists(r, test))
    rows = F.col("window")
    lows = F.reduce(rows, rows[0], lambda a, r: F.zip_with(a, r, lambda x, y: F.least(x, y)))
    highs = F.reduce(rows, rows[0], lambda a, r: F.zip_with(a, r, lambda x, y: F.greatest(x, y)))
    flat = F.zip_with(lows, highs, lambda a, b: a == b)
    marked = windows.select(
        "symbol", y.alias("_y"), F.size("window").alias("_len"), bad(lambda v: v.isNull()).alias("_null"),
        bad(lambda v: F.abs(v) == INF).alias("_inf"), F.forall(flat, lambda v: v).alias("_allflat"),
        F.exists(flat, lambda v: v).alias("_anyflat"),
    )
    cuts = exact_quantiles(marked, ["symbol"], "_y", {"_p1": 0.01, "_p99": 0.99})
    out = attach(marked, cuts, ["symbol"]).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_distinct("_len").alias("lengths"),
        F.count_if("_null").alias("nan_windows"), F.count_if("_inf").alias("inf_windows"),
        F.count_if("_allflat").alias("flat_windows"), F.count_if("_anyflat").alias("partly_flat_windows"),
        F.stddev_pop("_y").alias("target_std"),
        F.count_if(((F.col("_p1") != 0) & (F.col("_y") < F.col("_p1") * 10))
                   | ((F.col("_p99") != 0) & (F.col("_y") > F.col("_p99") * 10))).alias("extreme_low_high"),
        F.count_if((F.col("_y") < 0) | (F.col("_y") > 1)).alias("_outside"), F.min("_y").alias("_lo"), F.max("_y").alias("_hi"),
    )
    c = F.col
    score_like = (c("_lo") >= 0) & (c("_hi") <= 1) & (c("_hi") - c("_lo") > 0.3)
    out = out.withColumn("extreme_targets", F.when(score_like, c("_outside")).otherwise(c("extreme_low_high")))
    found = issues(
        (c("lengths") > 1, "lengths"), (c("nan_windows") > 0, "nulls"), (c("inf_windows") > 0, "infinite"),
        (c("flat_windows") > c("n_windows") * 0.1, "flat"), (c("target_std") == 0, "constant target"),
        ((c("target_std") > 0) & (c("target_std") < 1e-6), "low target variance"), (c("extreme_targets") > 0, "extreme targets"),
    )
    return out.withColumn("issues", found).withColumn("is_valid", F.size("issues") == 0).drop("extreme_low_high", "_outside", "_lo", "_hi")


def prediction_checks(predictions: DataFrame, min_direction: float = 45.0) -> DataFrame:
    t, p = F.col("y_true"), F.col("y_pred")
    out = predictions.groupBy("symbol").agg(
        F.count_if(p.isNull()).alias("nan_predictions"), F.count_if(is_inf(p)).alias("inf_predictions"),
        F.stddev_pop(p).alias("prediction_std"),
        (F.coalesce(match_rate(t, p, t != 0), F.lit(0.5)) * 100).alias("directional_accuracy"),
        F.coalesce(corr(t, p, 1e-10), F.lit(0.0)).alias("correlation"), F.avg(F.abs(t - p)).alias("mae"),
        (F.max(t) - F.min(t)).alias("_tr"), (F.max(p) - F.min(p)).alias("_pr"),
    )
    c = F.col
    found = issues(
        (c("nan_predictions") > 0, "nulls"), (c("inf_predictions") > 0, "infinite"), (c("prediction_std") == 0, "identical"),
        ((c("prediction_std") > 0) & (c("prediction_std") < 1e-6), "low variance"),
        ((c("_tr") > 0) & (c("_pr") > c("_tr") * 10), "range"), (c("directional_accuracy") < min_direction, "direction"),
        (F.abs("correlation") < 0.1, "correlation"),
    )
    return out.withColumn("issues", found).withColumn("is_valid", F.size("issues") == 0).drop("_tr", "_pr")


def history_checks(history: DataFrame) -> DataFrame:
    """Training-history rules per run (symbol, epoch, loss, val_loss)."""
    loss, val, epoch = F.col("loss"), F.col("val_loss"), F.col("epoch")
    sizes = history.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    recent = F.when(epoch >= F.col("_n") - 10, loss)
    known = F.when(loss.isNotNull(), epoch)
    out = attach(history, sizes, ["symbol"]).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("epochs"), F.min_by(loss, known).alias("initial_loss"), F.max_by(loss, known).alias("final_loss"),
        F.max(loss).alias("max_loss"), F.count_if(loss.isNull()).alias("nan_losses"), F.avg(recent).alias("_rm"),
        F.stddev_pop(recent).alias("_rs"), F.avg(val - loss).alias("train_val_gap"), F.avg(loss).alias("_mean"),
    )
    c = F.col
    found = issues(
        ((c("initial_loss") > 0) & (c("final_loss") > c("initial_loss") * 5), "explosion"),
        ((c("initial_loss") > 0) & (c("max_loss") > c("initial_loss") * 10), "spike"), (c("nan_losses") > 0, "nulls"),
        ((c("epochs") >= 10) & (c("_rm") > 0) & (c("_rs") > c("_rm") * 0.5), "unstable"),
        ((c("_mean") > 0) & (c("train_val_gap") > c("_mean") * 2), "overfit"),
    )
    return out.withColumn("issues", found).withColumn("is_valid", F.size("issues") == 0).drop("_rm", "_rs", "_mean")


def summary(*checks: DataFrame) -> DataFrame:
    """Overall verdict and issue count over check tables with issues and is_valid."""
    rows = [c.select("issues", "is_valid") for c in checks]
    table = rows[0]
    for r in rows[1:]:
        table = table.unionByName(r)
    return table.agg(F.sum(F.size("issues")).alias("total_issues"),
                     F.when(F.bool_and("is_valid"), "PASS").otherwise("FAIL").alias("overall_status"))


def verdict(checks: DataFrame) -> DataFrame:
    """PASS unless an issue exists that is not a warning."""
    hard = F.exists("issues", lambda v: ~v.startswith("Warning"))
    return checks.select("symbol", F.when(hard, "FAIL").otherwise("PASS").alias("verdict"), F.size("issues").alias("n_issues"))


def column_checks(df: DataFrame, columns) -> DataFrame:
    m = feature_moments(df, columns)
    return m.select(
        "symbol", "feature", "nan_count", "inf_count",
        (F.abs(F.col("highest") - F.col("lowest")) < 1e-10).alias("low_variance"),
    )


# -- portfolio -------------------------------------------------------------------
def pattern_readiness(bars: DataFrame, min_rows: int = 100) -> DataFrame:
    table = column_scores(_with_median_gap(_steps(bars)), OHLCV)
    c = F.col
    far = [F.count_if(F.abs(F.try_divide(c(x) - c(f"_mean_{x}"), F.when(c(f"_sd_{x}") > 0, c(f"_sd_{x}")))) > 5).alias(f"_o_{x}") for x in OHLCV]
    out = table.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(c("_gap") > c("_mid") * 5).alias("large_gaps"), *far)
    warned = issues((c("large_gaps") > c("n_rows") * 0.05, "time gaps"), *[(c(f"_o_{x}") > c("n_rows") * 0.01, f"outliers {x}") for x in OHLCV])
    return out.select("symbol", "n_rows", "large_gaps", warned.alias("warnings"), (c("n_rows") >= min_rows).alias("pattern_ready"))


def return_distributions(bars: DataFrame) -> DataFrame:
    """Return moments per symbol; divergent when the skew is over twice the 90th percentile of all."""
    r = F.col("daily_return")
    stats = CORE.compute(bars, ["daily_return"]).groupBy("symbol").agg(
        F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), skew(r).alias("skew"), kurt(r).alias("kurtosis"), F.count(r).alias("n")
    )
    cut = exact_quantiles(stats.select(F.lit(1).alias("g"), F.abs("skew").alias("a")), ["g"], "a", {"_cut": 0.9}).select("_cut")
    return stats.transform(attach_scalar, cut).withColumn("divergent", F.coalesce(F.abs("skew") > F.col("_cut") * 2, F.lit(False))).drop("_cut")


def range_advice(bars: DataFrame) -> DataFrame:
    day = F.to_date("ts")
    out = bars.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    span = F.datediff("last_day", "first_day")
    return out.withColumn("span_days", span).withColumn("before_2010", F.col("first_day") < F.lit("2010-01-01").cast("date")).withColumn(
        "very_long", span > 365 * 15)


def cross_consistency(bars: DataFrame, min_overlap: float = 0.8) -> DataFrame:
    low = date_overlap(bars).agg(F.coalesce(F.min("overlap"), F.lit(1.0)).alias("min_overlap"))
    div = return_distributions(bars).agg(F.count_if("divergent").alias("divergent_symbols"))
    return low.transform(attach_scalar, div).withColumn("consistent", F.col("min_overlap") >= min_overlap)


def portfolio_check(bars: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """Verdict over all symbols: quality, pattern readiness, required symbols, overlap."""
    per = quality_report(bars).select("symbol", "quality_score").join(pattern_readiness(bars).select("symbol", "pattern_ready"), "symbol")
    ok = (F.col("quality_score") > 0.5) & F.col("pattern_ready")
    out = per.agg(F.count(F.lit(1)).alias("total_tickers"), F.count_if(~ok).alias("failed_tickers")).transform(attach_scalar, cross_consistency(bars).select("consistent"))
    gone = (missing_symbols(bars, required) if required is not None else bars.select("symbol").limit(0)).agg(
        F.count(F.lit(1)).alias("missing_tickers"))
    return out.transform(attach_scalar, gone).withColumn(
        "overall_valid", (F.col("failed_tickers") == 0) & F.col("consistent") & (F.col("missing_tickers") == 0))


def portfolio_summary(bars: DataFrame) -> DataFrame:
    r = F.col("daily_return")
    return CORE.compute(bars, ["daily_return"], keep=["close"]).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg(r).alias("mean_return"),
        F.stddev_samp(r).alias("std_return"), F.min("close").alias("min_close"), F.max("close").alias("max_close"),
        share(r.isNull()).alias("null_share"))


# -- pattern features by category -----------------------------------------------------
def category_checks(df: DataFrame, groups: dict) -> DataFrame:
    """Per symbol and feature: rule breaks of its category."""
    category = F.create_map(*[F.lit(v) for g, names in groups.items() for n in names for v in (n, g)])
    names = [n for g in groups.values() for n in g if n in df.columns]
    m = feature_moments(df, names).withColumn("category", category[F.col("feature")])
    c = F.col
    cv = F.try_divide(c("std"), F.abs(c("mean") + 1e-8))
    zero = F.try_divide(c("zeros"), F.when(c("n_known") > 0, c("n_known")))
    f = lambda n: c("feature") == n
    g = lambda n: c("category") == n
    found = issues(
        (c("n_known") == 0, "no data"), (g("temporal_dependencies") & (c("n_known") < 30), "too few rows"),
        (g("nonlinear_price_patterns") & (c("std") > 0) & (cv > 10), "very high variability"),
        (g("nonlinear_price_patterns") & (c("std") > 0) & (cv < 0.01), "very low variability"),
        (f("intraday_range_expansion") & (c("lowest") < 0), "negative range"),
        (f("intraday_range_expansion") & (c("lowest") >= 0) & (c("highest") > 20), "very high range"),
        (f("overnight_gap_behavior") & (F.greatest(F.abs("highest"), F.abs("lowest")) > 0.5), "very large gaps"),
        (f("end_of_day_momentum") & ((c("lowest") < 0) | (c("highest") > 1)), "outside 0-1"),
        (g("cross_asset_relationships") & (zero > 0.9), "mostly zeros"),
        (g("cross_asset_relationships") & (zero > 0.5) & (zero <= 0.9), "many zeros"),
        (c("n_known").between(1, 9), "few values"),
    )
    return m.select("symbol", "feature", "category", "n_known", cv.alias("coefficient_of_variation"), zero.alias("zero_ratio"), found.alias("issues"))


def distribution_report(df: DataFrame, features) -> DataFrame:
    m = feature_moments(df, features).join(outlier_counts(df, features, 3.0), ["symbol", "feature"])
    return m.select("symbol", "feature", "mean", "std", "skewness", "kurtosis", "lowest", "highest", "outliers",
                    (F.col("outliers") / F.col("n_known")).alias("outlier_ratio"))


# -- training checks ---------------------------------------------------------------
def target_construction(df: DataFrame) -> DataFrame:
    """Stored return against the price change, per symbol, and the spread of means."""
    reg = Registry()
    reg.add("v", _again=lambda f: f.pct("close"))
    r = F.col("daily_return")
    out = reg.compute(df, ["_again"], keep=["daily_return"]).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.min(r).alias("lowest"),
        F.max(r).alias("highest"), F.count_if(r.isNull()).alias("nan_count"), corr(r, "_again").alias("match_corr"))
    c = F.col
    spread = out.agg((F.max("mean") - F.min("mean")).alias("_spread"))
    found = issues((F.abs("mean") > 0.01, "high mean"), (c("std") > 0.1, "high volatility"), (c("nan_count") > 0, "nulls"),
                   (c("match_corr") < 0.99, "mismatch"), (c("_spread") > 0.005, "means differ"))
    return out.transform(attach_scalar, spread).withColumn("issues", found).drop("_spread")


def scaling_checks(df: DataFrame, features, by=("symbol",)) -> DataFrame:
    m = feature_moments(df, features, by).withColumn("sd", F.col("std") * F.sqrt((F.col("n_known") - 1) / F.col("n_known")))
    c = F.col
    found = issues((F.abs("mean") > 2, "mean"), ((c("sd") > 5) | (c("sd") < 0.1), "std"),
                   ((F.abs("lowest") > 10) | (F.abs("highest") > 10), "range"), (c("nan_count") > 0, "nulls"))
    return m.select(*by, "feature", "mean", c("sd").alias("std"), "lowest", "highest", "nan_count", found.alias("issues"))


def prediction_behaviour(predictions: DataFrame, by=("symbol",)) -> DataFrame:
    t, p = F.col("y_true"), F.col("y_pred")
    out = predictions.groupBy(*by).agg(
        F.avg(t).alias("true_mean"), F.stddev_pop(t).alias("true_std"), F.avg(p).alias("pred_mean"), F.stddev_pop(p).alias("pred_std"),
        corr(t, p).alias("correlation"), match_rate(t, p).alias("directional_accuracy"))
    c = F.col
    found = issues(
        (c("pred_std") < c("true_std") * 0.1, "near constant"), (c("pred_std") > c("true_std") * 3, "excess variance"),
        (F.abs(c("pred_mean") - c("true_mean")) > F.abs("true_mean") * 2, "biased"), (c("correlation").isNull(), "no correlation"),
        (c("correlation") < 0.01, "low correlation"), (c("directional_accuracy") < 0.52, "random direction"))
    return out.withColumn("issues", found)


def training_suite(df: DataFrame, features) -> DataFrame:
    """Issue counts of the target and the scaling checks per symbol."""
    a = target_construction(df).select("symbol", F.size("issues").alias("target_issues"))
    b = scaling_checks(df, features).groupBy("symbol").agg(F.sum(F.size("issues")).alias("scaling_issues"))
    return a.join(b, "symbol").withColumn("passed", (F.col("target_issues") + F.col("scaling_issues")) == 0)


# -- strategies -----------------------------------------------------------------------
def strategy_data_check(df: DataFrame, needs, min_rows: int = 252, as_of=None, max_age_days: int = 30) -> DataFrame:
    needs = list(dict.fromkeys(needs))
    coverage = len([c for c in needs if c in df.columns]) / len(needs)
    out = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("data_points"), F.max("ts").alias("last_ts"))
    now = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    out = out.withColumn("age_days", F.datediff(now, F.to_date("last_ts"))).withColumn("feature_coverage", F.lit(coverage))
    found = issues((F.col("data_points") < min_rows, "too few rows"), (F.col("age_days") > max_age_days, "Warning: stale"),
                   (F.lit(coverage) < 1.0, "missing features"))
    return out.withColumn("issues", found)


def signal_check(signals: DataFrame, unit: float = 1.0) -> DataFrame:
    """Legal positions and a frequency between 1% and 50% (unit: size of a full position)."""
    p = F.col("position")
    out = signals.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_signals"), F.count_if(p != 0).alias("non_zero_signals"),
        F.avg((p != 0).cast("double")).alias("signal_frequency"), F.count_if(p.isNull()).alias("nan_positions"),
        F.count_if(~p.isin(-unit, 0.0, unit)).alias("invalid_positions"))
    c = F.col
    found = issues(
        (c("invalid_positions") > 0, "invalid positions"), (c("signal_frequency") == 0, "no signals"),
        (c("signal_frequency") > 0.5, "high frequency"), ((c("signal_frequency") > 0) & (c("signal_frequency") < 0.01), "low frequency"),
        (c("nan_positions") > c("total_signals") * 0.1, "null positions"))
    return out.withColumn("issues", found)


def diversity_check(pairs: DataFrame, limit: float = 0.8) -> DataFrame:
    out = pairs.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.abs("corr") > limit).alias("high_pairs"))
    return out.withColumn("diverse", F.col("high_pairs") == 0)


def backtest_readiness(df: DataFrame, needs, min_days: int = 252) -> DataFrame:
    """Raw checks, feature checks, length and span per symbol."""
    raw = raw_checks(df).select("symbol", F.size("issues").alias("raw_issues"))
    feat = feature_checks(df, [c for c in dict.fromkeys(needs) if c in df.columns]).select("symbol", F.size("issues").alias("feature_issues"))
    span = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.datediff(F.max("ts"), F.min("ts")).alias("span_days"))
    out = raw.join(feat, "symbol").join(span, "symbol")
    return out.withColumn("ready", (F.col("raw_issues") + F.col("feature_issues") == 0) & (F.col("n_rows") >= min_days) & (F.col("span_days") >= min_days))
