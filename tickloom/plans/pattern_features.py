"""Pattern features: the nineteen model inputs, and the earlier twelve."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import fdiv, guarded
from ..operators.clean import clean_bars, clean_features, zero_columns
from ..operators.fill import asof_join
from ..operators.layout import attach, with_positions
from ..session import materialize
from .core_features import CORE
from .registry import Registry

PATTERN = Registry(parent=CORE)
PATTERN_SET = Registry(parent=CORE)

TINY = 1e-8
GARCH_WARMUP = 20
GARCH = {"alpha": 0.1, "beta": 0.85}

PATTERN.add(
    "price_patterns",
    _mean5=lambda f: f.mean("daily_return", 5),
    price_acceleration=lambda f: f.diff("_mean5"),
    volume_price_divergence=lambda f: fdiv(f["volume"], f.mean("volume", 20)) * -f.mean("daily_return", 20),
    _std20=lambda f: f.std("daily_return", 20),
    volatility_regime_change=lambda f: guarded(f["_std20"] - f.mean("_std20", 60), f.mean("_std20", 60), TINY),
    return_skewness_7d=lambda f: f.skew("daily_return", 7),
)
PATTERN.add(
    "temporal",
    _direction=lambda f: F.signum(f["_mean5"]),
    _directions=lambda f: f.window_list("_direction", -6, 0),
    momentum_persistence_7d=lambda f: F.when(
        F.size(f["_directions"]) == 7,
        F.size(F.filter(f["_directions"], lambda v: v == F.element_at("_directions", -1))),
    ).cast("double"),
    _abs_return=lambda f: F.abs(f["daily_return"]),
    volatility_clustering=lambda f: guarded(f.mean("_abs_return", 5), f.mean("_abs_return", 20), TINY),
    trend_exhaustion=lambda f: guarded(F.abs(f.mean("daily_return", 10)), f.std("daily_return", 10), TINY),
    _ret0=lambda f: F.coalesce(f["daily_return"], F.lit(0.0)),
    _ret0_sq=lambda f: f["_ret0"] * f["_ret0"],
)
PATTERN.running("temporal", "_ret_sum", "_ret0")
PATTERN.running("temporal", "_ret_sq_sum", "_ret0_sq")


def _expanding_var(f, total, squares, n, ddof):
    """Variance of all earlier rows from running sums, n values long."""
    s, q = f.lag(total), f.lag(squares)
    return F.greatest(F.try_divide(q - F.try_divide(s * s, n), n - ddof), F.lit(0.0))


PATTERN.add(
    "temporal",
    _garch_in=lambda f: F.when(
        f["pos"] >= GARCH_WARMUP,
        GARCH["alpha"] * f.lag("_ret0_sq")
        + (1 - GARCH["alpha"] - GARCH["beta"])
        * _expanding_var(f, "_ret_sum", "_ret_sq_sum", (f["pos"] - 1).cast("double"), 1),
    ),
    _garch_body=lambda f: f.recurrence("_garch_in", GARCH["beta"]),
    garch_volatility_forecast=lambda f: F.when(
        f["pos"] >= GARCH_WARMUP,
        F.sqrt(f["_garch_body"] + F.pow(F.lit(GARCH["beta"]), f["pos"] - GARCH_WARMUP + 1) * f["_ret_var"]),
    ),
)
PATTERN.add(
    "microstructure",
    _range=lambda f: f["high"] - f["low"],
    intraday_range_expansion=lambda f: guarded(f["_range"], f.mean("_range", 20), TINY),
    overnight_gap_behavior=lambda f: fdiv(f["open"] - f.lag("close"), f.lag("close")),
    end_of_day_momentum=lambda f: guarded(f["close"] - f["low"], f["high"] - f["low"], TINY),
)


def _beta(f, stock, market, n, least):
    """Sample covariance over population variance of complete pairs."""
    a, b = f._pair(stock, market)
    get = lambda agg: f.over(agg, -(n - 1))
    live = (get(F.count(f[stock])) >= n) & (get(F.count(b)) >= least) & (get(F.max(b)) > get(F.min(b)))
    return F.when(live, F.try_divide(get(F.covar_samp(a, b)), get(F.var_pop(b))))


PATTERN.add(
    "cross_asset",
    sector_relative_strength=lambda f: f.mean("daily_return", 20) - f["sector_mean20"],
    _beta60=lambda f: _beta(f, "daily_return", "market_return", 60, 10),
    market_beta_instability=lambda f: f.std("_beta60", 20),
    vix_term_structure=lambda f: f["vix_slope"],
)
PATTERN.add(
    "context",
    returns_1d=lambda f: f["daily_return"],
    returns_3d=lambda f: f.pct("close", 3),
    returns_7d=lambda f: f.pct("close", 7),
    volume_normalized=lambda f: guarded(f["volume"], f.mean("volume", 20), TINY),
)

PATTERN_COLUMNS = [
    "price_acceleration", "volume_price_divergence", "volatility_regime_change", "return_skewness_7d",
    "momentum_persistence_7d", "volatility_clustering", "trend_exhaustion", "garch_volatility_forecast",
    "intraday_range_expansion", "overnight_gap_behavior", "end_of_day_momentum",
    "sector_relative_strength", "market_beta_instability", "vix_term_structure",
    "returns_1d", "returns_3d", "returns_7d", "volume_normalized", "close",
]
# Importance labels and named groups of the nineteen features.
IMPORTANCE = {
    "high": ["price_acceleration", "volatility_clustering", "momentum_persistence_7d",
             "garch_volatility_forecast", "returns_1d"],
    "medium": ["volume_price_divergence", "volatility_regime_change", "trend_exhaustion",
               "intraday_range_expansion", "overnight_gap_behavior", "end_of_day_momentum",
               "return_skewness_7d", "returns_3d", "returns_7d", "volume_normalized"],
    "low": ["sector_relative_strength", "market_beta_instability", "vix_term_structure", "close"],
}
GROUPS = {
    "nonlinear_price_patterns": PATTERN_COLUMNS[0:4],
    "temporal_dependencies": PATTERN_COLUMNS[4:8],
    "market_microstructure": PATTERN_COLUMNS[8:11],
    "cross_asset_relationships": PATTERN_COLUMNS[11:14],
    "core_context": PATTERN_COLUMNS[14:19],
}


def feature_catalog(spark) -> DataFrame:
    """One row per feature: name, group and importance label."""
    label = {n: k for k, names in IMPORTANCE.items() for n in names}
    group = {n: g for g, names in GROUPS.items() for n in names}
    rows = [(n, group[n], label[n]) for n in PATTERN_COLUMNS]
    return spark.createDataFrame(rows, "feature string, feature_group string, importance string")


def select_by_importance(df: DataFrame, level: str) -> DataFrame:
    return df.select("symbol", "ts", *IMPORTANCE[level])


def external_inputs(market=None, sectors=None, vix=None) -> dict[str, bool]:
    """Which outside inputs are available; absent ones make their feature 0."""
    return {"market": market is not None, "sector": sectors is not None, "vix": vix is not None}


def benchmark_bars(bars: DataFrame, by=()) -> DataFrame:
    """Equal-weight mean close per time (and sector): a stand-in for an index."""
    by = list(by)
    series = bars.groupBy(*by, "ts").agg(F.avg("close").alias("close"), F.sum("volume").alias("volume"))
    symbol = F.col(by[0]) if by else F.lit("benchmark")
    return with_positions(series.withColumn("symbol", symbol), "year")


def return_variance(bars: DataFrame, seed: str = "full") -> DataFrame:
    """Variance that starts the forecast: of the whole series, or of the warm-up rows only."""
    returns = CORE.compute(bars, ["daily_return"])
    if seed == "warmup":
        returns = returns.where(F.col("pos") < GARCH_WARMUP)
    return returns.groupBy("symbol").agg(F.var_samp("daily_return").alias("_ret_var"))


def attach_inputs(bars: DataFrame, market=None, sectors=None, vix=None, seed: str = "full") -> DataFrame:
    """Join benchmark, sector and volatility-index inputs to the bars.

    market: (ts, close); sectors: (sector, ts, close), bars need a sector column;
    vix: (ts, vix9d, vix), joined as of each bar.
    """
    out = attach(bars, return_variance(bars, seed), ["symbol"])
    if market is not None:
        returns = CORE.compute(with_positions(market.withColumn("symbol", F.lit("market")), "year"), ["daily_return"])
        out = attach(out, returns.select("ts", F.col("daily_return").alias("market_return")), ["ts"])
    if sectors is not None:
        series = with_positions(sectors.withColumn("symbol", F.col("sector")).drop("sector"), "year")
        mean20 = SECTOR.compute(series, ["sector_mean20"])
        out = attach(out, mean20.select(F.col("symbol").alias("sector"), "ts", "sector_mean20"), ["sector", "ts"])
    if vix is not None:
        slope = vix.select("ts", (F.col("vix9d") - F.col("vix")).alias("vix_slope"))
        out = asof_join(out, slope, ["vix_slope"], span="year")
    return out


SECTOR = Registry(parent=CORE)
SECTOR.add("sector", sector_mean20=lambda f: f.mean("daily_return", 20))

NEEDS = {"sector_relative_strength": "sector_mean20", "market_beta_instability": "market_return",
         "vix_term_structure": "vix_slope"}


def pattern_features(bars: DataFrame, market=None, sectors=None, vix=None, seed: str = "full",
                     columns=PATTERN_COLUMNS, keep=()) -> DataFrame:
    """The pattern features of all symbols in one plan (not cleaned)."""
    ready = materialize(attach_inputs(bars, market, sectors, vix, seed))
    columns = list(columns)
    wanted = [c for c in columns if c != "close" and NEEDS.get(c, "close") in ready.columns]
    keep = list(dict.fromkeys([*keep, *(["close"] if "close" in columns else [])]))
    out = zero_columns(PATTERN.compute(ready, wanted, keep=keep), columns)
    return out.select("symbol", "ts", "pos", *[k for k in keep if k != "close"], *columns)


def pattern_matrix(bars: DataFrame, market=None, sectors=None, vix=None, seed: str = "full",
                   causal: bool = False, keep=()) -> DataFrame:
    """Clean the bars, build the features of all symbols, clean the features."""
    cleaned = materialize(clean_bars(bars, causal=causal))
    features = materialize(pattern_features(cleaned, market, sectors, vix, seed, keep=keep))
    return clean_features(features, PATTERN_COLUMNS, causal=causal)


# -- the earlier twelve -----------------------------------------------------
PATTERN_SET.add(
    "momentum",
    price_momentum_5d=lambda f: F.coalesce(f.pct("close", 5) * 100, F.lit(0.0)),
    price_momentum_20d=lambda f: F.coalesce(f.pct("close", 20) * 100, F.lit(0.0)),
    volume_momentum=lambda f: (fdiv(f["volume"], f.mean("volume", 20)) - 1) * 100,
)
PATTERN_SET.add(
    "volatility",
    _log0=lambda f: F.coalesce(f["_log_return"], F.lit(0.0)),
    _log0_sq=lambda f: f["_log0"] * f["_log0"],
    _log0_abs=lambda f: F.abs(f["_log0"]),
    _vol20=lambda f: f.std("_log0", 20),
    volatility_regime=lambda f: fdiv(f["_vol20"] - f.mean("_vol20", 60), f.std("_vol20", 60)),
    volatility_clustering=lambda f: fdiv(f.mean("_log0_abs", 5), f.mean("_log0_abs", 20)),
)
PATTERN_SET.running("volatility", "_log_sum", "_log0")
PATTERN_SET.running("volatility", "_log_sq_sum", "_log0_sq")
PATTERN_SET.add(
    "volatility",
    _signal_in=lambda f: F.when(f["pos"] == GARCH_WARMUP - 1, f.over(F.var_pop(f["_log0"]), -GARCH_WARMUP + 1)).when(
        f["pos"] >= GARCH_WARMUP,
        GARCH["alpha"] * f.lag("_log0_sq")
        + (1 - GARCH["alpha"] - GARCH["beta"])
        * _expanding_var(f, "_log_sum", "_log_sq_sum", f["pos"].cast("double"), 0),
    ),
    garch_variance=lambda f: F.when(f["pos"] >= GARCH_WARMUP, f.recurrence("_signal_in", GARCH["beta"])).otherwise(0.0),
)
PATTERN_SET.add(
    "price",
    gap_analysis=lambda f: F.coalesce((fdiv(f["open"], f.lag("close")) - 1) * 100, F.lit(0.0)),
    _top=lambda f: f.agg(F.max("high"), "high", -20, -1),
    _bottom=lambda f: f.agg(F.min("low"), "low", -20, -1),
    support_resistance=lambda f: F.when(f["_top"].isNull(), 0.0)
    .when(f["_top"] == f["_bottom"], 50.0)
    .otherwise(fdiv(f["close"] - f["_bottom"], f["_top"] - f["_bottom"]) * 100),
    trend_strength=lambda f: F.coalesce(fdiv(f.slope("close", 20, lo=-20), f["close"]) * 100, F.lit(0.0)),
)


def _seeded(f, value, n, at, alpha):
    """Recursive mean that starts at row ``at`` with the simple mean of n values."""
    start = f.mean(value, n)
    return f.ewm_recursive(F.when(f["pos"] == at, start).when(f["pos"] > at, f[value]), alpha)


def _wilder_input(f, value):
    return F.when(f["pos"] == 14, f.mean(value, 14)).when(f["pos"] > 14, f[value])


PATTERN_SET.add(
    "technical",
    _up=lambda f: F.greatest(f.diff("close"), F.lit(0.0)) + 0 * f.diff("close"),
    _down=lambda f: F.greatest(-f.diff("close"), F.lit(0.0)) + 0 * f.diff("close"),
    _up_in=lambda f: _wilder_input(f, "_up"),
    _down_in=lambda f: _wilder_input(f, "_down"),
    _up_mean=lambda f: f.ewm_recursive("_up_in", 1.0 / 14),
    _down_mean=lambda f: f.ewm_recursive("_down_in", 1.0 / 14),
    _wilder_rsi=lambda f: F.when(
        f["pos"] >= 14,
        F.coalesce(fdiv(100.0 * f["_up_mean"], f["_up_mean"] + f["_down_mean"]), F.lit(0.0)),
    ),
    rsi_divergence=lambda f: F.when(f["pos"] < 10, 0.0).otherwise(
        f.pct("close", 10) * -(f.diff("_wilder_rsi", 10) / 100.0) * 100.0
    ),
    _fast_in=lambda f: F.when(f["pos"] == 25, f.mean("close", 12)).when(f["pos"] > 25, f["close"]),
    _slow_in=lambda f: F.when(f["pos"] == 25, f.mean("close", 26)).when(f["pos"] > 25, f["close"]),
    _line=lambda f: f.ewm_recursive("_fast_in", 2.0 / 13) - f.ewm_recursive("_slow_in", 2.0 / 27),
    _signal_seed=lambda f: F.when(f["pos"] == 33, f.mean("_line", 9)).when(f["pos"] > 33, f["_line"]),
    _histogram=lambda f: f["_line"] - f.ewm_recursive("_signal_seed", 2.0 / 10),
    macd_momentum=lambda f: F.coalesce(f.diff("_histogram", 5), F.lit(0.0)),
    _band=lambda f: f.std_pop("close", 20),
    bollinger_position=lambda f: F.when(f["_band"].isNull(), 0.0)
    .when(f["_band"] == 0, 50.0)
    .otherwise(fdiv(f["close"] - (f.mean("close", 20) - 2 * f["_band"]), 4 * f["_band"]) * 100),
)
PATTERN_SET_COLUMNS = [
    "price_momentum_5d", "price_momentum_20d", "volume_momentum", "volatility_regime", "volatility_clustering",
    "garch_signal", "gap_analysis", "support_resistance", "trend_strength", "rsi_divergence", "macd_momentum",
    "bollinger_position",
]


def pattern_set(bars: DataFrame) -> DataFrame:
    """The earlier twelve features; the variance signal is standardised per symbol."""
    names = [c for c in PATTERN_SET_COLUMNS if c != "garch_signal"] + ["garch_variance"]
    raw = PATTERN_SET.compute(bars, names)
    stats = raw.groupBy("symbol").agg(
        F.avg("garch_variance").alias("_m"), F.stddev_pop("garch_variance").alias("_s")
    )
    out = attach(raw, stats, ["symbol"]).withColumn(
        "garch_signal", (F.col("garch_variance") - F.col("_m")) / (F.col("_s") + TINY)
    )
    return out.select("symbol", "ts", "pos", *PATTERN_SET_COLUMNS)
