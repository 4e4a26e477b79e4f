"""Earlier forms of the features, and the sequence-model features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import clip, fdiv, flag, guarded
from .core_features import CORE
from .market_features import MARKET
from .registry import Registry

EARLIER = Registry(parent=MARKET)
SEQUENCE = Registry(parent=MARKET)

EARLIER.add(
    "averages",
    _hull_raw=lambda f: 2 * f.wma("close", 10) - f.wma("close", 20),
    hull_20=lambda f: f.wma("_hull_raw", 4),
    ma_convergence=lambda f: fdiv(F.abs(f["sma_5"] - f["sma_20"]), f["close"]),
    ma_slope_5=lambda f: fdiv(f.diff("sma_5", 5), f.lag("sma_5", 5)),
    ma_slope_20=lambda f: fdiv(f.diff("sma_20", 5), f.lag("sma_20", 5)),
    h1_range_normalized=lambda f: fdiv(f["high"] - f["low"], f["close"]),
    price_efficiency=lambda f: fdiv(F.abs(f["close"] - f["vwap_20"]), f["close"]),
)
for _n in (14, 21):
    # Means over the gaining (losing) rows only: NULL unless all n rows gain (lose).
    EARLIER.add(
        "rsi_simple",
        **{
            f"rsi_simple_{_n}": lambda f, n=_n: 100.0
            - fdiv(F.lit(100.0), 1.0 + guarded(f.mean("_gain_only", n), f.mean("_loss_only", n)))
        },
    )
EARLIER.add(
    "rsi_simple",
    _gain_only=lambda f: F.when(f.diff("close") > 0, f.diff("close")),
    _loss_only=lambda f: F.when(f.diff("close") < 0, -f.diff("close")),
)
EARLIER.add("volume", _seed_volume=lambda f: F.when(f["pos"] == 0, f["volume"]).otherwise(f["_signed_volume"]))
EARLIER.running("volume", "obv_seeded", "_seed_volume")
EARLIER.add(
    "momentum",
    momentum_strength_1e8=lambda f: guarded(f["momentum_5d"], f.std("daily_return", 5), 1e-8),
    momentum_persistence_sum=lambda f: f.sum(F.signum(f["momentum_5d"]), 10) / 10.0,
    momentum_oscillator_1e8=lambda f: guarded(
        f["momentum_10d"] - f["momentum_20d"], f["momentum_10d"] + f["momentum_20d"], 1e-8
    ),
    volatility_ratio_1e8=lambda f: guarded(f["volatility_5d"], f["volatility_20d"], 1e-8),
    trend_persistence=lambda f: f.std("trend_strength_5d", 10),
    low_vol_factor=lambda f: fdiv(f["volatility_20d"], f.mean("volatility_20d", 60)),
)
EARLIER.add(
    "cross_asset",
    _own_corr=lambda f: F.coalesce(f.corr("daily_return", "_prev_return", 20), F.lit(0.5)),
    basket_correlation=lambda f: f.corr("daily_return", "basket_return", 20),
    _basket_excess=lambda f: f["daily_return"] - f["basket_return"],
    basket_strength=lambda f: f.mean("_basket_excess", 10),
    _bench_var=lambda f: f.var("market_return", 60),
    basket_beta=lambda f: guarded(f.cov("daily_return", "market_return", 60), f["_bench_var"]),
    idiosyncratic_vol=lambda f: F.sqrt(
        F.greatest(
            f["volatility_20d"] * f["volatility_20d"]
            - F.pow(f["basket_beta"] * f["_own_corr"] * f["volatility_20d"], F.lit(2.0)),
            F.lit(0.0),
        )
    )
    + 0 * f["basket_beta"],
)
EARLIER.add(
    "alternative",
    sentiment_score=lambda f: F.tanh(fdiv(f.mean("daily_return", 5), f["volatility_5d"])),
    news_flow=lambda f: clip(fdiv(F.abs(f["daily_return"]), f["volatility_20d"]), 0.0, 3.0),
    social_sentiment=lambda f: (f["momentum_5d"] + f["sentiment_score"]) / 2.0,
    search_volume=lambda f: (F.abs(f["daily_return"]) + f["volatility_5d"]) / 2.0,
    analyst_revisions=lambda f: f.mean("momentum_20d", 10),
    seasonal_yield=lambda f: 0.1 * F.sin(f["pos"] * (2.0 * math.pi / 252.0)),
)


def with_basket(bars: DataFrame, members=None) -> DataFrame:
    """Mean return of the other basket members per time, and of the whole market.

    Leave-one-out means come from sums per time minus the own value, so there is
    no self join.
    """
    from ..operators.layout import attach

    returns = CORE.compute(bars, ["daily_return"], keep=[c for c in bars.columns if c not in ("symbol", "ts", "pos")])
    inside = F.col("symbol").isin(list(members)) if members else F.lit(True)
    own = F.when(inside, F.col("daily_return"))
    sums = returns.groupBy("ts").agg(
        F.sum(own).alias("_s"), F.count(own).alias("_k"), F.avg("daily_return").alias("market_return")
    )
    out = attach(returns, sums, ["ts"])
    left = F.col("_k") - F.when(own.isNotNull(), 1).otherwise(0)
    basket = F.try_divide(F.col("_s") - F.coalesce(own, F.lit(0.0)), F.when(left > 0, left))
    return out.withColumn("basket_return", basket).drop("_s", "_k", "daily_return")


# -- sequence-model features -------------------------------------------------
SEQUENCE.add(
    "sequence",
    return_sequence_sum_5=lambda f: f.sum("daily_return", 5),
    return_sequence_sum_10=lambda f: f.sum("daily_return", 10),
    return_sequence_std_5=lambda f: f.std("daily_return", 5),
    return_sequence_std_10=lambda f: f.std("daily_return", 10),
    return_momentum_3=lambda f: f.mean("daily_return", 3),
    return_momentum_5=lambda f: f.mean("daily_return", 5),
    return_acceleration=lambda f: f["return_momentum_3"] - f["return_momentum_5"],
    volatility_persistence=lambda f: f.std("volatility_5d", 10),
    volatility_trend=lambda f: f.slope("volatility_5d", 5),
    volume_trend_5=lambda f: f.slope("volume", 5),
    volume_acceleration=lambda f: f.diff("volume_trend_5"),
    price_momentum_3=lambda f: f.pct("close", 3),
    price_momentum_7=lambda f: f.pct("close", 7),
    price_acceleration=lambda f: f["price_momentum_3"] - f["price_momentum_7"],
    support_5=lambda f: f.min("close", 5),
    resistance_5=lambda f: f.max("close", 5),
    support_distance=lambda f: fdiv(f["close"] - f["support_5"], f["close"]),
    resistance_distance=lambda f: fdiv(f["resistance_5"] - f["close"], f["close"]),
    return_memory_5=lambda f: f.time_corr("daily_return", 5),
    return_memory_10=lambda f: f.time_corr("daily_return", 10),
    volume_memory_5=lambda f: f.time_corr("volume_ratio", 5),
    volume_memory_10=lambda f: f.time_corr("volume_ratio", 10),
)

for _regime in ("volatility_regime", "trend_regime", "volume_regime"):
    SEQUENCE.add(
        "sequence",
        **{
            f"{_regime}_change": lambda f, r=_regime: flag(~f[r].eqNullSafe(f.lag(r))),
            f"{_regime}_stability": lambda f, r=_regime: f.std(f[r].cast("double"), 5),
        },
    )


def lagged(df: DataFrame, columns, lags, keep=()) -> DataFrame:
    """One column per feature and lag."""
    reg = Registry(parent=MARKET)
    for c in columns:
        for k in lags:
            reg.add("lags", **{f"{c}_lag{k}": lambda f, c=c, k=k: f.lag(c, k)})
    return reg.compute(df, [f"{c}_lag{k}" for c in columns for k in lags], keep=keep)

