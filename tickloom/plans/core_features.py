"""Price, indicator, momentum, volatility and volume features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scalar import fdiv, flag, guarded, maximum, minimum
from .registry import Registry

CORE = Registry()
YEAR = math.sqrt(252.0)


def _positive(x):
    return F.when(x > 0, x).otherwise(F.lit(0.0))


# -- price -----------------------------------------------------------------
CORE.add(
    "price",
    daily_return=lambda f: f.pct("close"),
    high_low_pct=lambda f: fdiv(f["high"] - f["low"], f["close"]) * 100,
    open_close_pct=lambda f: fdiv(f["close"] - f["open"], f["open"]) * 100,
    true_range=lambda f: maximum(
        f["high"] - f["low"],
        maximum(F.abs(f["high"] - f.lag("close")), F.abs(f["low"] - f.lag("close"))),
    ),
    price_position=lambda f: guarded(f["close"] - f["low"], f["high"] - f["low"]),
    gap_normalized=lambda f: guarded(f["open"] - f.lag("close"), f.lag("close")),
    body_ratio=lambda f: guarded(F.abs(f["close"] - f["open"]), f["high"] - f["low"]),
    upper_shadow=lambda f: guarded(f["high"] - maximum(f["close"], f["open"]), f["close"]),
    lower_shadow=lambda f: guarded(minimum(f["close"], f["open"]) - f["low"], f["close"]),
)
for _n in (5, 10, 20, 50, 100):
    CORE.add("price", **{f"sma_{_n}": lambda f, n=_n: f.mean("close", n)})
for _n in (12, 26, 50, 100):
    CORE.add("price", **{f"ema_{_n}": lambda f, n=_n: f.ewm("close", span=n)})
CORE.add("price", hma_20=lambda f: f.mean("close", 20))
for _n in (5, 20, 50):
    CORE.add("price", **{f"price_to_sma{_n}": lambda f, n=_n: guarded(f["close"], f[f"sma_{n}"]) - 1})
CORE.add(
    "price",
    sma5_to_sma20=lambda f: guarded(f["sma_5"], f["sma_20"]) - 1,
    sma20_to_sma50=lambda f: guarded(f["sma_20"], f["sma_50"]) - 1,
    ema12_to_ema26=lambda f: guarded(f["ema_12"], f["ema_26"]) - 1,
)

# -- indicators --------------------------------------------------------------
for _n in (14, 21):
    CORE.add(
        "technical",
        **{
            # The first price change is unknown, so both means start at 0 and the first value is 0.
            f"_gain_{_n}": lambda f, n=_n: f.ewm_recursive(_positive(f.diff("close")), 1.0 / n),
            f"_loss_{_n}": lambda f, n=_n: f.ewm_recursive(_positive(-f.diff("close")), 1.0 / n),
            f"rsi_{_n}": lambda f, n=_n: F.coalesce(
                100.0 - fdiv(F.lit(100.0), 1.0 + guarded(f[f"_gain_{n}"], f[f"_loss_{n}"])), F.lit(50.0)
            ),
        },
    )
CORE.add(
    "technical",
    rsi=lambda f: f["rsi_14"],
    macd=lambda f: f["ema_12"] - f["ema_26"],
    macd_signal=lambda f: f.ewm("macd", span=9),
    macd_histogram=lambda f: f["macd"] - f["macd_signal"],
    _stoch=lambda f: 100.0 * guarded(f["close"] - f.min("low", 14), f.max("high", 14) - f.min("low", 14)),
    stoch_k=lambda f: f.mean("_stoch", 3),
    _typical=lambda f: (f["high"] + f["low"] + f["close"]) / 3.0,
    cci=lambda f: guarded(f["_typical"] - f.mean("_typical", 20), 0.015 * f.mean_abs_dev("_typical", 20)),
    bb_upper=lambda f: f.mean("close", 20) + 2.0 * f.std("close", 20),
    bb_lower=lambda f: f.mean("close", 20) - 2.0 * f.std("close", 20),
    bb_position=lambda f: guarded(f["close"] - f["bb_lower"], f["bb_upper"] - f["bb_lower"]),
    bb_width=lambda f: guarded(f["bb_upper"] - f["bb_lower"], f["close"]),
    bb_squeeze=lambda f: flag(f["bb_width"] < f.quantile("bb_width", 20, 0.1)),
    atr=lambda f: f.mean("true_range", 14),
    atr_ratio=lambda f: guarded(f["atr"], f["close"]),
    williams_r=lambda f: -100.0
    * guarded(f.max("high", 14) - f["close"], f.max("high", 14) - f.min("low", 14)),
)

# -- momentum ----------------------------------------------------------------
for _n in (2, 5, 10, 20):
    CORE.add("momentum", **{f"momentum_{_n}d": lambda f, n=_n: f.pct("close", n)})
CORE.add(
    "momentum",
    price_momentum_7d=lambda f: guarded(f.diff("close", 7), f.lag("close", 7)),
    momentum_strength=lambda f: guarded(f["momentum_5d"], f.std("daily_return", 5)),
    momentum_persistence=lambda f: f.mean(F.signum(f["momentum_5d"]), 10),
)
for _n in (5, 10, 20):
    CORE.add("momentum", **{f"trend_strength_{_n}d": lambda f, n=_n: f.slope("close", n)})
for _n in (5, 10):
    CORE.add("momentum", **{f"roc_{_n}": lambda f, n=_n: fdiv(f.diff("close", n), f.lag("close", n)) * 100})
CORE.add(
    "momentum",
    momentum_oscillator=lambda f: guarded(
        f["momentum_10d"] - f["momentum_20d"], f["momentum_10d"] + f["momentum_20d"]
    ),
)

# -- volatility --------------------------------------------------------------
CORE.add("volatility", _log_return=lambda f: F.log(fdiv(f["close"], f.lag("close"))))
for _n in (5, 20, 60):
    CORE.add("volatility", **{f"volatility_{_n}d": lambda f, n=_n: f.std("_log_return", n) * YEAR})
CORE.add(
    "volatility",
    volatility_ratio=lambda f: guarded(f["volatility_5d"], f["volatility_20d"]),
    return_volatility_5d=lambda f: f.std("_log_return", 5) * YEAR,
    _sq_return=lambda f: f["_log_return"] * f["_log_return"],
    _sq_return_lag=lambda f: f.lag("_sq_return"),
    volatility_clustering=lambda f: f.corr("_sq_return", "_sq_return_lag", 10),
    _log_std20=lambda f: f.std("_log_return", 20),
    volatility_skew=lambda f: f.skew("_log_std20", 60),
)

# -- volume ------------------------------------------------------------------
CORE.add(
    "volume",
    volume_sma_20=lambda f: f.mean("volume", 20),
    volume_ratio=lambda f: guarded(f["volume"], f["volume_sma_20"]),
    relative_volume=lambda f: guarded(f["volume"], f.median("volume", 20)),
    vwap_5=lambda f: guarded(f.sum(f["close"] * f["volume"], 5), f.sum("volume", 5)),
    vwap_20=lambda f: guarded(f.sum(f["close"] * f["volume"], 20), f.sum("volume", 20)),
    vwap_deviation=lambda f: guarded(f["close"] - f["vwap_20"], f["vwap_20"]),
    _traded_change=lambda f: f.diff("close") * f["volume"],
    volume_price_trend=lambda f: f.sum("_traded_change", 5),
    _signed_volume=lambda f: F.coalesce(F.signum(f.diff("close")), F.lit(0.0)) * f["volume"],
)
CORE.running("volume", "obv", "_signed_volume")
CORE.add(
    "volume",
    obv_normalized=lambda f: guarded(f["obv"], f.mean("obv", 20)),
    _typical_change=lambda f: f.diff("_typical"),
    _flow_in=lambda f: F.when(f["_typical_change"] > 0, f["_typical"] * f["volume"]).otherwise(F.lit(0.0)),
    _flow_out=lambda f: F.when(f["_typical_change"] < 0, f["_typical"] * f["volume"]).otherwise(F.lit(0.0)),
    money_flow_index=lambda f: 100.0
    - fdiv(F.lit(100.0), 1.0 + guarded(f.sum("_flow_in", 14), f.sum("_flow_out", 14))),
)
