"""Market structure, context, factor, regime, season and macro features.

No outside market data is joined here: the context features are proxies built
from each symbol's own history. Random factors are replaced by their mean.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scalar import c, choose, clip, fdiv, flag, guarded
from .core_features import CORE
from .registry import Registry

MARKET = Registry(parent=CORE)
MACRO = Registry(parent=CORE)

VIX_FACTOR = 1.5

# -- structure ---------------------------------------------------------------
MARKET.add(
    "structure",
    liquidity_ratio=lambda f: guarded(f["volume"], f["high"] - f["low"]),
    market_impact=lambda f: guarded(F.abs(f.lag("daily_return")), f["volume"]),
    buying_pressure=lambda f: guarded(f["close"] - f["low"], f["high"] - f["low"]),
    spread_normalized=lambda f: guarded(f["high"] - f["low"], f["close"]),
    support_20=lambda f: f.min("low", 20),
    resistance_20=lambda f: f.max("high", 20),
    price_vs_support=lambda f: guarded(f["close"], f["support_20"]),
    price_vs_resistance=lambda f: guarded(f["close"], f["resistance_20"]),
)

# -- context -----------------------------------------------------------------
MARKET.add(
    "context",
    _prev_return=lambda f: f.lag("daily_return"),
    _prev_return2=lambda f: f.lag("daily_return", 2),
    vix_level=lambda f: guarded(f["volatility_20d"], f.mean("volatility_20d", 252)),
    spy_correlation=lambda f: F.coalesce(f.corr("_prev_return", "_prev_return2", 20), F.lit(0.5)),
    market_regime=lambda f: flag(f["vix_level"] > 1.2),
    sector_performance=lambda f: guarded(f.mean("_prev_return", 20), f.mean("_prev_return", 60)),
    _prev_mean5=lambda f: f.mean("_prev_return", 5),
    mag7_correlation=lambda f: F.coalesce(f.corr("_prev_return", "_prev_mean5", 20), F.lit(0.5)),
    _excess=lambda f: f["_prev_return"] - f.mean("_prev_return", 20),
    relative_strength=lambda f: f.mean("_excess", 10),
    sector_rotation=lambda f: f.diff("relative_strength", 5) / 5.0,
)

# -- factors -----------------------------------------------------------------
MARKET.add(
    "factors",
    momentum_factor=lambda f: guarded(f["momentum_20d"], f["volatility_20d"]),
    value_factor=lambda f: guarded(f["close"], f["sma_50"]) - 1,
    quality_factor=lambda f: guarded(f.mean("_prev_return", 60), f["volatility_60d"]),
    size_factor=lambda f: F.lit(0.1),
    profitability_factor=lambda f: f.share(f["_prev_return"] > 0, 20),
)

# -- regimes -----------------------------------------------------------------
MARKET.add(
    "regime",
    volatility_regime=lambda f: choose(
        [
            (f["volatility_20d"] > f.quantile("volatility_20d", 252, 0.67), F.lit(2)),
            (f["volatility_20d"] < f.quantile("volatility_20d", 252, 0.33), F.lit(0)),
        ],
        F.lit(1),
    ),
    trend_regime=lambda f: choose(
        [(f["trend_strength_20d"] > 0.01, F.lit(1)), (f["trend_strength_20d"] < -0.01, F.lit(-1))], F.lit(0)
    ),
    volume_regime=lambda f: choose(
        [
            (f["volume"] > f.median("volume", 60) * 1.5, F.lit(1)),
            (f["volume"] < f.median("volume", 60) * 0.5, F.lit(-1)),
        ],
        F.lit(0),
    ),
    correlation_regime=lambda f: choose(
        [(f["spy_correlation"] > 0.7, F.lit(1)), (f["spy_correlation"] < 0.3, F.lit(-1))], F.lit(0)
    ),
    market_stress=lambda f: flag(f["volatility_20d"] > f.quantile("volatility_20d", 60, 0.8))
    + flag(f["vix_level"] > 1.5)
    + flag(F.abs(f["_prev_return"]) > f["volatility_20d"] * 2),
)


# -- seasons -----------------------------------------------------------------
def days_in_quarter(ts):
    return F.datediff(F.to_date(ts), F.trunc(F.to_date(ts), "quarter"))


def is_month_end(ts):
    return F.last_day(F.to_date(ts)) == F.to_date(ts)


MARKET.add(
    "season",
    day_of_week=lambda f: F.weekday(f["ts"]) / 6.0,
    month_of_year=lambda f: F.month(f["ts"]) / 12.0,
    options_expiry=lambda f: flag(
        (F.dayofmonth(f["ts"]) >= 15) & (F.dayofmonth(f["ts"]) <= 21) & (F.weekday(f["ts"]) == 4)
    ),
    earnings_proximity=lambda f: F.exp(
        -0.1 * F.least(days_in_quarter(f["ts"]), 90 - days_in_quarter(f["ts"])).cast("double")
    ),
    monday_effect=lambda f: flag(F.weekday(f["ts"]) == 0),
    friday_effect=lambda f: flag(F.weekday(f["ts"]) == 4),
    january_effect=lambda f: flag(F.month(f["ts"]) == 1),
    december_effect=lambda f: flag(F.month(f["ts"]) == 12),
    quarter=lambda f: F.quarter(f["ts"]) / 4.0,
    quarter_end=lambda f: flag(is_month_end(f["ts"]) & (F.month(f["ts"]) % 3 == 0)),
    month_end=lambda f: flag(is_month_end(f["ts"])),
    rebalancing_effect=lambda f: flag((F.dayofmonth(f["ts"]) >= 25) | (F.dayofmonth(f["ts"]) <= 5)),
)

# -- macro: volatility index proxy -------------------------------------------
MACRO.add(
    "macro_vix",
    vix_level=lambda f: F.coalesce(
        clip(f.std("daily_return", 20) * math.sqrt(252.0) * 100 * VIX_FACTOR, 10.0, 80.0), F.lit(20.0)
    ),
    vix_change=lambda f: F.coalesce(f.pct("vix_level"), F.lit(0.0)),
    vix_percentile=lambda f: F.coalesce(f.rank_pct("vix_level", 252), F.lit(0.5)),
    vix_term_structure=lambda f: F.coalesce(
        guarded(f.mean("vix_level", 60) - f["vix_level"], f["vix_level"]), F.lit(0.0)
    ),
    volatility_regime=lambda f: choose(
        [(f.mean("vix_level", 20) < 15, F.lit(0)), (f.mean("vix_level", 20) < 25, F.lit(1))], F.lit(2)
    ),
    vix_mean_reversion=lambda f: F.coalesce(
        guarded(f["vix_level"] - f.mean("vix_level", 60), f.std("vix_level", 60), 1e-8), F.lit(0.0)
    ),
    fear_greed_index=lambda f: F.coalesce(
        (100.0 - clip(f["vix_level"], 10.0, 50.0)) * 0.6
        + clip(f.mean("daily_return", 20) * 1000 + 50, 0.0, 100.0) * 0.4,
        F.lit(50.0),
    ),
)


def _ordered(f, sign):
    chain = [f["close"], f.mean("close", 20), f.mean("close", 50), f.mean("close", 200)]
    cond = (f.mean("daily_return", 20) * sign) > 0
    for a, b in zip(chain, chain[1:]):
        cond = cond & ((a - b) * sign > 0)
    return flag(cond)


MACRO.add(
    "macro_regime",
    market_regime_bull=lambda f: _ordered(f, 1),
    market_regime_bear=lambda f: _ordered(f, -1),
    market_regime_sideways=lambda f: F.lit(1) - f["market_regime_bull"] - f["market_regime_bear"],
    trend_strength=lambda f: F.abs(
        F.coalesce(guarded(f["close"] - f.mean("close", 200), f.mean("close", 200)), F.lit(0.0))
    ),
    market_stress_index=lambda f: F.coalesce(
        clip(f.std("daily_return", 20) * 100, 0.0, 10.0) + clip(-f.mean("daily_return", 5) * 100, 0.0, 5.0),
        F.lit(0.0),
    ),
    _volume_ratio1=lambda f: F.coalesce(guarded(f["volume"], f.mean("volume", 20)), F.lit(1.0)),
    liquidity_conditions=lambda f: F.coalesce(f.mean("_volume_ratio1", 5), F.lit(1.0)),
)
MACRO.add(
    "macro_cycle",
    economic_cycle=lambda f: choose(
        [(f.mean("daily_return", 252) > 0.01, F.lit(1)), (f.mean("daily_return", 252) < -0.01, F.lit(-1))], F.lit(0)
    ),
    _std20=lambda f: f.std("daily_return", 20),
    _recession=lambda f: F.when(
        (f["_std20"] > f.quantile("_std20", 252, 0.8)) & (f.mean("daily_return", 60) < -0.005), 1.0
    ).otherwise(0.0),
    recession_probability=lambda f: F.coalesce(f.mean("_recession", 20), F.lit(0.0)),
    growth_momentum=lambda f: F.coalesce(f.mean("daily_return", 20) - f.mean("daily_return", 60), F.lit(0.0)),
    inflation_expectations=lambda f: F.coalesce(clip(f.std("daily_return", 60) * 50, 0.0, 5.0), F.lit(2.0)),
)
MACRO.add(
    "macro_cross",
    equity_bond_ratio=lambda f: F.coalesce(fdiv(F.lit(1.0), f["_std20"] + 0.01), F.lit(1.0)),
    risk_on_risk_off=lambda f: F.coalesce(f.mean("daily_return", 5) - f["_std20"], F.lit(0.0)),
    _inflation=lambda f: f.mean("_std20", 60),
    commodity_momentum=lambda f: F.coalesce(f["_inflation"] - f.mean("_inflation", 120), F.lit(0.0)),
)
for _name in ("credit_conditions", "currency_strength", "dollar_strength", "yield_curve_slope", "credit_spreads"):
    MACRO.add("macro_neutral", **{_name: lambda f: F.lit(0.0)})
