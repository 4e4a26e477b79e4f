"""Queries over price, indicator, momentum, volatility, volume, market and macro features."""

from __future__ import annotations

from ..plans.core_features import CORE
from ..plans.market_features import MACRO, MARKET
from ..sources.bars import hourly_bars, scan_bars, stored_bars, weekly_bars
from . import sql as q
from .base import register

YEAR = "sqrt(252.0)"


def hourly(spark, d):
    return stored_bars(spark, d, "hourly")


def weekly(spark, d):
    return stored_bars(spark, d, "weekly")


# -- bars --------------------------------------------------------------------
register("bars_hourly", "symbol ts:t | open high low close volume", "SRC2",
         f"WITH {q.HOURLY} SELECT * FROM hourly")(lambda s, d: hourly_bars(s, d))
register("bars_weekly", "symbol sector ts:t | open:4 high:4 low:4 close:4 volume", "SRC2 SRC9",
         f"WITH {q.WEEKLY} SELECT * FROM weekly")(lambda s, d: weekly_bars(s, d))
register("bars_positions", "symbol ts:t pos:i | close", "WIN26 WIN27", q.stages("hourly"))(hourly)
register("bars_scan_range", "symbol ts:t | open high low close volume", "SRC1 SRC16",
         q.stages("hourly", final="SELECT * FROM {prev} WHERE symbol IN ('click', 'view') AND ts BETWEEN "
                                  "TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"))(
    lambda s, d: scan_bars(hourly(s, d), ["click", "view"], "2024-01-05", "2024-01-20"))


def simple(name, kind, registry, covers, columns, *steps, keys="symbol ts:t"):
    """Register a feature list with its oracle stages on hourly or weekly bars."""
    wanted = [w.partition(":")[0] for w in columns.split()]
    table = hourly if kind == "hourly" else weekly
    register(name, f"{keys} | {columns}", covers, q.stages(kind, *steps))(
        lambda s, d: registry.compute(table(s, d), wanted))


# -- price -------------------------------------------------------------------
PRICE_ROW = {
    "daily_return": q.pct("close"),
    "high_low_pct": "(high - low) / close * 100",
    "open_close_pct": "(close - open) / open * 100",
    "true_range": f"CASE WHEN {q.lag('close')} IS NOT NULL THEN greatest(high - low, "
                  f"abs(high - {q.lag('close')}), abs(low - {q.lag('close')})) END",
    "price_position": "(close - low) / (high - low + 1e-10)",
    "gap_normalized": f"(open - {q.lag('close')}) / ({q.lag('close')} + 1e-10)",
    "body_ratio": "abs(close - open) / (high - low + 1e-10)",
    "upper_shadow": "(high - greatest(close, open)) / (close + 1e-10)",
    "lower_shadow": "(least(close, open) - low) / (close + 1e-10)",
}
simple("price_shape", "hourly", CORE, "PRC1 PRC2 PRC3 PRC4 PRC5 PRC6 PRC7 WIN1 WIN2 WIN3 FN4 PRJ15",
       "daily_return high_low_pct open_close_pct true_range price_position gap_normalized body_ratio "
       "upper_shadow lower_shadow", PRICE_ROW)

SMA = {f"sma_{n}": q.mean("close", n) for n in (5, 10, 20, 50, 100)}
EMA = {f"ema_{n}": q.ewm("close", f"(2.0 / {n + 1})") for n in (12, 26, 50, 100)}
simple("price_averages", "weekly", CORE, "PRC8 PRC9 PRC10 PRC12 PRC13 WIN4 WIN18",
       "sma_5:4 sma_10:4 sma_20:4 sma_50:4 sma_100:4 ema_12:4 ema_26:4 ema_50:4 ema_100:4 hma_20:4 "
       "price_to_sma5 price_to_sma20 price_to_sma50 sma5_to_sma20 sma20_to_sma50 ema12_to_ema26",
       {**SMA, **EMA, "hma_20": q.mean("close", 20)},
       {"price_to_sma5": "close / (sma_5 + 1e-10) - 1", "price_to_sma20": "close / (sma_20 + 1e-10) - 1",
        "price_to_sma50": "close / (sma_50 + 1e-10) - 1", "sma5_to_sma20": "sma_5 / (sma_20 + 1e-10) - 1",
        "sma20_to_sma50": "sma_20 / (sma_50 + 1e-10) - 1", "ema12_to_ema26": "ema_12 / (ema_26 + 1e-10) - 1"})

# -- indicators ----------------------------------------------------------------
RSI_STEPS = (
    {"delta": f"close - {q.lag('close')}"},
    {"gain": "CASE WHEN delta > 0 THEN delta ELSE 0 END", "loss": "CASE WHEN delta < 0 THEN -delta ELSE 0 END"},
    {f"{k}{n}": q.ewm_recursive(v, f"(1.0 / {n})") for n in (14, 21) for k, v in (("g", "gain"), ("l", "loss"))},
    {f"rsi_{n}": f"coalesce(100 - 100 / (1 + g{n} / (l{n} + 1e-10)), 50)" for n in (14, 21)},
    {"rsi": "rsi_14"},
)
simple("indicator_rsi", "hourly", CORE, "TEC1 WIN19", "rsi_14 rsi_21 rsi", *RSI_STEPS)
MACD_STEPS = (
    {"ema_12": q.ewm("close", "(2.0 / 13)"), "ema_26": q.ewm("close", "(2.0 / 27)")},
    {"macd": "ema_12 - ema_26"},
    {"macd_signal": q.ewm("macd", "(2.0 / 10)")},
    {"macd_histogram": "macd - macd_signal"},
)
simple("indicator_macd", "weekly", CORE, "TEC3", "macd:4 macd_signal:4 macd_histogram:4", *MACD_STEPS)
simple("indicator_stochastic", "hourly", CORE, "TEC4 TEC9 WIN6", "stoch_k:5 williams_r:5",
       {"ll": q.lo("low", 14), "hh": q.hi("high", 14)},
       {"raw": "100 * (close - ll) / (hh - ll + 1e-10)", "williams_r": "-100 * (hh - close) / (hh - ll + 1e-10)"},
       {"stoch_k": q.mean("raw", 3)})
CCI_STEPS = (
    {"tp": "(high + low + close) / 3"},
    {"m": q.mean("tp", 20), "l": f"list(tp) OVER {q.rows(-19)}"},
    {"cci": "CASE WHEN len(l) = 20 THEN (tp - m) / (0.015 * list_sum(list_transform(l, lambda v: abs(v - m))) "
            "/ 20 + 1e-10) END"},
)
simple("indicator_cci", "hourly", CORE, "TEC5 WIN15", "cci:5", *CCI_STEPS)
BAND_STEPS = (
    {"m": q.mean("close", 20), "sd": q.std("close", 20)},
    {"bb_upper": "m + sd * 2", "bb_lower": "m - sd * 2"},
    {"bb_position": "(close - bb_lower) / (bb_upper - bb_lower + 1e-10)",
     "bb_width": "(bb_upper - bb_lower) / (close + 1e-10)"},
    {"bb_cut": q.quant("bb_width", 20, 0.1)},
    {"bb_squeeze": q.flag("bb_width < bb_cut")},
)
simple("indicator_bollinger", "weekly", CORE, "TEC6 TEC7 WIN5 WIN8", "bb_upper:4 bb_lower:4 bb_position bb_width bb_squeeze",
       *BAND_STEPS)
ATR_STEPS = (PRICE_ROW, {"atr": q.mean("true_range", 14)}, {"atr_ratio": "atr / (close + 1e-10)"})
simple("indicator_atr", "hourly", CORE, "TEC8", "atr atr_ratio", *ATR_STEPS)

# -- momentum --------------------------------------------------------------------
simple("momentum", "weekly", CORE, "MOM1 MOM2 MOM3 MOM4 MOM6 MOM7 FN1",
       "momentum_2d momentum_5d momentum_10d momentum_20d price_momentum_7d momentum_strength:4 "
       "momentum_persistence roc_5:5 roc_10:5 momentum_oscillator:3",
       {"daily_return": q.pct("close"), **{f"momentum_{n}d": q.pct("close", n) for n in (2, 5, 10, 20)},
        "price_momentum_7d": f"(close - {q.lag('close', 7)}) / ({q.lag('close', 7)} + 1e-10)",
        **{f"roc_{n}": f"(close - {q.lag('close', n)}) / {q.lag('close', n)} * 100" for n in (5, 10)}},
       {"momentum_strength": q.guard("momentum_5d", q.std("daily_return", 5)), "sgn": "sign(momentum_5d)",
        "momentum_oscillator": q.guard("momentum_10d - momentum_20d", "momentum_10d + momentum_20d")},
       {"momentum_persistence": q.mean("sgn", 10)})
simple("trend_strength", "hourly", CORE, "MOM5 WIN13", "trend_strength_5d trend_strength_10d trend_strength_20d",
       {f"trend_strength_{n}d": q.slope("close", n) for n in (5, 10, 20)})

# -- volatility --------------------------------------------------------------------
VOL_STEPS = (
    {"lr": f"ln(close / {q.lag('close')})"},
    {"volatility_5d": f"{q.std('lr', 5)} * {YEAR}", "volatility_20d": f"{q.std('lr', 20)} * {YEAR}",
     "volatility_60d": f"{q.std('lr', 60)} * {YEAR}", "return_volatility_5d": f"{q.std('lr', 5)} * {YEAR}"},
)
for _k in ("volatility_5d", "volatility_20d", "volatility_60d", "return_volatility_5d"):
    VOL_STEPS[1][_k] = "(" + VOL_STEPS[1][_k].replace(" * sqrt", ") * sqrt")
simple("volatility_basic", "weekly", CORE, "VOL1 VOL2 FN2 PRJ17",
       "volatility_5d volatility_20d volatility_60d volatility_ratio return_volatility_5d",
       *VOL_STEPS, {"volatility_ratio": q.guard("volatility_5d", "volatility_20d")})
simple("volatility_shape", "weekly", CORE, "VOL5 VOL6 WIN9 WIN10", "volatility_clustering volatility_skew",
       {"lr": f"ln(close / {q.lag('close')})"}, {"sq": "lr * lr"},
       {"sql": q.lag("sq"), "v20": q.std("lr", 20)},
       {"volatility_clustering": q.corr("sq", "sql", 10), "volatility_skew": q.skew("v20", 60)})

# -- volume --------------------------------------------------------------------------
simple("volume_basic", "weekly", CORE, "VLM1 VLM2 VLM3 VLM4 WIN7",
       "volume_sma_20 volume_ratio relative_volume vwap_5:4 vwap_20:4 vwap_deviation volume_price_trend:2",
       {"volume_sma_20": q.mean("volume", 20), "med": q.quant("volume", 20, 0.5), "cv": "close * volume",
        "chg": f"(close - {q.lag('close')}) * volume"},
       {"volume_ratio": "volume / (volume_sma_20 + 1e-10)", "relative_volume": "volume / (med + 1e-10)",
        "vwap_5": q.guard(q.total("cv", 5), q.total("volume", 5)),
        "vwap_20": q.guard(q.total("cv", 20), q.total("volume", 20)), "volume_price_trend": q.total("chg", 5)},
       {"vwap_deviation": "(close - vwap_20) / (vwap_20 + 1e-10)"})
OBV_STEPS = (
    {"sv": f"coalesce(sign(close - {q.lag('close')}), 0) * volume"},
    {"obv": f"sum(sv) OVER {q.RUN}"},
)
simple("volume_obv", "hourly", CORE, "VLM5 WIN21", "obv obv_normalized:5", *OBV_STEPS,
       {"obv_normalized": q.guard("obv", q.mean("obv", 20))})
simple("money_flow_index", "hourly", CORE, "VLM7", "money_flow_index:5",
       {"tp": "(high + low + close) / 3"}, {"chg": f"tp - {q.lag('tp')}"},
       {"fin": "CASE WHEN chg > 0 THEN tp * volume ELSE 0 END", "fout": "CASE WHEN chg < 0 THEN tp * volume ELSE 0 END"},
       {"a": q.total("fin", 14), "b": q.total("fout", 14)},
       {"money_flow_index": "100 - 100 / (1 + a / (b + 1e-10))"})

# -- market --------------------------------------------------------------------------
RET = {"daily_return": q.pct("close")}
simple("market_structure", "hourly", MARKET, "MKT1 MKT2 MKT3",
       "liquidity_ratio:1 market_impact buying_pressure spread_normalized support_20 resistance_20 "
       "price_vs_support price_vs_resistance", RET,
       {"liquidity_ratio": "volume / (high - low + 1e-10)",
        "market_impact": f"abs({q.lag('daily_return')}) / (volume + 1e-10)",
        "buying_pressure": "(close - low) / (high - low + 1e-10)", "spread_normalized": "(high - low) / (close + 1e-10)",
        "support_20": q.lo("low", 20), "resistance_20": q.hi("high", 20)},
       {"price_vs_support": "close / (support_20 + 1e-10)", "price_vs_resistance": "close / (resistance_20 + 1e-10)"})
CONTEXT_STEPS = (
    {**RET, **VOL_STEPS[0]},
    {"volatility_20d": VOL_STEPS[1]["volatility_20d"], "p1": q.lag("daily_return"), "p2": q.lag("daily_return", 2)},
    {"vix_level": q.guard("volatility_20d", q.mean("volatility_20d", 252)),
     "spy_correlation": f"coalesce({q.corr('p1', 'p2', 20)}, 0.5)",
     "sector_performance": q.guard(q.mean("p1", 20), q.mean("p1", 60)), "p5": q.mean("p1", 5),
     "ex": f"p1 - ({q.mean('p1', 20)})"},
    {"market_regime": q.flag("vix_level > 1.2"), "mag7_correlation": f"coalesce({q.corr('p1', 'p5', 20)}, 0.5)",
     "relative_strength": q.mean("ex", 10)},
    {"sector_rotation": f"(relative_strength - {q.lag('relative_strength', 5)}) / 5",
     "correlation_regime": "CASE WHEN spy_correlation > 0.7 THEN 1 WHEN spy_correlation < 0.3 THEN -1 ELSE 0 END"},
)
simple("market_context", "weekly", MARKET, "MKT6 MKT7 MKT8 MKT9 MKT10 MKT16",
       "vix_level spy_correlation market_regime sector_performance:2 mag7_correlation relative_strength "
       "sector_rotation correlation_regime", *CONTEXT_STEPS)
simple("market_factors", "weekly", MARKET, "MKT12 PRJ23 WIN17",
       "momentum_factor value_factor quality_factor size_factor profitability_factor",
       {**RET, **VOL_STEPS[0], "m20": q.pct("close", 20), "sma_50": q.mean("close", 50)},
       {"volatility_20d": VOL_STEPS[1]["volatility_20d"], "volatility_60d": VOL_STEPS[1]["volatility_60d"],
        "p1": q.lag("daily_return")},
       {"momentum_factor": q.guard("m20", "volatility_20d"), "value_factor": "close / (sma_50 + 1e-10) - 1",
        "quality_factor": q.guard(q.mean("p1", 60), "volatility_60d"), "size_factor": "0.1",
        "profitability_factor": q.share("p1 > 0", 20)})
simple("market_regimes", "weekly", MARKET, "MKT13 MKT14 MKT15 MKT17 FN5",
       "volatility_regime trend_regime volume_regime market_stress",
       {**RET, **VOL_STEPS[0], "t20": q.slope("close", 20), "vm": q.quant("volume", 60, 0.5)},
       {"v": VOL_STEPS[1]["volatility_20d"], "p1": q.lag("daily_return")},
       {"vlo": q.quant("v", 252, 0.33), "vhi": q.quant("v", 252, 0.67), "v80": q.quant("v", 60, 0.8),
        "vl": q.guard("v", q.mean("v", 252))},
       {"volatility_regime": "CASE WHEN v > vhi THEN 2 WHEN v < vlo THEN 0 ELSE 1 END",
        "trend_regime": "CASE WHEN t20 > 0.01 THEN 1 WHEN t20 < -0.01 THEN -1 ELSE 0 END",
        "volume_regime": "CASE WHEN volume > vm * 1.5 THEN 1 WHEN volume < vm * 0.5 THEN -1 ELSE 0 END",
        "market_stress": f"{q.flag('v > v80')} + {q.flag('vl > 1.5')} + {q.flag('abs(p1) > v * 2')}"
        .replace("CASE", "(CASE").replace("END", "END)")})
simple("seasonality", "weekly", MARKET, "MKT18 MKT19 FN8 FN9 FN10",
       "day_of_week month_of_year options_expiry earnings_proximity monday_effect friday_effect january_effect "
       "december_effect quarter quarter_end month_end rebalancing_effect",
       {"dow": "isodow(ts) - 1", "dq": "date_diff('day', CAST(date_trunc('quarter', ts) AS DATE), CAST(ts AS DATE))",
        "me": "CAST(ts AS DATE) = last_day(ts)"},
       {"day_of_week": "dow / 6.0", "month_of_year": "month(ts) / 12.0",
        "options_expiry": q.flag("day(ts) BETWEEN 15 AND 21 AND dow = 4"),
        "earnings_proximity": "exp(-0.1 * least(dq, 90 - dq))", "monday_effect": q.flag("dow = 0"),
        "friday_effect": q.flag("dow = 4"), "january_effect": q.flag("month(ts) = 1"),
        "december_effect": q.flag("month(ts) = 12"), '"quarter"': "quarter(ts) / 4.0",
        "quarter_end": q.flag("me AND month(ts) % 3 = 0"), "month_end": q.flag("me"),
        "rebalancing_effect": q.flag("day(ts) >= 25 OR day(ts) <= 5")})

# -- macro -----------------------------------------------------------------------------
VIX = {"vix_level": f"coalesce({q.clip('(' + q.std('daily_return', 20) + ') * sqrt(252.0) * 100 * 1.5', 10, 80)}, 20)"}
simple("macro_volatility_index", "weekly", MACRO, "MAC1 MAC2 MAC3 MAC4 MAC5 MAC6 WIN12 FN3",
       "vix_level:5 vix_change vix_percentile vix_term_structure volatility_regime vix_mean_reversion:3 fear_greed_index:5",
       RET, VIX,
       {"vix_change": f"coalesce({q.pct('vix_level')}, 0)", "l": f"list(vix_level) OVER {q.rows(-251)}",
        "m60": q.mean("vix_level", 60), "m20": q.mean("vix_level", 20), "s60": q.std("vix_level", 60),
        "r20": q.mean("daily_return", 20)},
       {"vix_percentile": "CASE WHEN len(l) = 252 THEN (len(list_filter(l, lambda v: v < vix_level)) + "
                          "(len(list_filter(l, lambda v: v = vix_level)) + 1) / 2.0) / 252 ELSE 0.5 END",
        "vix_term_structure": "coalesce((m60 - vix_level) / (vix_level + 1e-10), 0)",
        "volatility_regime": "CASE WHEN m20 < 15 THEN 0 WHEN m20 < 25 THEN 1 ELSE 2 END",
        "vix_mean_reversion": "coalesce((vix_level - m60) / (s60 + 1e-8), 0)",
        "fear_greed_index": f"coalesce((100 - least(greatest(vix_level, 10), 50)) * 0.6 + "
                            f"({q.clip('r20 * 1000 + 50', 0, 100)}) * 0.4, 50)"})
MACRO_BASE = {"r20": q.mean("daily_return", 20), "m20": q.mean("close", 20), "m50": q.mean("close", 50),
              "m200": q.mean("close", 200), "s20": q.std("daily_return", 20), "r5": q.mean("daily_return", 5),
              "r60": q.mean("daily_return", 60), "r252": q.mean("daily_return", 252), "s60": q.std("daily_return", 60),
              "vr": f"coalesce({q.guard('volume', q.mean('volume', 20))}, 1)"}
simple("macro_regime", "weekly", MACRO, "MAC7 MAC8 MAC9 MAC10",
       "market_regime_bull market_regime_bear market_regime_sideways trend_strength market_stress_index liquidity_conditions",
       RET, MACRO_BASE,
       {"market_regime_bull": q.flag("close > m20 AND m20 > m50 AND m50 > m200 AND r20 > 0"),
        "market_regime_bear": q.flag("close < m20 AND m20 < m50 AND m50 < m200 AND r20 < 0"),
        "trend_strength": "abs(coalesce((close - m200) / (m200 + 1e-10), 0))",
        "market_stress_index": f"coalesce(({q.clip('s20 * 100', 0, 10)}) + ({q.clip('-r5 * 100', 0, 5)}), 0)",
        "liquidity_conditions": f"coalesce({q.mean('vr', 5)}, 1)"},
       {"market_regime_sideways": "1 - market_regime_bull - market_regime_bear"})
simple("macro_cycle", "weekly", MACRO, "MAC11 MAC12 MAC13 MAC14 MAC15",
       "economic_cycle recession_probability growth_momentum inflation_expectations equity_bond_ratio:4 "
       "risk_on_risk_off commodity_momentum credit_conditions currency_strength dollar_strength yield_curve_slope credit_spreads",
       RET, MACRO_BASE, {"q80": q.quant("s20", 252, 0.8), "infl": q.mean("s20", 60)},
       {"rec": "CASE WHEN s20 > q80 AND r60 < -0.005 THEN 1.0 ELSE 0.0 END", "infl120": q.mean("infl", 120)},
       {"economic_cycle": "CASE WHEN r252 > 0.01 THEN 1 WHEN r252 < -0.01 THEN -1 ELSE 0 END",
        "recession_probability": f"coalesce({q.mean('rec', 20)}, 0)", "growth_momentum": "coalesce(r20 - r60, 0)",
        "inflation_expectations": f"coalesce({q.clip('s60 * 50', 0, 5)}, 2)",
        "equity_bond_ratio": "coalesce(1 / (s20 + 0.01), 1)", "risk_on_risk_off": "coalesce(r5 - s20, 0)",
        "commodity_momentum": "coalesce(infl - infl120, 0)", "credit_conditions": "0", "currency_strength": "0",
        "dollar_strength": "0", "yield_curve_slope": "0", "credit_spreads": "0"})
