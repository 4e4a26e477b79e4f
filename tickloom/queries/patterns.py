"""Queries over pattern features, the earlier forms and the sequence-model features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.earlier_features import EARLIER, SEQUENCE, lagged, with_basket
from ..plans.pattern_features import (
    PATTERN_COLUMNS, benchmark_bars, feature_catalog, pattern_features, pattern_matrix, pattern_set,
    select_by_importance,
)
from . import sql as q
from .base import register
from .features import ATR_STEPS, CONTEXT_STEPS, RET, VOL_STEPS, hourly, simple, weekly  # noqa: F401

# -- pattern features ------------------------------------------------------------
BENCH = """bench AS (SELECT ts, avg(close) AS bclose FROM bars GROUP BY ts),
bench_ret AS (SELECT ts, bclose / lag(bclose) OVER (ORDER BY ts) - 1 AS market_return FROM bench),
sect AS (SELECT sector, ts, avg(close) AS sclose FROM bars GROUP BY 1, 2),
sect_ret AS (SELECT *, sclose / lag(sclose) OVER (PARTITION BY sector ORDER BY ts) - 1 AS sret FROM sect),
sect20 AS (SELECT sector, ts, CASE WHEN count(sret) OVER w >= 20 THEN avg(sret) OVER w END AS sector_mean20
           FROM sect_ret WINDOW w AS (PARTITION BY sector ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
JOIN_EXTRA = ("SELECT p.*, market_return, sector_mean20 FROM {prev} p LEFT JOIN bench_ret USING (ts) "
              "LEFT JOIN sect20 USING (sector, ts)")


def with_inputs(*steps, final=None):
    text = q.stages("weekly", JOIN_EXTRA, *steps, final=final)
    head, tail = text.split("s0 AS (", 1)
    return head + BENCH + ",\ns0 AS (" + tail


_PAIR = "CASE WHEN daily_return IS NOT NULL AND market_return IS NOT NULL THEN {} END"
_W60 = q.rows(-59)
_D, _M = _PAIR.format("daily_return"), _PAIR.format("market_return")
BETA60 = (f"CASE WHEN count(daily_return) OVER {_W60} >= 60 AND count({_M}) OVER {_W60} >= 10 AND "
          f"max({_M}) OVER {_W60} > min({_M}) OVER {_W60} THEN covar_samp({_D}, {_M}) OVER {_W60} / "
          f"var_pop({_M}) OVER {_W60} END")
PATTERN_STEPS = (
    RET,
    {"mean5": q.mean("daily_return", 5), "std20": q.std("daily_return", 20), "ar": "abs(daily_return)",
     "rng": "high - low", "b60": BETA60,
     "ev": f"var_samp(daily_return) OVER {q.BEFORE}", "fv": "var_samp(daily_return) OVER (PARTITION BY symbol)"},
    {"price_acceleration": f"mean5 - {q.lag('mean5')}",
     "volume_price_divergence": f"volume / ({q.mean('volume', 20)}) * -({q.mean('daily_return', 20)})",
     "volatility_regime_change": f"(std20 - ({q.mean('std20', 60)})) / (({q.mean('std20', 60)}) + 1e-8)",
     "return_skewness_7d": q.skew("daily_return", 7), "dl": f"list(sign(mean5)) FILTER (WHERE mean5 IS NOT NULL) OVER {q.rows(-6)}",
     "volatility_clustering": f"({q.mean('ar', 5)}) / (({q.mean('ar', 20)}) + 1e-8)",
     "trend_exhaustion": f"abs({q.mean('daily_return', 10)}) / (({q.std('daily_return', 10)}) + 1e-8)",
     "intraday_range_expansion": f"rng / (({q.mean('rng', 20)}) + 1e-8)",
     "overnight_gap_behavior": f"(open - {q.lag('close')}) / {q.lag('close')}",
     "end_of_day_momentum": "(close - low) / (high - low + 1e-8)",
     "sector_relative_strength": f"({q.mean('daily_return', 20)}) - sector_mean20",
     "market_beta_instability": q.std("b60", 20), "vix_term_structure": "0", "returns_1d": "daily_return",
     "returns_3d": q.pct("close", 3), "returns_7d": q.pct("close", 7),
     "volume_normalized": f"volume / (({q.mean('volume', 20)}) + 1e-8)",
     "gu": f"CASE WHEN pos >= 20 THEN 0.1 * pow({q.lag('daily_return')}, 2) + 0.05 * ev END"},
    {"momentum_persistence_7d": "CASE WHEN len(dl) = 7 THEN len(list_filter(dl, lambda v: v = dl[7])) END",
     "gl": f"list(gu) FILTER (WHERE gu IS NOT NULL) OVER {q.RUN}"},
    {"garch_volatility_forecast": "CASE WHEN pos >= 20 THEN sqrt(list_reduce(list_prepend(fv, gl), "
                                  "lambda a, v: 0.85 * a + v)) END"},
)
PATTERN_SPEC = " ".join(c + (":4" if c == "close" else ":5") for c in PATTERN_COLUMNS)


def _pattern(s, d):
    bars = weekly(s, d)
    market = benchmark_bars(bars).select("ts", "close")
    sectors = benchmark_bars(bars, ["sector"]).select("sector", "ts", "close")
    return pattern_features(bars, market, sectors)


register("pattern_features", f"symbol ts:t | {PATTERN_SPEC}",
         "PAT1 PAT2 PAT3 PAT4 PAT5 PAT6 PAT7 PAT8 PAT9 PAT10 PAT11 PAT12 PAT13 PAT15 PAT16 PAT17 PAT20 JN5 JN6 WIN11 WIN20 WIN24",
         with_inputs(*PATTERN_STEPS))(_pattern)


def _vix(s, d):
    """Volatility-index stand-in from one symbol, joined as of the other symbols' bars."""
    from ..plans.core_features import CORE
    from ..plans.registry import Registry
    reg = Registry(parent=CORE)
    reg.add("vix", vix=lambda f: f.std("daily_return", 20), vix9d=lambda f: f.std("daily_return", 9))
    bars = hourly(s, d)
    source = reg.compute(bars.where(F.col("symbol") == "view"), ["vix9d", "vix"])
    return pattern_features(bars.where(F.col("symbol") != "view"), vix=source, columns=["vix_term_structure", "close"])


register("pattern_vix_asof", "symbol ts:t | vix_term_structure close", "PAT14 PAT21 JN7",
         q.stages("hourly", RET, {"slope": f"({q.std('daily_return', 9)}) - ({q.std('daily_return', 20)})"},
                  final="SELECT b.symbol, b.ts, b.close, v.slope AS vix_term_structure FROM (SELECT * FROM {prev} "
                        "WHERE symbol <> 'view') b ASOF LEFT JOIN (SELECT ts, slope FROM {prev} WHERE symbol = 'view') v "
                        "ON b.ts >= v.ts"))(_vix)
register("pattern_matrix_clean", f"symbol ts:t | {PATTERN_SPEC}", "PAT17 PRJ11 PRJ24 PRJ25", None)(
    lambda s, d: pattern_matrix(weekly(s, d)))
register("pattern_catalog_share", "feature feature_group importance n:i", "PAT18 PAT19",
         with_inputs(*PATTERN_STEPS, final="SELECT 'price_acceleration' AS feature, 'nonlinear_price_patterns' AS "
                     "feature_group, 'high' AS importance, count(price_acceleration) AS n FROM {prev} UNION ALL "
                     "SELECT 'volatility_clustering', 'temporal_dependencies', 'high', count(volatility_clustering) FROM {prev} UNION ALL "
                     "SELECT 'momentum_persistence_7d', 'temporal_dependencies', 'high', count(momentum_persistence_7d) FROM {prev} UNION ALL "
                     "SELECT 'garch_volatility_forecast', 'temporal_dependencies', 'high', count(garch_volatility_forecast) FROM {prev} UNION ALL "
                     "SELECT 'returns_1d', 'core_context', 'high', count(returns_1d) FROM {prev}"))(
    lambda s, d: select_by_importance(_pattern(s, d), "high").unpivot(
        ["symbol", "ts"], ["price_acceleration", "volatility_clustering", "momentum_persistence_7d",
                           "garch_volatility_forecast", "returns_1d"], "feature", "value")
    .groupBy("feature").agg(F.count("value").alias("n")).join(F.broadcast(feature_catalog(s)), "feature"))

# -- earlier twelve ----------------------------------------------------------------
SET_STEPS = (
    {"lr0": f"coalesce(ln(close / {q.lag('close')}), 0)", "delta": f"close - {q.lag('close')}"},
    {"v20": q.std("lr0", 20), "al": "abs(lr0)", "top": q.agg("max(high)", "high", -20, -1),
     "bot": q.agg("min(low)", "low", -20, -1), "up": "greatest(delta, 0) + 0 * delta",
     "dn": "greatest(-delta, 0) + 0 * delta", "pv": f"var_pop(lr0) OVER {q.BEFORE}",
     "fs": f"CASE WHEN pos = 25 THEN {q.mean('close', 12)} WHEN pos > 25 THEN close END",
     "ss": f"CASE WHEN pos = 25 THEN {q.mean('close', 26)} WHEN pos > 25 THEN close END",
     "m20": q.mean("close", 20), "sd": q.agg("stddev_pop(close)", "close", -19)},
    {"us": f"CASE WHEN pos = 14 THEN {q.mean('up', 14)} WHEN pos > 14 THEN up END",
     "ds": f"CASE WHEN pos = 14 THEN {q.mean('dn', 14)} WHEN pos > 14 THEN dn END",
     "line": f"({q.ewm_recursive('fs', '(2.0/13)')}) - ({q.ewm_recursive('ss', '(2.0/27)')})",
     "gu": f"CASE WHEN pos = 19 THEN var_pop(lr0) OVER {q.rows(-19)} WHEN pos >= 20 THEN "
           f"0.1 * pow({q.lag('lr0')}, 2) + 0.05 * pv END"},
    {"au": q.ewm_recursive("us", "(1.0/14)"), "ad": q.ewm_recursive("ds", "(1.0/14)"),
     "sg": f"CASE WHEN pos = 33 THEN {q.mean('line', 9)} WHEN pos > 33 THEN line END",
     "gv": f"CASE WHEN pos >= 20 THEN list_reduce(list(gu) FILTER (WHERE gu IS NOT NULL) OVER {q.RUN}, "
           "lambda a, v: 0.85 * a + v) ELSE 0 END"},
    {"rsi": "CASE WHEN pos >= 14 THEN coalesce(CASE WHEN au + ad <> 0 THEN 100.0 * au / (au + ad) END, 0) END",
     "hist": f"line - ({q.ewm_recursive('sg', '(2.0/10)')})"},
    {"price_momentum_5d": f"coalesce((close / {q.lag('close', 5)} - 1) * 100, 0)",
     "price_momentum_20d": f"coalesce((close / {q.lag('close', 20)} - 1) * 100, 0)",
     "volume_momentum": f"(volume / ({q.mean('volume', 20)}) - 1) * 100",
     "volatility_regime": q.div(f"v20 - ({q.mean('v20', 60)})", q.std("v20", 60)),
     "volatility_clustering": q.div(q.mean("al", 5), q.mean("al", 20)),
     "garch_signal": "(gv - avg(gv) OVER (PARTITION BY symbol)) / (stddev_pop(gv) OVER (PARTITION BY symbol) + 1e-8)",
     "gap_analysis": f"coalesce((open / {q.lag('close')} - 1) * 100, 0)",
     "support_resistance": "CASE WHEN top IS NULL THEN 0 WHEN top = bot THEN 50 ELSE (close - bot) / (top - bot) * 100 END",
     "trend_strength": f"coalesce(({q.slope('close', 20, -20)}) / close * 100, 0)",
     "rsi_divergence": f"CASE WHEN pos < 10 THEN 0 ELSE (close / {q.lag('close', 10)} - 1) * -((rsi - {q.lag('rsi', 10)}) / 100) * 100 END",
     "macd_momentum": f"coalesce(hist - {q.lag('hist', 5)}, 0)",
     "bollinger_position": "CASE WHEN sd IS NULL THEN 0 WHEN sd = 0 THEN 50 ELSE (close - (m20 - 2 * sd)) / (4 * sd) * 100 END"},
)
register("pattern_set_earlier", "symbol ts:t | price_momentum_5d:5 price_momentum_20d:5 volume_momentum:5 volatility_regime:5 "
         "volatility_clustering garch_signal:4 gap_analysis:5 support_resistance:5 trend_strength:5 rsi_divergence:4 "
         "macd_momentum:5 bollinger_position:4",
         "PAT22 MOM8 MOM9 VOL7 VOL8 MKT4 MKT5 TEC10 TEC11 TEC12", q.stages("hourly", *SET_STEPS))(
    lambda s, d: pattern_set(hourly(s, d)))

# -- earlier forms --------------------------------------------------------------------
def wma(x, n):
    total = n * (n + 1) / 2
    terms = " + ".join(f"{n - k} * " + (x if k == 0 else q.lag(x, k)) for k in range(n))
    return f"({terms}) / {total}"


AVERAGES = (
    {"raw": f"2 * ({wma('close', 10)}) - ({wma('close', 20)})", "sma_5": q.mean("close", 5), "sma_20": q.mean("close", 20), "cv": "close * volume"},
    {"vwap_20": q.guard(q.total("cv", 20), q.total("volume", 20))},
    {"hull_20": wma("raw", 4), "ma_convergence": "abs(sma_5 - sma_20) / close", "ma_slope_5": f"(sma_5 - {q.lag('sma_5', 5)}) / {q.lag('sma_5', 5)}",
     "ma_slope_20": f"(sma_20 - {q.lag('sma_20', 5)}) / {q.lag('sma_20', 5)}", "h1_range_normalized": "(high - low) / close",
     "price_efficiency": "abs(close - vwap_20) / close"})
RSI_OBV = (
    {"delta": f"close - {q.lag('close')}"},
    {"g": "CASE WHEN delta > 0 THEN delta END", "l": "CASE WHEN delta < 0 THEN -delta END",
     "sv": "CASE WHEN pos = 0 THEN volume ELSE coalesce(sign(delta), 0) * volume END"},
    {"rsi_simple_14": f"100 - 100 / (1 + ({q.mean('g', 14)}) / (({q.mean('l', 14)}) + 1e-10))",
     "rsi_simple_21": f"100 - 100 / (1 + ({q.mean('g', 21)}) / (({q.mean('l', 21)}) + 1e-10))", "obv_seeded": f"sum(sv) OVER {q.RUN}"})
MOMENTUM_VOLATILITY = (
    {**RET, **VOL_STEPS[0], **{f"m{n}": q.pct("close", n) for n in (5, 10, 20)}, "t5": q.slope("close", 5)},
    {"volatility_5d": VOL_STEPS[1]["volatility_5d"], "volatility_20d": VOL_STEPS[1]["volatility_20d"], "s5": q.std("daily_return", 5), "sg": "sign(m5)"},
    {"momentum_strength_1e8": "m5 / (s5 + 1e-8)", "momentum_persistence_sum": f"({q.total('sg', 10)}) / 10",
     "momentum_oscillator_1e8": q.guard("m10 - m20", "m10 + m20", "1e-8"), "volatility_ratio_1e8": "volatility_5d / (volatility_20d + 1e-8)",
     "trend_persistence": q.std("t5", 10), "low_vol_factor": f"volatility_20d / ({q.mean('volatility_20d', 60)})"})
PROXIES = (
    {**RET, **VOL_STEPS[0], "m5": q.pct("close", 5), "m20": q.pct("close", 20)},
    {"v5": VOL_STEPS[1]["volatility_5d"], "v20": VOL_STEPS[1]["volatility_20d"], "r5": q.mean("daily_return", 5)},
    {"sentiment_score": "tanh(r5 / v5)", "news_flow": q.clip("abs(daily_return) / v20", 0, 3), "search_volume": "(abs(daily_return) + v5) / 2",
     "analyst_revisions": q.mean("m20", 10), "seasonal_yield": "sin(pos * 2 * pi() / 252) * 0.1"},
    {"social_sentiment": "(m5 + sentiment_score) / 2"})
simple("earlier_averages", "hourly", EARLIER, "PRC11 PRC14 PRC15 WIN16",
       "hull_20 ma_convergence ma_slope_5 ma_slope_20 h1_range_normalized price_efficiency", *AVERAGES)
simple("earlier_rsi_obv", "hourly", EARLIER, "TEC2 VLM6", "rsi_simple_14:4 rsi_simple_21:4 obv_seeded", *RSI_OBV)
simple("earlier_momentum_volatility", "weekly", EARLIER, "MOM10 MOM11 VOL10 VOL11",
       "momentum_strength_1e8:4 momentum_persistence_sum momentum_oscillator_1e8:3 volatility_ratio_1e8 "
       "trend_persistence:4 low_vol_factor", *MOMENTUM_VOLATILITY)
BASKET = ("SELECT *, avg(daily_return) OVER (PARTITION BY ts) AS market_return, "
          "CASE WHEN count(daily_return) OVER (PARTITION BY ts) - (daily_return IS NOT NULL)::INT > 0 THEN "
          "(sum(daily_return) OVER (PARTITION BY ts) - coalesce(daily_return, 0)) / "
          "(count(daily_return) OVER (PARTITION BY ts) - (daily_return IS NOT NULL)::INT) END AS basket_return, "
          "lag(daily_return) OVER (PARTITION BY symbol ORDER BY ts) AS p1 FROM {prev}")
register("basket_relative", "symbol ts:t | basket_correlation basket_strength basket_beta idiosyncratic_vol",
         "MKT11 VOL9 JN9",
         q.stages("weekly", {**RET, **VOL_STEPS[0]}, BASKET,
                  {"v20": VOL_STEPS[1]["volatility_20d"], "ex": "daily_return - basket_return",
                   "oc": f"coalesce({q.corr('daily_return', 'p1', 20)}, 0.5)",
                   "dm": "CASE WHEN daily_return IS NOT NULL AND market_return IS NOT NULL THEN daily_return END",
                   "md": "CASE WHEN daily_return IS NOT NULL AND market_return IS NOT NULL THEN market_return END"},
                  {"basket_correlation": q.corr("daily_return", "basket_return", 20), "basket_strength": q.mean("ex", 10),
                   "basket_beta": f"({q.agg('covar_samp(dm, md)', 'dm', -59)}) / (({q.agg('var_samp(market_return)', 'market_return', -59)}) + 1e-10)"},
                  {"idiosyncratic_vol": "sqrt(greatest(v20 * v20 - pow(basket_beta * oc * v20, 2), 0)) + 0 * basket_beta"}))(
    lambda s, d: EARLIER.compute(with_basket(weekly(s, d)), ["basket_correlation", "basket_strength", "basket_beta",
                                                             "idiosyncratic_vol"]))
simple("alternative_proxies", "weekly", EARLIER, "MKT20 MKT21",
       "sentiment_score news_flow social_sentiment search_volume analyst_revisions seasonal_yield", *PROXIES)


def tcorr(x, n):
    w = q.rows(1 - n)
    return (f"CASE WHEN count({x}) OVER {w} >= {n} THEN CASE WHEN max({x}) OVER {w} > min({x}) OVER {w} "
            f"THEN corr({x}, pos) OVER {w} ELSE 0 END END")


simple("sequence_features", "hourly", SEQUENCE, "SEQ1 SEQ2 SEQ3 SEQ4 SEQ5 SEQ7 WIN14",
       "return_sequence_sum_5 return_sequence_sum_10 return_sequence_std_5 return_sequence_std_10 return_momentum_3 "
       "return_momentum_5 return_acceleration volatility_persistence volatility_trend volume_trend_5 volume_acceleration "
       "price_momentum_3 price_momentum_7 price_acceleration support_5 resistance_5 support_distance resistance_distance "
       "return_memory_5 return_memory_10 volume_memory_5 volume_memory_10",
       {**RET, **VOL_STEPS[0], "volume_trend_5": q.slope("volume", 5), "price_momentum_3": q.pct("close", 3),
        "price_momentum_7": q.pct("close", 7), "support_5": q.lo("close", 5), "resistance_5": q.hi("close", 5),
        "vr": f"volume / (({q.mean('volume', 20)}) + 1e-10)"},
       {"v5": VOL_STEPS[1]["volatility_5d"], "return_sequence_sum_5": q.total("daily_return", 5),
        "return_sequence_sum_10": q.total("daily_return", 10), "return_sequence_std_5": q.std("daily_return", 5),
        "return_sequence_std_10": q.std("daily_return", 10), "return_momentum_3": q.mean("daily_return", 3),
        "return_momentum_5": q.mean("daily_return", 5), "volume_acceleration": f"volume_trend_5 - {q.lag('volume_trend_5')}",
        "price_acceleration": "price_momentum_3 - price_momentum_7", "support_distance": "(close - support_5) / close",
        "resistance_distance": "(resistance_5 - close) / close", "return_memory_5": tcorr("daily_return", 5),
        "return_memory_10": tcorr("daily_return", 10), "volume_memory_5": tcorr("vr", 5), "volume_memory_10": tcorr("vr", 10)},
       {"return_acceleration": "return_momentum_3 - return_momentum_5", "volatility_persistence": q.std("v5", 10),
        "volatility_trend": q.slope("v5", 5)})
simple("sequence_regimes", "weekly", SEQUENCE, "SEQ6",
       "trend_regime_change trend_regime_stability volume_regime_change volume_regime_stability",
       {"t20": q.slope("close", 20), "vm": q.quant("volume", 60, 0.5)},
       {"tr": "CASE WHEN t20 > 0.01 THEN 1 WHEN t20 < -0.01 THEN -1 ELSE 0 END",
        "vr": "CASE WHEN volume > vm * 1.5 THEN 1 WHEN volume < vm * 0.5 THEN -1 ELSE 0 END"},
       {"trend_regime_change": q.flag(f"tr IS DISTINCT FROM {q.lag('tr')}"), "trend_regime_stability": q.std("tr", 5),
        "volume_regime_change": q.flag(f"vr IS DISTINCT FROM {q.lag('vr')}"), "volume_regime_stability": q.std("vr", 5)})
register("lagged_features", "symbol ts:t | daily_return_lag1 daily_return_lag5 momentum_5d_lag1 momentum_5d_lag5", "PRJ19 WIN1",
         q.stages("hourly", {**RET, "momentum_5d": q.pct("close", 5)},
                  {f"{c}_lag{k}": q.lag(c, k) for c in ("daily_return", "momentum_5d") for k in (1, 5)}))(
    lambda s, d: lagged(hourly(s, d), ["daily_return", "momentum_5d"], [1, 5]))
