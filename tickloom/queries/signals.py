"""Queries over strategy signals, pattern scores and the ensemble."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..evaluate.strategy import strategy_performance
from ..learn.splits import sized
from ..learn.window_models import fit_window_model, landing_windows, load_model, model_scores, save_model
from ..plans.core_features import CORE
from ..plans.registry import Registry
from ..signals.ensemble import (
    EnsembleRules, align_signals, attribution, batch_flow, combine_long, compatibility,
    coordinate, correlated_pairs, default_weights, ensemble_signals, flow_metrics, rebalanced_weights, signal_flow,
    signal_pairs,
)
from ..signals.strategies import (
    MacdRules, RsiRules, long_signals, rsi_extremity, run_strategies, run_strategy, strategy_returns,
)
from ..signals.verification import PatternRules, score_signals, verification_stats, verify_signals, window_scores
from . import sql as q
from .base import register, scratch
from .features import ATR_STEPS, MACD_STEPS, RET, RSI_STEPS, hourly, weekly
from .fit_sql import residuals

NAMES = ["rsi_mean_reversion", "macd_momentum"]
DAMP = "CASE WHEN an / nullif(am, 0) IS NOT NULL THEN 1 - least(greatest(least(greatest(an / nullif(am, 0), 0), 2) - 1, 0), 1) END"
BASE_STEPS = (*RSI_STEPS, *ATR_STEPS, *MACD_STEPS, {"an": "atr / close"}, {"am": q.mean("an", 20, 1)})
RSI_RULES = (
    {"prev": q.lag("rsi_14")},
    {"lng": "coalesce(rsi_14 < 30, false) AND NOT coalesce(prev < 30, false)",
     "sht": "coalesce(rsi_14 > 70, false) AND NOT coalesce(prev > 70, false)",
     "out": "coalesce((rsi_14 > 40 AND prev <= 40) OR (rsi_14 < 60 AND prev >= 60), false)"},
    {"raw": "CASE WHEN out THEN 0 WHEN lng THEN 1 WHEN sht THEN -1 ELSE 0 END"},
    {"r_str": f"coalesce(CASE WHEN raw > 0 THEN least(greatest((30 - rsi_14) / 30, 0), 1) WHEN raw < 0 THEN "
              f"least(greatest((rsi_14 - 70) / 30, 0), 1) ELSE 0 END * ({DAMP}), 0)",
     "r_pos": "least(greatest(raw, -0.1), 0.1)", "r_entry": "CASE WHEN lng OR sht THEN close END",
     "r_stop": "CASE WHEN lng THEN close - 2 * atr WHEN sht THEN close + 2 * atr END",
     "r_target": "CASE WHEN lng THEN close + 3 * atr WHEN sht THEN close - 3 * atr END"},
)
MACD_RULES = (
    {"pm": f"lag(macd, 1, 0) OVER ({q.PART})", "ps": f"lag(macd_signal, 1, 0) OVER ({q.PART})", "hs": q.std("macd_histogram", 20, 1)},
    {"up": "macd > macd_signal AND pm <= ps AND macd_histogram > 0", "dn": "macd < macd_signal AND pm >= ps AND macd_histogram < 0"},
    {"mraw": "CASE WHEN up THEN 1 WHEN dn THEN -1 ELSE 0 END",
     "msc": "macd_histogram / (CASE WHEN hs = 0 THEN 1 ELSE hs END)"},
    {"m_str": f"coalesce(CASE WHEN mraw <> 0 THEN least(greatest(mraw * msc, 0), 3) / 3 ELSE 0 END * ({DAMP}), 0)",
     "m_pos": "least(greatest(mraw, -0.1), 0.1)", "m_entry": "CASE WHEN mraw <> 0 THEN close END",
     "m_stop": "close - nullif(mraw, 0) * 2 * atr", "m_target": "close + nullif(mraw, 0) * 3 * atr"},
)
ALL = (*BASE_STEPS, *RSI_RULES, *MACD_RULES)
SPEC = "symbol ts:t strategy | position entry stop target strength"


def _sig(p, name, prefix):
    return (f"SELECT symbol, ts, '{name}' AS strategy, {prefix}_pos AS position, {prefix}_entry AS entry, "
            f"{prefix}_stop AS stop, {prefix}_target AS target, {prefix}_str AS strength FROM {p}")


register("rsi_signals", "symbol ts:t strategy | close position entry stop target strength",
         "SIG1 SIG2 SIG5 SIG6 SIG7 SIG8 SIG9", q.stages("hourly", *ALL, final=_sig("{prev}", NAMES[0], "r").replace(
             "SELECT symbol", "SELECT close, symbol")))(lambda s, d: run_strategy(hourly(s, d), "rsi_mean_reversion"))
register("macd_signals", SPEC, "SIG7 SIG11 SIG12 SIG14",
         q.stages("hourly", *ALL, final=_sig("{prev}", NAMES[1], "m")))(
    lambda s, d: run_strategy(hourly(s, d), "macd_momentum"))
register("macd_signals_zeroed", "symbol ts:t strategy | position entry strength", "SIG13",
         q.stages("hourly", *ALL, final=f"SELECT symbol, ts, '{NAMES[1]}' AS strategy, 0 AS position, m_entry AS entry, "
                  "0 AS strength FROM {prev}"))(
    lambda s, d: run_strategy(hourly(s, d), "macd_momentum", MacdRules(zero_on_cross=True)))
register("rsi_extremity", "symbol ts:t | extremity", "SIG10",
         q.stages("hourly", *RSI_STEPS, final="SELECT symbol, ts, CASE WHEN rsi_14 <= 30 THEN (30 - rsi_14) / 30 "
                  "WHEN rsi_14 >= 70 THEN (rsi_14 - 70) / 30 ELSE 0 END AS extremity FROM {prev}"))(
    lambda s, d: CORE.compute(hourly(s, d), ["rsi_14"]).select("symbol", "ts", rsi_extremity(F.col("rsi_14")).alias("extremity")))
register("signals_long", SPEC, "SIG1 ENS6",
         q.stages("weekly", *ALL, final=_sig("{prev}", NAMES[0], "r") + " UNION ALL " + _sig("{prev}", NAMES[1], "m")))(
    lambda s, d: long_signals(run_strategies(weekly(s, d)), NAMES))
RET_STEPS = (*ALL, RET, {"sret": f"coalesce(({q.lag('r_pos')}) * daily_return, 0)"})
register("strategy_returns", "symbol ts:t | strategy_return", "SIG3",
         q.stages("weekly", *RET_STEPS, final="SELECT symbol, ts, sret AS strategy_return FROM {prev}"))(
    lambda s, d: strategy_returns(run_strategy(weekly(s, d), "rsi_mean_reversion"), weekly(s, d)))
register("strategy_performance", "symbol total_signals:i | total_return sharpe max_drawdown win_rate", "SIG4 WIN22 WIN23 PERF1",
         q.stages("weekly", *RET_STEPS, {"eq": f"product(1 + sret) OVER {q.RUN}"}, {"hw": f"max(eq) OVER {q.RUN}"},
                  final="SELECT symbol, count(*) FILTER (WHERE sret <> 0) AS total_signals, sum(sret) AS total_return, "
                        "coalesce(avg(sret) / nullif(stddev_samp(sret), 0) * sqrt(252.0), 0) AS sharpe, "
                        "min((eq - hw) / hw) AS max_drawdown, avg((sret > 0)::INT) AS win_rate FROM {prev} GROUP BY symbol"))(
    lambda s, d: strategy_performance(strategy_returns(run_strategy(weekly(s, d), "rsi_mean_reversion"), weekly(s, d))))

# -- ensemble ----------------------------------------------------------------------
# Default weights at registration: 1 for the first strategy, 1/2 for the second.
WA = {"position": "(r_pos * 1.0 + m_pos * 0.5) / 1.5", "confidence": "(r_str * 1.0 + m_str * 0.5) / 1.5",
      "act": "(CASE WHEN r_pos <> 0 THEN 'rsi_mean_reversion ' ELSE '' END) || (CASE WHEN m_pos <> 0 THEN 'macd_momentum ' ELSE '' END)"}


def _ens(s, d, method="weighted_average", table=weekly, **limits):
    return ensemble_signals(table(s, d), rules=EnsembleRules(method=method, **limits))


register("ensemble_weighted", "symbol ts:t active | position confidence rsi_part macd_part", "ENS1 ENS5 ENS6 ENS17",
         q.stages("weekly", *ALL, WA, final="SELECT symbol, ts, act AS active, CASE WHEN act = '' THEN 0 ELSE position END AS position, "
                  "confidence, r_pos * 1.0 AS rsi_part, m_pos * 0.5 AS macd_part FROM {prev}"))(
    lambda s, d: _ens(s, d).select(
        "symbol", "ts", F.array_join(F.transform("active_strategies", lambda v: F.concat(v, F.lit(" "))), "").alias("active"),
        "position", "confidence", F.col("contributions")["rsi_mean_reversion"].alias("rsi_part"),
        F.col("macd_momentum_contribution").alias("macd_part")))
register("ensemble_voting", "symbol ts:t | position confidence", "ENS2",
         q.stages("weekly", *ALL, {"lv": "(r_pos > 0)::INT + (m_pos > 0)::INT", "sv": "(r_pos < 0)::INT + (m_pos < 0)::INT"},
                  final="SELECT symbol, ts, (CASE WHEN lv > sv THEN 1 WHEN sv > lv THEN -1 ELSE 0 END) * "
                        "greatest(lv, sv) / greatest(lv + sv, 1) AS position, (r_str + m_str) / 2 AS confidence FROM {prev}"))(
    lambda s, d: _ens(s, d, "voting"))
register("ensemble_confidence", "symbol ts:t | position confidence", "ENS3",
         q.stages("weekly", *ALL, {"tw": "r_str + 0.5 * m_str"},
                  final="SELECT symbol, ts, CASE WHEN tw > 0 THEN (r_pos * r_str + m_pos * 0.5 * m_str) / tw ELSE 0 END AS position, "
                        "CASE WHEN tw > 0 THEN (r_str * r_str + m_str * 0.5 * m_str) / tw ELSE 0 END AS confidence FROM {prev}"))(
    lambda s, d: _ens(s, d, "confidence_weighted"))
register("ensemble_filtered", "symbol ts:t | position confidence", "ENS4 FN12",
         q.stages("weekly", *ALL, WA, final="SELECT symbol, ts, CASE WHEN (r_pos <> 0)::INT + (m_pos <> 0)::INT < 1 THEN 0 "
                  "WHEN confidence < 0.05 THEN 0 ELSE least(greatest(position, -0.05), 0.05) END AS position, confidence FROM {prev}"))(
    lambda s, d: _ens(s, d, min_confidence=0.05, max_total=0.05))
register("ensemble_long_form", "symbol ts:t n_active:i | position confidence", "ENS1 ENS17",
         q.stages("weekly", *ALL, WA, final="SELECT symbol, ts, (r_pos <> 0)::INT + (m_pos <> 0)::INT AS n_active, position, "
                  "confidence FROM {prev}"))(
    lambda s, d: combine_long(
        long_signals(run_strategies(weekly(s, d)), NAMES),
        s.createDataFrame([("rsi_mean_reversion", 1.0), ("macd_momentum", 0.5), ("pattern_score", 0.0)],
                          "strategy string, weight double")).withColumn("n_active", F.size("active_strategies")))
register("signal_alignment", "symbol ts:t | position", "JN12",
         q.stages("weekly", *ALL, final="SELECT symbol, ts, r_pos AS position FROM {prev}"))(
    lambda s, d: align_signals(weekly(s, d), run_strategy(weekly(s, d), "rsi_mean_reversion").where("position != 0"), ["position"]))
PAIR_SQL = q.stages("weekly", *ALL,
                    final="SELECT symbol, 'rsi_mean_reversion' AS a, 'macd_momentum' AS b, CASE WHEN max(r_pos) > min(r_pos) AND "
                          "max(m_pos) > min(m_pos) THEN corr(r_pos, m_pos) END AS corr FROM {prev} GROUP BY symbol")
register("ensemble_signal_correlation", "symbol a b | corr", "ENS7 WIN29", PAIR_SQL)(
    lambda s, d: signal_pairs(run_strategies(weekly(s, d)), NAMES))
register("ensemble_correlated_pairs", "symbol a b | corr", "ENS8",
         f"SELECT symbol, a, b, abs(corr) AS corr FROM ({PAIR_SQL}) WHERE abs(corr) > 0.1")(
    lambda s, d: correlated_pairs(signal_pairs(run_strategies(weekly(s, d)), NAMES), 0.1))


def _sharpes(s, d):
    """Mean Sharpe of each strategy over the symbols, with the weight in force."""
    parts = []
    for n, w in default_weights(NAMES).items():
        perf = strategy_performance(strategy_returns(run_strategy(weekly(s, d), n), weekly(s, d)))
        parts.append(perf.agg(F.avg("sharpe").alias("sharpe")).select(F.lit(n).alias("strategy"), "sharpe", F.lit(w).alias("weight")))
    return parts[0].unionByName(parts[1])


register("ensemble_rebalance", "strategy | weight", "ENS9",
         q.stages("weekly", *ALL, RET, {"a": f"coalesce(({q.lag('r_pos')}) * daily_return, 0)", "b": f"coalesce(({q.lag('m_pos')}) * daily_return, 0)"},
                  "SELECT coalesce(avg(a) / nullif(stddev_samp(a), 0) * sqrt(252.0), 0) AS sa, "
                  "coalesce(avg(b) / nullif(stddev_samp(b), 0) * sqrt(252.0), 0) AS sb FROM {prev} GROUP BY symbol",
                  "SELECT greatest(avg(sa), 0) AS ga, greatest(avg(sb), 0) AS gb FROM {prev}",
                  final="SELECT 'rsi_mean_reversion' AS strategy, CASE WHEN ga + gb > 0 THEN ga / (ga + gb) ELSE 1.0 END AS weight FROM {prev} "
                        "UNION ALL SELECT 'macd_momentum', CASE WHEN ga + gb > 0 THEN gb / (ga + gb) ELSE 0.5 END FROM {prev}"))(
    lambda s, d: rebalanced_weights(_sharpes(s, d)))
register("ensemble_attribution", "symbol strategy total_signals:i long_signals:i short_signals:i active_periods:i | "
         "avg_position_size max_position_size avg_contribution max_contribution contribution_std", "ENS10",
         q.stages("weekly", *ALL, WA, "SELECT *, CASE WHEN act = '' THEN 0 ELSE position END AS p FROM {prev}",
                  "SELECT symbol, p, unnest([{{'strategy': 'rsi_mean_reversion', 'x': r_pos * 1.0}}, "
                  "{{'strategy': 'macd_momentum', 'x': m_pos * 0.5}}], recursive := true) FROM {prev}",
                  final="SELECT symbol, strategy, count(*) FILTER (WHERE p <> 0) AS total_signals, count(*) FILTER (WHERE p > 0) AS long_signals, "
                        "count(*) FILTER (WHERE p < 0) AS short_signals, count(*) FILTER (WHERE x <> 0) AS active_periods, "
                        "avg(abs(p)) AS avg_position_size, max(abs(p)) AS max_position_size, avg(abs(x)) AS avg_contribution, "
                        "max(abs(x)) AS max_contribution, stddev_samp(x) AS contribution_std FROM {prev} GROUP BY 1, 2"))(
    lambda s, d: attribution(_ens(s, d), NAMES))

# -- data checks and flow ----------------------------------------------------------
CHECK_SQL = q.stages("hourly", *ALL,
                     final="SELECT symbol, 'rsi_mean_reversion' AS strategy, count(*) AS n_rows, (CASE WHEN count(*) < 50 THEN 1 ELSE 0 END) + "
                           "(CASE WHEN avg((atr IS NULL)::INT) > 0.01 THEN 1 ELSE 0 END) AS n_issues FROM {prev} GROUP BY symbol")
register("strategy_compatibility", "symbol strategy n_rows:i n_issues:i", "ENS11 PRJ14", CHECK_SQL)(
    lambda s, d: compatibility(CORE.compute(hourly(s, d), ["rsi_14", "atr"], keep=["open", "high", "low", "close", "volume"]),
                               RsiRules(), max_null=0.01).withColumn("n_issues", F.size("issues")))
register("strategy_coordination", "symbol n_valid:i n_invalid:i ensemble_ready", "ENS12 ENS13",
         q.stages("hourly", *ALL, final="SELECT symbol, 2 * (avg((atr IS NULL)::INT) <= 0.1 AND count(*) >= 50)::INT AS n_valid, "
                  "2 - 2 * (avg((atr IS NULL)::INT) <= 0.1 AND count(*) >= 50)::INT AS n_invalid, "
                  "avg((atr IS NULL)::INT) <= 0.1 AND count(*) >= 50 AS ensemble_ready FROM {prev} GROUP BY symbol"))(
    lambda s, d: coordinate(CORE.compute(hourly(s, d), ["rsi_14", "macd", "macd_signal", "macd_histogram", "atr"],
                                         keep=["open", "high", "low", "close", "volume"]), (RsiRules(), MacdRules()))
    .select("symbol", F.size("valid_strategies").alias("n_valid"), F.size("invalid_strategies").alias("n_invalid"), "ensemble_ready"))
FLOW = q.stages("hourly", *ALL, WA, final="SELECT symbol, ts, CASE WHEN act = '' THEN 0 ELSE position END AS position, confidence FROM {prev}")
register("signal_flow", "symbol ts:t | position confidence", "ENS14 UDF2", FLOW)(lambda s, d: signal_flow(hourly(s, d)))
register("signal_flow_metrics", "symbol data_points:i ensemble_rows:i signals:i", "ENS15",
         f"SELECT symbol, count(*) AS data_points, count(*) AS ensemble_rows, count(*) FILTER (WHERE position <> 0) AS signals "
         f"FROM ({FLOW}) GROUP BY symbol")(lambda s, d: flow_metrics(hourly(s, d), signal_flow(hourly(s, d))))
register("signal_flow_batch", "dataset symbol n:i | total", "ENS16",
         f"SELECT unnest(['a', 'b']) AS dataset, symbol, n, total FROM (SELECT symbol, count(*) FILTER (WHERE position <> 0) AS n, "
         f"sum(abs(position)) AS total FROM ({FLOW}) GROUP BY symbol)")(
    lambda s, d: batch_flow(hourly(s, d).withColumn("dataset", F.explode(F.array(F.lit("a"), F.lit("b")))))
    .groupBy("dataset", "symbol").agg(F.count_if(F.col("position") != 0).alias("n"), F.sum(F.abs("position")).alias("total")))

# -- pattern scores ------------------------------------------------------------------
SCORE = {"returns_1d": 4.0, "returns_3d": 2.0, "trend_strength_5d": 1.0}
FEATS = {**RET, "returns_3d": q.pct("close", 3), "trend_strength_5d": q.slope("close", 5)}
W20 = q.rows(-20, -1)


def _b(x):
    """Backward fill of a leading gap, then 0."""
    return f"coalesce({x}, first_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)"


SCORE_STEPS = (
    FEATS,
    {"f1": _b("daily_return"), "f3": _b("returns_3d"), "f5": _b("trend_strength_5d")},
    {"conf": f"CASE WHEN pos >= 20 THEN 1 / (1 + exp(-(4 * avg(f1) OVER {W20} + 2 * avg(f3) OVER {W20} + avg(f5) OVER {W20}))) ELSE 0 END"},
)


def _scores(s, d, keep=("close",)):
    reg_cols = ["daily_return", "trend_strength_5d"]
    reg = Registry(parent=CORE)
    reg.add("score", returns_1d=lambda f: f["daily_return"], returns_3d=lambda f: f.pct("close", 3))
    feats = reg.compute(hourly(s, d), ["returns_1d", "returns_3d", *reg_cols], keep=["close"])
    return window_scores(feats, SCORE, keep=keep)


register("pattern_scores", "symbol ts:t | confidence", "SIG22 SEQ15 JN13 PRJ13",
         q.stages("hourly", *SCORE_STEPS, final="SELECT symbol, ts, conf AS confidence FROM {prev}"))(_scores)
MODEL_COLUMNS, MODEL_ROWS = ["returns_1d", "returns_3d"], 5
MODEL_INPUTS = [f"w{c}_{k}" for k in range(MODEL_ROWS) for c in ("f1", "f3")]
# Each row scores once (y 0: what a fit leaves there is minus its prediction) and, in the first 70% of its series, trains once.
MODEL_STEPS = (
    {**FEATS, "n": "count(*) OVER (PARTITION BY symbol)"}, {"f1": _b("daily_return"), "f3": _b("returns_3d")},
    {f"w{c}_{k}": q.lag(c, MODEL_ROWS - k) for k in range(MODEL_ROWS) for c in ("f1", "f3")},
    "SELECT *, 'train' AS part, daily_return AS y, 1 AS one FROM {prev} WHERE pos >= 5 AND pos < floor(n * 0.7::DOUBLE) AND daily_return IS NOT NULL "
    "UNION ALL SELECT *, 'test', 0, 1 FROM {prev} WHERE pos >= 5 UNION ALL SELECT *, 'none', NULL, 1 FROM {prev} WHERE pos < 5",
    *residuals(MODEL_INPUTS, "y", "one"),
)


def _model_scores(s, d):
    """Fit on the first 70% of every series, store the weights, load the newest version and score all windows."""
    reg = Registry(parent=CORE)
    reg.add("score", returns_1d=lambda f: f["daily_return"], returns_3d=lambda f: f.pct("close", 3), target=lambda f: f["daily_return"])
    feats = reg.compute(hourly(s, d), [*MODEL_COLUMNS, "target"])
    windows = landing_windows(feats, MODEL_COLUMNS, MODEL_ROWS, keep=["target"])
    train = sized(windows).where(F.col("pos") < F.floor(F.col("n_rows") * F.lit(0.7)))
    path = scratch(s)
    save_model(s, fit_window_model(train, MODEL_COLUMNS, MODEL_ROWS, "target", "next_return"), path, "1")
    return model_scores(feats, load_model(s, path, "next_return"))


register("window_model_scores", "symbol ts:t | confidence:9", "SIG22",
         q.stages("hourly", *MODEL_STEPS, final="SELECT symbol, ts, CASE WHEN part = 'none' THEN 0 ELSE -y_r END AS confidence FROM {prev} WHERE part <> 'train'"))(_model_scores)
for _mode, _ids, _pos in (
    ("standalone", "SIG15 SIG18 SIG23", "CASE WHEN conf > 0.6 THEN least((conf - 0.6) / 0.4, 1) WHEN conf < 0.4 THEN -least((0.4 - conf) / 0.4, 1) ELSE 0 END"),
    ("verification", "SIG16 SIG18 SIG23", "CASE WHEN conf < 0.5 THEN 0 ELSE conf END"),
    ("enhancement", "SIG17 SIG18 SIG23", "CASE WHEN abs((conf - 0.5) * 2) > 0 THEN (conf - 0.5) * 2 ELSE 0 END"),
):
    register(f"pattern_signals_{_mode}", "symbol ts:t | position strength", _ids,
             q.stages("hourly", *SCORE_STEPS, {"position": _pos},
                      final="SELECT symbol, ts, position, least(abs(position), 1) AS strength FROM {prev}"))(
        lambda s, d, m=_mode: score_signals(_scores(s, d), PatternRules(mode=m)))
VERIFY = (*ALL, *SCORE_STEPS, WA,
          {"was": "CASE WHEN act = '' THEN 0 ELSE position END"},
          {"now": "CASE WHEN conf < 0.5 THEN 0 WHEN conf > 0.5 THEN was + sign(was) * (conf - 0.5) * 0.3 * abs(was) ELSE was END"})


def _verified(s, d):
    return verify_signals(ensemble_signals(hourly(s, d)), _scores(s, d))


register("signal_verification", "symbol ts:t | position confidence", "SIG19 SIG20 ENS6",
         q.stages("hourly", *VERIFY, final="SELECT symbol, ts, now AS position, confidence * 0.7 + conf * 0.3 AS confidence FROM {prev}"))(_verified)
register("signal_verification_stats", "symbol signals_filtered:i signals_enhanced:i high_confidence:i strong_patterns:i weak_patterns:i | "
         "mean_confidence enhancement_ratio", "SIG21",
         q.stages("hourly", *VERIFY, final="SELECT symbol, count(*) FILTER (WHERE conf < 0.5) AS signals_filtered, "
                  "count(*) FILTER (WHERE abs(was) > 1e-6 AND abs(now) > abs(was)) AS signals_enhanced, "
                  "count(*) FILTER (WHERE conf > 0.7) AS high_confidence, count(*) FILTER (WHERE conf > 0.5) AS strong_patterns, "
                  "count(*) FILTER (WHERE conf < 0.5) AS weak_patterns, avg(conf) AS mean_confidence, "
                  "avg(CASE WHEN abs(was) > 1e-6 THEN abs(now) / abs(was) END) AS enhancement_ratio FROM {prev} GROUP BY symbol"))(
    lambda s, d: verification_stats(_verified(s, d)))
