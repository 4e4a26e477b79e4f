"""Queries over targets, sequence windows, splits and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.layout import attach_scalar

from ..learn import sequences as sq, splits as sp
from ..learn.scaling import (
    clip_bounds, fit_clip_scale, fit_scale, fit_scaler, load_scaler, save_scaler, scale, scale_by_group, unscale,
)
from ..learn.targets import (
    FIXED_TARGETS, TARGETS, TargetRules, all_targets, calibration, fixed_targets, forward_return, raw_targets,
    target_quality, temporal_integrity, thresholds, with_horizons,
)
from ..plans.core_features import CORE
from ..plans.pattern_features import PATTERN
from ..session import checkpoint_dir
from . import sql as q
from .base import register
from .features import RET, hourly, weekly
from .patterns import PATTERN_STEPS

NINE = ["momentum_persistence_7d", "volatility_clustering", "trend_exhaustion", "volume_price_divergence",
        "volatility_regime_change", "returns_1d", "returns_3d", "returns_7d"]


def nine(s, d, table=weekly):
    return PATTERN.compute(table(s, d), NINE, keep=["close"])


def _steps():
    """Pattern steps without the joined inputs."""
    drop = {"b60", "sector_relative_strength", "market_beta_instability"}
    return [{k: v for k, v in step.items() if k not in drop} if isinstance(step, dict) else step
            for step in PATTERN_STEPS[:4]]


P = _steps()
MP, VR, TE, VD = "momentum_persistence_7d", "volatility_regime_change", "trend_exhaustion", "volume_price_divergence"
HORIZON = (
    {"vol": q.agg("stddev_samp(returns_1d)", "returns_1d", -19, 0, 10), "n": "count(*) OVER (PARTITION BY symbol)"},
    {"q25": "quantile_cont(vol, 0.25) OVER (PARTITION BY symbol)", "q75": "quantile_cont(vol, 0.75) OVER (PARTITION BY symbol)",
     "kv": "count(vol) OVER (PARTITION BY symbol)",
     "t_m": f"quantile_cont(abs({MP}), 0.70) OVER (PARTITION BY symbol)", "t_v": f"quantile_cont(abs({VR}), 0.75) OVER (PARTITION BY symbol)",
     "t_t": f"quantile_cont(abs({TE}), 0.80) OVER (PARTITION BY symbol)", "t_d": f"quantile_cont(abs({VD}), 0.75) OVER (PARTITION BY symbol)"},
    {"horizon": "CASE WHEN kv < 50 OR pos < 20 OR vol IS NULL THEN 5 WHEN vol < q25 THEN 8 WHEN vol > q75 THEN 3 ELSE 5 END"},
    {"mh": "max(horizon) OVER (PARTITION BY symbol)"},
)


def past(fn, x, need=10):
    return q.agg(fn, x, -20, -1, need)


def pick(fn, x, need=3):
    return "CASE horizon " + " ".join(f"WHEN {h} THEN ({q.agg(fn, x, 5, 4 + h, need)})" for h in (3, 5, 8)) + " END"


def match(side, picker):
    """Share of later returns with the sign of the earlier pattern."""
    return (f"CASE WHEN {side} > 0 THEN {picker('avg((returns_1d > 0)::INT)', 'returns_1d')} "
            f"WHEN {side} < 0 THEN {picker('avg((returns_1d < 0)::INT)', 'returns_1d')} "
            f"WHEN {side} = 0 THEN {picker('avg((returns_1d = 0)::INT)', 'returns_1d')} END")


TARGET_STEPS = (
    *HORIZON,
    {"ms": past(f"avg(abs({MP}))", MP), "msd": past(f"stddev_pop({MP})", MP), "mside": past(f"avg({MP})", MP),
     "use": "pos >= 20 AND pos < n - 5 - mh",
     "rv": q.agg("stddev_pop(returns_1d)", "returns_1d", -20, -1), "ov": f"CASE WHEN pos >= 40 THEN {q.agg('stddev_pop(returns_1d)', 'returns_1d', -40, -21)} END",
     "vsd": past(f"stddev_pop({VR})", VR, 6), "vab": past(f"avg(abs({VR}))", VR, 6),
     "r3m": f"CASE WHEN {TE} IS NOT NULL THEN returns_3d END", "ts": "ts", "tab": past(f"avg(abs({TE}))", TE),
     "dab": past(f"avg(abs({VD}))", VD), "f3": pick("avg(returns_3d)", "returns_3d"), "fsd": pick("stddev_pop(returns_1d)", "returns_1d")},
    {"mfit": match("mside", pick), "mv": "CASE WHEN rv > 0 AND ov > 0 THEN abs(ln(rv / ov)) END",
     "sg": f"least(abs({VR}) / (t_v + 1e-8), 1)", "st": "coalesce(CASE WHEN vsd IS NOT NULL THEN least(greatest(1 - vsd / (vab + 1e-8), 0), 1) END, 0.5)",
     "was3": f"CASE WHEN count({TE}) OVER {q.rows(-20, -1)} >= 10 THEN avg(r3m) OVER {q.rows(-20, -1)} END"},
    {"m0": "CASE WHEN use AND ms >= t_m AND 1 - msd / (ms + 1e-8) >= 0.5 AND mfit > 0.6 THEN 1.0 ELSE 0.0 END",
     "v0": f"CASE WHEN pos >= 20 AND {VR} IS NOT NULL AND mv IS NOT NULL THEN CASE WHEN mv > 0.1 THEN sg * least(mv, 1) * st ELSE sg * 0.3 END ELSE 0 END",
     "t0": "CASE WHEN use AND tab >= t_t AND abs(was3) >= 0.01 AND sign(was3) <> sign(f3) AND abs(f3) > 0.005 THEN 1.0 ELSE 0.0 END",
     "d0": "CASE WHEN use AND dab >= t_d AND fsd > 0.012 THEN 1.0 ELSE 0.0 END"},
    {"momentum_persistence": "CASE WHEN max(m0) OVER (PARTITION BY symbol) > 0 THEN m0 / max(m0) OVER (PARTITION BY symbol) ELSE m0 END",
     "volatility_regime": "CASE WHEN max(v0) OVER (PARTITION BY symbol) > 0 THEN v0 / max(v0) OVER (PARTITION BY symbol) ELSE v0 END",
     "trend_exhaustion_t": "t0", "volume_divergence": "d0"},
)
TARGET_STEPS[4].pop("ts")
_RENAMED = "SELECT symbol, ts, pos, horizon, momentum_persistence, volatility_regime, trend_exhaustion_t AS trend_exhaustion, volume_divergence FROM {prev}"

register("target_horizons", "symbol ts:t horizon:i", "TGT1", q.stages("weekly", *P, *HORIZON))(
    lambda s, d: with_horizons(nine(s, d)))
register("target_thresholds", "symbol | thr_momentum thr_volatility thr_trend thr_volume", "TGT2 FN7 WIN31",
         q.stages("weekly", *P, *HORIZON, final="SELECT DISTINCT symbol, t_m AS thr_momentum, t_v AS thr_volatility, t_t AS thr_trend, t_d AS thr_volume FROM {prev}"))(
    lambda s, d: thresholds(nine(s, d)))
register("target_thresholds_fixed", "symbol | thr_momentum thr_volatility thr_trend thr_volume", "TGT3",
         q.stages("weekly", final="SELECT DISTINCT symbol, 0.2 AS thr_momentum, 0.15 AS thr_volatility, 0.2 AS thr_trend, 0.15 AS thr_volume FROM {prev}"))(
    lambda s, d: thresholds(nine(s, d), TargetRules(adaptive_thresholds=False)))
register("targets_raw", "symbol ts:t | momentum_persistence volatility_regime trend_exhaustion volume_divergence",
         "TGT4 TGT5 TGT6 TGT7", q.stages("weekly", *P, *TARGET_STEPS, final=_RENAMED))(lambda s, d: raw_targets(nine(s, d)))
CALIB = (
    _RENAMED,
    "SELECT symbol, unnest([{{'target': 'momentum_persistence', 'lo': 0.20::DOUBLE, 'hi': 0.40::DOUBLE, 'v': momentum_persistence}}, "
    "{{'target': 'volatility_regime', 'lo': 0.20::DOUBLE, 'hi': 0.40::DOUBLE, 'v': volatility_regime}}, "
    "{{'target': 'trend_exhaustion', 'lo': 0.15::DOUBLE, 'hi': 0.35::DOUBLE, 'v': trend_exhaustion}}, "
    "{{'target': 'volume_divergence', 'lo': 0.20::DOUBLE, 'hi': 0.40::DOUBLE, 'v': volume_divergence}}], recursive := true) FROM {prev}",
    "SELECT symbol, target, any_value(lo) AS lo, any_value(hi) AS hi, avg((v > 0.5)::INT) AS rate, "
    "list_sort(list(v))[1 + CAST(greatest(least(floor((1.0::DOUBLE - (any_value(lo) + any_value(hi)) / 2.0::DOUBLE) * count(*)), count(*) - 1), 0) AS BIGINT)] AS c "
    "FROM {prev} GROUP BY 1, 2",
    "SELECT symbol, target, rate, (rate < lo OR rate > hi) AS out, CASE WHEN (rate < lo OR rate > hi) AND rate > 0 AND rate < 1 THEN c END AS centre FROM {prev}",
)
register("target_calibration", "symbol target reason | rate centre", "TGT8",
         q.stages("weekly", *P, *TARGET_STEPS, *CALIB, final="SELECT *, CASE WHEN centre IS NOT NULL THEN 'calibrated' WHEN out THEN "
                  "'uniform_distribution' ELSE 'within_target_range' END AS reason FROM {prev}"))(
    lambda s, d: calibration(raw_targets(nine(s, d))))
N_T = 4 + len(TARGET_STEPS)  # number of the stage that holds the renamed raw targets
FULL = q.stages(
    "weekly", *P, *TARGET_STEPS, *CALIB,
    "SELECT r.symbol, r.ts, " + ", ".join(
        f"CASE WHEN max(c.centre) FILTER (WHERE c.target = '{t}') IS NOT NULL THEN 1 / (1 + exp(-4 * (any_value(r.{t}) - "
        f"max(c.centre) FILTER (WHERE c.target = '{t}')))) ELSE any_value(r.{t}) END AS {t}" for t in TARGETS)
    + f" FROM s{N_T} r JOIN {{prev}} c USING (symbol) GROUP BY r.symbol, r.ts",
    {"sc": "1 / (1 + exp(-4 * (0.35 * momentum_persistence + 0.35 * volatility_regime + 0.15 * trend_exhaustion + 0.15 * volume_divergence - 0.5)))"},
    {"tv": "quantile_cont(sc, 0.6) OVER (PARTITION BY symbol)"},
    {"pattern_confidence_score": "CASE WHEN tv <= 0 OR tv = 0.5 THEN sc WHEN tv > 0.5 THEN CASE WHEN sc >= tv THEN 0.5 + 0.5 * (sc - tv) / (1 - tv) "
     "ELSE 0.5 * sc / tv END ELSE CASE WHEN sc <= tv THEN 0.5 * sc / tv ELSE 0.5 + 0.5 * (sc - tv) / (1 - tv) END END"})
register("targets_all", "symbol ts:t | momentum_persistence volatility_regime trend_exhaustion volume_divergence pattern_confidence_score",
         "TGT8 TGT9 TGT10 FN6", FULL)(lambda s, d: all_targets(nine(s, d)))

# -- fixed targets ---------------------------------------------------------------
def fixed_pick(gap):
    return lambda fn, x, need=3: "(" + q.agg(fn, x, gap, gap + 4, need) + ")"


def fixed_steps(gap=5):
    pk = fixed_pick(gap)
    w20, w5 = q.rows(-20, -1), q.rows(-5, -1)
    return (
        {"use": f"pos >= 20 AND {q.lead('pos', gap + 5)} IS NOT NULL", "ms": past(f"avg(abs({MP}))", MP), "msd": past(f"stddev_pop({MP})", MP),
         "mside": past(f"avg({MP})", MP), "r1v": f"CASE WHEN {VR} IS NOT NULL THEN returns_1d END",
         "r3t": f"CASE WHEN {TE} IS NOT NULL THEN returns_3d END", "fsd": pk("stddev_pop(returns_1d)", "returns_1d"), "f3": pk("avg(returns_3d)", "returns_3d"),
         "v5": f"avg({VR}) OVER {w5}", "t5": f"avg(abs({TE})) OVER {w5}", "d5": f"avg(abs({VD})) OVER {w5}",
         "nv": f"count({VR}) OVER {w20}", "nt": f"count({TE}) OVER {w20}", "nd": f"count({VD}) OVER {w20}"},
        {"mfit": match("mside", pk), "wsd": f"stddev_pop(r1v) OVER {w20}", "w3": f"avg(r3t) OVER {w20}"},
        {"chg": "(fsd - wsd) / nullif(wsd, 0)"},
        {"momentum_persistence_binary": "CASE WHEN use AND ms >= 0.3 AND 1 - msd / (ms + 1e-8) >= 0.6 AND mfit > 0.6 THEN 1 ELSE 0 END",
         "volatility_regime_binary": "CASE WHEN use AND nv >= 10 AND abs(v5) >= 0.2 AND sign(v5) = sign(chg) AND abs(chg) > 0.1 THEN 1 ELSE 0 END",
         "trend_exhaustion_binary": "CASE WHEN use AND nt >= 10 AND t5 >= 0.3 AND abs(w3) >= 0.01 AND sign(w3) <> sign(f3) AND abs(f3) > 0.005 THEN 1 ELSE 0 END",
         "volume_divergence_binary": "CASE WHEN use AND nd >= 10 AND d5 >= 0.2 AND fsd > 0.015 THEN 1 ELSE 0 END"},
        {"pattern_confidence_score": "(momentum_persistence_binary + volatility_regime_binary + trend_exhaustion_binary + volume_divergence_binary) / 4.0"},
    )


register("targets_fixed", "symbol ts:t | momentum_persistence_binary volatility_regime_binary trend_exhaustion_binary "
         "volume_divergence_binary pattern_confidence_score", "TGT12 TGT13 TGT16", q.stages("weekly", *P, *fixed_steps()))(
    lambda s, d: fixed_targets(nine(s, d)))
register("target_quality", "symbol target balance | positive_rate mean_value std_value", "TGT11",
         q.stages("weekly", *P, *fixed_steps(), "SELECT symbol, unnest([" + ", ".join(
             f"{{{{'target': '{t}', 'v': {t}}}}}" for t in FIXED_TARGETS) + "], recursive := true) FROM {prev}",
             final="SELECT symbol, target, avg((v > 0.5)::INT) AS positive_rate, avg(v) AS mean_value, stddev_pop(v) AS std_value, "
                   "CASE WHEN avg((v > 0.5)::INT) BETWEEN 0.1 AND 0.9 THEN 'GOOD' ELSE 'IMBALANCED' END AS balance FROM {prev} GROUP BY 1, 2"))(
    lambda s, d: target_quality(fixed_targets(nine(s, d)), FIXED_TARGETS))


def _ac(a, b):
    p = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"CASE WHEN stddev_pop({a}) {p} * stddev_pop({b}) {p} > 1e-15 THEN abs(corr({a}, {b}) {p}) END"


def _gap_sql(gap):
    return q.stages("weekly", *P, *fixed_steps(gap), final=f"SELECT symbol, {_ac(MP, 'pattern_confidence_score')} AS g{gap} FROM {{prev}} GROUP BY symbol")


register("target_integrity", "symbol | corr_momentum_persistence_7d corr_trend_exhaustion corr_volatility_regime_change "
         "max_same_time_correlation gap_0 gap_1 gap_5 gap_10", "TGT14",
         "SELECT a.*, greatest(coalesce(corr_momentum_persistence_7d, 0), coalesce(corr_trend_exhaustion, 0), coalesce(corr_volatility_regime_change, 0)) "
         "AS max_same_time_correlation, g0 AS gap_0, g1 AS gap_1, g5 AS gap_5, g10 AS gap_10 FROM ("
         + q.stages("weekly", *P, *fixed_steps(), final="SELECT symbol, " + ", ".join(
             f"{_ac(c, 'pattern_confidence_score')} AS corr_{c}" for c in (MP, TE, VR)) + " FROM {prev} GROUP BY symbol")
         + ") a " + " ".join(f"JOIN ({_gap_sql(g)}) t{g} USING (symbol)" for g in (0, 1, 5, 10)))(
    lambda s, d: temporal_integrity(nine(s, d)))
register("target_forward_return", "symbol ts:t | forward_return", "TGT15",
         q.stages("hourly", {"forward_return": f"{q.lead('close', 5)} / close - 1"}))(lambda s, d: forward_return(hourly(s, d)))

# -- sequence windows ---------------------------------------------------------------
FEATS = ["daily_return", "momentum_5d"]
SEQ_BASE = {**RET, "momentum_5d": q.pct("close", 5)}


def _seq(s, d):
    reg = CORE
    return reg.compute(hourly(s, d), FEATS, keep=["close"])


def _summary(w, *ys):
    """Length, sum and corner values of each window."""
    flat = F.flatten("window")
    return w.select("symbol", "start", F.size("window").alias("length"),
                    F.aggregate(flat, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))).alias("total"),
                    F.element_at(F.element_at("window", 1), 1).alias("first_cell"),
                    F.element_at(F.element_at("window", -1), -1).alias("last_cell"),
                    *[F.col(f"y_{y}").alias(f"y_{y}") for y in ys])


def seq_sql(length, stride, y_shift=None, need_shift=None, extra_where="", a="coalesce(daily_return, 0)", b="coalesce(momentum_5d, 0)", ys=("close",)):
    w = q.rows(0, length - 1)
    need = length - 1 if need_shift is None else need_shift
    cols = {"n_in": f"count(*) OVER {w}", "sa": f"sum({a}) OVER {w}", "sb": f"sum({b}) OVER {w}", "first_cell": a,
            "last_cell": f"lead({b}, {length - 1}) OVER ({q.PART})", "ok": q.lead("pos", need)}
    if y_shift is not None:
        for y in ys:
            cols[f"y_{y}"] = f"coalesce({q.lead(y, y_shift)}, 0)"
    keep = "".join(f", y_{y}" for y in ys) if y_shift is not None else ""
    return (cols, f"SELECT symbol, pos AS start, n_in AS length, sa + sb AS total, first_cell, last_cell{keep} FROM {{prev}} "
                  f"WHERE pos % {stride} = 0 AND ok IS NOT NULL {extra_where}")


def windows_query(name, covers, make, sql_parts, ys=("close",), pre=()):
    cols, final = sql_parts
    y_spec = " ".join(f"y_{y}" for y in ys)
    register(name, f"symbol start:i length:i | total first_cell last_cell {y_spec}", covers,
             q.stages("hourly", SEQ_BASE, *pre, cols, final=final))(lambda s, d: _summary(make(_seq(s, d)), *ys))


FILL = ({"da": "coalesce(daily_return, first_value(daily_return IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
         "mb": "coalesce(momentum_5d, first_value(momentum_5d IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"},)
windows_query("windows_long", "SEQ8", lambda t: sq.windows(t, FEATS, 60, 1, 1, ["close"]), seq_sql(60, 1, 60, 60))
windows_query("windows_swing", "SEQ9", lambda t: sq.swing_windows(t, FEATS, "close"), seq_sql(20, 5, 24, 24))
windows_query("windows_portfolio", "SEQ10", lambda t: sq.portfolio_windows(t, FEATS), seq_sql(20, 5), ys=())
windows_query("windows_training", "SEQ11", lambda t: sq.training_windows(t, FEATS, ["close"]), seq_sql(20, 1, 20, 21, a="da", b="mb"), pre=FILL)
windows_query("windows_training_multi", "SEQ12 JN17", lambda t: sq.training_windows(t, FEATS, ["close", "momentum_5d"]),
              seq_sql(20, 1, 20, 21, a="da", b="mb", ys=("close", "momentum_5d")), ys=("close", "momentum_5d"),
              pre=({**FILL[0], "momentum_raw": "momentum_5d"},))
windows_query("windows_test", "SEQ13", lambda t: sq.test_windows(t, FEATS, "close"), seq_sql(20, 20, 20, 21, a="da", b="mb"), pre=FILL)
windows_query("windows_whole", "SEQ14", lambda t: sq.whole_windows(t, FEATS, "close"),
              seq_sql(20, 1, 24, 24, "AND pos >= 5", a="daily_return", b="momentum_5d"))
windows_query("windows_fixed", "SEQ17", lambda t: sq.fixed_windows(t, FEATS), seq_sql(30, 1), ys=())
register("windows_overlapping_rows", "symbol ts:t window_id:i", "SEQ16",
         q.stages("hourly", {"n": "count(*) OVER (PARTITION BY symbol)"},
                  final="SELECT symbol, ts, unnest(range(CAST(greatest(ceil((pos - 29) / 15.0), 0) AS BIGINT), "
                        "CAST(least(floor(pos / 15.0), floor((n - 30) / 15.0)) AS BIGINT) + 1)) AS window_id FROM {prev}"))(
    lambda s, d: sq.overlapping_rows(hourly(s, d)))
register("windows_overlap_statistics", "symbol total_samples:i n_sequences:i overlap_length:i | overlap_percentage training_multiplier",
         "SEQ18", q.stages("hourly", final="SELECT symbol, count(*) AS total_samples, (count(*) - 20) // 5 + 1 AS n_sequences, 15 AS overlap_length, "
                           "75 AS overlap_percentage, ((count(*) - 20) // 5 + 1) / (count(*) - 19) AS training_multiplier FROM {prev} GROUP BY symbol"))(
    lambda s, d: sq.overlap_statistics(hourly(s, d), 20, 5))
register("windows_preparation_statistics", "symbol first_ts:t last_ts:t n_rows:i n_windows:i | min_close max_close target_mean target_std target_min target_max",
         "SEQ20", q.stages("hourly", RET, final="SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, count(*) - 21 AS n_windows, "
                           "min(close) AS min_close, max(close) AS max_close, avg(daily_return) AS target_mean, stddev_pop(daily_return) AS target_std, "
                           "min(daily_return) AS target_min, max(daily_return) AS target_max FROM {prev} GROUP BY symbol"))(
    lambda s, d: sq.preparation_statistics(CORE.compute(hourly(s, d), ["daily_return"], keep=["close"]), "daily_return"))

# -- scaling --------------------------------------------------------------------------
SC = {"a": "coalesce(daily_return, 0)", "b": "coalesce(momentum_5d, 0)"}


def _norm(x, kind):
    p = "OVER (PARTITION BY symbol)"
    c, w = {"robust": (f"quantile_cont({x}, 0.5) {p}", f"(quantile_cont({x}, 0.75) {p} - quantile_cont({x}, 0.25) {p})"),
            "standard": (f"avg({x}) {p}", f"stddev_pop({x}) {p}"),
            "minmax": (f"min({x}) {p}", f"(max({x}) {p} - min({x}) {p})")}[kind]
    return f"({x} - {c}) / CASE WHEN {w} = 0 THEN 1 ELSE {w} END"


for _m in ("robust", "standard", "minmax"):
    register(f"scaling_{_m}", "symbol ts:t | daily_return momentum_5d", "SPL13 PRJ20",
             q.stages("hourly", SEQ_BASE, SC, final=f"SELECT symbol, ts, {_norm('a', _m)} AS daily_return, {_norm('b', _m)} AS momentum_5d FROM {{prev}}"))(
        lambda s, d, m=_m: fit_scale(_seq(s, d), FEATS, m))
register("scaling_round_trip", "symbol ts:t | daily_return:8 momentum_5d:8", "SPL13 SPL28",
         q.stages("hourly", SEQ_BASE, SC, final="SELECT symbol, ts, a AS daily_return, b AS momentum_5d FROM {prev}"))(
    lambda s, d: _round_trip(s, d))


def _round_trip(s, d):
    """Fit, store, load, scale and invert."""
    import uuid
    table = _seq(s, d)
    path = f"{checkpoint_dir(s)}/scaler-{uuid.uuid4().hex}"
    save_scaler(fit_scaler(table, FEATS, "standard"), path)
    params = load_scaler(s, path)
    return unscale(scale(table, params, FEATS), params, FEATS)


register("scaling_statistics", "symbol feature method missing_count:i | original_mean original_std original_min original_max", "SPL14",
         q.stages("hourly", SEQ_BASE, "SELECT symbol, unnest([{{'feature': 'daily_return', 'v': daily_return}}, {{'feature': 'momentum_5d', 'v': momentum_5d}}], recursive := true) FROM {prev}",
                  final="SELECT symbol, feature, 'standard' AS method, count(*) FILTER (WHERE v IS NULL) AS missing_count, avg(v) AS original_mean, "
                        "stddev_samp(v) AS original_std, min(v) AS original_min, max(v) AS original_max FROM {prev} GROUP BY 1, 2"))(
    lambda s, d: fit_scaler(_seq(s, d), FEATS, "standard"))
register("scaling_by_group", "symbol ts:t | daily_return momentum_5d", "SPL15",
         q.stages("hourly", SEQ_BASE, SC, final=f"SELECT symbol, ts, {_norm('a', 'standard')} AS daily_return, {_norm('b', 'minmax')} AS momentum_5d FROM {{prev}}"))(
    lambda s, d: scale_by_group(_seq(s, d), {"returns": ["daily_return"], "momentum": ["momentum_5d"]}, {"returns": "standard", "momentum": "minmax"}))
CLIP = {"lo": "quantile_cont(daily_return, 0.01) OVER (PARTITION BY symbol)", "up": "quantile_cont(daily_return, 0.99) OVER (PARTITION BY symbol)"}
register("scaling_clipped", "symbol ts:t | daily_return", "SPL16",
         q.stages("hourly", RET, CLIP, {"a": "coalesce(CASE WHEN daily_return IS NOT NULL THEN least(greatest(daily_return, lo), up) END, 0)"},
                  final=f"SELECT symbol, ts, {_norm('a', 'robust')} AS daily_return FROM {{prev}}"))(
    lambda s, d: fit_clip_scale(_seq(s, d), ["daily_return"])[0])
register("scaling_outlier_report", "symbol feature outliers_clipped:i | original_min original_max clipped_min clipped_max lower_bound upper_bound", "SPL17",
         q.stages("hourly", RET, CLIP, final="SELECT symbol, 'daily_return' AS feature, count(*) FILTER (WHERE daily_return < lo OR daily_return > up) AS outliers_clipped, "
                  "min(daily_return) AS original_min, max(daily_return) AS original_max, min(greatest(daily_return, lo)) AS clipped_min, "
                  "max(least(daily_return, up)) AS clipped_max, min(lo) AS lower_bound, min(up) AS upper_bound FROM {prev} GROUP BY symbol"))(
    lambda s, d: clip_bounds(_seq(s, d), ["daily_return"]))
register("scaling_then_windows", "symbol start:i length:i | total first_cell last_cell y_close", "SEQ19",
         q.stages("hourly", SEQ_BASE, SC, {"ra": _norm("a", "robust"), "rb": _norm("b", "robust")},
                  seq_sql(60, 1, 60, 60, a="ra", b="rb")[0], final=seq_sql(60, 1, 60, 60)[1]))(
    lambda s, d: _summary(sq.windows(fit_scale(_seq(s, d), FEATS, "robust"), FEATS, 60, 1, 1, ["close"]), "close"))

# -- splits ---------------------------------------------------------------------------
SIZE = {"n": "count(*) OVER (PARTITION BY symbol)"}
FOLDS = "SELECT symbol, ts, pos, n, fold, CASE WHEN pos >= a AND pos < b THEN 'train' WHEN pos >= c AND pos < e THEN 'test' END AS part FROM ({}) WHERE (pos >= a AND pos < b) OR (pos >= c AND pos < e)"


def gapped_sql(expanding=True):
    start = "0" if expanding else "greatest(e - sz - 10 - 2 * sz, 0)"
    lim = f"SELECT *, {start} AS a, e - sz - 10 AS b, e - sz AS c FROM (SELECT *, n - i * (sz + 10) AS e FROM (SELECT symbol, ts, pos, n, floor(n * 0.2::DOUBLE)::BIGINT AS sz, unnest(range(5)) AS i FROM {{prev}}))"
    num = f"SELECT *, (SELECT count(*) FROM range(5) r(j) WHERE j > i AND n - j * (sz + 10) - sz - 10 > 0) AS fold FROM ({lim}) WHERE a < b"
    return FOLDS.format(num)


register("folds_gapped", "symbol ts:t fold:i part", "SPL1 SPL8", q.stages("hourly", SIZE, final=gapped_sql()))(lambda s, d: sp.gapped_folds(hourly(s, d)))
register("folds_gapped_rolling", "symbol ts:t fold:i part", "SPL1", q.stages("hourly", SIZE, final=gapped_sql(False)))(
    lambda s, d: sp.gapped_folds(hourly(s, d), expanding=False))
DATES = ("SELECT symbol, fold, min(ts) FILTER (WHERE part = 'train') AS train_start, max(ts) FILTER (WHERE part = 'train') AS train_end, "
         "min(ts) FILTER (WHERE part = 'test') AS test_start, max(ts) FILTER (WHERE part = 'test') AS test_end, count(*) FILTER (WHERE part = 'train') AS train_size, "
         "count(*) FILTER (WHERE part = 'test') AS test_size FROM (" + gapped_sql() + ") GROUP BY 1, 2")
register("fold_dates", "symbol fold:i train_start:t train_end:t test_start:t test_end:t train_size:i test_size:i", "SPL2", q.stages("hourly", SIZE, final=DATES))(
    lambda s, d: sp.fold_dates(sp.gapped_folds(hourly(s, d))))
register("fold_leak_check", "symbol fold:i gap_days:i no_leak", "SPL3 SPL8",
         q.stages("weekly", SIZE, final="SELECT symbol, fold, date_diff('day', train_end::DATE, test_start::DATE) AS gap_days, train_end < test_start AND "
                  "date_diff('day', train_end::DATE, test_start::DATE) >= 10 AS no_leak FROM (" + DATES + ")"))(
    lambda s, d: sp.fold_leaks(sp.gapped_folds(weekly(s, d)), 10))
register("folds_walk_forward", "symbol ts:t fold:i part", "SPL4",
         q.stages("hourly", SIZE, final=FOLDS.format("SELECT symbol, ts, pos, n, i AS fold, 0 AS a, 252 + 60 * i AS b, 252 + 60 * i AS c, 272 + 60 * i AS e "
                  "FROM (SELECT *, unnest(range(CASE WHEN n >= 272 THEN (n - 272) // 60 + 1 ELSE 0 END)) AS i FROM {prev})")))(
    lambda s, d: sp.walk_forward_folds(hourly(s, d)))
register("folds_expanding", "symbol ts:t fold:i part", "SPL6",
         q.stages("hourly", SIZE, final=FOLDS.format("SELECT symbol, ts, pos, n, i AS fold, 0 AS a, n - (3 - i) * (n // 4) AS b, n - (3 - i) * (n // 4) AS c, "
                  "n - (2 - i) * (n // 4) AS e FROM (SELECT *, unnest(range(3)) AS i FROM {prev})")))(lambda s, d: sp.expanding_folds(hourly(s, d)))
register("folds_standard", "symbol ts:t fold:i part", "SPL7",
         q.stages("hourly", SIZE, final=FOLDS.format("SELECT symbol, ts, pos, n, i AS fold, 0 AS a, n - (5 - i) * sz AS b, n - (5 - i) * sz AS c, n - (4 - i) * sz AS e "
                  "FROM (SELECT *, floor(n * 0.15::DOUBLE)::BIGINT AS sz, unnest(range(5)) AS i FROM {prev})")))(lambda s, d: sp.standard_folds(hourly(s, d)))
register("retrain_trigger", "symbol ts:t | retrain", "SPL5",
         q.stages("weekly", {"m": q.agg("avg(close)", "close", -3, -1)}, final="SELECT symbol, ts, CASE WHEN close < m * 0.9::DOUBLE THEN 1 ELSE 0 END AS retrain FROM {prev}"))(
    lambda s, d: sp.retrain_flags(weekly(s, d).withColumn("score", F.col("close"))))
GAP = {"part": "CASE WHEN te + 90 >= n - 30 THEN 'insufficient' WHEN pos < te THEN 'train' WHEN pos < least(te + 90, n) THEN 'gap' ELSE 'test' END"}
GAPN = {"te": "floor(n * 0.6::DOUBLE)"}
register("split_gap", "symbol ts:t part", "SPL9 FN11 LK9", q.stages("weekly", SIZE, GAPN, GAP))(lambda s, d: sp.gap_split(weekly(s, d), 3, 0.6))
register("split_integrity", "symbol train_samples:i test_samples:i actual_gap:i valid", "SPL10",
         q.stages("weekly", SIZE, GAPN, GAP, "SELECT symbol, count(*) FILTER (WHERE part = 'train') AS train_samples, count(*) FILTER (WHERE part = 'test') AS test_samples, "
                  "date_diff('day', (max(ts) FILTER (WHERE part = 'train'))::DATE, (min(ts) FILTER (WHERE part = 'test'))::DATE) AS actual_gap FROM {prev} GROUP BY symbol",
                  final="SELECT *, coalesce(actual_gap >= 72, false) AS valid FROM {prev}"))(
    lambda s, d: sp.split_integrity(sp.gap_split(weekly(s, d), 3, 0.6), 90))
register("split_shared_dates", "part_rows:i shared:i", "JN15",
         q.stages("weekly", SIZE, GAPN, GAP, final="SELECT count(*) FILTER (WHERE part IN ('train', 'test')) AS part_rows, 0 AS shared FROM {prev}"))(
    lambda s, d: _shared(sp.gap_split(weekly(s, d), 3, 0.6)))


def _shared(parts):
    shared = sp.shared_dates(parts).agg(F.count(F.lit(1)).alias("shared"))
    return parts.where(F.col("part").isin("train", "test")).agg(F.count(F.lit(1)).alias("part_rows")).transform(attach_scalar, shared)


register("split_ratio", "symbol ts:t part", "SPL11",
         q.stages("weekly", SIZE, {"part": "CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END"}))(
    lambda s, d: sp.ratio_split(weekly(s, d)))
register("split_chronological", "symbol ts:t part", "SPL12",
         q.stages("weekly", SIZE, {"part": "CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END"}))(
    lambda s, d: sp.chronological_split(weekly(s, d)))
