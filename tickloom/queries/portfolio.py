"""Queries over sizing, portfolio risk, selection, GARCH, user functions and streamed bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import clip
from ..learn import selection as sel
from ..learn.scaling import fit_scale
from ..plans.core_features import CORE
from ..plans.earlier_features import EARLIER
from ..plans.garch import garch_fits, garch_volatility
from ..plans.registry import Registry
from ..signals import risk as rk
from ..sources.bars import hourly_ticks
from ..streaming.bars import append_bars, completed_bars, stream_bars
from . import fit_sql as fs, patterns as pt, sql as q
from .base import register, scratch
from .evaluation import FX, FXS, feats, h
from .features import RET, hourly, weekly
from .learning import _norm

EQUITY = 1_000_000.0
OUT = {"p_act": "least(greatest(0.5 + m5, 0), 1)", "z_h": "daily_return / s20", "p_tail": "least(abs(daily_return), 1)", "sigma": "s20", "price": "close"}
MODEL = ({**RET, "m5": q.pct("close", 5)}, {"s20": q.std("daily_return", 20)}, "SELECT * FROM {prev} WHERE s20 > 0", OUT)


def sized_sql(a=1.0, th=0.0, b=1.0, sf=0.005, fm=0.20, pf=0.01, pc=0.95):
    return ({"sigma_used": f"greatest(sigma, {sf}::DOUBLE)", "p_act_used": f"greatest(p_act, {pf}::DOUBLE)", "p_tail_used": f"least(p_tail, {pc}::DOUBLE)"},
            {"raw": f"{a} * p_act_used * greatest(z_h - {th}, 0) / (1 + {b} * p_tail_used)"}, {"f": f"least(raw, {fm}::DOUBLE)"},
            {"n_shares": f"round_even(f * {EQUITY}::DOUBLE / sigma_used / price, 0)"}, {"dollar_amount": "n_shares * price"})


def model_table(s, d):
    reg = Registry(parent=CORE)
    reg.add("m", sigma=lambda f: f.std("daily_return", 20))
    t = reg.compute(weekly(s, d), ["daily_return", "momentum_5d", "sigma"], keep=["close"]).where(F.col("sigma") > 0)
    return t.select("symbol", "ts", clip(0.5 + F.col("momentum_5d"), 0.0, 1.0).alias("p_act"), (F.col("daily_return") / F.col("sigma")).alias("z_h"),
                    F.least(F.abs("daily_return"), F.lit(1.0)).alias("p_tail"), "sigma", F.col("close").alias("price"))


def sized(s, d, rules=rk.SizingRules()):
    t = model_table(s, d)
    return rk.portfolio_positions(t.select("symbol", "ts", "p_act", "z_h", "p_tail"), t.select("symbol", "ts", "sigma", "price"), EQUITY, rules)


SIZE_COLS = "symbol ts:t n_shares:i | f dollar_amount:2 sigma_used p_act_used p_tail_used"
register("sizing_positions", SIZE_COLS, "RSK1 RSK2 JN14", q.stages("weekly", *MODEL, *sized_sql()))(lambda s, d: sized(s, d))
register("sizing_conservative", SIZE_COLS, "RSK5", q.stages("weekly", *MODEL, *sized_sql(0.5, 0.5, 2.0, 0.01, 0.15, 0.05, 0.90)))(
    lambda s, d: sized(s, d, rk.SIZING_PRESETS["conservative"]))
register("sizing_aggressive", SIZE_COLS, "RSK5", q.stages("weekly", *MODEL, *sized_sql(1.5, 0.2, 1.0, 0.005, 0.25, 0.01, 0.95)))(
    lambda s, d: sized(s, d, rk.SIZING_PRESETS["aggressive"]))
register("sizing_input_checks", "symbol ts:t p_act_valid z_h_finite p_tail_valid sigma_positive price_positive equity_positive", "RSK3",
         q.stages("weekly", *MODEL, final="SELECT symbol, ts, p_act BETWEEN 0 AND 1 AS p_act_valid, true AS z_h_finite, p_tail BETWEEN 0 AND 1 AS p_tail_valid, sigma > 0 AS sigma_positive, price > 0 AS price_positive, true AS equity_positive FROM {prev}"))(
    lambda s, d: rk.input_checks(model_table(s, d), EQUITY))
register("sizing_summary", "ts:t total_positions:i active_positions:i long_positions:i short_positions:i sigma_floor_applied:i p_act_floor_applied:i p_tail_cap_applied:i f_max_clipped:i negative_z_zeroed:i | "
         "avg_fraction max_fraction total_exposure:1 net_exposure:1", "RSK4",
         q.stages("weekly", *MODEL, *sized_sql(), final="SELECT ts, count(*) AS total_positions, count(*) FILTER (WHERE f <> 0) AS active_positions, count(*) FILTER (WHERE f > 0) AS long_positions, count(*) FILTER (WHERE f < 0) AS short_positions, "
                  "count(*) FILTER (WHERE sigma_used <> sigma) AS sigma_floor_applied, count(*) FILTER (WHERE p_act_used <> p_act) AS p_act_floor_applied, count(*) FILTER (WHERE p_tail_used <> p_tail) AS p_tail_cap_applied, "
                  "count(*) FILTER (WHERE f <> raw) AS f_max_clipped, count(*) FILTER (WHERE greatest(z_h, 0) = 0 AND z_h > 0) AS negative_z_zeroed, avg(abs(f)) AS avg_fraction, max(abs(f)) AS max_fraction, "
                  "sum(abs(dollar_amount)) AS total_exposure, sum(dollar_amount) AS net_exposure FROM {prev} GROUP BY ts"))(lambda s, d: rk.sizing_summary(sized(s, d)))
CORRS = ("ret AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars),\nvols AS (SELECT symbol, stddev_samp(r) AS vol FROM ret GROUP BY symbol),\n"
         "cors AS (SELECT x.symbol AS a, y.symbol AS b, CASE WHEN x.symbol = y.symbol THEN 1 ELSE corr(x.r, y.r) END AS corr FROM ret x JOIN ret y USING (ts) WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2)")


def with_corrs(text):
    i = text.index(",\ns0 AS (")
    return text[:i] + ",\n" + CORRS + text[i:]


NOSTEP = {"one": "1"}
register("risk_correlations", "a b | corr", "RSK13", with_corrs(q.stages("weekly", NOSTEP, final="SELECT * FROM cors")))(lambda s, d: rk.correlation_table(weekly(s, d)))
register("risk_asset_volatility", "symbol | vol", "RSK13", with_corrs(q.stages("weekly", NOSTEP, final="SELECT * FROM vols")))(lambda s, d: rk.asset_volatilities(weekly(s, d)))
PVOL = "SELECT x.ts, sqrt(greatest(sum(x.f * vx.vol * y.f * vy.vol * c.corr), 0)) AS portfolio_vol FROM {src} x JOIN {src} y USING (ts) JOIN vols vx ON vx.symbol = x.symbol JOIN vols vy ON vy.symbol = y.symbol JOIN cors c ON c.a = x.symbol AND c.b = y.symbol GROUP BY x.ts"
BASE = len(MODEL) + len(sized_sql()) - 1  # stage that holds the sized positions


def vol_of(s, d, positions):
    return rk.portfolio_volatility(positions, rk.correlation_table(weekly(s, d)), rk.asset_volatilities(weekly(s, d)))


register("risk_portfolio_volatility", "ts:t | portfolio_vol", "RSK6",
         with_corrs(q.stages("weekly", *MODEL, *sized_sql(), final="SELECT ts, CASE WHEN n < 2 THEN simple ELSE portfolio_vol END AS portfolio_vol FROM (" + PVOL.replace("{src}", "{prev}") + ") JOIN "
                             "(SELECT ts, count(*) AS n, sum(abs(f) * vol) AS simple FROM {prev} JOIN vols USING (symbol) GROUP BY ts) USING (ts)")))(
    lambda s, d: vol_of(s, d, sized(s, d)))
SCALED = ("SELECT p.*, v.portfolio_vol AS pv, (0.12::DOUBLE / sqrt(252.0)) / nullif(v.portfolio_vol, 0) AS k FROM {prev} p JOIN (SELECT ts, CASE WHEN n < 2 THEN simple ELSE portfolio_vol END AS portfolio_vol FROM (" + PVOL.replace("{src}", "{prev}") +
          ") JOIN (SELECT ts, count(*) AS n, sum(abs(f) * vol) AS simple FROM {prev} JOIN vols USING (symbol) GROUP BY ts) USING (ts)) v USING (ts)",
          {"f2": "CASE WHEN k IS NULL THEN f ELSE least(f * k, 0.15::DOUBLE) END", "pr": "CASE WHEN n_shares <> 0 AND dollar_amount <> 0 THEN abs(dollar_amount / n_shares) ELSE 100 END", "eq": "CASE WHEN f <> 0 THEN abs(dollar_amount / f) ELSE 100000 END"},
          {"d2": "CASE WHEN k IS NULL THEN dollar_amount ELSE f2 * eq END", "n2": "CASE WHEN k IS NULL THEN n_shares ELSE round_even(f2 * eq / pr, 0) END"})
register("risk_volatility_target", "symbol ts:t n_shares:i | f dollar_amount:1", "RSK7",
         with_corrs(q.stages("weekly", *MODEL, *sized_sql(), *SCALED, final="SELECT symbol, ts, f2 AS f, n2 AS n_shares, d2 AS dollar_amount FROM {prev}")))(
    lambda s, d: rk.scale_to_target(sized(s, d), vol_of(s, d, sized(s, d))))


def lim(f, n, dl, cap):
    return ({"tot": f"sum(abs({f})) OVER (PARTITION BY ts)"},
            {"f3": f"CASE WHEN tot > {cap} THEN {f} * ({cap}::DOUBLE / tot) ELSE {f} END"},
            {"d3": f"CASE WHEN tot > {cap} THEN CASE WHEN {f} <> 0 THEN f3 * abs({dl} / {f}) ELSE 0 END ELSE {dl} END", "p3": f"{dl} / CASE WHEN {n} <> 0 THEN {n} ELSE 1 END"},
            {"n3": f"CASE WHEN tot > {cap} THEN coalesce(round_even(d3 / nullif(p3, 0), 0), 0) ELSE {n} END"})


register("risk_exposure_limit", "symbol ts:t n_shares:i | f dollar_amount:1", "RSK8",
         q.stages("weekly", *MODEL, *sized_sql(), *lim("f", "n_shares", "dollar_amount", 1.0), final="SELECT symbol, ts, f3 AS f, n3 AS n_shares, d3 AS dollar_amount FROM {prev}"))(
    lambda s, d: rk.limit_exposure(sized(s, d)))
METRIC = ("SELECT m.*, v.portfolio_vol * sqrt(252.0) AS annual_vol FROM (SELECT ts, sum(abs(f)) AS total_exposure, sum(f) AS net_exposure, sum(greatest(f, 0)) AS long_exposure, sum(greatest(-f, 0)) AS short_exposure, "
          "max(abs(f)) AS max_position, count(*) FILTER (WHERE f <> 0) AS position_count FROM {prev} GROUP BY ts) m JOIN (SELECT ts, CASE WHEN n < 2 THEN simple ELSE portfolio_vol END AS portfolio_vol FROM (" + PVOL.replace("{src}", "{prev}") +
          ") JOIN (SELECT ts, count(*) AS n, sum(abs(f) * vol) AS simple FROM {prev} JOIN vols USING (symbol) GROUP BY ts) USING (ts)) v USING (ts)",
          {"vol_ratio": "annual_vol / 0.12::DOUBLE"}, {"vol_ok": "abs(vol_ratio - 1) <= 0.02::DOUBLE / 0.12::DOUBLE", "single_ok": "max_position <= 0.15::DOUBLE", "total_ok": "total_exposure <= 1", "net_ok": "abs(net_exposure) <= 0.8::DOUBLE"})
register("risk_constraint_metrics", "ts:t position_count:i vol_ok single_ok total_ok net_ok | total_exposure net_exposure long_exposure short_exposure max_position annual_vol vol_ratio", "RSK9",
         with_corrs(q.stages("weekly", *MODEL, *sized_sql(), *METRIC)))(lambda s, d: rk.constraint_metrics(sized(s, d), vol_of(s, d, sized(s, d))))


def metric(target, slack, single, total, net):
    """The constraint metrics under other limits."""
    checks = {"vol_ok": f"abs(vol_ratio - 1) <= {slack}::DOUBLE / {target}::DOUBLE", "single_ok": f"max_position <= {single}::DOUBLE",
              "total_ok": f"total_exposure <= {total}::DOUBLE", "net_ok": f"abs(net_exposure) <= {net}::DOUBLE"}
    return METRIC[0], {"vol_ratio": f"annual_vol / {target}::DOUBLE"}, checks


for preset, numbers in {"conservative": (0.10, 0.015, 0.12, 0.8, 0.6), "aggressive": (0.15, 0.03, 0.20, 1.2, 1.0)}.items():
    register(f"risk_limits_{preset}", "ts:t vol_ok single_ok total_ok net_ok | total_exposure max_position vol_ratio", "RSK5 RSK9",
             with_corrs(q.stages("weekly", *MODEL, *sized_sql(), *metric(*numbers))))(
        lambda s, d, preset=preset: rk.constraint_metrics(sized(s, d), vol_of(s, d, sized(s, d)), rk.RISK_PRESETS[preset]))
register("risk_controls", "symbol ts:t n_shares:i | f dollar_amount:1", "RSK10",
         with_corrs(q.stages("weekly", *MODEL, *sized_sql(), *SCALED, *lim("f2", "n2", "d2", 1.0), final="SELECT symbol, ts, f3 AS f, n3 AS n_shares, d3 AS dollar_amount FROM {prev}")))(
    lambda s, d: rk.risk_controls(sized(s, d), rk.correlation_table(weekly(s, d)), rk.asset_volatilities(weekly(s, d))))
DDS = ("SELECT ts, sum(n_shares * (b.close - b.pc)) / nullif(sum(abs(n_shares * b.pc)), 0) AS drawdown FROM {src} p JOIN (SELECT symbol, ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars) b USING (symbol, ts) "
       "WHERE n_shares <> 0 AND b.pc IS NOT NULL GROUP BY ts")
register("risk_drawdown", "ts:t | drawdown", "RSK12", q.stages("weekly", *MODEL, *sized_sql(), final=DDS.replace("{src}", "{prev}")))(
    lambda s, d: rk.one_step_drawdown(sized(s, d), weekly(s, d)))
ALERTS = "((NOT vol_ok)::INT + (NOT single_ok)::INT + (NOT total_ok)::INT + (NOT net_ok)::INT + coalesce((abs(drawdown) > 0.15)::INT, 0))"
register("risk_monitor", "ts:t risk_status n_alerts:i", "RSK11",
         with_corrs(q.stages("weekly", *MODEL, *sized_sql(), *METRIC, final=f"SELECT m.ts, {ALERTS} AS n_alerts, CASE WHEN {ALERTS} = 0 THEN 'GREEN' WHEN {ALERTS} <= 2 THEN 'YELLOW' ELSE 'RED' END AS risk_status FROM {{prev}} m LEFT JOIN ("
                             + DDS.replace("{src}", f"s{BASE}") + ") d USING (ts)")))(
    lambda s, d: rk.risk_monitor(rk.constraint_metrics(sized(s, d), vol_of(s, d, sized(s, d))), rk.one_step_drawdown(sized(s, d), weekly(s, d)))
    .withColumn("n_alerts", F.size("risk_alerts")))

# -- selection ------------------------------------------------------------------------
COLS = ["momentum_2d", "momentum_5d", "momentum_10d", "volume_ratio", "high_low_pct"]
SELB = {**RET, "momentum_2d": q.pct("close", 2), "momentum_5d": q.pct("close", 5), "momentum_10d": q.pct("close", 10), "high_low_pct": "(high - low) / close * 100",
        "volume_ratio": q.guard("volume", q.mean("volume", 20))}
FSQL = ({"y": "coalesce(daily_return, 0)", **{f"c{i}": f"coalesce({c}, 0)" for i, c in enumerate(COLS)}},
        "SELECT count(*) AS n, " + ", ".join(f"corr(c{i}, y) AS r{i}" for i in range(5)) + " FROM {prev}",
        "SELECT unnest([" + ", ".join(f"{{{{'feature': '{c}', 'score': r{i} * r{i} / (1 - r{i} * r{i}) * (n - 2)}}}}" for i, c in enumerate(COLS)) + "], recursive := true) FROM {prev}")


def table(s, d):
    return CORE.compute(weekly(s, d), ["daily_return", *COLS])


register("selection_f_test", "feature | score:4", "SPL18 SPL26", q.stages("weekly", SELB, *FSQL, final="SELECT * FROM {prev} ORDER BY score DESC LIMIT 3"))(
    lambda s, d: sel.select(table(s, d), COLS, "daily_return", 3, "statistical"))
register("selection_forest", "feature | score", "SPL19 SPL26", None)(lambda s, d: sel.top(sel.forest_scores(table(s, d), COLS, "daily_return"), 3))
INPUTS = [f"c{i}" for i in range(5)]
FILLED = {"y": "coalesce(daily_return, 0)", **{f"c{i}": f"coalesce({c}, 0)" for i, c in enumerate(COLS)}}
PENALTIES = (0.0001, 0.001, 0.01, 0.1)
NAMED = "[" + ", ".join(f"{{{{'feature': '{c}', 'score': w{i}}}}}" for i, c in enumerate(COLS)) + "]"
WEIGHTS = {f"w{i}": f"b{i} / d{i}" for i in range(5)}
MISS = "y - my - " + " - ".join(f"w{i} * (c{i} - m{i})" for i in range(5))
LASSO = q.stages(
    "weekly", SELB, {**FILLED, "fold": f"{h(42, 'pos')} % 5"},
    # set f: all rows but those of fold f; set 5: all rows
    f"SELECT f, {fs.sums(5)} FROM {{prev}}, range(6) g(f) WHERE fold <> f GROUP BY f",
    fs.standard(5), f"SELECT *, 31 AS mask, unnest({list(PENALTIES)}::DOUBLE[]) AS lam FROM {{prev}}",
    "SELECT * FROM (" + fs.descent("{prev}", 5, 300) + ")", WEIGHTS,
    f"SELECT a.f, a.lam, sqrt(avg(({MISS}) ** 2)) AS e FROM (SELECT *, sy / m AS my, " + ", ".join(f"s{i} / m AS m{i}" for i in range(5))
    + " FROM {prev} WHERE f < 5) a JOIN s1 ON s1.fold = a.f GROUP BY 1, 2",
    "SELECT lam, avg(e) AS e FROM {prev} GROUP BY lam",
    final=f"SELECT feature, abs(score) AS score FROM (SELECT unnest({NAMED}, recursive := true) FROM s6 WHERE f = 5 AND lam = (SELECT arg_min(lam, (e, lam)) FROM {{prev}})) "
          "WHERE abs(score) > 1e-6 ORDER BY abs(score) DESC, feature LIMIT 3")
register("selection_lasso", "feature | score", "SPL20 SPL26", LASSO)(lambda s, d: sel.top(sel.lasso_scores(table(s, d), COLS, "daily_return"), 3))
register("selection_elimination", "feature | score", "SPL21", None)(lambda s, d: sel.elimination_scores(table(s, d), COLS, "daily_return"))
ELIMINATION = q.stages(
    "weekly", SELB, FILLED, *fs.folds(3),
    # set k < 3: train part of fold k; set 3: all rows
    f"SELECT k, {fs.sums(5)} FROM (SELECT k, y, {', '.join(INPUTS)} FROM {{prev}} WHERE part = 'train' UNION ALL SELECT 3, y, {', '.join(INPUTS)} FROM s1) GROUP BY k",
    fs.standard(5), "SELECT *, unnest(range(1, 32)) AS mask, 0.0::DOUBLE AS lam FROM {prev}",
    "SELECT * FROM (" + fs.descent("{prev}", 5, 500) + ")", WEIGHTS,
    f"SELECT mask, avg(e) AS e FROM (SELECT a.k, a.mask, avg(({MISS}) ** 2) AS e FROM (SELECT *, sy / m AS my, " + ", ".join(f"s{i} / m AS m{i}" for i in range(5))
    + " FROM {prev} WHERE k < 3) a JOIN (SELECT * FROM s5 WHERE part = 'test') t ON t.k = a.k GROUP BY 1, 2) GROUP BY mask",
    "SELECT a.mask, a.e, b.weak FROM {prev} a JOIN (SELECT mask, arg_min(i, v) AS weak FROM (SELECT mask, unnest([" + ", ".join(f"{{{{'i': {i}, 'v': abs(b{i})}}}}" for i in range(5))
    + "], recursive := true) FROM s10 WHERE k = 3) WHERE (mask >> i) & 1 = 1 GROUP BY mask) b USING (mask)",
    "SELECT * FROM (WITH RECURSIVE w AS (SELECT 31 AS mask, 1 AS place UNION ALL SELECT (w.mask - (1 << c.weak))::INT, place + 1 FROM w JOIN {prev} c ON c.mask = w.mask WHERE place < 5) "
    "SELECT c.*, place FROM w JOIN {prev} c ON c.mask = w.mask)",
    final="SELECT " + str(COLS) + "[weak + 1] AS feature, place + CASE WHEN place >= (SELECT arg_min(place, (e, place)) FROM {prev}) THEN 5 ELSE 0 END AS score FROM {prev}")
register("selection_elimination_linear", "feature | score", "SPL21", ELIMINATION)(lambda s, d: sel.linear_elimination(table(s, d), COLS, "daily_return"))
register("selection_single_feature", "feature | score:10", "SPL22",
         q.stages("weekly", SELB, FILLED, *fs.folds(5), "SELECT k, part, y, unnest([" + ", ".join(f"{{{{'feature': '{c}', 'x': c{i}}}}}" for i, c in enumerate(COLS)) + "], recursive := true) FROM {prev}",
                  {"b": "regr_slope(y, x) FILTER (WHERE part = 'train') OVER (PARTITION BY feature, k)", "a": "regr_intercept(y, x) FILTER (WHERE part = 'train') OVER (PARTITION BY feature, k)"},
                  "SELECT feature, k, avg((y - a - b * x) ** 2) AS e FROM {prev} WHERE part = 'test' GROUP BY 1, 2",
                  final="SELECT feature, -avg(e) AS score FROM {prev} GROUP BY feature ORDER BY score DESC, feature LIMIT 3"))(
    lambda s, d: sel.top(sel.single_scores(table(s, d), COLS, "daily_return"), 3))
register("selection_vote", "feature votes:i", "SPL23", None)(
    lambda s, d: sel.select(table(s, d), COLS, "daily_return", 2))


def compared(name, n):
    """Mean test error of a least-squares fit on the first n inputs."""
    return ("SELECT '" + name + f"' AS method, {n} AS n_features, avg(e) AS error FROM (" + q.stages(
        "weekly", SELB, FILLED, *fs.folds(5), *fs.residuals(INPUTS[:n], "y"), final="SELECT k, avg(y_r ** 2) AS e FROM {prev} WHERE part = 'test' GROUP BY k") + ")")


register("selection_method_comparison", "method n_features:i | error:10", "SPL24", f"{compared('first', 2)} UNION ALL {compared('all', 5)}")(
    lambda s, d: sel.compare_methods(table(s, d), {"first": COLS[:2], "all": COLS}, "daily_return"))
CAT = "CASE feature WHEN 'high_low_pct' THEN 'price' WHEN 'volume_ratio' THEN 'volume' ELSE 'momentum' END"
register("selection_by_category", "feature category rank:i | score:4", "SPL25 FN13",
         q.stages("weekly", SELB, *FSQL, {"category": CAT}, {"rank": "row_number() OVER (PARTITION BY category ORDER BY score DESC, feature)"}, final="SELECT * FROM {prev} WHERE rank <= 2"))(
    lambda s, d: sel.by_category(sel.f_scores(table(s, d), COLS, "daily_return"), 2))
register("selection_importance_summary", "feature category selected | score:4", "SPL27",
         q.stages("weekly", SELB, *FSQL, {"category": CAT}, {"selected": "row_number() OVER (ORDER BY score DESC) <= 3"}))(
    lambda s, d: sel.importance_summary(sel.f_scores(table(s, d), COLS, "daily_return"), sel.top(sel.f_scores(table(s, d), COLS, "daily_return"), 3)))
register("feature_summary", "symbol sample_size:i numeric_features:i missing_cells:i returns_features:i first_ts:t last_ts:t", "SPL27",
         q.stages("weekly", FXS, final="SELECT symbol, count(*) AS sample_size, 4 AS numeric_features, sum((daily_return IS NULL)::INT + (momentum_5d IS NULL)::INT + (momentum_10d IS NULL)::INT) AS missing_cells, 1 AS returns_features, "
                  "min(ts) AS first_ts, max(ts) AS last_ts FROM {prev} GROUP BY symbol"))(
    lambda s, d: sel.feature_summary(feats(s, d), {"returns": ["daily_return", "weekly_return"]}))
# The earlier flow: all its features, each scaled by its own median and quartiles per symbol; a feature with ten known values or fewer is left.
FLOW = {
    "sma_20": 4, "momentum_5d": 4, "volatility_20d": 4, "hull_20": 4, "ma_convergence": 4, "ma_slope_5": 4, "ma_slope_20": 4, "h1_range_normalized": 4, "price_efficiency": 4,
    "rsi_simple_14": 3, "rsi_simple_21": 3, "obv_seeded": 4, "momentum_strength_1e8": 3, "momentum_persistence_sum": 4, "momentum_oscillator_1e8": 1, "volatility_ratio_1e8": 4,
    "trend_persistence": 3, "low_vol_factor": 4, "sentiment_score": 4, "news_flow": 4, "social_sentiment": 4, "search_volume": 4, "analyst_revisions": 4, "seasonal_yield": 4,
}


def _merged(*chains):
    """Steps of several chains side by side; equal names are equal terms."""
    steps, seen = [], set()
    for k in range(max(map(len, chains))):
        step = {}
        for chain in chains:
            if k < len(chain):
                step.update({n: e for n, e in chain[k].items() if n not in seen})
        seen |= set(step)
        steps.append(step)
    return steps


FLOWCOLS = list(FLOW)
register("earlier_feature_flow", "symbol ts:t | " + " ".join(f"{c}:{n}" for c, n in FLOW.items()), "SPL29 UDF1",
         q.stages("weekly", *_merged(pt.AVERAGES, pt.RSI_OBV, pt.MOMENTUM_VOLATILITY, pt.PROXIES), {"momentum_5d": "m5"},
                  {f"z_{c}": f"coalesce({c}, 0)" for c in FLOWCOLS}, {f"k_{c}": f"count({c}) OVER (PARTITION BY symbol)" for c in FLOWCOLS},
                  final="SELECT symbol, ts, " + ", ".join(f"CASE WHEN k_{c} > 10 THEN {_norm(f'z_{c}', 'robust')} ELSE {c} END AS {c}" for c in FLOWCOLS) + " FROM {prev}"))(
    lambda s, d: EARLIER.compute(weekly(s, d), FLOWCOLS).transform(lambda t: fit_scale(t, FLOWCOLS, "robust")))
register("feature_matrix_columns", "feature n:i", "PRJ20 UDF1",
         q.stages("weekly", FXS, final="SELECT 'daily_return' AS feature, count(daily_return) AS n FROM {prev} UNION ALL SELECT 'momentum_5d', count(momentum_5d) FROM {prev} UNION ALL SELECT 'momentum_10d', count(momentum_10d) FROM {prev}"))(
    lambda s, d: feats(s, d).unpivot(["symbol", "ts"], FX, "feature", "value").groupBy("feature").agg(F.count("value").alias("n")))


def _range_share(f):
    """A user function on a window: share of the window's range above the last value."""
    rows = f.window_list("close", -9, 0)
    top, bottom, last = F.array_max(rows), F.array_min(rows), F.element_at(rows, -1)
    return F.when(F.size(rows) == 10, F.try_divide(top - last, F.when(top > bottom, top - bottom)))


def _user_window(s, d):
    reg = Registry(parent=CORE)
    reg.add("user", range_share=_range_share)
    return reg.compute(hourly(s, d), ["range_share"])


register("user_window_function", "symbol ts:t | range_share", "UDF4",
         q.stages("hourly", {"a": q.hi("close", 10), "b": q.lo("close", 10)}, final="SELECT symbol, ts, CASE WHEN a > b THEN (a - close) / (a - b) END AS range_share FROM {prev}"))(_user_window)
register("garch_volatility", "symbol ts:t | garch_volatility", "VOL3 VOL4", None)(lambda s, d: garch_volatility(hourly(s, d)))


def _fit_facts(s, d):
    """What any engine can say of the fits: how many there are, and that none is worse than its grid point or has a slope left inside the bounds."""
    inside = F.col("fitted") & (F.col("alpha") > 1e-3) & (F.col("beta") > 1e-3)
    return garch_fits(hourly(s, d)).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("refits"), F.count_if(F.col("nll") > F.col("grid_nll")).alias("below_grid"), F.count_if(inside & (F.col("slope") > 0.05)).alias("slopes_left"),
        F.count_if(F.col("alpha") + F.col("beta") >= 0.999).alias("outside"), F.count_if(F.col("omega") <= 0).alias("no_variance"))


register("garch_fit_facts", "symbol refits:i below_grid:i slopes_left:i outside:i no_variance:i", "VOL3 VOL4",
         q.stages("hourly", final="SELECT symbol, count(*) FILTER (WHERE pos - 1 = 30 OR (pos - 1 >= 50 AND (pos - 1) % 25 = 0)) AS refits, 0 AS below_grid, 0 AS slopes_left, 0 AS outside, 0 AS no_variance FROM {prev} GROUP BY symbol"))(_fit_facts)


def _streamed(s, d):
    """Drive the event table through the stream once, and complete the bars that are still open when it ends."""
    folder = scratch(s)
    events = s.read.parquet(f"{d}/events.parquet")
    ticks = hourly_ticks(s.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]"))
    append_bars(stream_bars(ticks), f"{folder}/out", f"{folder}/state").awaitTermination()
    return completed_bars(s.read.parquet(f"{folder}/out"), hourly_ticks(events)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


register("bars_streamed", "symbol ts:t | open high low close volume", "SRC2",
         f"WITH {q.HOURLY} SELECT * FROM hourly")(_streamed)
