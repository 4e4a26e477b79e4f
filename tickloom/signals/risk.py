"""Position sizing in volatility units and portfolio limits.

A portfolio is the group of positions that share ``by`` (one portfolio per time
by default), so whole histories are sized in one plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.aggregates import corr, issues
from ..functions.scalar import INF, clip
from ..operators.layout import attach
from ..plans.core_features import CORE
from ..plans.registry import Registry

DEFAULT_VOLATILITY = 0.02


@dataclass(frozen=True)
class SizingRules:
    alpha: float = 1.0
    theta: float = 0.0
    beta: float = 1.0
    sigma_floor: float = 0.005
    f_max: float = 0.20
    p_act_floor: float = 0.01
    p_tail_cap: float = 0.95


@dataclass(frozen=True)
class RiskLimits:
    vol_target: float = 0.12
    vol_tolerance: float = 0.02
    max_single: float = 0.15
    max_total: float = 1.0
    max_net: float = 0.8
    max_drawdown: float = 0.15


# The two presets of each parameter set.
SIZING_PRESETS = {
    "conservative": SizingRules(0.5, 0.5, 2.0, 0.01, 0.15, 0.05, 0.90),
    "aggressive": SizingRules(1.5, 0.2, 1.0, 0.005, 0.25, 0.01, 0.95),
}
RISK_PRESETS = {
    "conservative": RiskLimits(0.10, 0.015, 0.12, 0.8, 0.6, 0.12),
    "aggressive": RiskLimits(0.15, 0.03, 0.20, 1.2, 1.0, 0.20),
}
FLAGS = ["sigma_floor_applied", "p_act_floor_applied", "p_tail_cap_applied", "f_max_clipped", "negative_z_zeroed"]


def size_positions(table: DataFrame, equity: float, rules: SizingRules = SizingRules()) -> DataFrame:
    """Positions from p_act, z_h, p_tail, sigma and price, with a map of the controls that applied."""
    sigma = F.greatest("sigma", F.lit(rules.sigma_floor))
    p_act = F.greatest("p_act", F.lit(rules.p_act_floor))
    p_tail = F.least("p_tail", F.lit(rules.p_tail_cap))
    edge = F.greatest(F.col("z_h") - rules.theta, F.lit(0.0))
    raw = rules.alpha * p_act * edge / (1.0 + rules.beta * p_tail)
    f = clip(raw, -rules.f_max, rules.f_max)
    out = table.select("*", sigma.alias("sigma_used"), p_act.alias("p_act_used"), p_tail.alias("p_tail_used"), raw.alias("_raw"), f.alias("f"))
    shares = F.bround(F.col("f") * equity / F.col("sigma_used") / F.col("price")).cast("long")
    out = out.withColumn("n_shares", shares).withColumn("dollar_amount", F.col("n_shares") * F.col("price"))
    flags = [
        F.col("sigma_used") != F.col("sigma"), F.col("p_act_used") != F.col("p_act"), F.col("p_tail_used") != F.col("p_tail"),
        F.abs("f") != F.abs("_raw"), (F.greatest(F.col("z_h") - rules.theta, F.lit(0.0)) == 0) & (F.col("z_h") > 0),
    ]
    pairs = [v for name, flag in zip(FLAGS, flags) for v in (F.lit(name), flag)]
    return out.withColumn("risk_controls", F.create_map(*pairs)).drop("_raw")


def portfolio_positions(outputs: DataFrame, market: DataFrame, equity: float, rules: SizingRules = SizingRules(),
                        on=("symbol", "ts")) -> DataFrame:
    """Symbols with both a model output and a market state, sized."""
    return size_positions(outputs.join(market, list(on)), equity, rules)


def input_checks(table: DataFrame, equity: float) -> DataFrame:
    c = F.col
    return table.select(
        "symbol", "ts", c("p_act").between(0, 1).alias("p_act_valid"),
        (~F.isnan("z_h") & (F.abs("z_h") != INF)).alias("z_h_finite"), c("p_tail").between(0, 1).alias("p_tail_valid"),
        (c("sigma") > 0).alias("sigma_positive"), (c("price") > 0).alias("price_positive"), F.lit(equity > 0).alias("equity_positive"))


def sizing_summary(positions: DataFrame, by=("ts",)) -> DataFrame:
    f, d = F.col("f"), F.col("dollar_amount")
    return positions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_positions"), F.count_if(f != 0).alias("active_positions"),
        F.avg(F.abs(f)).alias("avg_fraction"), F.max(F.abs(f)).alias("max_fraction"), F.sum(F.abs(d)).alias("total_exposure"),
        F.sum(d).alias("net_exposure"), F.count_if(f > 0).alias("long_positions"), F.count_if(f < 0).alias("short_positions"),
        *[F.count_if(F.col("risk_controls")[n]).alias(n) for n in FLAGS])


# -- inputs ---------------------------------------------------------------------
def asset_volatilities(bars: DataFrame) -> DataFrame:
    return CORE.compute(bars, ["daily_return"]).groupBy("symbol").agg(F.stddev_samp("daily_return").alias("vol"))


def correlation_table(bars: DataFrame) -> DataFrame:
    """Correlation of returns of every pair of symbols, as rows (a, b, corr).

    Joined per time, one row per symbol and time on each side; the sums combine
    before the shuffle, so only pairs of symbols move.
    """
    r = CORE.compute(bars, ["daily_return"]).dropna(subset=["daily_return"])
    a = r.select("ts", F.col("symbol").alias("a"), F.col("daily_return").alias("_x"))
    b = r.select("ts", F.col("symbol").alias("b"), F.col("daily_return").alias("_y"))
    half = a.join(b, "ts").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(corr("_x", "_y").alias("corr"))
    same = r.select(F.col("symbol").alias("a"), F.col("symbol").alias("b"), F.lit(1.0).alias("corr")).distinct()
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).unionByName(same)


# -- portfolio volatility ----------------------------------------------------------
def correlation_rows(correlations: DataFrame) -> DataFrame:
    """(symbol, idx, row): symbols in order, and their correlations with the symbol of every place; 0 where there is none."""
    names = correlations.agg(F.sort_array(F.collect_set("a")).alias("_names"))  # one row: the symbols
    places = names.select(F.posexplode("_names").alias("idx", "symbol"))
    cells = correlations.join(F.broadcast(places.select(F.col("symbol").alias("b"), "idx")), "b").where(F.col("corr").isNotNull())
    rows = cells.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("idx", "corr"))).alias("_cells"), F.max("idx").alias("_last"))
    # places without a value are filled by walking the sorted cells once
    dense = F.aggregate("_cells", F.array().cast("array<double>"), lambda out, c: F.concat(out, F.array_repeat(F.lit(0.0), c.idx - F.size(out)), F.array(c["corr"])))
    return places.join(rows.select(F.col("a").alias("symbol"), dense.alias("row")), "symbol", "left")


def portfolio_volatility(positions: DataFrame, correlations: DataFrame, vols: DataFrame, by=("ts",)) -> DataFrame:
    """sqrt(w' D C D w) per portfolio; sum of |w| vol when fewer than two symbols are in the table.

    A sparse quadratic form: the nonzero weights of a portfolio stand in one list, each held symbol meets its row of
    correlations once and adds the products with the held symbols after it, which count twice. Rows are held symbols, not pairs.
    """
    by = list(by)
    table = attach(positions.select(*by, "symbol", "f"), vols, ["symbol"])
    table = attach(table, correlation_rows(correlations), ["symbol"])
    table = table.withColumn("_w", F.col("f") * F.coalesce("vol", F.lit(DEFAULT_VOLATILITY)))
    known = F.col("idx").isNotNull()
    item = F.when(known & (F.col("_w") != 0), F.struct("idx", F.col("_w").alias("w")))
    base = table.groupBy(*by).agg(
        F.sum(F.abs("_w")).alias("_simple"), F.count("idx").alias("_k"), F.collect_list(item).alias("_held"))
    held = table.where(known & (F.col("_w") != 0)).select(*by, "idx", "_w", "row").join(base.select(*by, "_held"), by)
    later = F.aggregate(
        F.filter("_held", lambda h: h.idx > F.col("idx")), F.lit(0.0), lambda s, h: s + h.w * F.coalesce(F.get("row", h.idx), F.lit(0.0)))
    spread = held.groupBy(*by).agg(F.sum(F.col("_w") * (F.col("_w") + 2.0 * later)).alias("_v"))
    out = base.drop("_held").join(spread, by, "left")
    vol = F.when(F.col("_k") < 2, F.col("_simple")).otherwise(F.sqrt(F.greatest(F.coalesce("_v", F.lit(0.0)), F.lit(0.0))))
    return out.select(*by, vol.alias("portfolio_vol"))


def scale_to_target(positions: DataFrame, volatility: DataFrame, limits: RiskLimits = RiskLimits(), by=("ts",)) -> DataFrame:
    """Scale to the volatility target, clip, and work shares and amounts out again."""
    joined = attach(positions, volatility, list(by))
    factor = F.when(F.col("portfolio_vol") > 0, F.try_divide(F.lit(limits.vol_target / math.sqrt(252.0)), F.col("portfolio_vol")))
    price = F.when((F.col("n_shares") != 0) & (F.col("dollar_amount") != 0), F.abs(F.try_divide(F.col("dollar_amount"), F.col("n_shares")))).otherwise(100.0)
    equity = F.when(F.col("f") != 0, F.abs(F.try_divide(F.col("dollar_amount"), F.col("f")))).otherwise(100000.0)
    out = joined.withColumn("_k", factor).withColumn("_price", price).withColumn("_equity", equity)
    new_f = clip(F.col("f") * F.col("_k"), -limits.max_single, limits.max_single)
    out = out.withColumn("_f", F.coalesce(new_f, F.col("f")))
    amount = F.col("_f") * F.col("_equity")
    shares = F.bround(F.try_divide(amount, F.col("_price"))).cast("long")
    live = F.col("_k").isNotNull()
    controls = F.map_concat("risk_controls", F.create_map(
        F.lit("vol_target_scaling_applied"), F.coalesce(F.col("_k") != 1.0, F.lit(False)),
        F.lit("post_scaling_f_max_applied"), F.coalesce(F.col("_f") != F.col("f") * F.col("_k"), F.lit(False))))
    return out.select(
        *[c for c in positions.columns if c not in ("f", "n_shares", "dollar_amount", "risk_controls")],
        F.col("_f").alias("f"), F.when(live, shares).otherwise(F.col("n_shares")).alias("n_shares"),
        F.when(live, amount).otherwise(F.col("dollar_amount")).alias("dollar_amount"), controls.alias("risk_controls"))


def limit_exposure(positions: DataFrame, limits: RiskLimits = RiskLimits(), by=("ts",)) -> DataFrame:
    """Scale a portfolio down when its total exposure is above the limit."""
    total = positions.groupBy(*by).agg(F.sum(F.abs("f")).alias("_total"))
    joined = attach(positions, total, list(by))
    over = F.col("_total") > limits.max_total
    new_f = F.col("f") * F.try_divide(F.lit(limits.max_total), F.col("_total"))
    amount = F.when(F.col("f") != 0, new_f * F.abs(F.try_divide(F.col("dollar_amount"), F.col("f")))).otherwise(0.0)
    price = F.try_divide(F.col("dollar_amount"), F.when(F.col("n_shares") != 0, F.col("n_shares")).otherwise(1))
    shares = F.coalesce(F.bround(F.try_divide(amount, F.when(price != 0, price))).cast("long"), F.lit(0).cast("long"))
    return joined.select(
        *[c for c in positions.columns if c not in ("f", "n_shares", "dollar_amount", "risk_controls")],
        F.when(over, new_f).otherwise(F.col("f")).alias("f"), F.when(over, shares).otherwise(F.col("n_shares")).alias("n_shares"),
        F.when(over, amount).otherwise(F.col("dollar_amount")).alias("dollar_amount"),
        F.when(over, F.map_concat("risk_controls", F.create_map(F.lit("exposure_limit_scaling_applied"), F.lit(True))))
        .otherwise(F.col("risk_controls")).alias("risk_controls"))


def constraint_metrics(positions: DataFrame, volatility: DataFrame, limits: RiskLimits = RiskLimits(), by=("ts",)) -> DataFrame:
    f = F.col("f")
    out = positions.groupBy(*by).agg(
        F.sum(F.abs(f)).alias("total_exposure"), F.sum(f).alias("net_exposure"), F.sum(F.greatest(f, F.lit(0.0))).alias("long_exposure"),
        F.sum(F.greatest(-f, F.lit(0.0))).alias("short_exposure"), F.max(F.abs(f)).alias("max_position"), F.count_if(f != 0).alias("position_count"))
    out = attach(out, volatility, list(by)).withColumn("annual_vol", F.col("portfolio_vol") * math.sqrt(252.0))
    ratio = F.col("annual_vol") / limits.vol_target
    return out.withColumn("vol_ratio", ratio).withColumn("vol_ok", F.abs(ratio - 1.0) <= limits.vol_tolerance / limits.vol_target).withColumn(
        "single_ok", F.col("max_position") <= limits.max_single).withColumn("total_ok", F.col("total_exposure") <= limits.max_total).withColumn(
        "net_ok", F.abs("net_exposure") <= limits.max_net).drop("portfolio_vol")


def risk_controls(positions: DataFrame, correlations: DataFrame, vols: DataFrame, limits: RiskLimits = RiskLimits(), by=("ts",)) -> DataFrame:
    """Volatility target, then exposure limit."""
    volatility = portfolio_volatility(positions, correlations, vols, by)
    return limit_exposure(scale_to_target(positions, volatility, limits, by), limits, by)


def one_step_drawdown(positions: DataFrame, bars: DataFrame, by=("ts",)) -> DataFrame:
    """Profit of the last step over the value before it, per portfolio."""
    reg = Registry()
    reg.add("d", previous=lambda f: f.lag("close"))
    prices = reg.compute(bars, ["previous"], keep=["close"]).select("symbol", "ts", "close", "previous")
    joined = positions.where("n_shares != 0").join(prices, ["symbol", "ts"]).where(F.col("previous").isNotNull())
    value = F.sum(F.abs(F.col("n_shares") * F.col("previous")))
    pnl = F.sum(F.col("n_shares") * (F.col("close") - F.col("previous")))
    return joined.groupBy(*by).agg(F.try_divide(pnl, F.when(value > 0, value)).alias("drawdown"))


def risk_monitor(metrics: DataFrame, drawdown: DataFrame, limits: RiskLimits = RiskLimits(), by=("ts",)) -> DataFrame:
    """Alerts and a GREEN, YELLOW or RED status per portfolio."""
    out = metrics.join(drawdown, list(by), "left")
    alerts = issues((~F.col("vol_ok"), "volatility"), (~F.col("single_ok"), "single position"), (~F.col("total_ok"), "total exposure"),
                    (~F.col("net_ok"), "net exposure"), (F.abs("drawdown") > limits.max_drawdown, "drawdown"))
    n = F.size("risk_alerts")
    return out.withColumn("risk_alerts", alerts).withColumn(
        "risk_status", F.when(n == 0, "GREEN").when(n <= 2, "YELLOW").otherwise("RED"))


def preset_table(spark) -> DataFrame:
    rows = [(n, k, float(v)) for n, r in SIZING_PRESETS.items() for k, v in vars(r).items()]
    rows += [(n, k, float(v)) for n, r in RISK_PRESETS.items() for k, v in vars(r).items()]
    return spark.createDataFrame(rows, "preset string, parameter string, value double")
