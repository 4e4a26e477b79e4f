"""Leak-guarded pattern targets.

A target at row i looks at rows i-20 .. i-1 for the pattern, skips a gap and
looks at a later horizon for the outcome. Only three horizons can occur, so
each outcome is computed for all three as plain frames and picked per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import choose, clip, guarded, logistic
from ..operators.layout import attach
from ..operators.order_stats import exact_quantiles, nth_values
from ..plans.registry import Registry
from ..session import materialize

REQUIRED = [
    "momentum_persistence_7d", "volatility_clustering", "trend_exhaustion", "volume_price_divergence",
    "volatility_regime_change", "returns_1d", "returns_3d", "returns_7d", "close",
]
TARGETS = ["momentum_persistence", "volatility_regime", "trend_exhaustion", "volume_divergence"]
# Thresholds without adaptation, quantiles with it, wanted positive rates, weights.
FIXED_THRESHOLDS = {"momentum": 0.2, "volatility": 0.15, "trend": 0.2, "volume": 0.15}
THRESHOLD_SOURCE = {
    "momentum": ("momentum_persistence_7d", 0.70), "volatility": ("volatility_regime_change", 0.75),
    "trend": ("trend_exhaustion", 0.80), "volume": ("volume_price_divergence", 0.75),
}
POSITIVE_RATES = {
    "momentum_persistence": (0.20, 0.40), "volatility_regime": (0.20, 0.40),
    "trend_exhaustion": (0.15, 0.35), "volume_divergence": (0.20, 0.40),
}
COMBINED_WEIGHTS = [0.35, 0.35, 0.15, 0.15]


@dataclass(frozen=True)
class TargetRules:
    base_horizon: int = 5
    lookback: int = 20
    gap: int = 5
    dynamic_horizons: bool = True
    adaptive_thresholds: bool = True
    calibrate: bool = True
    causal: bool = False  # thresholds from the first half of each series only

    @property
    def horizons(self):
        """Base, low-volatility and high-volatility horizon."""
        if not self.dynamic_horizons:
            return [self.base_horizon]
        return [self.base_horizon, min(15, self.base_horizon + 3), max(3, self.base_horizon - 2)]


def require(df: DataFrame):
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required features: {missing}")


def rolling_volatility(features: DataFrame, rules: TargetRules) -> DataFrame:
    reg = Registry()
    reg.add("target", _vol=lambda f: f.std("returns_1d", rules.lookback, 10))
    keep = [c for c in features.columns if c not in ("symbol", "ts", "pos")]
    return reg.compute(features, ["_vol"], keep=keep)


def _fit_part(df: DataFrame, rules: TargetRules) -> DataFrame:
    return df.where(F.col("pos") < F.col("_rows") / 2) if rules.causal else df


def with_horizons(features: DataFrame, rules: TargetRules = TargetRules()) -> DataFrame:
    """Add ``horizon``, ``_rows`` and the longest horizon of the symbol."""
    sizes = features.groupBy("symbol").agg(F.count(F.lit(1)).alias("_rows"))
    table = attach(rolling_volatility(features, rules), sizes, ["symbol"])
    if not rules.dynamic_horizons:
        out = table.withColumn("horizon", F.lit(rules.base_horizon))
    else:
        cuts = exact_quantiles(_fit_part(table, rules), ["symbol"], "_vol", {"_q25": 0.25, "_q75": 0.75})
        known = table.groupBy("symbol").agg(F.count("_vol").alias("_known"))
        table = attach(table, known.join(cuts, "symbol", "left"), ["symbol"])
        base, calm, rough = rules.horizons
        live = (F.col("_known") >= 50) & (F.col("pos") >= rules.lookback)
        out = table.withColumn(
            "horizon",
            choose([(live & (F.col("_vol") < F.col("_q25")), F.lit(calm)),
                    (live & (F.col("_vol") > F.col("_q75")), F.lit(rough))], F.lit(base)),
        )
    longest = out.groupBy("symbol").agg(F.max("horizon").alias("_longest"))
    return attach(out, longest, ["symbol"])


def thresholds(features: DataFrame, rules: TargetRules = TargetRules()) -> DataFrame:
    """Strength thresholds per symbol: quantiles of the absolute features, or fixed values."""
    symbols = features.groupBy("symbol").agg(F.count(F.lit(1)).alias("_rows"))
    if not rules.adaptive_thresholds:
        return symbols.select("symbol", *[F.lit(v).alias(f"thr_{k}") for k, v in FIXED_THRESHOLDS.items()])
    names = {c: k for k, (c, _) in THRESHOLD_SOURCE.items()}
    source = attach(features, symbols, ["symbol"]) if rules.causal else features
    if rules.causal:
        source = _fit_part(source, rules)
    long = source.select("symbol", *names).unpivot(["symbol"], list(names), "feature", "value").withColumn(
        "value", F.abs("value")
    )
    probs = {f"q{int(p * 100)}": p for p in sorted({p for _, p in THRESHOLD_SOURCE.values()})}
    table = exact_quantiles(long, ["symbol", "feature"], "value", probs).join(
        long.groupBy("symbol", "feature").agg(F.count("value").alias("_n")), ["symbol", "feature"]
    )
    picks = []
    for key, (column, p) in THRESHOLD_SOURCE.items():
        here = F.col("feature") == column
        value = F.max(F.when(here & (F.col("_n") > 10), F.col(f"q{int(p * 100)}")))
        picks.append(F.coalesce(value, F.lit(FIXED_THRESHOLDS[key])).alias(f"thr_{key}"))
    return table.groupBy("symbol").agg(*picks)


def _future(f, rules, agg, value, least=3):
    """Aggregate of the later horizon, picked by the row's own horizon."""
    out = F.lit(None).cast("double")
    for h in rules.horizons:
        found = f.agg(agg, value, rules.gap, rules.gap + h - 1, least)
        out = F.when(F.col("horizon") == h, found).otherwise(out)
    f["horizon"]
    return out


def _past(f, rules, agg, value, least=10):
    return f.agg(agg, value, -rules.lookback, -1, least)


def target_registry(rules: TargetRules) -> Registry:
    reg = Registry()

    def usable(f):
        return (f["pos"] >= rules.lookback) & (f["pos"] < f["_rows"] - rules.gap - f["_longest"])

    def consistency(f, value, least):
        return 1.0 - guarded(
            _past(f, rules, F.stddev_pop(value), value, least), _past(f, rules, F.avg(F.abs(value)), value, least), 1e-8
        )

    def momentum(f):
        x = f["momentum_persistence_7d"]
        strength = _past(f, rules, F.avg(F.abs(x)), x)
        strong = (strength >= f["thr_momentum"]) & (consistency(f, x, 10) >= 0.5)
        ups = _future(f, rules, F.avg(F.when(f["returns_1d"] > 0, 1.0).otherwise(0.0)), f["returns_1d"])
        downs = _future(f, rules, F.avg(F.when(f["returns_1d"] < 0, 1.0).otherwise(0.0)), f["returns_1d"])
        flats = _future(f, rules, F.avg(F.when(f["returns_1d"] == 0, 1.0).otherwise(0.0)), f["returns_1d"])
        side = _past(f, rules, F.avg(x), x)
        match = F.when(side > 0, ups).when(side < 0, downs).otherwise(flats)
        return choose([(usable(f) & strong & (match > 0.6), F.lit(1.0))], F.lit(0.0))

    def volatility(f):
        n = rules.lookback
        x = f["volatility_regime_change"]
        recent = f.agg(F.stddev_pop(f["returns_1d"]), "returns_1d", -n, -1)
        older = F.when(f["pos"] >= 2 * n, f.agg(F.stddev_pop(f["returns_1d"]), "returns_1d", -2 * n, -n - 1))
        signal = F.least(guarded(F.abs(x), f["thr_volatility"], 1e-8), F.lit(1.0))
        move = F.abs(F.log(F.try_divide(F.when(recent > 0, recent), F.when(older > 0, older))))
        steady = F.coalesce(clip(consistency(f, x, 6), 0.0, 1.0), F.lit(0.5))
        score = F.when(move > 0.1, signal * F.least(move, F.lit(1.0)) * steady).when(move.isNotNull(), signal * 0.3)
        return F.when((f["pos"] >= n) & x.isNotNull(), F.coalesce(score, F.lit(0.0))).otherwise(0.0)

    def trend(f):
        x = f["trend_exhaustion"]
        seen = F.when(x.isNotNull(), f["returns_3d"])
        was = _past(f, rules, F.avg(seen), x)
        strong = (_past(f, rules, F.avg(F.abs(x)), x) >= f["thr_trend"]) & (F.abs(was) >= 0.01)
        then = _future(f, rules, F.avg(f["returns_3d"]), f["returns_3d"])
        turned = (F.signum(was) != F.signum(then)) & (F.abs(then) > 0.005)
        return choose([(usable(f) & strong & turned, F.lit(1.0))], F.lit(0.0))

    def volume(f):
        x = f["volume_price_divergence"]
        strong = _past(f, rules, F.avg(F.abs(x)), x) >= f["thr_volume"]
        then = _future(f, rules, F.stddev_pop(f["returns_1d"]), f["returns_1d"])
        return choose([(usable(f) & strong & (then > 0.012), F.lit(1.0))], F.lit(0.0))

    reg.add("target", momentum_persistence=momentum, volatility_regime=volatility, volume_divergence=volume)
    reg.add("target", trend_exhaustion_target=trend)
    return reg


def raw_targets(features: DataFrame, rules: TargetRules = TargetRules()) -> DataFrame:
    """The four targets before calibration, scaled to at most 1 per symbol."""
    require(features)
    ready = attach(with_horizons(features, rules), thresholds(features, rules), ["symbol"])
    names = ["momentum_persistence", "volatility_regime", "trend_exhaustion_target", "volume_divergence"]
    out = target_registry(rules).compute(materialize(ready), names, keep=["horizon"])
    out = materialize(out.withColumnRenamed("trend_exhaustion_target", "trend_exhaustion"))
    tops = out.groupBy("symbol").agg(*[F.max(t).alias(f"_top_{t}") for t in TARGETS[:2]])
    joined = attach(out, tops, ["symbol"])
    scaled = [
        F.when(F.col(f"_top_{t}") > 0, F.try_divide(F.col(t), F.col(f"_top_{t}"))).otherwise(F.col(t)).alias(t)
        for t in TARGETS[:2]
    ]
    return joined.select("symbol", "ts", "pos", "horizon", *scaled, *TARGETS[2:])


def calibration(targets: DataFrame, rates: dict = POSITIVE_RATES) -> DataFrame:
    """Per symbol and target: positive rate and, where out of range, the value to centre on."""
    long = targets.select("symbol", *TARGETS).unpivot(["symbol"], TARGETS, "target", "value")
    stats = long.groupBy("symbol", "target").agg(F.avg((F.col("value") > 0.5).cast("double")).alias("rate"))
    low = F.create_map(*[F.lit(v) for t in TARGETS for v in (t, rates[t][0])])
    high = F.create_map(*[F.lit(v) for t in TARGETS for v in (t, rates[t][1])])
    aim = (low[F.col("target")] + high[F.col("target")]) / 2.0
    rank = F.floor((1.0 - aim) * F.col("_n")).cast("long")
    centre = nth_values(
        long, ["symbol", "target"], "value", {"centre": F.greatest(F.least(rank, F.col("_n") - 1), F.lit(0))}
    )
    out = (F.col("rate") < low[F.col("target")]) | (F.col("rate") > high[F.col("target")])
    usable = out & (F.col("rate") > 0) & (F.col("rate") < 1)
    return stats.join(centre, ["symbol", "target"]).select(
        "symbol", "target", "rate", F.when(usable, F.col("centre")).alias("centre"), usable.alias("calibrated"),
        F.when(usable, F.lit("calibrated")).when(out, F.lit("uniform_distribution"))
        .otherwise(F.lit("within_target_range")).alias("reason"),
    )


def calibrated(targets: DataFrame) -> DataFrame:
    """Apply the logistic around each centre."""
    table = calibration(targets).groupBy("symbol").agg(
        *[F.max(F.when(F.col("target") == t, F.col("centre"))).alias(f"_at_{t}") for t in TARGETS]
    )
    joined = attach(targets, table, ["symbol"])
    return joined.select(
        "symbol", "ts", "pos", "horizon",
        *[F.when(F.col(f"_at_{t}").isNotNull(), logistic(t, F.col(f"_at_{t}"))).otherwise(F.col(t)).alias(t)
          for t in TARGETS],
    )


def combined_score(targets: DataFrame) -> DataFrame:
    """Weighted score, spread by a logistic, with its 60th percentile moved to 0.5."""
    mix = sum((F.col(t) * w for t, w in zip(TARGETS[1:], COMBINED_WEIGHTS[1:])), F.col(TARGETS[0]) * COMBINED_WEIGHTS[0])
    scored = targets.withColumn("_s", logistic(mix / sum(COMBINED_WEIGHTS), F.lit(0.5)))
    joined = attach(scored, exact_quantiles(scored, ["symbol"], "_s", {"_t": 0.6}), ["symbol"])
    s, t = F.col("_s"), F.col("_t")
    upper = 0.5 + 0.5 * F.try_divide(s - t, 1.0 - t)
    lower = 0.5 * F.try_divide(s, t)
    value = F.when((t <= 0) | (t == 0.5), s).when(t > 0.5, F.when(s >= t, upper).otherwise(lower)).otherwise(
        F.when(s <= t, lower).otherwise(upper)
    )
    return joined.withColumn("pattern_confidence_score", value).drop("_s", "_t")


def all_targets(features: DataFrame, rules: TargetRules = TargetRules()) -> DataFrame:
    out = raw_targets(features, rules)
    return combined_score(calibrated(out) if rules.calibrate else out)


def target_quality(targets: DataFrame, columns) -> DataFrame:
    """Positive rate, balance label, mean and deviation per symbol and target."""
    long = targets.select("symbol", *columns).unpivot(["symbol"], list(columns), "target", "value")
    out = long.groupBy("symbol", "target").agg(
        F.avg((F.col("value") > 0.5).cast("double")).alias("positive_rate"),
        F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("std_value"),
    )
    good = F.col("positive_rate").between(0.1, 0.9)
    return out.withColumn("balance", F.when(good, F.lit("GOOD")).otherwise(F.lit("IMBALANCED")))


# -- fixed-threshold, fixed-horizon targets --------------------------------------
FIXED_TARGETS = [f"{t}_binary" for t in TARGETS]


def fixed_registry(horizon: int = 5, gap: int = 5, lookback: int = 20) -> Registry:
    rules = TargetRules(base_horizon=horizon, lookback=lookback, gap=gap, dynamic_horizons=False)
    reg = Registry()

    def future(f, agg, value):
        return f.agg(agg, value, gap, gap + horizon - 1, 3)

    def usable(f):
        """The row after the horizon must exist."""
        return (f["pos"] >= lookback) & f.lead("pos", gap + horizon).isNotNull()

    def enough(f, x):
        return f.over(F.count(x), -lookback, -1) >= 10

    def recent(f, agg):
        return f.over(agg, -5, -1)

    def momentum(f):
        x = f["momentum_persistence_7d"]
        strength = _past(f, rules, F.avg(F.abs(x)), x)
        steady = 1.0 - guarded(_past(f, rules, F.stddev_pop(x), x), strength, 1e-8)
        side = _past(f, rules, F.avg(x), x)
        r = f["returns_1d"]
        share = lambda cond: future(f, F.avg(F.when(cond, 1.0).otherwise(0.0)), r)
        match = F.when(side > 0, share(r > 0)).when(side < 0, share(r < 0)).otherwise(share(r == 0))
        return choose([(usable(f) & (strength >= 0.3) & (steady >= 0.6) & (match > 0.6), F.lit(1.0))], F.lit(0.0))

    def volatility(f):
        x = f["volatility_regime_change"]
        shift = recent(f, F.avg(x))
        seen = F.when(x.isNotNull(), f["returns_1d"])
        was = f.over(F.stddev_pop(seen), -lookback, -1)
        then = future(f, F.stddev_pop(f["returns_1d"]), f["returns_1d"])
        change = F.try_divide(then - was, F.when(was != 0, was))
        hit = (F.abs(shift) >= 0.2) & (F.signum(shift) == F.signum(change)) & (F.abs(change) > 0.1)
        return choose([(usable(f) & enough(f, x) & hit, F.lit(1.0))], F.lit(0.0))

    def trend(f):
        x = f["trend_exhaustion"]
        was = f.over(F.avg(F.when(x.isNotNull(), f["returns_3d"])), -lookback, -1)
        then = future(f, F.avg(f["returns_3d"]), f["returns_3d"])
        hit = (
            (recent(f, F.avg(F.abs(x))) >= 0.3) & (F.abs(was) >= 0.01)
            & (F.signum(was) != F.signum(then)) & (F.abs(then) > 0.005)
        )
        return choose([(usable(f) & enough(f, x) & hit, F.lit(1.0))], F.lit(0.0))

    def volume(f):
        x = f["volume_price_divergence"]
        then = future(f, F.stddev_pop(f["returns_1d"]), f["returns_1d"])
        hit = (recent(f, F.avg(F.abs(x))) >= 0.2) & (then > 0.015)
        return choose([(usable(f) & enough(f, x) & hit, F.lit(1.0))], F.lit(0.0))

    reg.add("fixed", momentum_persistence_binary=momentum, volatility_regime_binary=volatility,
            trend_exhaustion_binary=trend, volume_divergence_binary=volume)
    reg.add("fixed", pattern_confidence_score=lambda f: sum((f[t] for t in FIXED_TARGETS[1:]), f[FIXED_TARGETS[0]]) / 4.0)
    return reg


def fixed_targets(features: DataFrame, horizon: int = 5, gap: int = 5, keep=()) -> DataFrame:
    """Four binary targets and their mean (the noise of the mean is left out)."""
    require(features)
    return fixed_registry(horizon, gap).compute(features, [*FIXED_TARGETS, "pattern_confidence_score"], keep=keep)


INTEGRITY_FEATURES = ["momentum_persistence_7d", "trend_exhaustion", "volatility_regime_change"]


def _abs_corr(a, b):
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    a, b = F.when(both, F.col(a)), F.when(both, F.col(b))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(a) > 10, F.abs(F.try_divide(F.covar_pop(a, b), F.when(spread > 1e-15, spread))))


def temporal_integrity(features: DataFrame, gaps=(0, 1, 5, 10)) -> DataFrame:
    """Same-time correlation of the score with inputs, and correlation by gap, per symbol."""
    base = fixed_targets(features, keep=INTEGRITY_FEATURES)
    same = base.groupBy("symbol").agg(*[_abs_corr(c, "pattern_confidence_score").alias(f"corr_{c}") for c in INTEGRITY_FEATURES])
    top = F.greatest(*[F.coalesce(F.col(f"corr_{c}"), F.lit(0.0)) for c in INTEGRITY_FEATURES])
    out = same.withColumn("max_same_time_correlation", top)
    for g in gaps:
        at = fixed_targets(features, gap=g, keep=["momentum_persistence_7d"])
        out = out.join(
            at.groupBy("symbol").agg(_abs_corr("momentum_persistence_7d", "pattern_confidence_score").alias(f"gap_{g}")),
            "symbol",
        )
    return out.withColumn("temporal_integrity_passed", F.col("max_same_time_correlation") < 0.1)


def forward_return(bars: DataFrame, horizon: int = 5, keep=()) -> DataFrame:
    reg = Registry()
    reg.add("target", forward_return=lambda f: F.try_divide(f.lead("close", horizon), f["close"]) - 1)
    return reg.compute(bars, ["forward_return"], keep=keep)
