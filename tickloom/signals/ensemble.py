"""Combination of strategy signals, filters, attribution and the whole signal flow."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import add_all, clip, is_inf
from ..operators.clean import infinities_to_null, valid_bars, with_fallbacks
from ..operators.layout import attach, attach_scalar, with_positions
from ..plans.core_features import CORE
from .strategies import MacdRules, RsiRules, run_strategies


@dataclass(frozen=True)
class EnsembleRules:
    weights: dict = field(default_factory=dict)
    method: str = "weighted_average"
    max_total: float = 1.0
    min_agreement: int = 1
    min_confidence: float = 0.0
    max_correlation: float = 0.7


def default_weights(names, given=None) -> dict[str, float]:
    """A strategy registered without a weight gets 1/n at its registration."""
    out = dict(given or {})
    for n, name in enumerate(names, 1):
        out.setdefault(name, 1.0 / n)
    return out


def _parts(names, weights):
    pos = {n: F.coalesce(F.col(f"{n}__position"), F.lit(0.0)) for n in names}
    stg = {n: F.coalesce(F.col(f"{n}__strength"), F.lit(0.0)) for n in names}
    return pos, stg, {n: weights.get(n, 0.0) for n in names}


def combine(wide: DataFrame, names, rules: EnsembleRules) -> DataFrame:
    """Add position and confidence of the ensemble to side-by-side signals."""
    names = list(names)
    pos, stg, w = _parts(names, rules.weights)
    used = [n for n in names if w[n] > 0]
    if rules.method == "weighted_average":
        total = sum(w[n] for n in used)
        active = F.filter(
            F.array(*[F.when(pos[n] != 0, F.lit(n)) for n in used]), lambda v: v.isNotNull()
        )
        contributions = F.map_from_arrays(
            F.array(*[F.lit(n) for n in used]), F.array(*[pos[n] * w[n] for n in used])
        )
        return wide.select(
            "*",
            (add_all([pos[n] * w[n] for n in used]) / total).alias("position"),
            (add_all([stg[n] * w[n] for n in used]) / total).alias("confidence"),
            active.alias("active_strategies"),
            contributions.alias("contributions"),
            *[(pos[n] * w[n]).alias(f"{n}_contribution") for n in used],
        )
    if rules.method == "voting":
        voters = [n for n in names if w[n]]
        longs = add_all([F.when(pos[n] > 0, 1).otherwise(0) for n in voters])
        shorts = add_all([F.when(pos[n] < 0, 1).otherwise(0) for n in voters])
        side = F.when(longs > shorts, 1.0).when(shorts > longs, -1.0).otherwise(0.0)
        share = F.greatest(longs, shorts) / F.greatest(longs + shorts, F.lit(1))
        return wide.select(
            "*", (side * share).alias("position"), (add_all([stg[n] for n in voters]) / len(names)).alias("confidence")
        )
    if rules.method == "confidence_weighted":
        dyn = {n: stg[n] * w[n] for n in used}
        total = add_all(list(dyn.values()))

        def share(cols):
            value = add_all(cols)
            return F.when(total > 0, F.try_divide(value, F.when(total > 0, total))).otherwise(value)

        return wide.select(
            "*",
            share([pos[n] * dyn[n] for n in used]).alias("position"),
            share([stg[n] * dyn[n] for n in used]).alias("confidence"),
        )
    raise ValueError(f"Unknown combination method: {rules.method}")


def combine_long(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted average of signals held one row per strategy (weights: strategy, weight).

    Strategies without a positive weight stay out; used when the number of
    strategies is not known when the plan is built.
    """
    live = weights.where(F.col("weight") > 0)
    total = live.agg(F.sum("weight").alias("_total"))
    joined = attach(signals, live, ["strategy"], "inner").transform(attach_scalar, total)
    return joined.groupBy("symbol", "ts").agg(
        (F.sum(F.col("position") * F.col("weight")) / F.max("_total")).alias("position"),
        (F.sum(F.col("strength") * F.col("weight")) / F.max("_total")).alias("confidence"),
        F.array_sort(F.collect_list(F.when(F.col("position") != 0, F.col("strategy")))).alias("active_strategies"),
    )


def apply_filters(ensemble: DataFrame, rules: EnsembleRules) -> DataFrame:
    """Confidence, size and agreement limits."""
    position = F.when(F.col("confidence") < rules.min_confidence, 0.0).otherwise(F.col("position"))
    position = clip(position, -rules.max_total, rules.max_total)
    if "active_strategies" in ensemble.columns:
        position = F.when(F.size("active_strategies") < rules.min_agreement, 0.0).otherwise(position)
    return ensemble.withColumn("position", position)


def align_signals(bars: DataFrame, signals: DataFrame, columns) -> DataFrame:
    """Signals on the rows of the bars, 0 where there is none."""
    joined = bars.join(signals.select("symbol", "ts", *columns), ["symbol", "ts"], "left")
    return joined.fillna(0.0, list(columns))


def ensemble_signals(bars: DataFrame, rule_sets=(RsiRules(), MacdRules()), rules: EnsembleRules | None = None,
                     keep=("close",)) -> DataFrame:
    """Run the strategies, combine and filter them in one plan."""
    names = [r.name for r in rule_sets]
    rules = rules or EnsembleRules()
    weights = default_weights(names, rules.weights)
    rules = EnsembleRules(weights, rules.method, rules.max_total, rules.min_agreement, rules.min_confidence,
                          rules.max_correlation)
    return apply_filters(combine(run_strategies(bars, rule_sets, keep), names, rules), rules)


def signal_pairs(wide: DataFrame, names, last: int | None = None) -> DataFrame:
    """Correlation of each pair of strategies over all signals of each symbol, or over the last ones where a number is given."""
    names, recent = list(names), wide
    if last is not None:
        sizes = wide.groupBy("symbol").agg((F.max("pos") + 1).alias("_n"))
        recent = attach(wide, sizes, ["symbol"]).where(F.col("pos") >= F.col("_n") - last)
    aggs = [
        _corr(F.col(f"{a}__position"), F.col(f"{b}__position")).alias(f"{a}|{b}")
        for i, a in enumerate(names) for b in names[i + 1:]
    ]
    table = recent.groupBy("symbol").agg(*aggs)
    pairs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr"))
        for i, a in enumerate(names) for b in names[i + 1:]
    ]
    return table.select("symbol", F.explode(F.array(*pairs)).alias("p")).select("symbol", "p.*")


def _corr(a, b):
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.when(spread > 0, spread))


def correlated_pairs(pairs: DataFrame, limit: float = 0.7) -> DataFrame:
    return pairs.where(F.abs("corr") > limit).withColumn("corr", F.abs("corr")).orderBy(F.desc("corr"))


def rebalanced_weights(performance: DataFrame) -> DataFrame:
    """Weights in proportion to the positive Sharpe ratios (strategy, sharpe, weight)."""
    gain = performance.withColumn("_g", F.greatest(F.col("sharpe"), F.lit(0.0)))
    total = gain.agg(F.sum("_g").alias("_total"))
    share = F.when(F.col("_total") > 0, F.try_divide(F.col("_g"), F.col("_total"))).otherwise(F.col("weight"))
    return gain.transform(attach_scalar, total).select("strategy", share.alias("weight"))


def attribution(ensemble: DataFrame, names) -> DataFrame:
    """Signal counts, sizes and contribution statistics per symbol and strategy."""
    rows = [
        F.struct(F.lit(n).alias("strategy"), F.col(f"{n}_contribution").alias("contribution"))
        for n in names if f"{n}_contribution" in ensemble.columns
    ]
    long = ensemble.select("symbol", "position", F.explode(F.array(*rows)).alias("r")).select("symbol", "position", "r.*")
    x = F.col("contribution")
    return long.groupBy("symbol", "strategy").agg(
        F.count_if(F.col("position") != 0).alias("total_signals"),
        F.count_if(F.col("position") > 0).alias("long_signals"),
        F.count_if(F.col("position") < 0).alias("short_signals"),
        F.avg(F.abs("position")).alias("avg_position_size"),
        F.max(F.abs("position")).alias("max_position_size"),
        F.avg(F.abs(x)).alias("avg_contribution"),
        F.max(F.abs(x)).alias("max_contribution"),
        F.count_if(x != 0).alias("active_periods"),
        F.stddev_samp(x).alias("contribution_std"),
    )


# -- data checks before signals ------------------------------------------------
def prepare_signal_data(df: DataFrame) -> DataFrame:
    return with_fallbacks(infinities_to_null(df))


def compatibility(df: DataFrame, rules, min_rows: int = 50, max_null: float = 0.1) -> DataFrame:
    """Per symbol: can this strategy run, and which rules are broken."""
    needed = rules.needs
    swaps = {"rsi_14": "rsi", "rsi": "rsi_14"}
    missing = [c for c in needed if c not in df.columns and swaps.get(c) not in df.columns]
    present = [c for c in dict.fromkeys(needed) if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in present:
        x = F.col(c)
        aggs += [
            F.avg(x.isNull().cast("double")).alias(f"_null_{c}"),
            F.count_if(is_inf(x)).alias(f"_inf_{c}"),
        ]
        if c.startswith("rsi"):
            aggs.append(F.count_if((x < 0) | (x > 100)).alias(f"_bad_{c}"))
        elif c == "atr":
            aggs.append(F.count_if(x < 0).alias(f"_bad_{c}"))
    stats = df.groupBy("symbol").agg(*aggs)
    notes = [F.when(F.col("n_rows") < min_rows, F.lit("too_few_rows"))]
    notes += [F.lit(f"missing:{c}") for c in missing]
    for c in present:
        notes.append(F.when(F.col(f"_null_{c}") > max_null, F.lit(f"nulls:{c}")))
        notes.append(F.when(F.col(f"_inf_{c}") > 0, F.lit(f"infinite:{c}")))
        if f"_bad_{c}" in stats.columns:
            notes.append(F.when(F.col(f"_bad_{c}") > 0, F.lit(f"range:{c}")))
    issues = F.filter(F.array(*notes), lambda v: v.isNotNull())
    return stats.select(
        "symbol", F.lit(rules.name).alias("strategy"), "n_rows", issues.alias("issues"),
        (F.size(issues) == 0).alias("compatible"),
    )


def coordinate(df: DataFrame, rule_sets, min_strategies: int = 1, **limits) -> DataFrame:
    """Per symbol: the strategies that can run and whether enough of them remain."""
    tables = [compatibility(df, r, **limits) for r in rule_sets]
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.when(F.col("compatible"), F.col("strategy")))).alias("valid_strategies"),
        F.array_sort(F.collect_list(F.when(~F.col("compatible"), F.col("strategy")))).alias("invalid_strategies"),
        (F.count_if("compatible") >= min_strategies).alias("ensemble_ready"),
    )


def flow_metrics(bars: DataFrame, ensemble: DataFrame) -> DataFrame:
    """Rows in, rows out and signals per symbol."""
    rows = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("data_points"))
    out = ensemble.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("ensemble_rows"), F.count_if(F.col("position") != 0).alias("signals")
    )
    return rows.join(out, "symbol", "left")


def signal_flow(bars: DataFrame, rule_sets=(RsiRules(), MacdRules()), rules: EnsembleRules | None = None) -> DataFrame:
    """Validate, build features, keep symbols that are ready, run and combine the strategies.

    Symbols that fail the checks drop out; the others go on.
    """
    good = with_positions(valid_bars(bars).drop("pos"), "year")
    features = sorted({c for r in rule_sets for c in r.needs} - {"open", "high", "low", "close", "volume"})
    table = prepare_signal_data(CORE.compute(good, features, keep=["open", "high", "low", "close", "volume"]))
    ready = coordinate(table, rule_sets).where("ensemble_ready").select("symbol")
    return ensemble_signals(attach(good, ready, ["symbol"], "left_semi"), rule_sets, rules)


def batch_flow(datasets: DataFrame, **options) -> DataFrame:
    """The flow over many datasets at once: (dataset, symbol) becomes the series key.

    The key begins with the length of the dataset's name, so any text can be a name; a NULL name is the empty one.
    """
    name = F.coalesce(F.col("dataset").cast("string"), F.lit(""))
    out = signal_flow(datasets.withColumn("symbol", F.concat(F.length(name), F.lit("/"), name, "symbol")), **options)
    size = F.substring_index("symbol", "/", 1)
    start = F.length(size) + 2
    return out.withColumns({
        "dataset": F.substr("symbol", start, size.cast("int")), "symbol": F.substr("symbol", start + size.cast("int")),
    })
