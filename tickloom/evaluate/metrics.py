"""Prediction metrics per group: one grouped aggregate each."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.aggregates import corr, issues, match_rate, share
from ..functions.scalar import INF
from ..learn.gram import fits, products
from ..operators.layout import attach
from ..operators.order_stats import exact_quantiles
from ..plans.core_features import CORE
from ..plans.registry import Registry
from ..session import materialize
from .strategy import equity_curve


def T():
    """The truth column."""
    return F.col("y_true")


def P():
    """The prediction column."""
    return F.col("y_pred")



def prediction_table(bars: DataFrame, keep=()) -> DataFrame:
    """Next return as truth, two-row momentum as prediction."""
    reg = Registry(parent=CORE)
    reg.add("p", y_true=lambda f: f.lead("daily_return"), y_pred=lambda f: f["momentum_2d"])
    return reg.compute(bars, ["y_true", "y_pred"], keep=keep).dropna(subset=["y_true", "y_pred"])


def traded():
    """Return of a position in the predicted direction."""
    return F.when(P() > 0, T()).when(P() < 0, -T()).otherwise(0.0)


def _ratio(num, den, flat):
    return F.coalesce(F.try_divide(num, F.when(den != 0, den)), flat)


def hit_rate(threshold: float = 0.0):
    return F.coalesce(match_rate(T(), P(), F.abs(T()) > threshold) * 100, F.lit(0.0))


def profit_factor():
    x = traded()
    gain = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0))
    loss = F.abs(F.coalesce(F.sum(F.when(x < 0, x)), F.lit(0.0)))
    return F.when(loss > 0, F.try_divide(gain, loss)).when(gain > 0, F.lit(INF)).otherwise(1.0)


def information_ratio(actual=None, benchmark=None):
    x = (T() if actual is None else actual) - (F.lit(0.0) if benchmark is None else benchmark)
    return _ratio(F.avg(x), F.stddev_pop(x), F.lit(0.0))


def sharpe_annual(x, rate: float = 0.02):
    return _ratio(F.avg(x) * 252 - rate, F.stddev_pop(x) * math.sqrt(252.0), F.lit(0.0))


def sharpe_plain(x, rate: float = 0.0):
    return _ratio(F.avg(x) - rate, F.stddev_pop(x), F.lit(0.0))


def runs_below(curve: DataFrame) -> DataFrame:
    """Longest run of rows below the high-water mark, per symbol.

    A run is told by the number of rows at the mark so far, a running total
    that carries over blocks; runs are then counted by (symbol, number).
    """
    reg = Registry()
    reg.add("run", _top=lambda f: F.when(f["drawdown"] < 0, 0).otherwise(1))
    reg.running("run", "_run", "_top")
    marked = reg.compute(curve, ["_run"], keep=["drawdown"])
    runs = marked.where("drawdown < 0").groupBy("symbol", "_run").agg(F.count(F.lit(1)).alias("_len"))
    longest = runs.groupBy("symbol").agg(F.max("_len").alias("drawdown_duration"))
    return curve.select("symbol").distinct().join(longest, "symbol", "left").fillna(0, ["drawdown_duration"])


def max_drawdown(returns: DataFrame, column: str) -> DataFrame:
    curve = equity_curve(returns, column)
    depth = curve.groupBy("symbol").agg(F.abs(F.min("drawdown")).alias("max_drawdown"))
    return depth.join(runs_below(curve), "symbol")


def calmar(mean, depth):
    year = mean * 252
    return F.when(depth > 0, F.try_divide(year, depth)).when(year > 0, F.lit(INF)).otherwise(0.0)


def trading_evaluation(predictions: DataFrame) -> DataFrame:
    """Twelve trading metrics per symbol."""
    x = F.col("_x")
    table = predictions.withColumn("_x", traded())
    base = table.groupBy("symbol").agg(
        (F.sum(x) * 100).alias("total_return"), (F.avg(x) * 252 * 100).alias("annual_return"),
        sharpe_annual(x).alias("sharpe_ratio"), hit_rate().alias("hit_rate"),
        hit_rate(0.01).alias("hit_rate_significant"), profit_factor().alias("profit_factor"),
        information_ratio().alias("information_ratio"),
        (F.stddev_pop(x) * math.sqrt(252.0) * 100).alias("volatility"),
        F.count_if(F.abs(P()) > 0.001).alias("num_trades"), F.avg(x).alias("_mean"),
    )
    numbered = _renumber(table.select("symbol", "ts", "_x"))
    out = base.join(max_drawdown(numbered, "_x"), "symbol")
    return out.withColumn("calmar_ratio", calmar(F.col("_mean"), F.col("max_drawdown"))).withColumn(
        "max_drawdown", F.col("max_drawdown") * 100
    ).drop("_mean")


def _renumber(df: DataFrame) -> DataFrame:
    from ..operators.layout import with_positions

    return with_positions(df, "year")


def confidence_bands(predictions: DataFrame, levels=(0.5, 0.7, 0.9)) -> DataFrame:
    """Threshold, share and count of the predictions above each magnitude quantile."""
    table = predictions.withColumn("_a", F.abs(P()))
    cuts = exact_quantiles(table, ["symbol"], "_a", {f"q{int(v * 100)}": v for v in levels})
    bands = F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"q{int(v * 100)}").alias("threshold")) for v in levels])
    rows = attach(table, cuts, ["symbol"]).select("symbol", "_a", F.explode(bands).alias("b")).select("symbol", "_a", "b.*")
    above = F.col("_a") >= F.col("threshold")
    return rows.groupBy("symbol", "level").agg(
        F.max("threshold").alias("threshold"), (share(above) * 100).alias("percentage"), F.count_if(above).alias("n_above")
    )


def regression_aggregates():
    """Correlation, errors, fit and moments."""
    res = F.sum((T() - P()) * (T() - P()))
    tot = F.var_pop(T()) * F.count(T())
    return [
        F.count(F.lit(1)).alias("n_samples"),
        F.coalesce(F.when(F.var_pop(P()) > 1e-10, corr(T(), P())), F.lit(0.0)).alias("correlation"),
        F.avg(F.abs(T() - P())).alias("mae"), F.sqrt(F.avg((T() - P()) * (T() - P()))).alias("rmse"),
        F.when(tot > 0, 1.0 - F.try_divide(res, tot)).otherwise(0.0).alias("r_squared"),
        F.var_pop(P()).alias("predictions_variance"), F.avg(P()).alias("predictions_mean"),
        F.stddev_pop(P()).alias("predictions_std"),
    ]


def regression_metrics(predictions: DataFrame, by=("symbol",)) -> DataFrame:
    return predictions.groupBy(*by).agg(*regression_aggregates())


def pattern_aggregates():
    """Accuracy at 0.5, precision above 0.7, recall of true patterns, errors."""
    t, p = T() > 0.5, P() > 0.5
    same = F.when(t == p, 1.0).otherwise(0.0)
    return [
        F.avg(same).alias("pattern_detection_accuracy"), F.coalesce(corr(T(), P()), F.lit(0.0)).alias("correlation"),
        F.coalesce(F.avg(F.when(P() > 0.7, same)), F.lit(0.0)).alias("pattern_precision"),
        F.coalesce(F.avg(F.when(t, same)), F.lit(0.0)).alias("pattern_recall"),
        F.avg(F.abs(T() - P())).alias("mae"), F.sqrt(F.avg((T() - P()) * (T() - P()))).alias("rmse"),
    ]


PATTERN_METRICS = ["pattern_detection_accuracy", "correlation", "pattern_precision", "pattern_recall", "mae", "rmse"]


def pattern_metrics(predictions: DataFrame, by=("symbol",)) -> DataFrame:
    return predictions.groupBy(*by).agg(*pattern_aggregates())


def aggregate_folds(folds: DataFrame, metrics, by=("symbol",)) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    long = folds.select(*by, *metrics).unpivot(list(by), list(metrics), "metric", "value")
    known = F.when(~F.isnan("value"), F.col("value"))
    return long.groupBy(*by, "metric").agg(
        F.coalesce(F.avg(known), F.lit(0.0)).alias("metric_mean"),
        F.coalesce(F.stddev_pop(known), F.lit(0.0)).alias("metric_std"),
    )


# Targets that a model has to reach.
READY_TARGETS = {"pattern_detection_accuracy": 0.55, "correlation": 0.1}


def readiness_gate(summary: DataFrame, targets: dict = READY_TARGETS, by=("symbol",)) -> DataFrame:
    """Each metric against its target, and whether all are met."""
    wanted = F.create_map(*[F.lit(v) for kv in targets.items() for v in kv])
    rows = summary.where(F.col("metric").isin(list(targets))).withColumn("target", wanted[F.col("metric")])
    met = F.col("metric_mean") >= F.col("target")
    return rows.groupBy(*by).agg(F.count_if(met).alias("targets_met"), F.bool_and(met).alias("ready"))


def direction_evaluation(predictions: DataFrame, by=("symbol",)) -> DataFrame:
    """Direction accuracy with a binomial interval, and for the largest moves."""
    cuts = exact_quantiles(predictions.withColumn("_a", F.abs(T())), list(by), "_a", {"_q75": 0.75})
    table = attach(predictions, cuts, list(by))
    n = F.count(F.lit(1))
    hit = match_rate(T(), P())
    margin = 1.96 * F.sqrt(hit * (1 - hit) / n)
    return table.groupBy(*by).agg(
        n.alias("n_samples"), F.sum(F.when(F.signum(T()) == F.signum(P()), 1).otherwise(0)).alias("n_correct"),
        (hit * 100).alias("directional_accuracy"),
        F.greatest(F.lit(0.0), (hit - margin) * 100).alias("ci_lower"),
        F.least(F.lit(100.0), (hit + margin) * 100).alias("ci_upper"),
        F.coalesce(match_rate(T(), P(), F.abs(T()) > F.col("_q75")) * 100, F.lit(0.0)).alias("high_magnitude"),
        F.avg(F.abs(T() - P())).alias("mae"), F.avg((T() - P()) * (T() - P())).alias("mse"),
    )


def weighted_direction(predictions: DataFrame, by=("symbol",)) -> DataFrame:
    """Accuracy weighted by move size, mean of up and down accuracy, mean profit."""
    hit = F.when(F.signum(T()) == F.signum(P()), 1.0).otherwise(0.0)

    def side(cond):
        return F.coalesce(F.sum(F.when(cond, hit)), F.lit(0.0)) / (F.count_if(cond) + 1e-8)

    return predictions.groupBy(*by).agg(
        F.try_divide(F.sum(hit * F.abs(T())), F.when(F.sum(F.abs(T())) > 0, F.sum(F.abs(T())))).alias("weighted_accuracy"),
        ((side(T() > 0) + side(T() < 0)) / 2.0).alias("up_down_accuracy"),
        F.avg(F.signum(P()) * T()).alias("profit_loss"),
    )


def compare_models(results: DataFrame, model: str) -> DataFrame:
    """The best other model by accuracy against one model, per symbol (symbol, model, dir_acc, mae)."""
    other = F.col("model") != model
    best = F.max_by(F.struct("model", "dir_acc", "mae"), F.when(other, F.struct("dir_acc", "model")))
    mine = F.max(F.when(~other, F.col("dir_acc"))), F.max(F.when(~other, F.col("mae")))
    out = results.groupBy("symbol").agg(best.alias("b"), mine[0].alias("model_dir_acc"), mine[1].alias("model_mae"))
    gain = F.col("model_dir_acc") - F.col("b.dir_acc")
    return out.select(
        "symbol", F.col("b.model").alias("best_baseline"), F.col("b.dir_acc").alias("baseline_dir_acc"), "model_dir_acc",
        gain.alias("dir_acc_improvement"), (F.col("b.mae") - F.col("model_mae")).alias("mae_improvement"),
        F.when(gain > 2, "outperforms").when(gain > -2, "similar").otherwise("underperforms").alias("assessment"),
    )


def fit_labels(parts: DataFrame) -> DataFrame:
    """Overfit and generalisation labels from direction accuracy per part (symbol, part, accuracy)."""
    cell = lambda p: F.max(F.when(F.col("part") == p, F.col("accuracy")))
    out = parts.groupBy("symbol").agg((cell("train") - cell("validation")).alias("train_val_gap"),
                                      F.abs(cell("validation") - cell("test")).alias("cv_test_gap"))
    g, h = F.col("train_val_gap"), F.col("cv_test_gap")
    return out.withColumn("risk", F.when(g > 10, "High").when(g > 5, "Moderate").otherwise("Low")).withColumn(
        "generalization", F.when(h < 2, "Good").when(h < 5, "Fair").otherwise("Poor")
    )


def prediction_statistics(predictions: DataFrame, by=("symbol",)) -> DataFrame:
    """Moments, median, distinct values to four digits, constant test and findings."""
    mid = exact_quantiles(predictions, list(by), "y_pred", {"median": 0.5})
    rounded = F.floor(P() * 10000 + 0.5)
    out = predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(P()).alias("mean"), F.stddev_pop(P()).alias("std"), F.min(P()).alias("lowest"),
        F.max(P()).alias("highest"), F.count_distinct(rounded).alias("unique_values"),
        F.avg(T()).alias("true_mean"), F.stddev_pop(T()).alias("true_std"),
    ).join(mid, list(by))
    return out.withColumn("constant", F.col("std") < 1e-6).withColumn("findings", issues(
        (F.col("std") < 1e-6, "constant_predictions"), (F.col("unique_values") < 10, "few_unique_values"),
        (F.col("std") < F.col("true_std") * 0.1, "low_variance"),
        (F.abs(F.col("mean") - F.col("true_mean")) > F.col("true_std"), "biased_mean"),
    ))


def correlation_history(epochs: DataFrame) -> DataFrame:
    """Correlation and prediction variance per epoch (epoch, y_true, y_pred), with alerts."""
    out = epochs.groupBy("symbol", "epoch").agg(
        F.coalesce(corr(T(), P()), F.lit(0.0)).alias("correlation"), F.var_pop(P()).alias("prediction_variance")
    )
    return out.withColumn("alert", F.when(F.abs("correlation") > 0.15, "leakage")
                          .when(F.col("prediction_variance") < 1e-6, "collapse").otherwise("none"))


def split_evaluation(parts: DataFrame) -> DataFrame:
    """Direction accuracy and counts of up and down moves per part."""
    return parts.groupBy("symbol", "part").agg(
        F.count(F.lit(1)).alias("n_samples"), match_rate(T(), P()).alias("direction_accuracy"),
        F.count_if(T() > 0).alias("true_up"), F.count_if(T() < 0).alias("true_down"),
        F.count_if(P() > 0).alias("pred_up"), F.count_if(P() < 0).alias("pred_down"),
    )


def metric_progression(history: DataFrame, metrics) -> DataFrame:
    """First, last, lowest, highest and improvement of each metric over the epochs."""
    long = history.select("symbol", "epoch", *metrics).unpivot(["symbol", "epoch"], list(metrics), "metric", "value")
    at = F.when(F.col("value").isNotNull(), F.col("epoch"))
    out = long.groupBy("symbol", "metric").agg(
        F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"),
        F.min("value").alias("lowest"), F.max("value").alias("highest"),
    )
    return out.withColumn("improvement", F.col("last_value") - F.col("first_value")).withColumn(
        "trend", F.when(F.col("last_value") > F.col("first_value"), "increasing").otherwise("decreasing")
    )


def walk_forward_scores(table: DataFrame, features, folds: DataFrame, estimator=None) -> DataFrame:
    """Fit on the train part of each fold over all symbols and score the test part.

    Linear fits come from one pass of sums per fold, their weights are joined to the test rows. Any Spark ML estimator can be given
    instead; it is then fitted once per fold.
    """
    features = list(features)
    ready = materialize(folds.join(table, ["symbol", "ts"]).dropna(subset=[*features, "y_true"]))
    if estimator is None:
        cells = products(ready.where("part = 'train'"), F.array(*features, "y_true"), ["fold"])
        models = fits(cells, list(range(1, len(features) + 1)), len(features) + 1)
        score = sum((F.col("weights")[k] * F.col(f) for k, f in enumerate(features)), F.col("intercept"))
        test = attach(ready.where("part = 'test'"), models, ["fold"], "inner")
        return pattern_metrics(test.select("symbol", "fold", "y_true", score.alias("y_pred")), ["fold"])
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(ready)
    numbers = [r.fold for r in ready.select("fold").distinct().orderBy("fold").collect()]  # one row per fold
    scored = []
    for k in numbers:
        part = vectors.where(F.col("fold") == k)
        scored.append(estimator.fit(part.where("part = 'train'")).transform(part.where("part = 'test'")).select("symbol", "fold", "y_true", "y_pred"))
    return pattern_metrics(reduce(DataFrame.unionByName, scored), ["fold"])
