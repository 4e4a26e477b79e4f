"""Feature selection with grouped statistics, sums of products and Spark ML.

Scores are one row per feature; only those small score lists reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..evaluate.significance import draw_hash
from ..functions.aggregates import corr
from ..operators.layout import attach_scalar
from .gram import elimination_path, filled, fold_errors, fold_products, lasso_path, products
from .splits import standard_folds

# Words that put a feature name into a category, first match wins.
CATEGORY_WORDS = {
    "price": ["price", "close", "open", "high", "low", "hl_", "oc_", "gap", "body", "shadow", "candle", "sma", "ema", "percentile"],
    "technical": ["rsi", "macd", "bb_", "bollinger", "williams", "stoch", "cci", "squeeze", "atr", "adx", "aroon"],
    "volume": ["volume", "vol_", "vwap", "obv", "mfi", "money_flow"],
    "momentum": ["momentum", "roc", "rate_of_change", "acceleration", "persistence", "strength"],
    "volatility": ["volatility", "vol_ratio", "garch", "clustering", "skew", "true_range", "atr"],
    "market": ["regime", "trend", "spy", "vix", "market", "sector", "correlation", "stress", "month", "day", "options", "expiry"],
}


def category(name):
    """Category of a feature-name column."""
    low = F.lower(name)
    out = None
    for label, words in CATEGORY_WORDS.items():
        hit = low.rlike("|".join(words))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("price")


def prepared(df: DataFrame, features, target: str) -> DataFrame:
    """Nulls as 0, one vector column."""
    filled = df.fillna(0.0, [*features, target])
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)


def f_scores(df: DataFrame, features, target: str) -> DataFrame:
    """Regression F value of each feature against the target."""
    features = list(features)
    y = F.coalesce(F.col(target), F.lit(0.0))
    row = df.agg(F.count(F.lit(1)).alias("n"), *[corr(F.coalesce(F.col(c), F.lit(0.0)), y).alias(c) for c in features])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in features]))
    r2 = F.col("r") * F.col("r")
    return row.select("n", cells.alias("s")).select("n", "s.*").select(
        "feature", F.coalesce(F.try_divide(r2, 1.0 - r2) * (F.col("n") - 2), F.lit(0.0)).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "feature").limit(k)


def _scores(df: DataFrame, features, values) -> DataFrame:
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, score double")


def forest_scores(df, features, target, trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    model = RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(prepared(df, features, target))
    return _scores(df, features, model.featureImportances.toArray())


def lasso_scores(df, features, target, grid=(0.0001, 0.001, 0.01, 0.1), folds: int = 5, seed: int = 42) -> DataFrame:
    """Absolute coefficients of the penalised fit with the best penalty.

    Folds are dealt by a hash of the row position. All folds and penalties come from one pass: see `gram.lasso_path`.
    """
    features = list(features)
    cells = products(df.withColumn("fold", draw_hash(seed, F.col("pos")) % folds), filled(features, target), ["fold"])
    inputs = list(range(1, len(features) + 1))
    path = lasso_path(cells, inputs, len(features) + 1, grid)
    best = path.agg(F.min_by("weights", F.struct("error", "penalty")).alias("w"))
    named = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("w").alias("score"))
    return best.select(F.inline(named)).select("feature", F.abs("score").alias("score")).where("score > 1e-6")


def subset_errors(df: DataFrame, subsets: dict, target: str, folds: int = 5) -> DataFrame:
    """(subset, error): mean squared error of the linear fit on each subset of features over the test parts of the time folds.

    One pass over the rows for all subsets and folds.
    """
    features = list(dict.fromkeys(f for names in subsets.values() for f in names))
    cells = fold_products(df, features, target, folds)
    places = {name: [features.index(f) + 1 for f in names] for name, names in subsets.items()}
    return fold_errors(cells, places, len(features) + 1).groupBy("subset").agg(F.avg("error").alias("error"))


def fold_error(df: DataFrame, features, target: str, estimator, folds: int = 5) -> float:
    """Mean squared error of any Spark ML estimator over the test parts of the time folds: one fit per fold."""
    split = standard_folds(df, folds).persist()
    errors = []
    for k in range(folds):
        train, test = (prepared(split.where((F.col("fold") == k) & (F.col("part") == p)), features, target) for p in ("train", "test"))
        scored = estimator.fit(train).transform(test)
        errors.append(RegressionEvaluator(labelCol=target, metricName="mse").evaluate(scored))
    split.unpersist()
    return sum(errors) / len(errors)


def elimination_scores(df, features, target, folds: int = 3, trees: int = 50, depth: int = 5, seed: int = 42) -> DataFrame:
    """Drop the weakest feature again and again; keep the set with the lowest fold error.

    All features are scored: each by the round in which it went (later is better), plus the number of features where it belongs
    to the kept set, so kept features stand before all others and the last survivor first.
    """
    left, best, kept, gone = list(features), None, list(features), {}
    forest = RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, seed=seed)
    while left:
        error = fold_error(df, left, target, forest, folds)
        if best is None or error < best:
            best, kept = error, list(left)
        if len(left) == 1:
            break
        importances = forest.fit(prepared(df, left, target)).featureImportances.toArray()
        weakest = min(zip(left, importances), key=lambda p: (p[1], p[0]))[0]
        gone[weakest] = len(gone) + 1
        left.remove(weakest)
    gone.update((name, len(gone) + 1) for name in left)
    features = list(features)
    return _scores(df, features, [gone[f] + (len(features) if f in kept else 0) for f in features])


def linear_elimination(df, features, target, folds: int = 3) -> DataFrame:
    """`elimination_scores` with linear fits: the weakest is the smallest weight in units of its deviation.

    All fits of all rounds and folds are solved from one pass of sums.
    """
    features = list(features)
    cells = fold_products(df, features, target, folds)
    whole = products(df, filled(features, target))
    path = elimination_path(cells, whole, list(range(1, len(features) + 1)), len(features) + 1)
    best = path.agg(F.min_by("place", F.struct("error", "place")).alias("_best"))
    kept = F.when(F.col("place") >= F.col("_best"), len(features)).otherwise(0)
    names = F.array(*[F.lit(f) for f in features])
    return attach_scalar(path, best).select(F.element_at(names, F.col("input")).alias("feature"), (F.col("place") + kept).cast("double").alias("score"))


def single_scores(df, features, target, folds: int = 5, estimator=None) -> DataFrame:
    """Negative fold error of each feature alone; linear fits unless an estimator is given."""
    if estimator is None:
        return subset_errors(df, {f: [f] for f in features}, target, folds).select(F.col("subset").alias("feature"), (-F.col("error")).alias("score"))
    return _scores(df, features, [-fold_error(df, [c], target, estimator, folds) for c in features])


def vote(selections: dict[str, DataFrame], k: int) -> DataFrame:
    """Features that half of the methods chose, then the others by votes."""
    rows = reduce(DataFrame.unionByName, [s.select("feature", F.lit(m).alias("method")) for m, s in selections.items()])
    votes = rows.groupBy("feature").agg(F.count_distinct("method").alias("votes"))
    enough = F.col("votes") >= max(1, len(selections) // 2)
    return votes.withColumn("score", F.col("votes") + F.when(enough, len(selections)).otherwise(0)).orderBy(
        F.desc("score"), "feature").limit(k)


METHODS = {"statistical": f_scores, "rf": forest_scores, "lasso": lasso_scores, "rfe": elimination_scores, "rfe_linear": linear_elimination, "cv": single_scores}


def select(df: DataFrame, features, target: str, k: int = 50, method: str = "ensemble", **options) -> DataFrame:
    """Selection by method name, the one asked for whatever the number of rows."""
    features = [f for f in features if f in df.columns and f != target]
    if method == "ensemble":
        parts = {m: top(METHODS[m](df, features, target, **options.get(m, {})), k * 2) for m in ("rf", "lasso", "rfe", "statistical")}
        return vote(parts, k)
    return top(METHODS[method](df, features, target, **options.get(method, {})), k)


def by_category(scores: DataFrame, per_category: int) -> DataFrame:
    """The best features of each name category (a window over the list of features)."""
    from pyspark.sql import Window as W

    order = W.partitionBy("category").orderBy(F.desc("score"), "feature")
    return scores.withColumn("category", category(F.col("feature"))).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= per_category)


def importance_summary(scores: DataFrame, selected: DataFrame) -> DataFrame:
    chosen = selected.select("feature").distinct().withColumn("selected", F.lit(True))
    return scores.withColumn("category", category(F.col("feature"))).join(chosen, "feature", "left").fillna(False, ["selected"])


def compare_methods(df: DataFrame, chosen: dict, target: str, estimator=None, folds: int = 5) -> DataFrame:
    """Fold error of each method's features, best first (chosen: method -> feature names); linear fits unless an estimator is given."""
    rows = [(m, len(names)) for m, names in chosen.items()]
    if estimator is None:
        sizes = F.create_map(*[F.lit(v) for row in rows for v in row])
        errors = subset_errors(df, chosen, target, folds)
        return errors.select(F.col("subset").alias("method"), sizes[F.col("subset")].alias("n_features"), "error").orderBy("error")
    rows = [(m, n, fold_error(df, chosen[m], target, estimator, folds)) for m, n in rows]
    return df.sparkSession.createDataFrame(rows, "method string, n_features int, error double").orderBy("error")


def feature_summary(df: DataFrame, groups: dict) -> DataFrame:
    """Rows, missing cells and date range per symbol, and how many features of each group exist."""
    numeric = [n for n, t in df.dtypes if t == "double"]
    missing = reduce(lambda a, b: a + b, [F.sum(F.col(c).isNull().cast("long")) for c in numeric])
    found = {g: sum(c in df.columns for c in names) for g, names in groups.items()}
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sample_size"), F.lit(len(numeric)).alias("numeric_features"), missing.alias("missing_cells"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *[F.lit(n).alias(f"{g}_features") for g, n in found.items()])
