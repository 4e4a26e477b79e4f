"""Statistical tests by resampling, and series statistics.

Draws come from an integer hash of (seed, draw, position), so a result does not
depend on partitioning or on retries, and any engine can repeat it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.aggregates import corr, match_rate
from ..operators.layout import attach, looked_up, with_positions
from ..operators.order_stats import average_ranks, exact_quantiles
from ..plans.registry import Registry
from ..session import materialize

PRIME = 2147483647


def draw_hash(seed: int, *parts) -> Column:
    """Uniform integer in [0, PRIME) from a seed and integer columns."""
    h = F.lit(seed % PRIME).cast("long")
    for k, part in enumerate(parts):
        h = (h * 48271 + part.cast("long") * (69621 + 2 * k) + 12345) % PRIME
        h = (h * h + 6789) % PRIME
        h = (h * 39373 + 1) % PRIME
        h = (h * h + 97) % PRIME
    return h


def numbered(predictions: DataFrame, columns=("y_true", "y_pred")) -> DataFrame:
    return with_positions(predictions.select("symbol", "ts", *columns), "year")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Few rows that are about to become many, over all tasks."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *by)


# -- moving block bootstrap ----------------------------------------------------
@dataclass(frozen=True)
class BlockMetric:
    """A metric made of sums over rows: terms of one row (return, prediction), and the value from their sums and the row count."""

    terms: Callable[[Column, Column], list[Column]]
    value: Callable[[list[Column], Column], Column]

    def over(self, r, p) -> Column:
        """The metric as an aggregate over plain rows."""
        return self.value([F.sum(t) for t in self.terms(r, p)], F.count(F.lit(1)))


def _sharpe(sums, n):
    mean = sums[0] / n
    sd = F.sqrt(F.greatest(sums[1] / n - mean * mean, F.lit(0.0)))
    return F.coalesce(F.try_divide(mean, F.when(sd > 0, sd)) * (252.0**0.5), F.lit(0.0))


def _traded(r, p):
    return F.when(p > 0, r).when(p < 0, -r).otherwise(0.0)


direction_metric = BlockMetric(lambda r, p: [F.when(F.signum(r) == F.signum(p), 1.0).otherwise(0.0)], lambda sums, n: sums[0] / n)
sharpe_metric = BlockMetric(lambda r, p: [_traded(r, p), _traded(r, p) * _traded(r, p)], _sharpe)


def block_draws(table: DataFrame, draws: int = 1000, block: int = 5, seed: int = 42, metric: BlockMetric = direction_metric) -> DataFrame:
    """Metric of each resample. Returns and predictions draw their blocks independently.

    Blocks are short arrays built by one window. Each pick looks its two blocks up by (symbol, start) and adds the metric's terms over
    them in place: a pick is one row, a draw never gathers a series, and rows are not multiplied by the block length.
    """
    reg = Registry()

    def part(name):
        return lambda f: f.window_list(name, 0, block - 1)

    reg.add("b", _r=part("y_true"), _p=part("y_pred"))
    blocks = materialize(reg.compute(table, ["_r", "_p"]))
    sizes = table.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= block)
    count = F.col("_n") - block + 1
    drawn = dealt(sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))), "symbol", "draw")
    picks = (
        drawn.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / block) - 1)))
        .withColumn("_a", draw_hash(seed, F.col("draw"), F.col("_k")) % count)
        .withColumn("_b", draw_hash(seed + 1, F.col("draw"), F.col("_k")) % count)
    )
    left = blocks.select("symbol", F.col("pos").alias("_a"), "_r")
    right = blocks.select("symbol", F.col("pos").alias("_b"), "_p")
    joined = looked_up(looked_up(picks, left, ["symbol", "_a"]), right, ["symbol", "_b"])
    taken = F.least(F.lit(block).cast("long"), F.col("_n") - F.col("_k") * block)
    rows = [metric.terms(F.col("_r")[k], F.col("_p")[k]) for k in range(block)]
    sums = [sum((F.when(taken > k, row[t]).otherwise(0.0) for k, row in enumerate(rows)), F.lit(0.0)) for t in range(len(rows[0]))]
    out = joined.groupBy("symbol", "draw").agg(F.sum(taken).alias("_n"), *[F.sum(x).alias(f"_s{t}") for t, x in enumerate(sums)])
    return out.select("symbol", "draw", metric.value([F.col(f"_s{t}") for t in range(len(sums))], F.col("_n")).alias("value"))


def _null_summary(draws: DataFrame, actual: DataFrame) -> DataFrame:
    draws = materialize(draws)  # one value per draw, read for the quantiles and for the summary
    cut = exact_quantiles(draws, ["symbol"], "value", {"ci_lower": 0.025, "ci_upper": 0.975})
    joined = attach(draws, actual, ["symbol"])
    out = joined.groupBy("symbol").agg(
        F.max("actual").alias("actual_performance"), F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_std"),
        F.avg((F.col("value") >= F.col("actual")).cast("double")).alias("p_value"), F.count(F.lit(1)).alias("draws"),
    ).join(cut, "symbol")
    z = F.try_divide(F.col("actual_performance") - F.col("null_mean"), F.when(F.col("null_std") > 0, F.col("null_std")))
    return out.withColumn("test_statistic", z).withColumn("significant", F.col("p_value") < 0.05)


def block_bootstrap(predictions: DataFrame, draws: int = 1000, block: int = 5, seed: int = 42, metric: BlockMetric = direction_metric) -> DataFrame:
    table = materialize(numbered(predictions))
    actual = table.groupBy("symbol").agg(metric.over(F.col("y_true"), F.col("y_pred")).alias("actual"))
    return _null_summary(block_draws(table, draws, block, seed, metric), actual)


# -- permutations ----------------------------------------------------------------
SHUFFLE_ROWS = 4096


def _ranked_by_hash(df: DataFrame, keys, h: Column, name: str) -> DataFrame:
    """0-based rank of the hash inside each group, through hash ranges of bounded size."""
    keys = list(keys)
    ranges = F.greatest(F.ceil(F.col("_m") / SHUFFLE_ROWS), F.lit(1))
    cut = df.withColumn("_h", h).withColumn("_z", F.floor(F.col("_h") * ranges / PRIME))
    sizes = cut.groupBy(*keys, "_z").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*keys).orderBy("_z").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_z", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = W.partitionBy(*keys, "_z").orderBy("_h", "pos")
    return (
        cut.withColumn("_i", F.row_number().over(inside) - 1).join(shift, keys + ["_z"])
        .withColumn(name, F.col("_i") + F.col("_o")).drop("_i", "_o", "_z", "_h")
    )


ROUNDS = 16


def _number_hash():
    """`draw_hash` for numpy arrays and Python integers; nested, so that it travels with the task."""
    prime = PRIME

    def number_hash(seed, *parts):
        h = seed % prime
        for k, part in enumerate(parts):
            h = (h * 48271 + part * (69621 + 2 * k) + 12345) % prime
            h = (h * h + 6789) % prime
            h = (h * 39373 + 1) % prime
            h = (h * h + 97) % prime
        return h

    return number_hash


def shuffler(seed: int):
    """A function (slots, size, draw) -> slots: the shuffle of 0 .. size - 1 that a draw stands for, by arithmetic alone.

    Every round pairs x with (mirror - x) mod size and swaps the two or not by a coin tossed for the pair, which is a bijection for any
    size; the coins of a round are pairwise independent.
    """
    number_hash, prime, rounds = _number_hash(), PRIME, ROUNDS

    def shuffled(x, size, draw):
        import numpy as np

        for r in range(rounds):
            mirror, a, b = number_hash(seed + 1, draw, r), number_hash(seed + 2, draw, r) % (prime - 1) + 1, number_hash(seed + 3, draw, r)
            y = (mirror - x) % size
            x = np.where((a * (np.maximum(x, y) % prime) + b) % prime * 2 < prime, y, x)
        return x

    return shuffled


def shuffled_pairs(table: DataFrame, draws: int, seed: int, by=("symbol",)) -> DataFrame:
    """Truths of each draw shuffled inside the groups, next to the predictions in place.

    table: symbol, pos, the group columns, y_true and y_pred. Rows get a slot in their group once; every draw computes where each
    truth goes and looks the prediction there up. Drawn rows are neither sorted nor ranked.
    """
    by = list(by)
    sized = attach(table, table.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")), by)
    slots = materialize(_ranked_by_hash(sized, by, draw_hash(seed, F.col("pos")), "_slot").withColumn("_slot", F.col("_slot").cast("long")))
    shuffled, width = shuffler(seed), len(by)

    def draw(batches):
        """Every row once per draw, with the slot of the prediction that it meets."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            slot, size = (batch.column(width + k).to_numpy() for k in (0, 1))
            for k in range(draws):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:width], pa.array(np.full(batch.num_rows, k, np.int64)), pa.array(shuffled(slot, size, k)), batch.column(width + 2)], names=names)

    few = dealt(slots.select(*by, "_slot", "_m", "y_true"))
    schema = StructType([*few.schema.fields[:width], StructField("draw", LongType()), few.schema["_slot"], few.schema["y_true"]])
    names = schema.names
    return looked_up(few.mapInArrow(draw, schema), slots.select(*by, "_slot", "y_pred"), by + ["_slot"])


def volatility_bins(table: DataFrame, bins: int = 5) -> DataFrame:
    """Quantile bin of the absolute truth; equal edges merge."""
    sized = table.withColumn("_a", F.abs("y_true"))
    names = {f"_e{i}": i / bins for i in range(1, bins)}
    edges = exact_quantiles(sized, ["symbol"], "_a", names)
    joined = attach(sized, edges, ["symbol"])
    above = F.size(F.filter(F.array_distinct(F.array(*names)), lambda e: e < F.col("_a")))
    return joined.withColumn("bin", above).drop("_a", *names)


def conditional_permutation(predictions: DataFrame, draws: int = 1000, bins: int = 5, seed: int = 42) -> DataFrame:
    """Direction accuracy against shuffles inside volatility bins."""
    table = materialize(volatility_bins(numbered(predictions), bins))
    actual = table.groupBy("symbol").agg(match_rate("y_true", "y_pred").alias("actual"), F.count_distinct("bin").alias("bins_used"))
    pairs = shuffled_pairs(table.select("symbol", "bin", "pos", "y_true", "y_pred"), draws, seed, ["symbol", "bin"])
    null = pairs.groupBy("symbol", "draw").agg(match_rate("y_true", "y_pred").alias("value"))
    return _null_summary(null, actual.select("symbol", "actual")).join(actual.select("symbol", "bins_used"), "symbol")


def correlation_permutation(predictions: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Absolute correlation against full shuffles."""
    table = materialize(numbered(predictions))
    actual = table.groupBy("symbol").agg(F.coalesce(F.abs(corr("y_true", "y_pred")), F.lit(0.0)).alias("actual"))
    pairs = shuffled_pairs(table.select("symbol", "pos", "y_true", "y_pred"), draws, seed)
    null = pairs.groupBy("symbol", "draw").agg(F.abs(corr("y_true", "y_pred")).alias("value"))
    return _null_summary(null, actual)


def significance(predictions: DataFrame, draws: int = 1000, block: int = 5, seed: int = 42) -> DataFrame:
    """Both tests, and PASS when every p-value is under 0.05."""
    a = block_bootstrap(predictions, draws, block, seed).select("symbol", F.col("p_value").alias("bootstrap_p"))
    b = conditional_permutation(predictions, draws, 5, seed).select("symbol", F.col("p_value").alias("permutation_p"))
    both = (F.col("bootstrap_p") < 0.05) & (F.col("permutation_p") < 0.05)
    return a.join(b, "symbol").withColumn("recommendation", F.when(both, "PASS").otherwise("FAIL"))


def correlation_tests(predictions: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Pearson and rank correlation; the p-value comes from the permutation test."""
    out = rank_correlation(predictions)
    return out.join(correlation_permutation(predictions, draws, seed).select("symbol", "p_value"), "symbol")


def rank_correlation(predictions: DataFrame) -> DataFrame:
    ranked = average_ranks(average_ranks(predictions, ["symbol"], "y_true", "_rt"), ["symbol"], "y_pred", "_rp")
    return ranked.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_samples"), corr("y_true", "y_pred").alias("pearson"), corr("_rt", "_rp").alias("spearman"))


# -- series statistics ------------------------------------------------------------
def autocorrelation(df: DataFrame, column: str, lags=20) -> DataFrame:
    """Lag products over the variance around the series mean, per symbol and lag."""
    means = df.groupBy("symbol").agg(F.avg(column).alias("_mean"))
    table = attach(df.where(F.col(column).isNotNull()), means, ["symbol"]).withColumn("_d", F.col(column) - F.col("_mean"))
    reg = Registry()
    names = []
    for k in range(1, lags + 1):
        names.append(f"_p{k}")
        reg.add("acf", **{f"_p{k}": lambda f, k=k: f["_d"] * f.lag("_d", k)})
    out = reg.compute(table, names, keep=["_d"]).groupBy("symbol").agg(
        F.sum(F.col("_d") * F.col("_d")).alias("_v"), *[F.sum(n).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_p{k}"), F.when(F.col("_v") > 0, F.col("_v"))).alias("acf"))
                     for k in range(1, lags + 1)])
    return out.select("symbol", F.explode(rows).alias("r")).select("symbol", "r.*")


def temporal_persistence(df: DataFrame, column: str, lags: int = 20) -> DataFrame:
    a = autocorrelation(df, column, lags)
    return a.groupBy("symbol").agg(
        F.max(F.when(F.col("lag") == 1, F.col("acf"))).alias("lag1"), F.max(F.when(F.col("lag") == 5, F.col("acf"))).alias("lag5"),
        F.count_if(F.abs("acf") > 0.1).alias("significant_lags"))


def label(value, great, good):
    return F.when(value < great, "great").when(value < good, "good").otherwise("poor")


def acf_preservation(df: DataFrame, a: str, b: str, lags: int = 20, tolerance: float = 0.1) -> DataFrame:
    """Mean and largest difference of two autocorrelation functions."""
    x = autocorrelation(df, a, lags).withColumnRenamed("acf", "_a")
    y = autocorrelation(df, b, lags).withColumnRenamed("acf", "_b")
    gap = F.abs(F.col("_a") - F.col("_b"))
    out = x.join(y, ["symbol", "lag"]).groupBy("symbol").agg(F.avg(gap).alias("avg_difference"), F.max(gap).alias("max_difference"))
    return out.withColumn("preserved", F.col("avg_difference") < tolerance).withColumn(
        "interpretation", label(F.col("avg_difference"), tolerance * 0.5, tolerance))


def direction_aggregates(where=None, tag="direction") -> list[Column]:
    """The counts that the direction rule with zero returns needs."""
    ok = F.lit(True) if where is None else where
    t, p = F.when(ok, F.col("y_true")), F.when(ok, F.col("y_pred"))
    same = F.signum(t) == F.signum(p)
    return [
        F.count(t).alias(f"{tag}_n"), F.min(F.signum(p)).alias(f"{tag}_lo"), F.max(F.signum(p)).alias(f"{tag}_hi"),
        F.avg(F.when(t.isNotNull(), F.when(same, 1.0).otherwise(0.0))).alias(f"{tag}_all"),
        F.avg(F.when(t != 0, F.when(same, 1.0).otherwise(0.0))).alias(f"{tag}_nz"),
    ]


def direction_value(tag="direction") -> Column:
    """Zero returns are left out; a constant sign is compared with all rows."""
    lo, hi = F.col(f"{tag}_lo"), F.col(f"{tag}_hi")
    return (
        F.when(F.col(f"{tag}_n") == 0, 0.0).when((lo == hi) & (lo == 0), 0.0).when(lo == hi, F.col(f"{tag}_all"))
        .otherwise(F.coalesce(F.col(f"{tag}_nz"), F.lit(0.5)))
    )


def direction_accuracy(predictions: DataFrame) -> DataFrame:
    out = predictions.groupBy("symbol").agg(*direction_aggregates())
    return out.select("symbol", direction_value().alias("direction_accuracy"))


def regime_transition(predictions: DataFrame, max_drop: float = 0.3) -> DataFrame:
    """Accuracy drop between stable (0) and transition (1) rows of a ``regime`` column."""
    out = predictions.groupBy("symbol").agg(
        *direction_aggregates(F.col("regime") == 0, "stable"), *direction_aggregates(F.col("regime") == 1, "moving"))
    out = out.withColumn("stable_accuracy", direction_value("stable")).withColumn("transition_accuracy", direction_value("moving"))
    drop = F.when(F.col("stable_accuracy") > 0, F.try_divide(F.col("stable_accuracy") - F.col("transition_accuracy"), F.col("stable_accuracy"))).otherwise(1.0)
    enough = (F.col("stable_n") > 0) & (F.col("moving_n") > 0)
    return out.select(
        "symbol", F.col("stable_n").alias("stable_samples"), F.col("moving_n").alias("transition_samples"), "stable_accuracy",
        "transition_accuracy", drop.alias("degradation"),
        F.when(~enough, "INSUFFICIENT_DATA").when(drop <= max_drop, "PASS").otherwise("FAIL").alias("validation"),
        label(drop, max_drop * 0.5, max_drop).alias("interpretation"))


def stress_test(predictions: DataFrame, min_accuracy: float = 0.45) -> DataFrame:
    """Accuracy on the fifth of rows with the highest 20-row volatility."""
    reg = Registry()
    reg.add("v", _vol=lambda f: f.std("y_true", 20, 10))
    table = materialize(reg.compute(numbered(predictions), ["_vol"], keep=["y_true", "y_pred"]).where(F.col("_vol").isNotNull()))
    table = attach(table, exact_quantiles(table, ["symbol"], "_vol", {"threshold": 0.8}), ["symbol"])
    hot = F.col("_vol") > F.col("threshold")
    out = table.groupBy("symbol").agg(F.max("threshold").alias("volatility_threshold"),
                                      *direction_aggregates(hot, "hot"), *direction_aggregates(~hot, "calm"))
    out = out.withColumn("stress_accuracy", direction_value("hot")).withColumn("normal_accuracy", direction_value("calm"))
    s = F.col("stress_accuracy")
    return out.select(
        "symbol", "volatility_threshold", F.col("hot_n").alias("stress_periods"), F.col("calm_n").alias("normal_periods"),
        "stress_accuracy", "normal_accuracy",
        F.when(F.col("hot_n") == 0, "NO_STRESS_PERIODS").when(s >= min_accuracy, "PASS").otherwise("FAIL").alias("validation"),
        F.when(s >= min_accuracy + 0.1, "excellent").when(s >= min_accuracy, "acceptable").otherwise("poor").alias("interpretation"))


def robustness(predictions: DataFrame) -> DataFrame:
    """Regime and stress tests together (predictions carry a ``regime`` column)."""
    a = regime_transition(predictions).select("symbol", F.col("validation").alias("regime_result"))
    b = stress_test(predictions).select("symbol", F.col("validation").alias("stress_result"))
    ok = (F.col("regime_result") == "PASS") & (F.col("stress_result") == "PASS")
    return a.join(b, "symbol").withColumn("recommendation", F.when(ok, "PASS").otherwise("INVESTIGATE"))


def corrected_p_values(tests: DataFrame, by=(), alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg and Bonferroni corrections of (test, p_value) rows.

    Works on the list of tests, which has one row per test and group.
    """
    by = list(by)
    order = W.partitionBy(*(by or [F.lit(0)])).orderBy("p_value", "test")
    everything = W.partitionBy(*(by or [F.lit(0)]))
    ranked = tests.withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(everything))
    raw = F.col("p_value") * F.col("_n") / F.col("_k")
    tail = order.rowsBetween(0, W.unboundedFollowing)
    return ranked.withColumn("_raw", raw).select(
        *by, "test", "p_value", F.least(F.min("_raw").over(tail), F.lit(1.0)).alias("fdr_p"),
        F.least(F.col("p_value") * F.col("_n"), F.lit(1.0)).alias("bonferroni_p")
    ).withColumn("rejected", F.col("fdr_p") <= alpha)


def effective_tests(df: DataFrame, columns, limit: float = 0.1, alpha: float = 0.05) -> DataFrame:
    """Eigenvalues of the correlation matrix above a limit count as tests.

    Spark computes the correlations; the matrix has one cell per pair of columns
    and its eigenvalues are taken on the driver.
    """
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[F.coalesce(corr(a, b), F.lit(0.0)).alias(f"{a}|{b}") for a, b in pairs]).first()
    matrix = np.eye(len(columns))
    for a, b in pairs:
        i, j = columns.index(a), columns.index(b)
        matrix[i, j] = matrix[j, i] = row[f"{a}|{b}"]
    count = int((np.linalg.eigvalsh(matrix) > limit).sum())
    return df.sparkSession.createDataFrame(
        [(len(columns), count, alpha / count, count / len(columns))],
        "original_n_tests int, effective_n_tests int, adjusted_alpha double, adjustment_factor double")


def nonlinearity(df: DataFrame, column: str) -> DataFrame:
    """Share of the linear fit's error that a quadratic fit removes, per symbol.

    With the row index centred, 1, t and t^2 - mean(t^2) are orthogonal, so
    sums are enough and nothing is fitted row by row.
    """
    known = df.where(F.col(column).isNotNull())
    span = known.groupBy("symbol").agg(F.min("pos").alias("_p0"), F.count(F.lit(1)).alias("_n"), F.avg(column).alias("_m"))
    table = attach(known, span, ["symbol"])
    t = (F.col("pos") - F.col("_p0")) - (F.col("_n") - 1) / 2.0
    y = F.col(column) - F.col("_m")
    n = F.col("_n").cast("double")
    q = t * t - (n * n - 1) / 12.0
    out = table.groupBy("symbol").agg(
        F.max("_n").alias("n_rows"), F.sum(y * y).alias("_yy"), F.sum(t * y).alias("_ty"), F.sum(t * t).alias("_tt"),
        F.sum(q * y).alias("_qy"), F.sum(q * q).alias("_qq"))
    linear = F.col("_yy") - F.try_divide(F.col("_ty") * F.col("_ty"), F.col("_tt"))
    gain = F.try_divide(F.col("_qy") * F.col("_qy"), F.col("_qq"))
    score = F.when(F.col("n_rows") > 20, F.greatest(F.coalesce(F.try_divide(gain, F.when(linear > 0, linear)), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return out.select("symbol", "n_rows", score.alias("nonlinearity_score"))
