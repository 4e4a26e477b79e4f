"""Time-ordered folds and splits.

Fold limits depend on the row count of a symbol only, so each row works out its
own folds from that count: no range join and no fold table to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import flag
from ..operators.layout import attach

GAP_DAYS_PER_MONTH = 30


def sized(df: DataFrame) -> DataFrame:
    sizes = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))
    return attach(df, sizes, ["symbol"])


def _expand(df: DataFrame, folds) -> DataFrame:
    """Rows by (fold, part); folds is a column: array of train_start..test_end structs."""
    pos = F.col("pos")
    numbered = F.transform(folds, lambda x, i: F.struct(i.alias("fold"), x.alias("x")))
    parts = F.transform(
        numbered,
        lambda s: F.struct(
            s.fold.alias("fold"),
            F.when((pos >= s.x.train_start) & (pos < s.x.train_end), F.lit("train"))
            .when((pos >= s.x.test_start) & (pos < s.x.test_end), F.lit("test")).alias("part"),
        ),
    )
    hit = F.explode(F.filter(parts, lambda s: s.part.isNotNull()))
    keep = [c for c in df.columns]
    return df.withColumn("_f", hit).select(*keep, F.col("_f.fold").alias("fold"), F.col("_f.part").alias("part"))


def _limits(train_start, train_end, test_start, test_end):
    return F.struct(
        train_start.cast("long").alias("train_start"), train_end.cast("long").alias("train_end"),
        test_start.cast("long").alias("test_start"), test_end.cast("long").alias("test_end"),
    )


def gapped_folds(df: DataFrame, n_splits: int = 5, test_size: float = 0.2, gap: int = 10, expanding: bool = True) -> DataFrame:
    """Folds built back from the end with a gap before each test part, oldest first."""
    n = F.col("n_rows")
    size = F.floor(n * F.lit(test_size))
    made = []
    for i in reversed(range(n_splits)):
        test_end = n - i * (size + gap)
        test_start = test_end - size
        train_end = test_start - gap
        train_start = F.lit(0) if expanding else F.greatest(train_end - size * 2, F.lit(0))
        ok = (train_start < train_end) & (train_end < test_start) & (test_start < test_end)
        made.append(F.when(ok, _limits(train_start, train_end, test_start, test_end)))
    folds = F.filter(F.array(*made), lambda v: v.isNotNull())
    return _expand(sized(df), folds)


def walk_forward_folds(df: DataFrame, retrain: int = 60, min_train: int = 252, test: int = 20) -> DataFrame:
    """Expanding train parts from a minimum size, one test part per retrain step."""
    n = F.col("n_rows")
    last = F.floor((n - test - min_train) / retrain)
    starts = F.when(n >= min_train + test, F.sequence(F.lit(0).cast("long"), last.cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )
    folds = F.transform(
        starts,
        lambda k: _limits(F.lit(0), k * retrain + min_train, k * retrain + min_train,
                          F.least(k * retrain + min_train + test, n)),
    )
    return _expand(sized(df), folds)


def expanding_folds(df: DataFrame, n_folds: int = 3) -> DataFrame:
    """n // (k + 1) rows per test part, everything before as train part."""
    n = F.col("n_rows")
    size = F.floor(n / (n_folds + 1))
    folds = F.array(*[
        _limits(F.lit(0), n - (n_folds - k) * size, n - (n_folds - k) * size, n - (n_folds - k - 1) * size)
        for k in range(n_folds)
    ])
    return _expand(sized(df), folds)


def standard_folds(df: DataFrame, n_splits: int = 5, test_ratio: float = 0.15) -> DataFrame:
    """Equal test parts at the end of the series, everything before as train part."""
    n = F.col("n_rows")
    size = F.floor(n * F.lit(test_ratio))
    folds = F.array(*[
        _limits(F.lit(0), n - (n_splits - k) * size, n - (n_splits - k) * size, n - (n_splits - k - 1) * size)
        for k in range(n_splits)
    ])
    return _expand(sized(df), folds)


def fold_dates(folds: DataFrame) -> DataFrame:
    """First and last time and size of each part, with the gap in days."""
    cell = lambda part, agg: agg(F.when(F.col("part") == part, F.col("ts")))
    return folds.groupBy("symbol", "fold").agg(
        cell("train", F.min).alias("train_start"), cell("train", F.max).alias("train_end"),
        cell("test", F.min).alias("test_start"), cell("test", F.max).alias("test_end"),
        F.count_if(F.col("part") == "train").alias("train_size"),
        F.count_if(F.col("part") == "test").alias("test_size"),
    ).withColumn("gap_days", F.datediff("test_start", "train_end"))


def fold_leaks(folds: DataFrame, gap_days: int) -> DataFrame:
    """A fold is clean when its train part ends before the test part by the gap."""
    dates = fold_dates(folds)
    ok = (F.col("train_end") < F.col("test_start")) & (F.col("gap_days") >= gap_days)
    return dates.select("symbol", "fold", "gap_days", F.coalesce(ok, F.lit(False)).alias("no_leak"))


def retrain_flags(history: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Retrain when a score falls below 90% of the mean of the three before it."""
    from ..plans.registry import Registry

    reg = Registry()
    reg.add("retrain", _recent=lambda f: f.agg(F.avg("score"), "score", -3, -1),
            retrain=lambda f: flag(f["score"] < f["_recent"] * (1 - threshold)))
    return reg.compute(history, ["retrain"], keep=["score"])


def gap_split(df: DataFrame, gap_months: int = 6, train_ratio: float = 0.8, min_test: int = 30) -> DataFrame:
    """Train, gap and test rows per symbol; symbols without enough rows are marked."""
    gap = gap_months * GAP_DAYS_PER_MONTH
    n = F.col("n_rows")
    train_end = F.floor(n * F.lit(train_ratio))
    test_start = F.least(train_end + gap, n)
    part = (
        F.when(test_start >= n - min_test, F.lit("insufficient"))
        .when(F.col("pos") < train_end, F.lit("train"))
        .when(F.col("pos") < test_start, F.lit("gap"))
        .otherwise(F.lit("test"))
    )
    return sized(df).withColumn("part", part)


def split_integrity(parts: DataFrame, gap_days: int) -> DataFrame:
    """Gap of at least 80% of the wanted days and no shared dates, per symbol."""
    cell = lambda part, agg: agg(F.when(F.col("part") == part, F.col("ts")))
    out = parts.groupBy("symbol").agg(
        cell("train", F.max).alias("train_last"), cell("test", F.min).alias("test_first"),
        F.count_if(F.col("part") == "train").alias("train_samples"),
        F.count_if(F.col("part") == "test").alias("test_samples"),
    )
    actual = F.datediff("test_first", "train_last")
    return out.withColumn("actual_gap", actual).withColumn(
        "valid", F.coalesce((actual >= gap_days * 0.8) & (F.col("train_last") < F.col("test_first")), F.lit(False))
    )


def shared_dates(parts: DataFrame) -> DataFrame:
    """Dates that occur in both the train and the test part of a symbol."""
    pick = lambda p: parts.where(F.col("part") == p).select("symbol", "ts")
    return pick("train").intersect(pick("test"))


def ratio_split(df: DataFrame, parts=(("train", 0.7), ("validation", 0.15), ("test", 0.15))) -> DataFrame:
    """Parts by order inside each symbol; the last part takes the rest."""
    n, done, out = F.col("n_rows"), 0.0, None
    for name, share in parts[:-1]:
        done += share
        cond = F.col("pos") < F.floor(n * F.lit(round(done, 10)))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return sized(df).withColumn("part", out.otherwise(F.lit(parts[-1][0])))


def chronological_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    return ratio_split(df, (("train", share), ("validation", 1 - share)))
