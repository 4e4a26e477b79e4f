"""Leakage checks between features, targets, windows and training history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.aggregates import corr
from ..plans.registry import Registry
from .significance import PRIME, draw_hash


def severity(x, warn: float = 0.10, critical: float = 0.15):
    return F.when(F.abs(x) > critical, "CRITICAL").when(F.abs(x) > warn, "WARNING").otherwise("NORMAL")


def feature_target(df: DataFrame, features, target: str, warn: float = 0.10, critical: float = 0.15, by=("symbol",), least: int = 10) -> DataFrame:
    """Correlation of every feature with the target: all in one aggregate, then one row each.

    Features with fewer than ``least`` known pairs have no row, as the definition has it.
    """
    features = list(features)
    wide = df.groupBy(*by).agg(
        *[F.coalesce(corr(c, target, 1e-5), F.lit(0.0)).alias(f"_c_{c}") for c in features],
        *[F.count_if(F.col(c).isNotNull() & F.col(target).isNotNull()).alias(f"_n_{c}") for c in features])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_c_{c}").alias("correlation"), F.col(f"_n_{c}").alias("valid_samples")) for c in features
    ]))
    out = wide.select(*by, rows.alias("r")).select(*by, "r.*").where(F.col("valid_samples") >= least)
    return out.withColumn("severity", severity(F.col("correlation"), warn, critical)).withColumn(
        "suspicious", F.abs("correlation") > warn)


def leakage_summary(results: DataFrame, by=("symbol",)) -> DataFrame:
    a = F.abs("correlation")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("features_checked"), F.count_if("suspicious").alias("suspicious_features"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_features"), F.max(a).alias("max_correlation"),
        F.avg(a).alias("mean_correlation"), F.max_by("feature", F.struct(a, "feature")).alias("worst_feature"),
        F.bool_or("suspicious").alias("leakage_detected"))


def window_overlap(windows: DataFrame, target: str, length: int, stride: int) -> DataFrame:
    """Overlap, correlation of windows ``stride`` apart, target autocorrelation and risk.

    windows: symbol, start, window, target. Each window is compared cell by cell
    with the one ``stride`` numbers later, joined on that number.
    """
    overlap = (length - stride) / length * 100.0
    numbered = windows.withColumn("_k", (F.col("start") / stride).cast("long"))
    flat = numbered.select("symbol", "_k", F.flatten("window").alias("_cells"))
    later = flat.select("symbol", (F.col("_k") - stride).alias("_k"), F.col("_cells").alias("_other"))
    cells = flat.join(later, ["symbol", "_k"]).select("symbol", "_k", F.explode(F.arrays_zip("_cells", "_other")).alias("z"))
    likeness = cells.groupBy("symbol", "_k").agg(F.abs(corr("z._cells", "z._other")).alias("_c"))
    likeness = likeness.groupBy("symbol").agg(F.coalesce(F.avg("_c"), F.lit(0.0)).alias("mean_sequence_correlation"))
    reg = Registry()
    lags = sorted({1, stride, stride * 2})
    for k in lags:
        reg.add("l", **{f"_l{k}": lambda f, k=k: f.lead("_y", k)})
    series = numbered.select("symbol", "start", F.col("_k").alias("pos"), F.col(target).alias("_y")).withColumn("ts", F.col("start"))
    auto = reg.compute(series, [f"_l{k}" for k in lags], keep=["_y"]).groupBy("symbol").agg(
        *[F.coalesce(F.abs(corr("_y", f"_l{k}")), F.lit(0.0)).alias(f"autocorr_{k}") for k in lags])
    out = windows.groupBy("symbol").agg(F.count(F.lit(1)).alias("total_sequences")).join(likeness, "symbol", "left").join(auto, "symbol")
    out = out.fillna(0.0, ["mean_sequence_correlation"]).withColumn("overlap_percentage", F.lit(overlap)).withColumn(
        "data_reuse_factor", F.lit(length / stride))
    high = F.lit(overlap > 90)
    tied = (F.col("mean_sequence_correlation") > 0.8) | (F.greatest(*[F.col(f"autocorr_{k}") for k in lags], F.lit(0.0)) > 0.3)
    return out.withColumn("leakage_risk", F.when(high & tied, "HIGH").when(high, "MEDIUM").otherwise("LOW"))


def recommendations(risks: DataFrame) -> DataFrame:
    """Advice per risk class."""
    risk, overlap = F.col("leakage_risk"), F.col("overlap_percentage")
    notes = F.array(
        F.when(risk == "HIGH", "reduce sequence overlap").when(risk == "MEDIUM", "consider reducing overlap").otherwise("acceptable"),
        F.when((risk == "HIGH") & (overlap > 95), "stride of at least half the length"),
        F.when(risk == "HIGH", "validate without overlap"), F.when(risk == "HIGH", "consider walk-forward validation"),
        F.when(overlap > 90, F.concat(F.lit("recommended stride "), F.greatest(F.lit(1), F.floor(overlap / 75)).cast("string"))))
    return risks.withColumn("recommendations", F.filter(notes, lambda v: v.isNotNull()))


def early_epochs(history: DataFrame, epochs: int = 5, limit: float = 0.15) -> DataFrame:
    """Alerts and learning slope over the first epochs (symbol, epoch, val_corr)."""
    x = F.abs("val_corr")
    early = history.where(F.col("epoch") < epochs)
    out = early.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("epochs_analyzed"), F.count_if(x > limit).alias("alert_count"), F.max(x).alias("max_early_correlation"),
        F.min_by(x, "epoch").alias("_a"), F.max_by(x, "epoch").alias("_b"))
    slope = F.when(F.col("epochs_analyzed") >= 3, (F.col("_b") - F.col("_a")) / F.col("epochs_analyzed")).otherwise(0.0)
    return out.withColumn("learning_slope", slope).withColumn("steep_learning", slope > 0.05).withColumn(
        "leakage_detected", (F.col("alert_count") > 0) | (slope > 0.05)).drop("_a", "_b")


def same_time_audit(df: DataFrame, features, target: str, warn: float = 0.3, critical: float = 0.4) -> DataFrame:
    """Correlation of the target with inputs of the same row."""
    return feature_target(df, features, target, warn, critical)


def future_dependency(df: DataFrame, features, target: str, leads=(1, 3, 5)) -> DataFrame:
    """Mean absolute correlation of the target with later values of each feature."""
    features = list(features)
    reg = Registry()
    for c in features:
        for k in leads:
            reg.add("l", **{f"{c}_lead{k}": lambda f, c=c, k=k: f.lead(c, k)})
    names = [f"{c}_lead{k}" for c in features for k in leads]
    wide = reg.compute(df, names, keep=[target]).groupBy("symbol").agg(*[F.abs(corr(n, target)).alias(n) for n in names])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.array(*[F.col(f"{c}_lead{k}") for k in leads]).alias("v")) for c in features]))
    known = F.filter("v", lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return wide.select("symbol", rows.alias("r")).select("symbol", "r.*").select(
        "symbol", "feature", F.coalesce(F.try_divide(total, F.when(F.size(known) > 0, F.size(known))), F.lit(0.0)).alias("dependency"))


def random_target_test(df: DataFrame, features, seed: int = 42) -> DataFrame:
    """Correlation of the features with seeded uniform targets; should be near 0."""
    table = df.withColumn("_random", draw_hash(seed, F.col("pos")) / float(PRIME))
    return feature_target(table, features, "_random", 0.3, 0.4)


def gap_sensitivity(df: DataFrame, feature: str, target: str, gaps=(0, 1, 5, 10, 20)) -> DataFrame:
    """Correlation of a feature with the target gap+1 rows later, and how far it falls."""
    reg = Registry()
    for g in gaps:
        reg.add("g", **{f"_g{g}": lambda f, g=g: f.lead(target, g + 1)})
    out = reg.compute(df, [f"_g{g}" for g in gaps], keep=[feature]).groupBy("symbol").agg(
        *[F.coalesce(F.abs(corr(feature, f"_g{g}")), F.lit(0.0)).alias(f"gap_{g}") for g in gaps])
    cells = [F.col(f"gap_{g}") for g in gaps]
    drop = F.greatest(*cells) - F.least(*cells)
    return out.withColumn("correlation_drop", drop).withColumn(
        "drop_class", F.when(drop > 0.4, "sharp").when(drop > 0.2, "moderate").otherwise("gradual"))


