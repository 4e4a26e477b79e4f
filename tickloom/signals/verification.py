"""Pattern scores: signals from a score, and verification of other signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import clip, fdiv
from ..operators.clean import clean_sequences
from ..plans.registry import Registry


@dataclass(frozen=True)
class PatternRules:
    mode: str = "verification"
    min_confidence: float = 0.5
    strong: float = 0.7
    enhancement: float = 0.3
    dampening: float = 0.5
    enhanced: bool = True
    scaling: bool = True
    lookback: int = 20
    bullish: float = 0.6
    bearish: float = 0.4

    def check(self) -> bool:
        if self.bullish <= self.bearish:
            raise ValueError("Bullish threshold must be greater than bearish threshold")
        if self.min_confidence > self.strong:
            raise ValueError("Min confidence cannot exceed strong pattern threshold")
        if not (0 <= self.enhancement <= 1 and 0 <= self.dampening <= 1):
            raise ValueError("Enhancement and dampening factors must be between 0 and 1")
        if self.mode not in ("standalone", "verification", "enhancement"):
            raise ValueError(f"Unknown mode: {self.mode}")
        return True


SCORE_FEATURES = [
    "price_acceleration", "volume_price_divergence", "volatility_regime_change", "return_skewness_7d",
    "momentum_persistence_7d", "volatility_clustering", "trend_exhaustion", "garch_volatility_forecast",
    "intraday_range_expansion", "overnight_gap_behavior", "end_of_day_momentum", "sector_relative_strength",
    "market_beta_instability", "returns_1d", "returns_3d", "returns_7d",
]


def window_scores(features: DataFrame, weights: dict[str, float], bias: float = 0.0, lookback: int = 20,
                  keep=(), fill: bool = True) -> DataFrame:
    """Score of a fitted logistic model over the ``lookback`` rows before each row.

    The model reads the window mean of each feature. The score of the window
    that ends just before a row lands on that row; earlier rows score 0.
    """
    names = list(weights)
    if fill:
        features = clean_sequences(features, names)
    reg = Registry()

    def score(f):
        z = F.lit(bias)
        for n, w in weights.items():
            z = z + w * f.over(F.avg(f[n]), -lookback, -1)
        return F.when(f["pos"] >= lookback, 1.0 / (1.0 + F.exp(-z))).otherwise(0.0)

    reg.add("score", confidence=score)
    return reg.compute(features, ["confidence"], keep=keep)


def available_score_features(df: DataFrame, least: int = 14) -> list[str]:
    found = [c for c in SCORE_FEATURES if c in df.columns]
    if len(found) < least:
        raise ValueError(f"Insufficient pattern features: {len(found)}/16 available")
    return found


def score_signals(scored: DataFrame, rules: PatternRules = PatternRules()) -> DataFrame:
    """Position and strength from the confidence column, by mode."""
    rules.check()
    p = F.col("confidence")
    if rules.mode == "standalone":
        up = clip((p - rules.bullish) / (1.0 - rules.bullish), 0.0, 1.0) if rules.scaling else F.lit(1.0)
        down = clip((rules.bearish - p) / rules.bearish, 0.0, 1.0) if rules.scaling else F.lit(1.0)
        position = F.when(p > rules.bullish, up).when(p < rules.bearish, -down).otherwise(0.0)
    elif rules.mode == "verification":
        position = F.when(p < rules.min_confidence, 0.0).otherwise(p)
    else:
        side = (p - 0.5) * 2.0
        position = F.when(F.abs(side) > (rules.min_confidence - 0.5) * 2.0, side).otherwise(0.0)
    out = scored.withColumn("position", position)
    entry = F.when((F.col("position") != 0) & F.lit(rules.mode == "standalone"), F.col("close"))
    return out.withColumn("entry", entry).withColumn("strength", clip(F.abs("position"), 0.0, 1.0))


def enhanced_position(position, confidence, rules: PatternRules = PatternRules()):
    """Raise signals with strong patterns, damp those with weak ones."""
    position, confidence = F.col(position), F.col(confidence)
    if not rules.enhanced:
        return position * confidence
    lift = (confidence - 0.5) * rules.enhancement * F.abs(position)
    return (
        F.when(confidence > 0.5, F.when(position >= 0, position + lift).otherwise(position - lift))
        .when(confidence < 0.5, position * (1.0 - (0.5 - confidence) * rules.dampening))
        .otherwise(position)
    )


def verify_signals(signals: DataFrame, scores: DataFrame, rules: PatternRules = PatternRules()) -> DataFrame:
    """Join the pattern score and apply it; rows without a score keep their signal.

    A ``strength`` column scales with the position; a ``confidence`` column is
    blended 70/30 with the score instead.
    """
    rules.check()
    if rules.mode != "verification":
        return signals
    joined = signals.join(scores.select("symbol", "ts", F.col("confidence").alias("_score")), ["symbol", "ts"], "left")
    new = F.when(F.col("_score").isNull(), F.col("position")).when(
        F.col("_score") < rules.min_confidence, F.lit(0.0)
    ).otherwise(enhanced_position("position", "_score", rules))
    out = joined.withColumn("_new", new)
    if "strength" in signals.columns:
        factor = fdiv(F.abs("_new"), F.abs("position") + 1e-8)
        out = out.withColumn("strength", F.col("strength") * F.coalesce(factor, F.lit(1.0)))
    elif "confidence" in signals.columns:
        blend = F.col("confidence") * 0.7 + F.col("_score") * 0.3
        out = out.withColumn("confidence", F.coalesce(blend, F.col("confidence")))
    return out.withColumn("original_position", F.col("position")).withColumn("position", F.col("_new")).drop("_new")


def verification_stats(verified: DataFrame, rules: PatternRules = PatternRules()) -> DataFrame:
    """Filtered and enhanced counts, mean score and mean ratio per symbol."""
    was, now, score = F.col("original_position"), F.col("position"), F.col("_score")
    live = F.abs(was) > 1e-6
    return verified.groupBy("symbol").agg(
        F.count_if(score < rules.min_confidence).alias("signals_filtered"),
        F.count_if(live & (F.abs(now) > F.abs(was))).alias("signals_enhanced"),
        F.count_if(score > rules.strong).alias("high_confidence"),
        F.count_if(score > 0.5).alias("strong_patterns"),
        F.count_if(score < 0.5).alias("weak_patterns"),
        F.avg(score).alias("mean_confidence"),
        F.avg(F.when(live, F.try_divide(F.abs(now), F.abs(was)))).alias("enhancement_ratio"),
    )
