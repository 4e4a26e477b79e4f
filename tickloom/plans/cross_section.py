"""Cross-sectional features: market, sector and peer relations on common dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import fdiv, flag, guarded
from ..operators.align import common_dates
from ..operators.layout import attach, with_positions
from ..session import materialize
from .core_features import CORE
from .registry import Registry

CROSS = Registry()
TAIL = Registry()

# Constants used where a symbol has no peers at all.
NEUTRAL = {
    "market_correlation_5d": 0.5, "market_correlation_20d": 0.5, "sector_correlation_20d": 0.5,
    "peer_correlation_mean": 0.5, "peer_correlation_max": 0.5, "peer_correlation_min": 0.5,
    "relative_strength_market": 1.0, "relative_strength_sector": 1.0, "outperformance_ratio": 1.0,
    "beta_to_market": 1.0, "beta_to_sector": 1.0,
    "sector_momentum_5d": 0.0, "sector_momentum_20d": 0.0, "market_momentum_20d": 0.0,
    "relative_volume_sector": 1.0, "relative_volatility_sector": 1.0,
    "correlation_stability": 0.5, "beta_stability": 0.5, "sector_leadership": 0.5, "market_leadership": 0.5,
    "flow_divergence": 0.0, "sentiment_divergence": 0.0,
}

# Sector relations of a symbol that is alone in its sector.
NO_PEERS = {"beta_to_sector": 1.0, "relative_volume_sector": 0.0, "relative_volatility_sector": 0.0}


def _or(x, value):
    return F.coalesce(x, F.lit(float(value)))


def _beta(f, market):
    return guarded(_or(f.cov("daily_return", market, 60), 0), _or(f.var(market, 60), 1e-8))


CROSS.add(
    "relations",
    market_correlation_5d=lambda f: _or(f.corr("daily_return", "market_return", 5), 0),
    market_correlation_20d=lambda f: _or(f.corr("daily_return", "market_return", 20), 0),
    sector_correlation_20d=lambda f: _or(f.corr("daily_return", "sector_return", 20), 0),
    relative_strength_market=lambda f: _or(f.sum("daily_return", 20) - f.sum("market_return", 20), 0),
    relative_strength_sector=lambda f: _or(f.sum("daily_return", 20) - f.sum("sector_return", 20), 0),
    outperformance_ratio=lambda f: _or(
        fdiv(f.sum("daily_return", 20), F.abs(f.sum("market_return", 20)) + 1e-8 + 1e-10), 1
    ),
    beta_to_market=lambda f: _beta(f, "market_return"),
    beta_to_sector=lambda f: _beta(f, "sector_return"),
    market_momentum_20d=lambda f: _or(f.mean("market_return", 20), 0),
    relative_volume_sector=lambda f: _or(guarded(f["volume"], f["sector_volume"]), 1),
    relative_volatility_sector=lambda f: _or(guarded(f.std("daily_return", 20), f["sector_volatility"]), 1),
)
COMMON_FEATURES = CROSS.group("relations")

TAIL.add(
    "leadership",
    correlation_stability=lambda f: 1.0 / (_or(f.std("market_correlation_20d", 20), 1) + 0.1),
    beta_stability=lambda f: 1.0 / (_or(f.std("beta_to_market", 20), 1) + 0.1),
    sector_leadership=lambda f: flag(f["relative_strength_sector"] > f.quantile("relative_strength_sector", 60, 0.7)),
    market_leadership=lambda f: flag(f["relative_strength_market"] > f.quantile("relative_strength_market", 60, 0.7)),
    flow_divergence=lambda f: F.lit(0.0),
    sentiment_divergence=lambda f: F.lit(0.0),
)
LEADERSHIP = TAIL.group("leadership")
PEERS = ["peer_correlation_mean", "peer_correlation_max", "peer_correlation_min"]
SECTOR_MOMENTUM = ["sector_momentum_5d", "sector_momentum_20d"]
ALL_FEATURES = [
    "market_correlation_5d", "market_correlation_20d", "sector_correlation_20d", *PEERS,
    "relative_strength_market", "relative_strength_sector", "outperformance_ratio", "beta_to_market", "beta_to_sector",
    *SECTOR_MOMENTUM, "market_momentum_20d", "relative_volume_sector", "relative_volatility_sector", *LEADERSHIP,
]


def with_returns(bars: DataFrame) -> DataFrame:
    return CORE.compute(bars, ["daily_return"], keep=["sector", "volume"])


def market_aggregates(returns: DataFrame) -> DataFrame:
    """Mean return, volume and dispersion per common date, with momentum 5 and 20."""
    on = attach(returns, common_dates(returns), ["ts"], "left_semi")
    series = on.groupBy("ts").agg(
        F.avg("daily_return").alias("market_return"), F.sum("volume").alias("market_volume"),
        F.stddev_samp("daily_return").alias("market_volatility"),
    )
    reg = Registry()
    reg.add("m", market_momentum_5d=lambda f: f.mean("market_return", 5),
            market_momentum_20d=lambda f: f.mean("market_return", 20))
    numbered = with_positions(series.withColumn("symbol", F.lit("market")), "year")
    return reg.compute(numbered, ["market_momentum_5d", "market_momentum_20d"],
                       keep=["market_return", "market_volume", "market_volatility"])


def sector_aggregates(returns: DataFrame) -> DataFrame:
    """Per symbol and date: the same numbers for the other members of its sector.

    Sums per (sector, date) minus the own value give every leave-one-out series
    at once. A date counts when all other members have a row.
    """
    r = F.col("daily_return")
    sums = returns.groupBy("sector", "ts").agg(
        F.count(F.lit(1)).alias("_rows"), F.count(r).alias("_k"), F.sum(r).alias("_s"), F.sum(r * r).alias("_q"),
        F.sum("volume").alias("_v"),
    )
    members = returns.select("sector", "symbol").distinct()
    sizes = members.groupBy("sector").agg(F.count(F.lit(1)).alias("_size"))
    grid = attach(sums, members.join(sizes, "sector"), ["sector"], "inner")
    own = returns.select("symbol", "ts", F.lit(1).alias("_here"), r.alias("_r"), F.col("volume").alias("_w"))
    loo = grid.join(own, ["symbol", "ts"], "left").where(
        (F.col("_rows") - F.coalesce("_here", F.lit(0)) == F.col("_size") - 1) & (F.col("_size") > 1)
    )
    mine = F.coalesce("_r", F.lit(0.0))
    k = F.col("_k") - F.when(F.col("_r").isNotNull(), 1).otherwise(0)
    s, q = F.col("_s") - mine, F.col("_q") - mine * mine
    mean = F.try_divide(s, F.when(k > 0, k))
    spread = F.try_divide(q - F.try_divide(s * s, F.when(k > 0, k)), F.when(k > 1, k - 1))
    series = loo.select(
        "symbol", "ts", mean.alias("sector_return"), (F.col("_v") - F.coalesce("_w", F.lit(0.0))).alias("sector_volume"),
        F.sqrt(F.greatest(spread, F.lit(0.0)) + 0 * spread).alias("sector_volatility"),
    )
    reg = Registry()
    reg.add("s", sector_momentum_5d=lambda f: f.mean("sector_return", 5),
            sector_momentum_20d=lambda f: f.mean("sector_return", 20))
    return reg.compute(with_positions(series, "year"), SECTOR_MOMENTUM,
                       keep=["sector_return", "sector_volume", "sector_volatility"])


def peer_correlations(common: DataFrame, least_rows: int = 20) -> DataFrame:
    """Mean, highest and lowest 20-row correlation with the sector peers.

    Joined on (sector, ts): one row per symbol and time on each side, so the
    size is the number of pairs of symbols, never of rows. Each pair is windowed
    once and counts for both symbols. Pairs with at most ``least_rows`` shared
    rows stay out, as the definition has it.
    """
    a = common.select("symbol", "sector", "ts", "pos", "daily_return")
    b = common.select(F.col("symbol").alias("_peer"), "sector", "ts", F.col("daily_return").alias("_peer_return"))
    pairs = a.join(b, ["sector", "ts"]).where(F.col("symbol") < F.col("_peer"))
    keyed = pairs.withColumn("_own", F.col("symbol")).withColumn("symbol", F.to_json(F.struct("_own", "_peer")))
    reg = Registry()
    reg.add("p", _c=lambda f: _or(f.corr("daily_return", "_peer_return", 20), 0))
    corr = reg.compute(keyed, ["_c"], keep=["_own", "_peer"])
    enough = keyed.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least_rows).select("symbol")
    return attach(corr, enough, ["symbol"], "left_semi").select(F.explode(F.array("_own", "_peer")).alias("symbol"), "ts", "_c").groupBy("symbol", "ts").agg(
        F.avg("_c").alias("peer_correlation_mean"), F.max("_c").alias("peer_correlation_max"),
        F.min("_c").alias("peer_correlation_min"),
    )


def cross_sectional(bars: DataFrame) -> DataFrame:
    """All cross-sectional features; rows outside the common dates hold NULL relations."""
    returns = materialize(with_returns(bars))
    market = market_aggregates(returns).select("ts", "market_return")
    sector = sector_aggregates(returns).drop("pos")
    common = attach(returns, common_dates(returns), ["ts"], "left_semi")
    common = materialize(with_positions(common.drop("pos"), "year"))
    members = returns.select("sector", "symbol").distinct().groupBy("sector").agg(F.count(F.lit(1)).alias("members"))
    inputs = attach(attach(common, market, ["ts"]), members, ["sector"]).join(sector, ["symbol", "ts"], "left")
    rel = CROSS.compute(inputs, COMMON_FEATURES, keep=SECTOR_MOMENTUM + ["members"])
    alone = F.coalesce(F.col("members") < 2, F.lit(True))
    for name, value in NO_PEERS.items():
        rel = rel.withColumn(name, F.when(alone, F.lit(value)).otherwise(F.col(name)))
    rel = rel.join(peer_correlations(common), ["symbol", "ts"], "left")
    filled = rel.select(
        "symbol", "ts", *COMMON_FEATURES,
        *[_or(F.col(c), 0).alias(c) for c in SECTOR_MOMENTUM + PEERS],
    )
    full = returns.select("symbol", "ts", "pos").join(filled, ["symbol", "ts"], "left")
    return TAIL.compute(full, LEADERSHIP, keep=[c for c in ALL_FEATURES if c not in LEADERSHIP])


def neutral_features(bars: DataFrame) -> DataFrame:
    """The constants used when a symbol has nothing to be compared with."""
    return bars.select("symbol", "ts", *[F.lit(v).alias(k) for k, v in NEUTRAL.items()])
