"""Return series statistics: Sharpe, drawdown, Calmar and strategy summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..plans.registry import Registry

YEAR = 252.0


def equity_curve(returns: DataFrame, column: str) -> DataFrame:
    """Equity, high-water mark and drawdown along each series."""
    reg = Registry()
    reg.add("equity", _growth=lambda f: 1.0 + F.coalesce(f[column], F.lit(0.0)))
    reg.running("equity", "equity", "_growth", "product")
    reg.running("equity", "high_water", "equity", "max")
    reg.add("equity", drawdown=lambda f: F.try_divide(f["equity"] - f["high_water"], f["high_water"]))
    return reg.compute(returns, ["equity", "high_water", "drawdown"], keep=[column])


def sharpe(mean, deviation, rate: float = 0.0, scale: float = math.sqrt(YEAR)):
    """Mean over deviation, scaled; 0 for a flat series."""
    return F.coalesce(F.try_divide(mean - rate, F.when(deviation > 0, deviation)) * scale, F.lit(0.0))


def strategy_performance(returns: DataFrame, column: str = "strategy_return") -> DataFrame:
    """Total return, Sharpe, drawdown, win rate and signal count per symbol."""
    x = F.col(column)
    return equity_curve(returns, column).groupBy("symbol").agg(
        F.sum(x).alias("total_return"),
        sharpe(F.avg(x), F.stddev_samp(x)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        F.count_if(x != 0).alias("total_signals"),
    )
