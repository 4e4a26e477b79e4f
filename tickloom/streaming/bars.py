"""Bars from a tick stream: the batch aggregate with an event-time window and watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.layout import attach_scalar
from ..sources.bars import build_bars


def stream_bars(ticks: DataFrame, late: str = "2 hours", width: str = "1 hour", order=("ts", "event_id")) -> DataFrame:
    """Hourly bars of a streaming tick table (symbol, ts, price, order columns).

    A bar is final once the watermark passes its end; state holds open bars only.
    """
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return build_bars(timed, F.window("ts", width), order).select(
        "symbol", F.col("ts.start").alias("ts"), "open", "high", "low", "close", "volume")


def append_bars(bars: DataFrame, path: str, checkpoint: str):
    """Write finished bars; the checkpoint makes a restart continue where it stopped."""
    return (bars.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def completed_bars(final: DataFrame, ticks: DataFrame, width: str = "1 hour", order=("ts", "event_id")) -> DataFrame:
    """All bars of a bounded source: those the stream finished, and the open ones by the batch aggregate over later ticks.

    The watermark is the same for all symbols, so everything up to the end of the last finished bar is done.
    """
    done = final.agg(F.max("ts").alias("_last")).select((F.col("_last") + F.expr(f"INTERVAL {width}")).alias("_done"))
    rest = attach_scalar(ticks.withColumn("ts", F.col("ts").cast("timestamp")), done)
    rest = rest.where(F.col("_done").isNull() | (F.col("ts") >= F.col("_done"))).drop("_done")
    bars = build_bars(rest, F.window("ts", width), order)
    return final.unionByName(bars.select("symbol", F.col("ts.start").alias("ts"), "open", "high", "low", "close", "volume"))
