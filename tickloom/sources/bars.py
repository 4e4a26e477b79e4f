"""Price bars: scans, tick-to-bar builds and the bar tables of this engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.layout import with_positions
from ..session import materialize, stored


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_bars(bars: DataFrame, symbols=None, start=None, end=None) -> DataFrame:
    """Bars of a universe between two dates (both included).

    The predicates reach the Parquet scan of a stored bar table.
    """
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(list(symbols)))
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return bars


def build_bars(ticks: DataFrame, bucket: Column, order, price: str = "price", volume=None, extra=()) -> DataFrame:
    """First, highest, lowest and last price and summed volume per symbol and bucket.

    All aggregates combine on the map side, so a hot symbol ships one row per
    bucket and map task. Accepts a streaming table as well.
    """
    key = F.struct(*order)
    total = F.count(F.lit(1)) if volume is None else F.sum(volume)
    return ticks.groupBy("symbol", *extra, bucket.alias("ts")).agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        total.cast("double").alias("volume"),
    )


def hourly_ticks(events: DataFrame) -> DataFrame:
    return events.where(F.col("value") > 0).select(
        F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price")
    )


def hourly_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars of the event stream, one symbol per event type."""
    ticks = hourly_ticks(read_table(spark, folder, "events"))
    return build_bars(ticks, F.date_trunc("hour", "ts").cast("timestamp_ntz"), ("ts", "event_id"))


def weekly_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly bars of unit prices by supplier nation, with the region as sector."""
    items = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    suppliers = read_table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nations = read_table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    regions = read_table(spark, folder, "region").select("r_regionkey", "r_name")
    ticks = (
        items.join(suppliers, items.l_suppkey == suppliers.s_suppkey)
        .join(nations, F.col("s_nationkey") == nations.n_nationkey)
        .join(regions, nations.n_regionkey == regions.r_regionkey)
        .select(
            F.col("n_name").alias("symbol"),
            F.col("r_name").alias("sector"),
            "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        )
    )
    return build_bars(
        ticks,
        F.date_trunc("week", "l_shipdate").cast("timestamp_ntz"),
        ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        volume="l_quantity",
        extra=("sector",),
    )


TABLES = {"hourly": ("events",), "weekly": ("lineitem", "supplier", "nation", "region")}
_STORED: dict[tuple, tuple] = {}


def data_version(spark: SparkSession, folder: str, names) -> tuple:
    """Path, length and time of change of every file of the tables, from the listing alone."""
    context = spark.sparkContext
    found = []
    for name in names:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        files = path.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(path)
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return tuple(sorted(found))


def stored_bars(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Bars with row positions, built once per session and version of the data, and kept in the checkpoint
    folder. Analytics read this table the way they would read a loaded price
    table, so ticks are scanned once however many features follow."""
    key = (spark.sparkContext.applicationId, folder, kind)
    version = data_version(spark, folder, TABLES[kind])
    if key not in _STORED or _STORED[key][0] != version:
        build, span = (hourly_bars, "month") if kind == "hourly" else (weekly_bars, "year")
        bars = materialize(build(spark, folder))
        _STORED[key] = version, stored(with_positions(bars, span), "symbol", "ts")
    return _STORED[key][1]
