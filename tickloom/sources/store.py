"""Stored tables: schemas, incremental loads, links, chunks, logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..fixed import MAG7, UNIVERSE
from ..plans.core_features import CORE

PRICE = T.DecimalType(10, 4)
SCHEMAS = {
    "market_data": "time timestamp_ntz, ticker string, open decimal(10,4), high decimal(10,4), low decimal(10,4), "
                   "close decimal(10,4), volume bigint, daily_return decimal(12,8), adjusted_close decimal(10,4)",
    "features": "time timestamp_ntz, ticker string, feature_name string, feature_value decimal(15,8)",
    "predictions": "time timestamp_ntz, ticker string, model_name string, prediction_type string, horizon int, "
                   "predicted_value decimal(12,8), confidence decimal(5,4)",
    "backtest_results": "strategy string, ticker string, first_time timestamp_ntz, last_time timestamp_ntz, "
                        "total_return decimal(8,6), sharpe_ratio decimal(8,6), max_drawdown decimal(8,6), "
                        "win_rate decimal(5,4), total_trades int, config string",
    "model_registry": "model_name string, version string, created timestamp_ntz, metrics string, active boolean",
    "pipeline_runs": "run_id string, started timestamp_ntz, ended timestamp_ntz, status string, log string",
    "tickers": "symbol string, name string, sector string",
}
RUN_STATUS = ("success", "failed")


def universe(name: str = "expanded") -> list[str]:
    """Symbols of a named set; the volatility index itself is never traded."""
    names = {"expanded": UNIVERSE, "mag7": MAG7}[name]
    return [s for s in names if s not in ("VIX", "^VIX")]


def in_universe(df: DataFrame, symbols: DataFrame) -> DataFrame:
    return df.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def week_of(ts):
    return F.date_trunc("week", ts)


def new_rows(incoming: DataFrame, stored: DataFrame, keys=("symbol", "ts")) -> DataFrame:
    """Incoming rows whose key is not stored yet, each key once.

    Incoming keys can repeat, so they are reduced before the anti join; of
    repeated keys the row with the smallest values wins, whatever the order.
    """
    keys = list(keys)
    rest = [c for c in incoming.columns if c not in keys]
    once = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else incoming.distinct()
    return once.join(stored.select(*keys), keys, "left_anti").select(incoming.columns)


def append_new(incoming: DataFrame, path: str, keys=("symbol", "ts"), partition: str | None = None) -> int:
    """Append the rows that are not stored; a second run adds nothing. Returns the rows added."""
    spark = incoming.sparkSession
    found = exists(spark, path)
    fresh = new_rows(incoming, spark.read.parquet(path), keys) if found else new_rows(incoming, incoming.limit(0), keys)
    fresh = fresh.persist()
    try:
        count = fresh.count()
        if count:
            writer = fresh.write.mode("append")
            (writer.partitionBy(partition) if partition else writer).parquet(path)
        return count
    finally:
        fresh.unpersist()


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def upsert_tickers(bars: DataFrame, tickers: DataFrame) -> DataFrame:
    """Known tickers plus the symbols seen for the first time."""
    fresh = bars.select("symbol").distinct().join(tickers, "symbol", "left_anti")
    extra = fresh.select("symbol", F.col("symbol").alias("name"), F.lit(None).cast("string").alias("sector"))
    return tickers.unionByName(extra)


def returns_table(bars: DataFrame) -> DataFrame:
    """Returns per symbol and time without the first row."""
    return CORE.compute(bars, ["daily_return"]).dropna(subset=["daily_return"])


def link_returns(returns: DataFrame, prices: DataFrame) -> DataFrame:
    """Attach the id of the price row; the id is the hash of the key, so no counter is needed."""
    ids = prices.select("symbol", "ts", F.xxhash64("symbol", "ts").alias("price_id"))
    return returns.join(ids, ["symbol", "ts"])


def duplicate_keys(df: DataFrame, keys=("symbol", "ts")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_rows(df: DataFrame, keys=("symbol", "ts")) -> DataFrame:
    """Reject a table with duplicate keys (a streaming check of one row)."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"duplicate keys {list(keys)}")
    return df


def market_data(bars: DataFrame) -> DataFrame:
    """The stored market table: decimals at the sink only, one partition column per week."""
    table = CORE.compute(bars, ["daily_return"], keep=["open", "high", "low", "close", "volume"])
    return table.select(
        F.col("ts").alias("time"), F.col("symbol").alias("ticker"),
        *[F.col(c).cast(PRICE).alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("bigint").alias("volume"),
        F.col("daily_return").cast(T.DecimalType(12, 8)).alias("daily_return"),
        F.col("close").cast(PRICE).alias("adjusted_close"), week_of("ts").alias("week"),
    )


def long_features(df: DataFrame, columns) -> DataFrame:
    """One row per (time, ticker, feature); nulls are not stored."""
    long = df.select("symbol", "ts", *columns).unpivot(["symbol", "ts"], list(columns), "feature_name", "feature_value")
    return long.where(F.col("feature_value").isNotNull())


def wide_features(long: DataFrame, columns) -> DataFrame:
    return long.groupBy("symbol", "ts").pivot("feature_name", list(columns)).agg(F.first("feature_value"))


def write_weekly(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Chunks per week, sorted by symbol and time inside files so that statistics can skip.

    Only the weeks in the rows are replaced, other chunks stay. Rows are dealt by ranges of week, symbol and time, so a week
    is many tasks and files.
    """
    out = df.withColumn("week", F.to_date(week_of(F.col(ts))))
    out = out.repartitionByRange("week", "symbol", ts).sortWithinPartitions("week", "symbol", ts)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week").parquet(path)


def read_weeks(spark: SparkSession, path: str, first: str, last: str, ts: str = "ts") -> DataFrame:
    """The rows of two dates and all between: only their weeks' chunks are listed and read, and rows outside the dates skipped."""
    days = [F.lit(d).cast("date") for d in (first, last)]
    weeks = [F.to_date(F.date_trunc("week", d)) for d in days]
    end = F.date_add(days[1], 1).cast("timestamp_ntz")
    rows = spark.read.parquet(path).where(F.col("week").between(*weeks))
    return rows.where((F.col(ts) >= days[0].cast("timestamp_ntz")) & (F.col(ts) < end))


def prediction_rows(df: DataFrame, model: str, kind: str, horizon: int, value: str, confidence: str) -> DataFrame:
    return df.select(
        F.col("ts").alias("time"), F.col("symbol").alias("ticker"), F.lit(model).alias("model_name"),
        F.lit(kind).alias("prediction_type"), F.lit(horizon).alias("horizon"),
        F.col(value).alias("predicted_value"), F.col(confidence).alias("confidence"),
    )


def backtest_rows(performance: DataFrame, strategy: str, span: DataFrame, config: dict) -> DataFrame:
    """One row per run and symbol from the strategy summary."""
    return performance.join(span, "symbol").select(
        F.lit(strategy).alias("strategy"), F.col("symbol").alias("ticker"), "first_time", "last_time", "total_return",
        F.col("sharpe").alias("sharpe_ratio"), "max_drawdown", "win_rate", F.col("total_signals").alias("total_trades"),
        F.to_json(F.create_map(*[F.lit(v) for kv in config.items() for v in map(str, kv)])).alias("config"),
    )


def latest_models(registry: DataFrame) -> DataFrame:
    """The newest version of each model."""
    newest = F.max_by(F.struct(*[c for c in registry.columns if c != "model_name"]), F.struct("created", "version"))
    return registry.groupBy("model_name").agg(newest.alias("m")).select("model_name", "m.*")


def log_run(spark: SparkSession, path: str, run_id: str, status: str, log: str) -> None:
    if status not in RUN_STATUS:
        raise ValueError(f"Unknown run status: {status}")
    row = spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.current_timestamp().alias("ended"), F.lit(status).alias("status"), F.lit(log).alias("log")
    )
    row.write.mode("append").parquet(path)


def returns_range(returns: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    """Returns of one symbol between two US-style dates (MM-DD-YYYY)."""
    day = F.to_date("ts")
    return returns.where(
        (F.col("symbol") == symbol) & (day >= us_date(F.lit(start))) & (day <= us_date(F.lit(end)))
    )


def returns_lists(returns: DataFrame, symbols, start: str, end: str) -> DataFrame:
    """Returns of several symbols as one row per symbol and week with a sorted list.

    Lists are cut by week, so one list never holds a whole history; symbols
    without rows give no row.
    """
    day = F.to_date("ts")
    rows = returns.where(
        F.col("symbol").isin(list(symbols)) & (day >= us_date(F.lit(start))) & (day <= us_date(F.lit(end)))
    )
    item = F.struct("ts", "daily_return")
    return rows.groupBy("symbol", week_of("ts").alias("week")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def us_date(text):
    return F.to_date(text, "MM-dd-yyyy")


def percent_text(x):
    return F.format_string("%.2f%%", F.col(x) * 100)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def volume_report(returns: DataFrame, years: int = 15, share: float = 0.8) -> DataFrame:
    """Rows, span in years and non-zero returns per symbol, with the pass mark."""
    wanted = years * 252 * share
    return returns.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if(F.col("daily_return") != 0).alias("nonzero_returns"),
    ).withColumn("years", F.datediff("last_ts", "first_ts") / 365.25).withColumn("enough", F.col("n_rows") > wanted)


def format_check(df: DataFrame, min_rows: int = 50) -> DataFrame:
    """Per symbol: no column is entirely null and there are enough rows."""
    needed = ["open", "high", "low", "close", "volume"]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    out = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"_k_{c}") for c in needed]
    )
    filled = F.least(*[F.col(f"_k_{c}") for c in needed]) > 0
    return out.select("symbol", "n_rows", (filled & (F.col("n_rows") >= min_rows)).alias("valid"))


def readiness(checks: DataFrame, share: float = 0.7) -> DataFrame:
    """Ready when 70% of the symbols pass (checks: symbol, valid)."""
    out = checks.agg(F.count(F.lit(1)).alias("symbols"), F.count_if("valid").alias("valid_symbols"))
    return out.withColumn("ready", F.col("valid_symbols") >= F.col("symbols") * share)
