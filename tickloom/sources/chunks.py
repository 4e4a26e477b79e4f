"""Incremental loads into weekly chunks with a manifest.

A store is a folder: `data` holds the rows in one partition per week, `manifest` one row per load and week with the range of times and
the number of rows that the load brought. A load reads only the chunks whose recorded range meets the range of its own rows, so
a daily load into years of data opens the last week. The manifest is written before the data: a load that dies in between leaves a range that is
recorded too wide, which costs a later load some reading and never a row; the run is repeated with the same result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.layout import with_positions
from ..plans.core_features import CORE
from ..plans.registry import Registry
from ..session import materialize
from .store import append_new, exists, link_returns, log_run, new_rows, week_of

MANIFEST = "load string, week date, first_ts timestamp_ntz, last_ts timestamp_ntz, rows bigint"
STATE = "load string, symbol string, ts timestamp_ntz, close double"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    if exists(spark, f"{folder}/manifest"):
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return spark.createDataFrame([], MANIFEST)


def ranges(rows: DataFrame, load: str) -> DataFrame:
    """One manifest row per week of the rows (with a `week` column)."""
    return rows.groupBy("week").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("rows")).select(
        F.lit(load).alias("load"), "week", "first_ts", "last_ts", "rows")


def touched_weeks(spark: SparkSession, folder: str, incoming: DataFrame) -> list:
    """The stored weeks whose recorded times meet those of the incoming ranges; at most one entry per calendar week."""
    stored = manifest(spark, folder).groupBy("week").agg(F.min("first_ts").alias("_a"), F.max("last_ts").alias("_b"))
    met = incoming.join(stored, "week").where("first_ts <= _b AND last_ts >= _a")
    return sorted(r.week for r in met.select("week").distinct().collect())


def chunk_rows(spark: SparkSession, folder: str, weeks: list, schema) -> DataFrame:
    """The stored rows of some weeks: only their partitions are listed and read."""
    if not weeks:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{folder}/data").where(F.col("week").isin(weeks)).select(*schema.names)


def append_chunks(incoming: DataFrame, folder: str, load: str | None = None, keys=("symbol", "ts")) -> DataFrame:
    """Append the rows whose key is not stored, each once, and return them.

    They are kept in the checkpoint folder: a cached table would be worked out anew when the store that it was compared with grows.
    """
    spark, load = incoming.sparkSession, load or uuid.uuid4().hex
    dated = incoming.withColumn("week", F.to_date(week_of(F.col("ts"))))
    weeks = touched_weeks(spark, folder, ranges(dated, load))
    fresh = materialize(new_rows(incoming, chunk_rows(spark, folder, weeks, incoming.schema), keys))
    out = fresh.withColumn("week", F.to_date(week_of(F.col("ts"))))
    found = ranges(out, load)
    if not fresh.isEmpty():
        found.write.mode("append").parquet(f"{folder}/manifest")
        out.repartitionByRange("week", "symbol", "ts").sortWithinPartitions("week", "symbol", "ts").write.mode("append").partitionBy("week").parquet(f"{folder}/data")
    return fresh


# -- returns of new rows only ------------------------------------------------------------
def last_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, ts, close): the newest price row of each symbol.

    The state has the last rows of every load. Loads of the price manifest that the state does not know, because a run died before it was
    written, are read again from their chunks.
    """
    known = spark.read.schema(STATE).parquet(f"{folder}/state") if exists(spark, f"{folder}/state") else spark.createDataFrame([], STATE)
    missing = manifest(spark, f"{folder}/prices").join(known.select("load").distinct(), "load", "left_anti")
    weeks = sorted(r.week for r in missing.select("week").distinct().collect())
    rows = known.select("symbol", "ts", "close")
    if weeks:
        again = spark.read.parquet(f"{folder}/prices/data").where(F.col("week").isin(weeks))
        rows = rows.unionByName(again.select("symbol", "ts", "close"))
    return rows.groupBy("symbol").agg(F.max_by(F.struct("ts", "close"), "ts").alias("r")).select("symbol", "r.*")


def fresh_returns(fresh: DataFrame, last: DataFrame, folder: str) -> DataFrame:
    """Returns of new rows from the row before each, linked to their prices.

    That row is the last stored one of the symbol. Only for symbols whose rows come late their stored rows are read again, and the row after a
    late one is returned too: it can have its first return now. `last` is the state before the new rows were stored.
    """
    spark = fresh.sparkSession
    rows = fresh.select("symbol", "ts", "close").withColumn("_new", F.lit(True))
    before = last.withColumn("_new", F.lit(False))
    late = rows.join(last.select("symbol", F.col("ts").alias("_last")), "symbol").where("ts <= _last").select("symbol").distinct()
    if not late.isEmpty():
        stored = spark.read.parquet(f"{folder}/prices/data").select("symbol", "ts", "close").join(late, "symbol", "left_semi")
        stored = stored.join(rows, ["symbol", "ts"], "left_anti").withColumn("_new", F.lit(False))
        before = before.join(late, "symbol", "left_anti").unionByName(stored)
    table = with_positions(rows.unionByName(before), "year")
    reg = Registry(parent=CORE)
    reg.add("after", _after=lambda f: f.lag("_new"))
    out = reg.compute(table, ["daily_return", "_after"], keep=["_new"]).where("_new OR _after").dropna(subset=["daily_return"])
    return link_returns(out.drop("pos", "_new", "_after"), table)


def load_prices(bars: DataFrame, folder: str, run_id: str) -> dict[str, int]:
    """The load job: new bars, the new tickers among them and their returns are appended, and the run is logged.

    What a run reads grows with its own rows: touched chunks, the list of tickers and one state row per symbol and load.
    """
    spark, load = bars.sparkSession, uuid.uuid4().hex
    last = materialize(last_rows(spark, folder))
    fresh = append_chunks(bars, f"{folder}/prices", load)
    added = {"prices": fresh.count(), "tickers": append_new(fresh.select("symbol").distinct(), f"{folder}/tickers", ("symbol",)), "returns": 0}
    if added["prices"]:
        linked = append_chunks(fresh_returns(fresh, last, folder), f"{folder}/returns", load)
        added["returns"] = linked.count()
        newest = fresh.groupBy("symbol").agg(F.max_by(F.struct("ts", F.col("close").cast("double").alias("close")), "ts").alias("r"))
        newest.select(F.lit(load).alias("load"), "symbol", "r.ts", "r.close").write.mode("append").parquet(f"{folder}/state")
    log_run(spark, f"{folder}/runs", run_id, "success", str(added))
    return added
