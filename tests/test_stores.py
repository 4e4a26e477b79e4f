"""Incremental chunks, ranks, products of pairs, date words and the sparse variance against plain loops."""

import numpy as np
import pandas as pd
import pytest
from helpers import close_to, frame, ohlcv, pull
from pyspark.sql import functions as F

from tickloom.evaluate.validate import pair_correlations
from tickloom.operators.align import common_dates, date_overlap
from tickloom.plans.market_features import MACRO
from tickloom.plans.registry import Registry
from tickloom.signals import risk as rk
from tickloom.sources import chunks as ch
from tickloom.sources.bars import stored_bars


@pytest.fixture(scope="module")
def bars(spark):
    return frame(spark, ohlcv(120, "A"), ohlcv(90, "B", 3)).drop("pos").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def weeks_of(files):
    return {f.split("week=")[1][:10] for f in files}


def test_a_load_opens_only_the_chunks_it_touches(spark, bars, tmp_path):
    folder = str(tmp_path / "prices")
    cut = F.lit("2020-03-20").cast("timestamp_ntz")
    ch.append_chunks(bars.where(F.col("ts") < cut), folder)
    new = bars.where((F.col("ts") >= F.lit("2020-03-18").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2020-03-26").cast("timestamp_ntz")))
    dated = new.withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    weeks = ch.touched_weeks(spark, folder, ch.ranges(dated, "x"))
    assert [str(w) for w in weeks] == ["2020-03-16"]
    read = ch.chunk_rows(spark, folder, weeks, new.schema)
    assert "PartitionFilters: [isnotnull(week" in read._jdf.queryExecution().executedPlan().toString().replace("(week#", "(week") or "PartitionFilters: [week" in read._jdf.queryExecution().executedPlan().toString()
    assert weeks_of(r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect()) == {"2020-03-16"}
    assert len(weeks_of(spark.read.parquet(f"{folder}/data").inputFiles())) > 10
    added = ch.append_chunks(new, folder)
    assert added.count() == new.where(F.col("ts") >= cut).count()
    # rows of a stored week outside its recorded times open nothing
    later = new.where(F.col("ts") >= cut).limit(1).withColumn("ts", F.lit("2020-03-29 12:00:00").cast("timestamp_ntz"))
    assert ch.touched_weeks(spark, folder, ch.ranges(later.withColumn("week", F.to_date(F.date_trunc("week", "ts"))), "y")) == []
    ch.append_chunks(bars, folder)
    stored = spark.read.parquet(f"{folder}/data")
    assert stored.count() == bars.count() == stored.select("symbol", "ts").distinct().count()
    assert ch.manifest(spark, folder).agg(F.sum("rows")).first()[0] == bars.count()


def test_a_load_that_died_before_its_data_is_repeated(spark, bars, tmp_path):
    """Only the manifest was written: the next run stores the rows all the same."""
    folder = str(tmp_path / "prices")
    dated = bars.withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    first = bars.where(F.col("ts") < F.lit("2020-02-01").cast("timestamp_ntz"))
    ch.append_chunks(first, folder)
    ch.ranges(dated, "dead").write.mode("append").parquet(f"{folder}/manifest")
    ch.append_chunks(bars, folder)
    assert spark.read.parquet(f"{folder}/data").count() == bars.count()


def test_returns_of_loads_equal_those_of_one_load(spark, bars, tmp_path):
    """In order, with an unknown state, and with late rows before and between stored ones."""
    folder = str(tmp_path / "store")
    day = F.dayofyear("ts")
    parts = [bars.where((day > 20) & (day <= 40)), bars.where((day > 40) & (day <= 60)), bars.where(day > 60), bars.where(day <= 20)]
    for k, part in enumerate(parts):
        if k == 2:  # the state of the second load is lost
            state = spark.read.schema(ch.STATE).parquet(f"{folder}/state").where(day <= 40).persist()
            state.count()
            state.write.parquet(f"{folder}/kept")
            spark.read.parquet(f"{folder}/kept").write.mode("overwrite").parquet(f"{folder}/state")
        assert ch.load_prices(part, folder, str(k))["prices"] == part.count()
    assert ch.load_prices(bars, folder, "again") == {"prices": 0, "tickers": 0, "returns": 0}
    got = spark.read.parquet(f"{folder}/returns/data").toPandas().sort_values(["symbol", "ts"])
    want = []
    for symbol, part in bars.toPandas().sort_values(["symbol", "ts"]).groupby("symbol"):
        want.append(pd.DataFrame({"symbol": symbol, "ts": part["ts"], "r": part["close"].pct_change()}).dropna())
    want = pd.concat(want)
    assert got[["symbol", "ts"]].values.tolist() == want[["symbol", "ts"]].values.tolist()
    close_to(got["daily_return"], want["r"])


# -- ranks -----------------------------------------------------------------------------------
@pytest.mark.parametrize("n,block", [(50, 64), (252, 100), (5000, None)])
def test_percent_ranks_of_long_windows(spark, n, block):
    a = ohlcv(5200 if n == 5000 else 700, "A")
    a = a.assign(volume=(a["volume"] // 300))
    a.loc[[3, 90, 91], "volume"] = np.nan
    reg = Registry()
    reg.add("r", pr=lambda f: f.rank_pct("volume", n), twice=lambda f: f.rank_pct("volume", n) * 2)
    out = reg.compute(frame(spark, a, ohlcv(20, "B")), ["pr", "twice"], block=block)
    got = pull(out, ["pr", "twice"], "A")
    want = a["volume"].rolling(n).rank(pct=True)
    close_to(got["pr"], want)
    close_to(got["twice"], want * 2)


def test_percent_ranks_collect_nothing(spark):
    plan = MACRO.compute(frame(spark, ohlcv(300, "A")), ["vix_percentile"])._jdf.queryExecution().executedPlan().toString()
    rank = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "collect_list" not in plan and "Window" not in rank


# -- pairs -----------------------------------------------------------------------------------
def test_pair_correlations_of_many_features(spark):
    rng = np.random.default_rng(0)
    n, p = 400, 300
    x = rng.normal(0, 1, (n, p))
    x[:, 1] = 1e6 + 0.01 * x[:, 0] + 0.002 * x[:, 1]
    x[:, 2] = 7.0
    x[rng.random((n, p)) < 0.05] = np.nan
    x[:, 3] = np.nan
    pdf = pd.DataFrame(x, columns=[f"f{k}" for k in range(p)]).assign(symbol=np.where(np.arange(n) < 250, "A", "B"))
    from tickloom.operators.clean import nan_to_null

    got = pair_correlations(nan_to_null(spark.createDataFrame(pdf)).repartition(3), [f"f{k}" for k in range(p)]).toPandas()
    assert len(got) == 2 * p * (p - 1) // 2
    for symbol, part in got.groupby("symbol"):
        want = pdf[pdf["symbol"] == symbol].drop(columns="symbol").corr()
        a, b = part["a"].str[1:].astype(int), part["b"].str[1:].astype(int)
        flat = a.isin([2, 3]) | b.isin([2, 3])
        assert part["corr"][flat].isna().all() and part["corr"][~flat].notna().all()
        close_to(part["corr"][~flat], want.to_numpy()[a[~flat], b[~flat]], 1e-8)


def test_date_overlap_equals_sets(spark):
    """Repeated days, days before 1970, and symbols that share none."""
    rng = np.random.default_rng(4)
    days = {s: set(rng.choice(40000, size, replace=False) - 5000) for s, size in (("A", 300), ("B", 5000), ("C", 9000), ("D", 1))}
    days["E"] = {-4999, -5000}
    rows = [(s, pd.Timestamp("1970-01-01") + pd.Timedelta(days=int(d), hours=h)) for s, ds in days.items() for d in ds for h in (0, 7)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts"])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {(r.a, r.b): (r.shared, r.overlap) for r in date_overlap(df).collect()}
    want = {(a, b): len(days[a] & days[b]) for a in days for b in days if a < b and days[a] & days[b]}
    assert {k: v[0] for k, v in got.items()} == want
    for (a, b), (shared, overlap) in got.items():
        close_to(overlap, shared / len(days[a] | days[b]))


def test_common_dates_count_symbols_not_rows(spark):
    rows = [("A", 1), ("A", 1), ("A", 2), ("B", 2), ("B", 3), ("A", 3)]
    df = spark.createDataFrame(rows, "symbol string, d int").select("symbol", F.date_add(F.lit("2020-01-01"), F.col("d")).cast("timestamp_ntz").alias("ts"))
    assert sorted(r.ts.day for r in common_dates(df).collect()) == [3, 4]


def test_portfolio_volatility_equals_a_quadratic_form(spark):
    """Zero weights, unknown symbols, missing and NULL correlations, single positions."""
    rng = np.random.default_rng(8)
    names = [f"S{k}" for k in range(9)]
    base = rng.normal(0, 1, (40, 9))
    corr = np.corrcoef(base.T)
    cells = [(a, b, float(corr[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if {a, b} != {"S1", "S2"}]
    cells = [(a, b, None if {a, b} == {"S3", "S4"} else v) for a, b, v in cells]
    vols = {n: 0.01 * (k + 1) for k, n in enumerate(names[:-1])}
    rows = []
    for t in range(12):
        for k, n in enumerate([*names, "UNKNOWN"]):
            if rng.random() < 0.7 or t == 0:
                rows.append((t, n, 0.0 if rng.random() < 0.3 else float(rng.normal(0, 0.1))))
    rows += [(90, "S1", 0.2), (91, "UNKNOWN", 0.3), (92, "S0", 0.0), (92, "S1", 0.0)]
    got = {r.ts: r.portfolio_vol for r in rk.portfolio_volatility(
        spark.createDataFrame(rows, "ts int, symbol string, f double"), spark.createDataFrame(cells, "a string, b string, corr double"),
        spark.createDataFrame(list(vols.items()), "symbol string, vol double")).collect()}
    value = {(a, b): v or 0.0 for a, b, v in cells}
    for t in {r[0] for r in rows}:
        w = {n: f * vols.get(n, rk.DEFAULT_VOLATILITY) for s, n, f in rows if s == t}
        known = [n for n in w if n in names]
        want = sum(abs(x) for x in w.values())
        if len(known) >= 2:
            want = np.sqrt(max(sum(w[a] * w[b] * value.get((a, b), 0.0) for a in known for b in known), 0))
        close_to(got[t], want)


def test_bars_follow_a_changed_table(spark, tmp_path):
    """Stored bars are built once for a table, and anew when its files change."""
    ticks = spark.sql("SELECT id AS event_id, 'a' AS event_type, timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts, CAST(id + 1 AS DOUBLE) AS value FROM range(120)")
    ticks.write.parquet(str(tmp_path / "events.parquet"))
    first = stored_bars(spark, str(tmp_path), "hourly")
    assert stored_bars(spark, str(tmp_path), "hourly") is first and first.agg(F.max("close")).first()[0] == 120
    ticks.withColumn("value", F.col("value") * 2).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    second = stored_bars(spark, str(tmp_path), "hourly")
    assert second is not first and second.count() == 2 and second.agg(F.max("close")).first()[0] == 240
