"""Order statistics, fills, cleaning and alignment against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from helpers import close_to, frame, ohlcv, pull

from tickloom.operators import align as al, clean as cl
from tickloom.operators.fill import asof_join, backward_fill, forward_fill, interpolate
from tickloom.operators.order_stats import average_ranks, exact_quantiles, nth_values


@pytest.fixture(scope="module")
def skewed():
    """One hot group with a third of its rows on one value."""
    rng = np.random.default_rng(1)
    hot = np.concatenate([np.zeros(4000), rng.lognormal(0, 2, 8000)])
    return pd.DataFrame({"k": ["hot"] * 12000 + ["small"] * 3 + ["one"], "x": np.concatenate([hot, [3.0, 1.0, 2.0], [5.0]])})


def test_exact_quantiles_match_numpy(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = exact_quantiles(df, ["k"], "x", {"a": 0.1, "b": 0.5, "c": 0.99, "lo": 0.0, "hi": 1.0}).toPandas().set_index("k")
    for k, part in skewed.groupby("k"):
        close_to(got.loc[k, ["a", "b", "c", "lo", "hi"]], np.percentile(part["x"], [10, 50, 99, 0, 100]))


def test_ranks_average_ties(spark, skewed):
    got = average_ranks(spark.createDataFrame(skewed), ["k"], "x", "r").toPandas()
    want = got.groupby("k")["x"].rank()
    close_to(got["r"], want)


def test_nth_value(spark, skewed):
    from pyspark.sql import functions as F

    got = nth_values(spark.createDataFrame(skewed), ["k"], "x", {"v": F.floor(F.col("_n") * 0.7)}).toPandas().set_index("k")
    hot = np.sort(skewed[skewed["k"] == "hot"]["x"])
    assert got.loc["hot", "v"] == hot[8400]


@pytest.fixture(scope="module")
def gappy():
    a = ohlcv(120, "A")
    rng = np.random.default_rng(5)
    a.loc[rng.random(120) < 0.4, "close"] = np.nan
    a.loc[:4, "close"] = np.nan
    a.loc[40:90, "close"] = np.nan  # longer than a month
    return a


def test_fills_cross_spans(spark, gappy):
    df = frame(spark, gappy, ohlcv(10, "B"))
    c = gappy["close"]
    close_to(pull(forward_fill(df, ["close"], span="month"), ["close"], "A")["close"], c.ffill())
    close_to(pull(backward_fill(df, ["close"], span="month"), ["close"], "A")["close"], c.bfill())
    close_to(pull(interpolate(df, ["close"], span="month"), ["close"], "A")["close"], c.interpolate())


def test_asof_join_takes_the_last_row_at_or_before(spark):
    left = pd.DataFrame({"symbol": ["A", "A", "B", "B"], "ts": pd.to_datetime(["2020-01-01", "2020-03-05", "2020-01-10", "2020-02-01"])})
    right = pd.DataFrame({"ts": pd.to_datetime(["2020-01-05", "2020-01-10", "2020-02-20"]), "v": [1.0, None, 3.0]})
    out = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["v"]).toPandas().sort_values(["symbol", "ts"])
    want = pd.merge_asof(left.sort_values("ts"), right, on="ts").sort_values(["symbol", "ts"])
    close_to(out["v"].astype(float), want["v"])


def test_clean_bars_drops_broken_rows_and_outliers(spark):
    a = ohlcv(200)
    a.loc[10, "high"] = a.loc[10, "low"] / 2
    a.loc[50, "volume"] = 1e9
    out = cl.clean_bars(frame(spark, a)).toPandas().sort_values("ts")
    assert len(out) == 198 and out["pos"].tolist() == list(range(198))
    with pytest.raises(ValueError, match="Invalid OHLCV"):
        cl.assert_ohlcv(frame(spark, a))


def test_clean_features_fill_median_and_infinities(spark):
    a = ohlcv(50)
    a.loc[3, "close"] = np.inf
    a.loc[7, "close"] = -np.inf
    out = pull(cl.clean_features(frame(spark, a), ["close"]), ["close"])["close"]
    finite = a["close"].replace([np.inf, -np.inf], np.nan).dropna()
    assert out[3] == pytest.approx(np.percentile(finite, 99)) and out[7] == pytest.approx(-np.percentile(finite, 99))


def test_alignment_leaves_the_common_dates(spark):
    parts = [ohlcv(100, "A"), ohlcv(99, "B", start="2020-01-02"), ohlcv(98, "C", start="2020-01-03")]
    out = al.align(frame(spark, *parts)).toPandas()
    assert out.groupby("symbol").size().tolist() == [98, 98, 98]
    with pytest.raises(ValueError, match="No common dates"):
        al.require_common_dates(frame(spark, ohlcv(5, "A"), ohlcv(5, "B", start="2021-01-01")))


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="Missing required"):
        cl.lower_names(frame(spark, ohlcv(5)).drop("volume"))
    assert cl.lower_names(frame(spark, ohlcv(5)).withColumnRenamed("close", "Close")).columns[6] == "close"


def test_symbol_without_peers_gets_the_neutral_sector_relations(spark):
    from pyspark.sql import functions as F

    from tickloom.plans.cross_section import cross_sectional

    df = frame(spark, ohlcv(80, "A"), ohlcv(80, "B", 2), ohlcv(80, "C", 3))
    df = df.withColumn("sector", F.when(F.col("symbol") == "C", "lone").otherwise("pair"))
    out = cross_sectional(df).toPandas()
    lone, pair = out[out["symbol"] == "C"], out[out["symbol"] == "A"]
    assert (lone["beta_to_sector"] == 1).all() and (lone["relative_volume_sector"] == 0).all()
    assert (lone["relative_strength_sector"] == 0).all() and (lone["peer_correlation_mean"] == 0).all()
    assert pair["beta_to_sector"].tail(10).ne(1).all()


def test_chunks_are_replaced_one_by_one_and_pruned(spark, tmp_path):
    from tickloom.sources.store import read_weeks, write_weekly

    bars = frame(spark, ohlcv(60, start="2024-01-01")).drop("pos")
    path = str(tmp_path / "chunks")
    write_weekly(bars, path)
    write_weekly(bars.where("ts >= timestamp_ntz'2024-01-08' AND ts < timestamp_ntz'2024-01-15'").withColumn("volume", bars["volume"] * 0), path)
    assert spark.read.parquet(path).count() == 60
    got = read_weeks(spark, path, "2024-01-10", "2024-01-17")
    assert sorted(r.ts.day for r in got.collect()) == list(range(10, 18))
    assert got.where("volume = 0").count() == 5
    text = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(week" in text and "PushedFilters: [IsNotNull(ts)" in text


def test_attach_leaves_nothing_persisted(spark):
    from tickloom.operators.layout import attach

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    left = spark.range(100).selectExpr("id % 7 AS k", "id")
    small = spark.range(7).selectExpr("id AS k", "id * 2 AS v")
    assert attach(left, small, ["k"]).where("v = 2 * k").count() == 100
    assert attach(left, small, ["k"], bound=0).where("v = 2 * k").count() == 100
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
