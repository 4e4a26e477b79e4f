"""Window engine against pandas, on one block and on many."""

import numpy as np
import pandas as pd
import pytest
from helpers import close_to, frame, ohlcv, pull

from tickloom.operators.layout import framed, with_positions
from tickloom.plans.core_features import CORE
from tickloom.plans.market_features import MACRO, MARKET
from tickloom.plans.registry import Registry

BLOCKS = [None, 16, 61]


@pytest.fixture(scope="module")
def series():
    return ohlcv(300, "A"), ohlcv(37, "B", seed=7)


@pytest.mark.parametrize("block", BLOCKS)
def test_rolling_matches_pandas(spark, series, block):
    a, b = series
    names = ["sma_20", "bb_upper", "volatility_20d", "relative_volume", "trend_strength_10d", "volatility_skew", "volume_price_trend"]
    got = pull(CORE.compute(frame(spark, a, b), names, block=block), names, "A")
    c, v = a["close"], a["volume"]
    lr = np.log(c / c.shift(1))
    close_to(got["sma_20"], c.rolling(20).mean())
    close_to(got["bb_upper"], c.rolling(20).mean() + 2 * c.rolling(20).std())
    close_to(got["volatility_20d"], lr.rolling(20).std() * np.sqrt(252))
    close_to(got["relative_volume"], v / (v.rolling(20).median() + 1e-10))
    close_to(got["trend_strength_10d"], c.rolling(10).apply(lambda x: np.polyfit(np.arange(10), x, 1)[0]), 1e-7)
    close_to(got["volatility_skew"], lr.rolling(20).std().rolling(60).skew(), 1e-6)
    close_to(got["volume_price_trend"], (c.diff() * v).rolling(5).sum(), 1e-7)


@pytest.mark.parametrize("block", BLOCKS)
def test_exponential_means_match_pandas(spark, series, block):
    a, b = series
    names = ["ema_12", "ema_100", "macd_signal", "rsi_14"]
    got = pull(CORE.compute(frame(spark, a, b), names, block=block), names, "A")
    c = a["close"]
    close_to(got["ema_12"], c.ewm(span=12).mean())
    close_to(got["ema_100"], c.ewm(span=100).mean())
    line = c.ewm(span=12).mean() - c.ewm(span=26).mean()
    close_to(got["macd_signal"], line.ewm(span=9).mean(), 1e-8)
    d = c.diff()
    gain = d.where(d > 0, 0).ewm(alpha=1 / 14, adjust=False).mean()
    loss = d.where(d < 0, 0).abs().ewm(alpha=1 / 14, adjust=False).mean()
    close_to(got["rsi_14"], (100 - 100 / (1 + gain / (loss + 1e-10))).fillna(50), 1e-7)
    assert got["rsi_14"].iloc[0] == 0


def test_exponential_mean_restarts_its_powers(spark):
    """A frame longer than the double range of the powers uses two staggered epochs."""
    a = ohlcv(2500)
    reg = Registry()
    reg.add("e", fast=lambda f: f.ewm("close", alpha=0.7), slow=lambda f: f.ewm_recursive("close", 0.7))
    got = pull(reg.compute(frame(spark, a), ["fast", "slow"], block=4096), ["fast", "slow"])
    close_to(got["fast"], a["close"].ewm(alpha=0.7).mean())
    close_to(got["slow"], a["close"].ewm(alpha=0.7, adjust=False).mean())


@pytest.mark.parametrize("block", BLOCKS)
def test_running_totals_carry_over_blocks(spark, series, block):
    a, b = series
    got = pull(CORE.compute(frame(spark, a, b), ["obv", "obv_normalized"], block=block), ["obv", "obv_normalized"], "A")
    obv = (np.sign(a["close"].diff()).fillna(0) * a["volume"]).cumsum()
    close_to(got["obv"], obv)
    close_to(got["obv_normalized"], obv / (obv.rolling(20).mean() + 1e-10), 1e-7)


def test_running_product_and_maximum(spark, series):
    a, b = series
    reg = Registry()
    reg.add("e", _g=lambda f: 1.0 + f.pct("close") * 0.5)
    reg.running("e", "equity", "_g", "product")
    reg.running("e", "high", "equity", "max")
    got = pull(reg.compute(frame(spark, a, b), ["equity", "high"], block=32), ["equity", "high"], "A")
    eq = (1 + a["close"].pct_change() * 0.5).cumprod()
    close_to(got["equity"], eq)
    close_to(got["high"], eq.cummax())


def test_percent_rank_matches_pandas(spark, series):
    a, _ = series
    reg = Registry()
    reg.add("r", pr=lambda f: f.rank_pct("volume", 50))
    a = a.assign(volume=(a["volume"] // 500))
    got = pull(reg.compute(frame(spark, a), ["pr"], block=64), ["pr"])
    close_to(got["pr"], a["volume"].rolling(50).rank(pct=True))


def test_features_are_causal(spark, series):
    """Cutting the future off changes no earlier value."""
    a, _ = series
    names = ["rsi_14", "macd_histogram", "bb_position", "atr", "obv", "volatility_clustering", "money_flow_index"]
    whole = pull(CORE.compute(frame(spark, a), names, block=32), names)
    cut = pull(CORE.compute(frame(spark, a.head(180)), names, block=32), names)
    close_to(whole.head(180), cut, 1e-8)


def test_row_order_does_not_matter(spark, series):
    a, b = series
    mixed = pd.concat([a, b]).sample(frac=1, random_state=3)
    names = ["sma_5", "rsi_14", "obv"]
    close_to(pull(CORE.compute(frame(spark, mixed), names), names), pull(CORE.compute(frame(spark, a, b), names), names), 1e-9)


def test_positions_count_rows_across_spans(spark, series):
    a, b = series
    df = frame(spark, a, b).drop("pos")
    got = pull(with_positions(df, "month"), ["pos"], "A")
    assert got["pos"].tolist() == list(range(300))


def test_frames_hold_history_and_future(spark):
    df = spark.range(100).selectExpr("'A' AS symbol", "id AS pos")
    rows = framed(df, 7, 3, 20).toPandas()
    for blk in range(5):
        got = sorted(rows[rows["blk"] == blk]["pos"])
        assert got == list(range(max(0, blk * 20 - 7), min(100, (blk + 1) * 20 + 3)))
    assert rows["home"].sum() == 100


def test_degenerate_series(spark):
    one = ohlcv(1, "ONE")
    flat = ohlcv(60, "FLAT").assign(open=5.0, high=5.0, low=5.0, close=5.0, volume=0.0)
    names = ["rsi_14", "bb_position", "williams_r", "volume_ratio", "volatility_clustering", "return_memory"]
    reg = Registry(parent=CORE)
    reg.add("m", return_memory=lambda f: f.time_corr("daily_return", 5))
    got = reg.compute(frame(spark, one, flat), names)
    one_row = pull(got, names, "ONE").iloc[0]
    assert one_row["rsi_14"] == 0 and np.isnan(one_row["bb_position"])
    assert pull(got, names, "FLAT")["return_memory"].dropna().eq(0).all()
    MARKET.compute(frame(spark, one, flat), ["market_stress", "spy_correlation"]).collect()
    MACRO.compute(frame(spark, one, flat), ["vix_level", "vix_percentile"]).collect()


def test_missing_dependency_and_cycle_raise(spark, series):
    df = frame(spark, series[1])
    with pytest.raises(ValueError, match="missing dependency"):
        CORE.compute(df.drop("volume"), ["obv"])
    reg = Registry()
    reg.add("x", p=lambda f: f["q"] + 1, q=lambda f: f["p"] + 1)
    with pytest.raises(ValueError, match="circular"):
        reg.compute(df, ["p"])


def test_one_shuffle_serves_all_layers(spark, series):
    df = frame(spark, *series)
    plan = CORE.compute(df, ["macd_histogram", "stoch_k", "bb_squeeze"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("block", BLOCKS)
def test_recursive_means_cross_gaps(spark, series, block):
    """Single and short NULL runs: the old mean decays for the rows of the gap, and NULL rows keep it."""
    a = series[0].copy()
    holes = [0, 1, 30, 31, 32, 90, 200, 202]
    a.loc[holes, "close"] = np.nan
    reg = Registry()
    reg.add("e", slow=lambda f: f.ewm_recursive("close", 0.2), fast=lambda f: f.ewm_recursive("close", 0.7), norm=lambda f: f.ewm("close", alpha=0.2))
    got = pull(reg.compute(frame(spark, a), ["slow", "fast", "norm"], block=block), ["slow", "fast", "norm"], "A")
    close_to(got["slow"], a["close"].ewm(alpha=0.2, adjust=False).mean())
    close_to(got["fast"], a["close"].ewm(alpha=0.7, adjust=False).mean())
    close_to(got["norm"], a["close"].ewm(alpha=0.2).mean())
