"""Strategies, ensemble and verification on hand-made frames."""

import pandas as pd
import pytest
from helpers import frame, ohlcv
from pyspark.sql import functions as F

from tickloom.operators.clean import nan_to_null
from tickloom.plans.registry import Registry
from tickloom.signals.ensemble import EnsembleRules, apply_filters, batch_flow, combine, default_weights, signal_flow
from tickloom.signals.strategies import MacdRules, PARTS, RsiRules, macd_strategy, rsi_strategy
from tickloom.signals.verification import PatternRules, score_signals, verify_signals


def hand(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2020-01-01", periods=n), "pos": range(n), "close": 100.0, "atr": 2.0, **columns})
    return nan_to_null(spark.createDataFrame(rows))


def run(df, build, rules):
    out = build(rules, parent=Registry()).compute(df, [f"{rules.name}__{p}" for p in PARTS]).toPandas().sort_values("pos")
    return out.rename(columns={f"{rules.name}__{p}": p for p in PARTS})


def test_rsi_entries_exits_and_levels(spark):
    df = hand(spark, rsi_14=[50.0, 25, 20, 45, 75, 80, 55, None, 28])
    out = run(df, rsi_strategy, RsiRules(max_position=1.0))
    assert out["position"].tolist() == [0, 1, 0, 0, -1, 0, 0, 0, 1]
    assert out["entry"].notna().tolist() == [False, True, False, False, True, False, False, False, True]
    assert out["stop"].iloc[1] == 96 and out["target"].iloc[1] == 106
    assert out["stop"].iloc[4] == 104 and out["target"].iloc[4] == 94
    assert out["strength"].iloc[1] == pytest.approx(5 / 30) and out["strength"].iloc[0] == 0


def test_rsi_position_is_clipped_and_filtered(spark):
    df = hand(spark, rsi_14=[50.0, 29, 50, 5])
    out = run(df, rsi_strategy, RsiRules(min_strength=0.5))
    assert out["position"].tolist() == [0, 0, 0, 0.1]


def test_macd_crosses(spark):
    df = hand(spark, macd=[-1.0, 1, 2, -1], macd_signal=[0.0, 0, 0, 0], macd_histogram=[-1.0, 1, 2, -1])
    out = run(df, macd_strategy, MacdRules(max_position=1.0))
    assert out["position"].tolist() == [-1, 1, 0, -1]
    zeroed = run(df, macd_strategy, MacdRules(max_position=1.0, zero_on_cross=True))
    assert zeroed["position"].abs().sum() == 0 and zeroed["entry"].notna().sum() == 3


def test_bad_parameters_raise():
    with pytest.raises(ValueError):
        RsiRules(oversold=45).check()
    with pytest.raises(ValueError):
        PatternRules(bullish=0.4, bearish=0.4).check()


def test_combination_methods(spark):
    df = spark.createDataFrame(
        [("A", 1, 1.0, 0.5, -1.0, 0.25), ("A", 2, 0.0, 0.0, 1.0, 1.0), ("A", 3, None, None, None, None)],
        "symbol string, ts int, a__position double, a__strength double, b__position double, b__strength double")
    w = {"a": 0.6, "b": 0.4}
    avg = combine(df, ["a", "b"], EnsembleRules(w)).orderBy("ts").toPandas()
    assert avg["position"].tolist() == pytest.approx([0.2, 0.4, 0]) and avg["confidence"].tolist() == pytest.approx([0.4, 0.4, 0])
    assert [list(v) for v in avg["active_strategies"]] == [["a", "b"], ["b"], []]
    vote = combine(df, ["a", "b"], EnsembleRules(w, "voting")).orderBy("ts").toPandas()
    assert vote["position"].tolist() == [0, 1, 0]
    dyn = combine(df, ["a", "b"], EnsembleRules(w, "confidence_weighted")).orderBy("ts").toPandas()
    assert dyn["position"].tolist() == pytest.approx([(0.3 - 0.1) / 0.4, 1, 0])
    kept = apply_filters(combine(df, ["a", "b"], EnsembleRules(w)), EnsembleRules(w, min_agreement=2)).orderBy("ts").toPandas()
    assert kept["position"].tolist() == pytest.approx([0.2, 0, 0])
    with pytest.raises(ValueError, match="Unknown combination"):
        combine(df, ["a", "b"], EnsembleRules(w, "none"))
    assert default_weights(["a", "b", "c"]) == {"a": 1.0, "b": 0.5, "c": pytest.approx(1 / 3)}


def test_score_modes_and_verification(spark):
    df = spark.createDataFrame([("A", 1, 10.0, 0.9), ("A", 2, 10.0, 0.5), ("A", 3, 10.0, 0.2)], "symbol string, ts int, close double, confidence double")
    alone = score_signals(df, PatternRules(mode="standalone")).toPandas()["position"].tolist()
    assert alone == pytest.approx([0.75, 0, -0.5])
    signals = spark.createDataFrame([("A", 1, 1.0, 1.0), ("A", 2, -1.0, 1.0), ("A", 3, 1.0, 1.0), ("A", 4, 1.0, 0.5)],
                                    "symbol string, ts int, position double, strength double")
    out = verify_signals(signals, df).orderBy("ts").toPandas()
    assert out["position"].tolist() == pytest.approx([1.12, -1, 0, 1])
    assert out["strength"].tolist() == pytest.approx([1.12, 1, 0, 0.5], rel=1e-6)


def test_flow_drops_symbols_that_are_too_short(spark):
    from helpers import frame

    out = signal_flow(frame(spark, ohlcv(200, "LONG"), ohlcv(20, "SHORT"))).toPandas()
    assert set(out["symbol"]) == {"LONG"} and len(out) == 200


def test_datasets_keep_their_names(spark):
    """Names and symbols with the key's own separator, or without a letter, come back; each dataset gives the flow's own rows."""
    names = ["a", "a/b", "1/a", "", "é/"]
    bars = frame(spark, ohlcv(150, "B/C"), ohlcv(150, "7", 3))
    alone = {(r.symbol, r.ts, r.position, r.confidence) for r in signal_flow(bars).collect()}
    got = batch_flow(bars.withColumn("dataset", F.explode(F.array(*map(F.lit, names))))).collect()
    assert alone and {r.dataset for r in got} == set(names) and len(got) == len(names) * len(alone)
    for name in names:
        assert {(r.symbol, r.ts, r.position, r.confidence) for r in got if r.dataset == name} == alone
