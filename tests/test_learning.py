"""Targets, windows, folds, GARCH and resampling against plain loops."""

import numpy as np
import pandas as pd
import pytest
from helpers import close_to, frame, ohlcv, pull
from pyspark.sql import functions as F

from tickloom.evaluate import significance as sg
from tickloom.learn import sequences as sq, splits as sp
from tickloom.learn.targets import TargetRules, all_targets, fixed_targets, raw_targets
from tickloom.plans.garch import GRID, fitter, garch_fits, garch_volatility
from tickloom.plans.pattern_features import PATTERN, PATTERN_COLUMNS, pattern_matrix

NINE = ["momentum_persistence_7d", "volatility_clustering", "trend_exhaustion", "volume_price_divergence",
        "volatility_regime_change", "returns_1d", "returns_3d", "returns_7d"]


@pytest.fixture(scope="module")
def features(spark):
    return PATTERN.compute(frame(spark, ohlcv(400, "A"), ohlcv(260, "B", 3)), NINE, keep=["close"]).persist()


def test_targets_stay_in_range_and_leave_the_end_empty(spark, features):
    out = all_targets(features).toPandas().sort_values(["symbol", "pos"])
    for c in ["momentum_persistence", "volatility_regime", "trend_exhaustion", "volume_divergence", "pattern_confidence_score"]:
        assert out[c].between(0, 1).all()
    raw = raw_targets(features).toPandas().sort_values("pos")
    for s, n in (("A", 400), ("B", 260)):
        tail = raw[(raw["symbol"] == s) & (raw["pos"] >= n - 5 - 3)]
        assert (tail[["momentum_persistence", "trend_exhaustion", "volume_divergence"]] == 0).all().all()


def test_fixed_volume_target_matches_a_loop(spark, features):
    got = pull(fixed_targets(features), ["volume_divergence_binary"], "A")["volume_divergence_binary"]
    f = pull(features, NINE, "A")
    d, r, n = f["volume_price_divergence"].values, f["returns_1d"].values, len(f)
    want = np.zeros(n)
    for i in range(20, n - 10):
        past = d[i - 20:i]
        past = past[~np.isnan(past)]
        later = r[i + 5:i + 10]
        if len(past) >= 10 and np.abs(past[-5:]).mean() >= 0.2 and later.std() > 0.015:
            want[i] = 1
    close_to(got, want)


def test_future_changes_do_not_reach_the_past_side(spark, features):
    """Rows after the horizon do not change a fixed target."""
    whole = pull(fixed_targets(features), ["momentum_persistence_binary"], "A").head(150)
    cut = pull(fixed_targets(features.where("pos < 200")), ["momentum_persistence_binary"], "A").head(150)
    close_to(whole, cut)


def test_missing_target_columns_raise(features):
    with pytest.raises(ValueError, match="Missing required features"):
        raw_targets(features.drop("close"))


def test_windows_index(spark):
    df = frame(spark, ohlcv(40, "A"))
    out = sq.windows(df, ["pos"], 10, 2, 3, ["pos"]).toPandas().sort_values("start")
    assert out["start"].tolist() == list(range(0, 40 - 10 - 2 + 1, 3))
    for _, row in out.iterrows():
        assert [int(r[0]) for r in row["window"]] == list(range(row["start"], row["start"] + 10))
        assert row["y_pos"] == row["start"] + 11
    train = sq.training_windows(df, ["close"], ["pos"], 10).toPandas()
    assert sorted(train["start"]) == list(range(0, 40 - 10 - 1)) and (train["y_pos"] == train["start"] + 10).all()
    assert sq.portfolio_windows(frame(spark, ohlcv(10, "A")), ["close"]).count() == 0


def test_folds_never_overlap_and_keep_the_gap(spark):
    df = frame(spark, ohlcv(300, "A"), ohlcv(90, "B"))
    for expanding in (True, False):
        out = sp.gapped_folds(df, 4, 0.15, 7, expanding).toPandas()
        for _, part in out.groupby(["symbol", "fold"]):
            train, test = part[part["part"] == "train"]["pos"], part[part["part"] == "test"]["pos"]
            assert train.max() + 7 < test.min() and not set(train) & set(test)
    starts = out[out["part"] == "test"].groupby(["symbol", "fold"])["pos"].min().reset_index()
    assert starts.groupby("symbol")["pos"].is_monotonic_increasing.all()


def test_gap_split_marks_short_series(spark):
    out = sp.gap_split(frame(spark, ohlcv(1200, "A"), ohlcv(100, "B")), 6).toPandas()
    assert set(out[out["symbol"] == "B"]["part"]) == {"insufficient"}
    a = out[out["symbol"] == "A"].groupby("part").size()
    assert a["train"] == 960 and a["gap"] == 180 and a["test"] == 60


def path(w, o, al, be):
    s = [w[:10].var()]
    for x in w[:-1]:
        s.append(max(o + al * x * x + be * s[-1], 1e-8))
    return np.array(s)


def loss(w, o, al, be):
    s = np.maximum(path(w, o, al, be), 1e-8)
    return 0.5 * np.sum(np.log(s) + w**2 / s)


def simulated(n, seed, o, al, be):
    rng, s, out = np.random.default_rng(seed), o / (1 - al - be), []
    for _ in range(n):
        out.append(rng.normal(0, np.sqrt(s)))
        s = o + al * out[-1] ** 2 + be * s
    return np.array(out)


def test_garch_runs_the_recursion_of_its_refits(spark):
    a, flat = ohlcv(140), ohlcv(80, "FLAT").assign(open=5.0, high=5.0, low=5.0, close=5.0)
    bars = frame(spark, a, flat)
    fits = garch_fits(bars).toPandas()
    got = pull(garch_volatility(bars), ["garch_volatility"], "A")["garch_volatility"]
    r = np.log(a["close"] / a["close"].shift(1)).dropna().values
    mine = fits[fits["symbol"] == "A"].set_index("_anchor")
    assert sorted(mine.index) == [30, 50, 75, 100, 125]
    want = np.full(len(a), np.nan)
    for i in range(30, len(r)):
        w = r[max(0, i - 99):i + 1]
        p = mine.loc[30 if i < 50 else i // 25 * 25]
        if i in mine.index:
            assert p["grid_nll"] == pytest.approx(min(loss(w, max(w.var() * (1 - x - y), 1e-8), x, y) for x, y in GRID))
            assert p["nll"] <= p["grid_nll"]
            if p["fitted"]:
                assert p["nll"] == pytest.approx(loss(w, p["omega"], p["alpha"], p["beta"]))
            else:
                assert (p["omega"], p["alpha"], p["beta"]) == (pytest.approx(w.var() * 0.05), 0.05, 0.90)
        want[i + 1] = np.sqrt(path(w, p["omega"], p["alpha"], p["beta"])[-1])
    close_to(got, want, 1e-9)
    still = fits[fits["symbol"] == "FLAT"]
    assert not still["fitted"].any() and (still["omega"] == 0).all() and (still["alpha"] == 0.05).all()


@pytest.mark.parametrize("o,al,be", [(2e-5, 0.15, 0.7), (1e-6, 0.05, 0.93), (5e-4, 0.4, 0.1), (1e-2, 0.0, 0.0)])
def test_garch_fits_are_optima(o, al, be):
    """No small step in any direction raises the likelihood, and the slope left is small; short windows too."""
    windows = [simulated(n, seed, o, al, be) for seed in range(12) for n in (100, 31)]
    sizes = np.array([len(w) for w in windows])
    r = np.zeros((len(windows), 100))
    for k, w in enumerate(windows):
        r[k, :len(w)] = w
    omega, alpha, beta, nll, grid_nll, slope, fitted = fitter()(r, sizes)
    assert (nll <= grid_nll).all()
    inside = fitted & (alpha > 1e-3) & (beta > 1e-3)
    assert (slope[inside] < 0.05).all() and (omega >= 1e-8).all()
    for k in np.flatnonzero(fitted):
        w, base = windows[k], nll[k]
        assert base == pytest.approx(loss(w, omega[k], alpha[k], beta[k]))
        for i in range(3):
            for factor in (0.99, 1.01):
                p = np.array([omega[k], alpha[k], beta[k]])
                p[i] *= factor
                if p[1] + p[2] < 1:
                    assert loss(w, *p) >= base - 1e-3


def test_pattern_matrix_has_no_gaps(spark):
    out = pattern_matrix(frame(spark, ohlcv(150, "A"), ohlcv(120, "B", 9))).toPandas()
    assert len(PATTERN_COLUMNS) == 19 and not out[PATTERN_COLUMNS].isna().any().any()
    assert np.isfinite(out[PATTERN_COLUMNS].values).all()


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(0, 0.01, 300)
    ts = pd.date_range("2020-01-01", periods=300)
    good = pd.DataFrame({"symbol": "GOOD", "ts": ts, "y_true": y, "y_pred": y})
    bad = pd.DataFrame({"symbol": "BAD", "ts": ts, "y_true": y, "y_pred": rng.normal(0, 0.01, 300)})
    return spark.createDataFrame(pd.concat([good, bad])).persist()


def test_perfect_predictions_are_significant_and_random_ones_are_not(predictions):
    out = sg.significance(predictions, draws=60).toPandas().set_index("symbol")
    assert out.loc["GOOD", "recommendation"] == "PASS" and out.loc["BAD", "recommendation"] == "FAIL"


def test_shuffles_are_permutations(spark, predictions):
    table = sg.numbered(predictions)
    pairs = sg.shuffled_pairs(table.select("symbol", "pos", "y_true", "y_pred"), 3, 1).toPandas()
    base = table.toPandas()
    for (s, _), part in pairs.groupby(["symbol", "draw"]):
        close_to(np.sort(part["y_true"]), np.sort(base[base["symbol"] == s]["y_true"]))
        assert (part["y_true"].values != part["y_pred"].values).mean() > 0.5


def test_draws_repeat(predictions):
    a = sg.block_bootstrap(predictions, 20).orderBy("symbol").toPandas()
    b = sg.block_bootstrap(predictions.repartition(3), 20).orderBy("symbol").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_draw_hash_is_uniform(spark):
    h = spark.range(20000).select((sg.draw_hash(42, F.col("id"), F.col("id") % 7) % 10).alias("d")).groupBy("d").count().toPandas()
    assert len(h) == 10 and h["count"].between(1800, 2200).all()
