"""Fits from sums of products, stored window models and resampling, against plain loops and Spark ML."""

import numpy as np
import pandas as pd
import pytest
from helpers import close_to, frame, ohlcv
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tickloom.evaluate import significance as sg
from tickloom.learn import gram, selection as sel, window_models as wm
from tickloom.learn.splits import sized

COLS = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def table(spark):
    """Two symbols, correlated inputs, a constant one, NULLs in an input and in the target."""
    rng = np.random.default_rng(5)
    parts = []
    for symbol, n in (("A", 240), ("B", 130)):
        x = rng.normal(0, 1, (n, 3))
        x[:, 1] += 0.8 * x[:, 0]
        parts.append(pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2020-01-01", periods=n), "pos": np.arange(n), "a": x[:, 0], "b": 5 + x[:, 1], "c": x[:, 2] * 0.01,
                                   "flat": 3.0, "y": 0.4 * x[:, 0] - 0.02 * x[:, 1] + rng.normal(0, 0.3, n)}))
    pdf = pd.concat(parts)
    pdf.loc[pdf["pos"] % 37 == 3, "c"] = None
    pdf.loc[pdf["pos"] % 53 == 7, "y"] = None
    df = spark.createDataFrame(pdf, "symbol string, ts timestamp, pos long, a double, b double, c double, flat double, y double")
    return df.withColumns({x: F.when(~F.isnan(x), F.col(x)) for x in ("c", "y")}).repartition(5)


def local(table):
    return table.toPandas().sort_values(["symbol", "pos"]).fillna({c: 0.0 for c in [*COLS, "y"]})


def test_products_equal_numpy(table):
    pdf = local(table)
    got = gram.products(table, gram.filled(COLS, "y"), ["symbol"]).toPandas()
    for symbol, part in pdf.groupby("symbol"):
        z = np.column_stack([np.ones(len(part)), part[[*COLS, "y"]]])
        for _, cell in got[got["symbol"] == symbol].iterrows():
            close_to((z.T @ z)[cell.i, cell.j], cell.v)
        assert len(got[got["symbol"] == symbol]) == 6 * 7 // 2
    assert gram.products(table.limit(0), gram.filled(COLS, "y")).count() == 0


def test_products_hand_many_groups_on(table, monkeypatch):
    monkeypatch.setattr(gram, "HELD_CELLS", 50)
    got = gram.products(table, gram.filled(["a"], "y"), ["pos"]).where("i = 0 AND j = 0").agg(F.sum("v"), F.count("*")).first()
    assert tuple(got) == (370.0, 240)


def test_fold_errors_equal_a_fit_per_fold(table):
    chosen = {"one": ["a"], "two": ["a", "c"], "all": ["a", "b", "c"]}
    got = {r.method: (r.n_features, r.error) for r in sel.compare_methods(table, chosen, "y").collect()}
    for name, names in chosen.items():
        assert got[name][0] == len(names)
        close_to(got[name][1], sel.fold_error(table, names, "y", LinearRegression(labelCol="y")), 1e-8)
    single = {r.feature: r.score for r in sel.single_scores(table, ["a", "b"], "y").collect()}
    close_to(single["a"], -got["one"][1])


def test_all_penalties_equal_the_ml_fit(spark, table):
    penalties = [0.0001, 0.001, 0.01, 0.1]
    cells = gram.products(table.withColumn("fold", (F.col("pos") % 5).cast("int")), gram.filled(COLS, "y"), ["fold"])
    got = {r.penalty: r for r in gram.lasso_path(cells, [1, 2, 3, 4], 5, penalties).collect()}
    ready = VectorAssembler(inputCols=COLS, outputCol="features").transform(table.fillna(0.0))
    pdf = local(table)
    for p in penalties:
        fit = lambda df: LinearRegression(labelCol="y", elasticNetParam=1.0, regParam=p, maxIter=2000, tol=1e-12).fit(df)
        close_to(got[p].weights, fit(ready).coefficients.toArray(), 1e-6)
        errors = []
        for k in range(5):
            model = fit(ready.where(F.col("pos") % 5 != k))
            test = pdf[pdf["pos"] % 5 == k]
            errors.append(np.sqrt(np.mean((test["y"] - model.intercept - test[COLS] @ model.coefficients.toArray()) ** 2)))
        close_to(got[p].error, np.mean(errors), 1e-6)
        # at the optimum the gradient of every used input equals the penalty, of the others it is smaller
        x = pdf[COLS].to_numpy()
        w, dev = np.array(got[p].weights), x.std(axis=0)
        residual = pdf["y"] - pdf["y"].mean() - (x - x.mean(axis=0)) @ w
        pull = ((x - x.mean(axis=0)).T @ residual) / len(x)
        for k in range(3):
            close_to(pull[k] / dev[k], np.sign(w[k]) * p, 1e-8) if w[k] else None
            assert abs(pull[k] / dev[k]) <= p + 1e-8
    assert got[0.1].weights[3] == 0.0


def test_linear_elimination_equals_a_loop(table):
    pdf, names = local(table), ["a", "b", "c"]
    sizes = pdf.groupby("symbol")["pos"].transform("count")
    step = np.floor(sizes * 0.15)

    def fit(part, cols):
        return np.linalg.lstsq(np.column_stack([np.ones(len(part)), part[cols]]), part["y"], rcond=None)[0]

    left, errors, gone = list(names), [], []
    while left:
        folds = []
        for k in range(3):
            start = sizes - (3 - k) * step
            train, test = pdf[pdf["pos"] < start], pdf[(pdf["pos"] >= start) & (pdf["pos"] < start + step)]
            w = fit(train, left)
            folds.append(np.mean((test["y"] - np.column_stack([np.ones(len(test)), test[left]]) @ w) ** 2))
        errors.append(np.mean(folds))
        weakest = min(left, key=lambda c: abs(fit(pdf, left)[1 + left.index(c)]) * pdf[c].std())
        gone.append(weakest)
        left.remove(weakest)
    kept = gone[int(np.argmin(errors)):]
    got = {r.feature: r.score for r in sel.linear_elimination(table, names, "y").collect()}
    assert got == {f: gone.index(f) + 1 + (3 if f in kept else 0) for f in names}


# -- window models ----------------------------------------------------------------------
@pytest.fixture(scope="module")
def bars(spark):
    return frame(spark, ohlcv(160, "A"), ohlcv(90, "B", 7), ohlcv(4, "C", 9)).withColumn("gain", F.col("close") / F.col("open") - 1)


def test_a_stored_model_scores_the_same_in_another_session(spark, bars, tmp_path):
    path = str(tmp_path / "models")
    windows = wm.landing_windows(bars, ["gain", "volume"], 6, keep=["gain"])
    model = wm.fit_window_model(windows, ["gain", "volume"], 6, "gain", "m")
    wm.save_model(spark, model, path, "1")
    first = wm.model_scores(bars, model).toPandas().sort_values(["symbol", "pos"])
    bars.write.parquet(str(tmp_path / "bars"))

    other = spark.newSession()
    loaded = wm.load_model(other, path, "m")
    again = wm.model_scores(other.read.parquet(str(tmp_path / "bars")), loaded).toPandas().sort_values(["symbol", "pos"])
    assert first["confidence"].tolist() == again["confidence"].tolist()
    assert (first[first["pos"] < 6]["confidence"] == 0).all() and (first[first["symbol"] == "C"]["confidence"] == 0).all()

    pdf = bars.toPandas().sort_values(["symbol", "pos"])
    x, y = [], []
    for _, part in pdf.groupby("symbol"):
        v = part[["gain", "volume"]].to_numpy()
        x += [v[i - 6:i].ravel() for i in range(6, len(v))]
        y += v[6:, 0].tolist()
    w = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    close_to(first[first["pos"] >= 6]["confidence"], np.column_stack([np.ones(len(x)), x]) @ w, 1e-7)


def test_versions_are_kept_and_networks_are_matrix_products(spark, bars, tmp_path):
    path, rng = str(tmp_path / "models"), np.random.default_rng(2)
    net = wm.WindowModel("net", ("gain", "volume"), 4, (
        wm.Layer(rng.normal(0, 0.1, (5, 8)), rng.normal(0, 1, 5), "tanh"), wm.Layer(rng.normal(0, 1, (3, 5)), rng.normal(0, 1, 3), "relu"),
        wm.Layer(rng.normal(0, 1, (1, 3)), np.array([0.3]), "logistic")))
    wm.save_model(spark, net, path, "1")
    wm.save_model(spark, wm.WindowModel("net", ("gain",), 2, (wm.Layer(np.ones((1, 2)), np.zeros(1)),)), path, "2")
    wm.save_model(spark, wm.WindowModel("other", ("gain",), 1, (wm.Layer(np.ones((1, 1)), np.zeros(1)),)), path, "1")
    assert {(r.model_name, r.version, r.units, r.weights) for r in wm.model_versions(spark, path).collect()} == {("net", "1", 9, 58), ("net", "2", 1, 2), ("other", "1", 1, 1)}
    assert wm.load_model(spark, path, "net").version == "2"
    loaded = wm.load_model(spark, path, "net", "1")
    windows = wm.landing_windows(bars.withColumn("volume", F.col("volume") / 9000), ["gain", "volume"], 4)
    got = wm.score_windows(windows, loaded).toPandas()
    for _, row in got.iterrows():
        if row["window"] is None:
            assert np.isnan(row["score"])
            continue
        x = np.concatenate([np.asarray(r, float) for r in row["window"]])
        x = np.maximum(net.layers[1].weights @ np.tanh(net.layers[0].weights @ x + net.layers[0].bias) + net.layers[1].bias, 0)
        close_to(row["score"], 1 / (1 + np.exp(-(net.layers[2].weights @ x + 0.3)))[0])
    with pytest.raises(ValueError):
        wm.load_model(spark, path, "nothing")
    with pytest.raises(ValueError):
        wm.WindowModel("bad", ("gain",), 3, (wm.Layer(np.ones((1, 2)), np.zeros(1)),)).check()


def test_windows_with_nulls_get_no_score(spark, bars):
    holed = bars.withColumn("gain", F.when(F.col("pos") != 20, F.col("gain")))
    model = wm.WindowModel("m", ("gain",), 3, (wm.Layer(np.ones((1, 3)), np.zeros(1)),))
    got = wm.score_windows(wm.landing_windows(holed, ["gain"], 3, fill=False), model).where("symbol = 'A'").toPandas()
    assert sorted(got[got["score"].isna()]["pos"]) == [0, 1, 2, 21, 22, 23]


# -- resampling ---------------------------------------------------------------------------
@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_shuffles_are_bijections_and_spread(size):
    shuffled, x = sg.shuffler(42), np.arange(size)
    seen = np.zeros(size)
    for draw in range(400):
        slots = shuffled(x, size, draw)
        assert np.array_equal(np.sort(slots), x)
        seen[slots[0]] += 1
    if 2 < size < 100:
        assert seen.min() > 0 and seen.max() < 400 / size + 6 * np.sqrt(400 / size)


def test_neighbours_do_not_stay_neighbours():
    shuffled, x = sg.shuffler(7), np.arange(1000)
    gaps = np.concatenate([np.abs(np.diff(shuffled(x, 1000, k))) for k in range(50)])
    assert (gaps == 1).mean() < 0.01 and 300 < gaps.mean() < 366


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2020-01-01", periods=203), "y_true": rng.normal(0, 0.01, 203), "y_pred": rng.normal(0, 0.01, 203)})
    pdf.loc[::17, "y_pred"] = 0.0
    return spark.createDataFrame(pdf)


def test_drawn_rows_are_neither_sorted_nor_ranked(spark, predictions):
    pairs = sg.shuffled_pairs(sg.numbered(predictions), 5, 1)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = pairs.toPandas()
    assert len(got) == 5 * 203 and got["draw"].nunique() == 5


def test_lookups_above_the_bound_are_hash_joins(spark):
    from tickloom.operators.layout import looked_up

    big = spark.range(1000).withColumn("v", F.col("id") * 2)
    plan = looked_up(spark.range(50), big, ["id"], bound=10)
    assert "ShuffledHashJoin" in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 50


def test_block_metrics_equal_a_loop(spark, predictions):
    table = sg.numbered(predictions)
    pdf = table.toPandas().sort_values("pos")
    r, p, n = pdf["y_true"].to_numpy(), pdf["y_pred"].to_numpy(), len(pdf)
    number_hash = sg._number_hash()
    for metric, of in ((sg.direction_metric, lambda a, b: np.mean(np.sign(a) == np.sign(b))),
                       (sg.sharpe_metric, lambda a, b: np.mean(np.sign(b) * a) / np.std(np.sign(b) * a) * np.sqrt(252))):
        got = {x.draw: x.value for x in sg.block_draws(table, 6, 5, 42, metric).collect()}
        assert len(got) == 6
        for draw in range(6):
            a, b = [], []
            for k in range(-(-n // 5)):
                start, other = number_hash(42, draw, k) % (n - 4), number_hash(43, draw, k) % (n - 4)
                a += r[start:start + 5].tolist()
                b += p[other:other + 5].tolist()
            close_to(got[draw], of(np.array(a[:n]), np.array(b[:n])))
