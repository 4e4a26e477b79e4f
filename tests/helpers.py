"""Small seeded series and conversions for tests."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tickloom.operators.clean import nan_to_null

SCHEMA = "symbol string, ts timestamp_ntz, pos bigint, open double, high double, low double, close double, volume double"


def ohlcv(n: int = 300, symbol: str = "A", seed: int = 42, start="2020-01-01") -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 * np.cumprod(1 + rng.normal(0.001, 0.02, n))
    open_ = np.concatenate([[close[0]], close[:-1]])
    high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.01, n))
    low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.01, n))
    return pd.DataFrame({
        "symbol": symbol, "ts": pd.date_range(start, periods=n, freq="D"), "pos": np.arange(n), "open": open_, "high": high,
        "low": low, "close": close, "volume": rng.integers(1000, 9000, n).astype(float),
    })


def frame(spark, *parts: pd.DataFrame):
    """A bar table; missing values are NULL."""
    return nan_to_null(spark.createDataFrame(pd.concat(parts, ignore_index=True), SCHEMA))


def pull(df, columns, symbol=None) -> pd.DataFrame:
    out = df.toPandas().sort_values(["symbol", "ts"])
    if symbol is not None:
        out = out[out["symbol"] == symbol]
    return out[columns].reset_index(drop=True)


def close_to(a, b, tol=1e-9):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    assert a.shape == b.shape
    np.testing.assert_allclose(a, b, rtol=tol, atol=tol, equal_nan=True)
