"""Headline queries, timed once each in a fresh local session: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import Observation, functions as F

from tickloom.queries.catalog import QUERIES
from tickloom.session import local_session

HEADLINE = [
    "bars_hourly", "bars_weekly", "price_shape", "price_averages", "indicator_rsi", "indicator_macd", "indicator_bollinger",
    "momentum", "volatility_shape", "volume_obv", "market_context", "macro_volatility_index", "pattern_features",
    "cross_sectional_features", "rsi_signals", "ensemble_weighted", "targets_fixed", "windows_training", "scaling_robust",
    "folds_gapped", "trading_evaluation", "bootstrap_direction", "quality_report", "feature_checks", "leakage_feature_target",
    "risk_controls",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("tickloom-bench", int(os.environ.get("BENCH_CPUS", "8")))
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in HEADLINE:
        start = time.time()
        seen = Observation(name)
        QUERIES[name].run(spark, folder).observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        rows[name] = seen.get["rows"]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "rows": rows, "rows_per_sec": round(sum(rows.values()) / sum(times.values()), 1),
        "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
