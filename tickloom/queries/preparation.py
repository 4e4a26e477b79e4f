"""Queries over sources, cleaning, alignment and cross-sectional features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..evaluate.strategy import strategy_performance
from ..evaluate.validate import raw_checks
from ..functions.scalar import ratio_or
from ..operators import align as al, clean as cl
from ..operators.fill import backward_fill, fill_both, forward_fill, interpolate
from ..operators.layout import attach_scalar
from ..plans.core_features import CORE
from ..plans.cross_section import (
    ALL_FEATURES, cross_sectional, market_aggregates, neutral_features, sector_aggregates, with_returns,
)
from ..signals.strategies import run_strategy, strategy_returns
from ..sources import chunks as ch, store as st
from . import sql as q
from .base import register, scratch
from .features import RET, hourly, weekly
from .signals import RET_STEPS


# -- sources and sinks ---------------------------------------------------------------
HALF = "TIMESTAMP '2024-01-16'"


def _incremental(s, d):
    """Store the first half, then load everything: only unseen keys are added."""
    path = scratch(s)
    bars = hourly(s, d).drop("pos")
    for part in (bars.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")), bars, bars):
        ch.append_chunks(part, path)
    return s.read.parquet(f"{path}/data")


register("load_incremental", "symbol ts:t | open high low close volume", "SRC3 SRC7", q.stages("hourly"))(_incremental)
register("load_new_rows", "symbol ts:t | close", "SRC3",
         q.stages("hourly", final="SELECT * FROM {prev} WHERE ts >= " + HALF))(
    lambda s, d: st.new_rows(hourly(s, d), hourly(s, d).where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))))
register("tickers_upsert", "symbol name", "SRC4 SRC8",
         q.stages("weekly", final="SELECT DISTINCT symbol, CASE WHEN symbol = 'NATION_1' THEN 'known' ELSE symbol END AS name FROM {prev}"))(
    lambda s, d: st.upsert_tickers(weekly(s, d), s.createDataFrame([("NATION_1", "known", None)], st.SCHEMAS["tickers"])))
register("universe_scan", "symbol ts:t | close:4", "SRC8",
         q.stages("weekly", final="SELECT * FROM {prev} WHERE symbol IN (SELECT n_name FROM nation WHERE n_regionkey = 1)"))(
    lambda s, d: st.in_universe(weekly(s, d), s.read.parquet(f"{d}/nation.parquet").where("n_regionkey = 1").select(F.col("n_name").alias("symbol"))))
register("returns_table", "symbol ts:t | daily_return", "SRC5 PRJ17",
         q.stages("hourly", RET, final="SELECT * FROM {prev} WHERE daily_return IS NOT NULL"))(lambda s, d: st.returns_table(hourly(s, d)))
register("returns_linked", "symbol ts:t linked:i | daily_return", "SRC6",
         q.stages("hourly", RET, final="SELECT *, 1 AS linked FROM {prev} WHERE daily_return IS NOT NULL"))(
    lambda s, d: st.link_returns(st.returns_table(hourly(s, d)), hourly(s, d)).withColumn("linked", F.col("price_id").isNotNull().cast("int")))
register("unique_keys", "symbol n:i", "SRC7", q.stages("hourly", final="SELECT symbol, count(*) AS n FROM {prev} GROUP BY symbol"))(
    lambda s, d: st.unique_rows(hourly(s, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")))
register("market_data_table", "ticker time:t week:t volume:i | close:3 daily_return:6", "SRC9 SRC14",
         q.stages("hourly", RET, final="SELECT symbol AS ticker, ts AS time, date_trunc('week', ts)::TIMESTAMP AS week, volume, close, CAST(daily_return AS DECIMAL(12,8)) AS daily_return FROM {prev}"))(
    lambda s, d: st.market_data(hourly(s, d)))
register("feature_store_long", "symbol ts:t feature_name | feature_value", "SRC10",
         q.stages("hourly", {**RET, "momentum_5d": q.pct("close", 5)},
                  "SELECT symbol, ts, unnest([{{'feature_name': 'daily_return', 'feature_value': daily_return}}, "
                  "{{'feature_name': 'momentum_5d', 'feature_value': momentum_5d}}], recursive := true) FROM {prev}",
                  final="SELECT * FROM {prev} WHERE feature_value IS NOT NULL"))(
    lambda s, d: st.long_features(CORE.compute(hourly(s, d), ["daily_return", "momentum_5d"]), ["daily_return", "momentum_5d"]))
register("feature_store_wide", "symbol ts:t | daily_return momentum_5d", "SRC10",
         q.stages("hourly", {**RET, "momentum_5d": q.pct("close", 5)}, final="SELECT * FROM {prev} WHERE daily_return IS NOT NULL"))(
    lambda s, d: st.wide_features(st.long_features(CORE.compute(hourly(s, d), ["daily_return", "momentum_5d"]),
                                                   ["daily_return", "momentum_5d"]), ["daily_return", "momentum_5d"]))
register("predictions_table", "ticker time:t model_name prediction_type horizon:i | predicted_value confidence", "SRC11",
         q.stages("hourly", {"predicted_value": q.pct("close", 2)}, final="SELECT symbol AS ticker, ts AS time, 'momentum' AS model_name, 'return' AS prediction_type, "
                  "1 AS horizon, predicted_value, least(abs(predicted_value), 1) AS confidence FROM {prev} WHERE predicted_value IS NOT NULL"))(
    lambda s, d: st.prediction_rows(CORE.compute(hourly(s, d), ["momentum_2d"]).dropna(subset=["momentum_2d"])
                                    .withColumn("c", F.least(F.abs("momentum_2d"), F.lit(1.0))), "momentum", "return", 1, "momentum_2d", "c"))
register("backtest_table", "strategy ticker first_time:t last_time:t total_trades:i config | total_return sharpe_ratio max_drawdown win_rate", "SRC12",
         q.stages("weekly", *RET_STEPS, {"eq": f"product(1 + sret) OVER {q.RUN}"}, {"hw": f"max(eq) OVER {q.RUN}"},
                  final="SELECT 'rsi_mean_reversion' AS strategy, symbol AS ticker, min(ts) AS first_time, max(ts) AS last_time, "
                        "'{{\"oversold\":\"30\"}}' AS config, count(*) FILTER (WHERE sret <> 0) AS total_trades, sum(sret) AS total_return, "
                        "coalesce(avg(sret) / nullif(stddev_samp(sret), 0) * sqrt(252.0), 0) AS sharpe_ratio, min((eq - hw) / hw) AS max_drawdown, "
                        "avg((sret > 0)::INT) AS win_rate FROM {prev} GROUP BY symbol"))(lambda s, d: _backtest(s, d))


def _backtest(s, d):
    bars = weekly(s, d)
    perf = strategy_performance(strategy_returns(run_strategy(bars, "rsi_mean_reversion"), bars))
    span = bars.groupBy("symbol").agg(F.min("ts").alias("first_time"), F.max("ts").alias("last_time"))
    return st.backtest_rows(perf, "rsi_mean_reversion", span, {"oversold": 30})


register("model_registry_latest", "model_name version | close", "SRC13",
         q.stages("hourly", final="SELECT symbol AS model_name, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS version, arg_max(close, ts) AS close FROM {prev} GROUP BY symbol"))(
    lambda s, d: st.latest_models(hourly(s, d).select(F.col("symbol").alias("model_name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("version"),
                                                      F.col("ts").alias("created"), "close")))


def _weeks(s, d):
    """Rows of two dates inside weeks, from a table of which one chunk was written again."""
    path = scratch(s)
    bars = hourly(s, d).drop("pos")
    st.write_weekly(bars, path)
    first = F.lit("2024-01-08").cast("timestamp_ntz")
    week = bars.where((F.col("ts") >= first) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")))
    st.write_weekly(week.withColumn("close", F.col("close") * 2), path)
    return st.read_weeks(s, path, "2024-01-10", "2024-01-17")


register("weekly_chunks", "symbol ts:t | close", "SRC14",
         q.stages("hourly", final="SELECT symbol, ts, CASE WHEN ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' THEN close * 2 ELSE close END AS close "
                                  "FROM {prev} WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-18'"))(_weeks)


def _rewritten(s, d):
    """A stored table of which one chunk was written again: all other chunks are as before."""
    path = scratch(s)
    bars = hourly(s, d).drop("pos")
    st.write_weekly(bars, path)
    st.write_weekly(bars.where(F.date_trunc("week", "ts") == F.lit("2024-01-15").cast("timestamp_ntz")).withColumn("volume", F.lit(0.0)), path)
    return s.read.parquet(path)


register("weekly_rewrite", "symbol ts:t week:t | close volume", "SRC14",
         q.stages("hourly", final="SELECT symbol, ts, date_trunc('week', ts)::TIMESTAMP AS week, close, CASE WHEN date_trunc('week', ts) = DATE '2024-01-15' THEN 0 ELSE volume END AS volume FROM {prev}"))(_rewritten)


def _load_job(s, d):
    """Three runs of the load job: the first half of the bars, all bars, and again; the last adds nothing."""
    path, bars = scratch(s), hourly(s, d).drop("pos")
    ch.load_prices(bars.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")), path, "first")
    ch.load_prices(bars, path, "second")
    ch.load_prices(bars, path, "third")
    size = lambda t: s.read.parquet(f"{path}/{t}/data" if t in ("prices", "returns") else f"{path}/{t}").agg(F.count(F.lit(1)).alias(t))
    runs = s.read.parquet(f"{path}/runs").where("status = 'success'").agg(F.count(F.lit(1)).alias("runs"))
    return size("prices").transform(attach_scalar, size("returns")).transform(attach_scalar, size("tickers")).transform(attach_scalar, runs)


register("load_job", "prices:i returns:i tickers:i runs:i", "SRC3 SRC4 SRC6 SRC15",
         q.stages("hourly", RET, final="SELECT count(*) AS prices, count(daily_return) AS returns, count(DISTINCT symbol) AS tickers, 3 AS runs FROM {prev}"))(_load_job)


def _loaded_returns(s, d):
    """Returns that loads linked piece by piece, the last piece late: as if all bars had come at once."""
    path, bars = scratch(s), hourly(s, d).drop("pos")
    part = F.pmod(F.weekofyear("ts"), F.lit(3))
    for k in (0, 2, 1):
        ch.load_prices(bars.where(part == k), path, str(k))
    return s.read.parquet(f"{path}/returns/data")


register("load_returns_pieces", "symbol ts:t linked", "SRC6 SRC15",
         q.stages("hourly", RET, final="SELECT symbol, ts, true AS linked FROM {prev} WHERE daily_return IS NOT NULL"))(
    lambda s, d: _loaded_returns(s, d).withColumn("linked", F.col("price_id").isNotNull()))
register("returns_range", "symbol ts:t pct | daily_return", "SRC16 SRC18 SRC19",
         q.stages("hourly", RET, final="SELECT symbol, ts, printf('%.2f%%', daily_return * 100) AS pct, daily_return FROM {prev} "
                  "WHERE symbol = 'click' AND daily_return IS NOT NULL AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"))(
    lambda s, d: st.returns_range(st.returns_table(hourly(s, d)), "click", "01-05-2024", "01-20-2024").withColumn("pct", st.percent_text("daily_return")))
register("returns_lists", "symbol week:t n:i | total", "SRC17",
         q.stages("hourly", RET, final="SELECT symbol, date_trunc('week', ts)::TIMESTAMP AS week, count(*) AS n, sum(daily_return) AS total FROM {prev} WHERE symbol IN ('click', 'view') "
                  "AND daily_return IS NOT NULL AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2"))(
    lambda s, d: st.returns_lists(st.returns_table(hourly(s, d)), ["click", "view", "none"], "01-05-2024", "01-20-2024")
    .select("symbol", "week", F.size("items").alias("n"), F.aggregate("items", F.lit(0.0), lambda a, x: a + x.daily_return).alias("total")))


def _json(s, d):
    path = scratch(s)
    st.write_report(st.volume_report(st.returns_table(hourly(s, d))).select("symbol", "n_rows", "years"), path)
    return st.read_report(s, path, "symbol string, n_rows bigint, years double")


register("report_json", "symbol n_rows:i | years", "SRC20",
         q.stages("hourly", RET, final="SELECT symbol, count(daily_return) AS n_rows, date_diff('day', (min(ts) FILTER (WHERE daily_return IS NOT NULL))::DATE, max(ts)::DATE) / 365.25 AS years FROM {prev} GROUP BY symbol"))(_json)
register("data_volume_report", "symbol n_rows:i nonzero_returns:i enough | years", "SRC21",
         q.stages("weekly", RET, final="SELECT symbol, count(daily_return) AS n_rows, count(*) FILTER (WHERE daily_return <> 0) AS nonzero_returns, "
                  "count(daily_return) > 15 * 252 * 0.8 AS enough, date_diff('day', (min(ts) FILTER (WHERE daily_return IS NOT NULL))::DATE, max(ts)::DATE) / 365.25 AS years FROM {prev} GROUP BY symbol"))(
    lambda s, d: st.volume_report(st.returns_table(weekly(s, d))))
register("data_readiness", "symbols:i valid_symbols:i ready", "SRC22",
         q.stages("hourly", RET, "SELECT symbol, count(*) FILTER (WHERE abs(daily_return) > 0.5) = 0 AS ok FROM {prev} GROUP BY symbol",
                  final="SELECT count(*) AS symbols, count(*) FILTER (WHERE ok) AS valid_symbols, count(*) FILTER (WHERE ok) >= count(*) * 0.7 AS ready FROM {prev}"))(
    lambda s, d: st.readiness(raw_checks(hourly(s, d)).withColumn("valid", F.col("extreme_moves") == 0)))
register("load_format_check", "symbol n_rows:i valid", "SRC23",
         q.stages("weekly", final="SELECT symbol, count(*) AS n_rows, count(*) >= 350 AS valid FROM {prev} GROUP BY symbol"))(
    lambda s, d: st.format_check(weekly(s, d), 350))

# -- cleaning ---------------------------------------------------------------------------
register("ohlc_rule_counts", "symbol n_rows:i high_below_low:i high_below_price:i low_above_price:i negative_volume:i", "PRJ1 PRJ2",
         q.stages("hourly", final="SELECT symbol, count(*) AS n_rows, count(*) FILTER (WHERE high < low) AS high_below_low, "
                  "count(*) FILTER (WHERE high < open OR high < close) AS high_below_price, count(*) FILTER (WHERE low > open OR low > close) AS low_above_price, "
                  "count(*) FILTER (WHERE volume < 0) AS negative_volume FROM {prev} GROUP BY symbol"))(
    lambda s, d: cl.broken_counts(cl.assert_ohlcv(cl.lower_names(hourly(s, d)))))
# A broken variant of the bars: every 7th high is halved.
BROKEN = {"high2": "CASE WHEN pos % 7 = 0 THEN high / 2 ELSE high END"}
register("valid_bars", "symbol ts:t | open high low close volume", "PRJ3",
         q.stages("hourly", BROKEN, final="SELECT symbol, ts, open, high2 AS high, low, close, volume FROM {prev} WHERE high2 >= low AND high2 >= open "
                  "AND high2 >= close AND low <= open AND low <= close AND volume >= 0 AND open > 0 AND high2 > 0 AND low > 0 AND close > 0"))(
    lambda s, d: cl.valid_bars(hourly(s, d).withColumn("high", F.when(F.col("pos") % 7 == 0, F.col("high") / 2).otherwise(F.col("high")))))


def _far(limit, cols=("open", "high", "low", "close", "volume")):
    return " OR ".join(f"coalesce(abs({c} - avg({c}) OVER (PARTITION BY symbol)) / nullif(stddev_pop({c}) OVER (PARTITION BY symbol), 0) > {limit}, false)" for c in cols)


register("outliers_dropped", "symbol ts:t | open:4 high:4 low:4 close:4 volume", "PRJ4",
         q.stages("weekly", {"far": _far(2.5)}, final="SELECT * FROM {prev} WHERE NOT far"))(lambda s, d: cl.drop_outliers(weekly(s, d), limit=2.5))
register("outliers_nulled", "symbol ts:t | close:4", "PRJ5 PRJ6",
         q.stages("weekly", {"far": _far(2.5, ("close",))}, {"c2": "CASE WHEN NOT far THEN close END"},
                  final=f"SELECT symbol, ts, last_value(c2 IGNORE NULLS) OVER {q.RUN} AS close FROM {{prev}}"))(
    lambda s, d: cl.null_outliers(weekly(s, d), ["close"], 2.5))
# Bars with gaps: closes of every row with pos % 5 in (0, 1) are missing.
GAPPED = {"g": "CASE WHEN pos % 5 > 1 THEN close END"}


def gapped(s, d):
    return hourly(s, d).withColumn("close", F.when(F.col("pos") % 5 > 1, F.col("close")))


FWD = f"last_value(g IGNORE NULLS) OVER {q.RUN}"
BWD = f"first_value(g IGNORE NULLS) OVER ({q.PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
register("fill_forward", "symbol ts:t | close", "PRJ6", q.stages("hourly", GAPPED, final=f"SELECT symbol, ts, {FWD} AS close FROM {{prev}}"))(
    lambda s, d: forward_fill(gapped(s, d), ["close"], span="week"))
register("fill_backward", "symbol ts:t | close", "PRJ7", q.stages("hourly", GAPPED, final=f"SELECT symbol, ts, {BWD} AS close FROM {{prev}}"))(
    lambda s, d: backward_fill(gapped(s, d), ["close"], span="week"))
register("fill_both_ways", "symbol ts:t | close", "PRJ13", q.stages("hourly", GAPPED, final=f"SELECT symbol, ts, coalesce({FWD}, {BWD}) AS close FROM {{prev}}"))(
    lambda s, d: fill_both(gapped(s, d), ["close"], span="week"))
register("fill_interpolated", "symbol ts:t | close", "PRJ8",
         q.stages("hourly", GAPPED, {"pv": FWD, "nv": BWD, "pp": f"max(CASE WHEN g IS NOT NULL THEN pos END) OVER {q.RUN}",
                                     "np": f"min(CASE WHEN g IS NOT NULL THEN pos END) OVER ({q.PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"},
                  final="SELECT symbol, ts, CASE WHEN g IS NOT NULL THEN g WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * ((pos - pp) / (np - pp)) ELSE pv END AS close FROM {prev}"))(
    lambda s, d: interpolate(gapped(s, d), ["close"], span="week"))
register("fill_dropped", "symbol ts:t | close", "PRJ9", q.stages("hourly", GAPPED, final="SELECT * FROM {prev} WHERE g IS NOT NULL"))(
    lambda s, d: cl.fill_gaps(gapped(s, d), ["close"], "drop"))
register("cleaning_statistics", "symbol rows_in:i rows_valid:i rows_kept:i outliers_removed:i | retention", "PRJ10 PRJ24",
         q.stages("weekly", {"far": _far(2.5)}, final="SELECT symbol, count(*) AS rows_in, count(*) AS rows_valid, count(*) FILTER (WHERE NOT far) AS rows_kept, "
                  "count(*) FILTER (WHERE far) AS outliers_removed, count(*) FILTER (WHERE NOT far) / count(*) AS retention FROM {prev} GROUP BY symbol"))(
    lambda s, d: cl.cleaning_stats(weekly(s, d), 2.5))
INFS = {"x": "CASE WHEN pos % 11 = 3 THEN 'inf'::DOUBLE WHEN pos % 11 = 5 THEN '-inf'::DOUBLE WHEN pos % 11 = 7 THEN NULL ELSE close END"}


def with_infs(s, d):
    m = F.col("pos") % 11
    return hourly(s, d).withColumn("close", F.when(m == 3, float("inf")).when(m == 5, float("-inf")).when(m == 7, None).otherwise(F.col("close")))


FIN = "CASE WHEN abs(x) < 'inf'::DOUBLE THEN x END"
register("infinities_nulled", "symbol ts:t | close", "PRJ12 FN14", q.stages("hourly", INFS, final=f"SELECT symbol, ts, {FIN} AS close FROM {{prev}}"))(
    lambda s, d: cl.infinities_to_null(with_infs(s, d)))
register("features_cleaned", "symbol ts:t | close", "PRJ11 FN7",
         q.stages("hourly", INFS, {"f": f"last_value(x IGNORE NULLS) OVER {q.RUN}", "b": f"first_value(x IGNORE NULLS) OVER ({q.PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"},
                  {"y": "coalesce(f, b)"}, {"top": "quantile_cont(CASE WHEN abs(y) < 'inf'::DOUBLE THEN y END, 0.99) OVER (PARTITION BY symbol)"},
                  final="SELECT symbol, ts, CASE WHEN y = 'inf'::DOUBLE THEN top WHEN y = '-inf'::DOUBLE THEN -top ELSE y END AS close FROM {prev}"))(
    lambda s, d: cl.clean_features(with_infs(s, d), ["close"]))
register("fill_median", "symbol ts:t | close", "PRJ25",
         q.stages("hourly", INFS, {"z": FIN}, final=f"SELECT symbol, ts, coalesce(last_value(z IGNORE NULLS) OVER {q.RUN}, first_value(z IGNORE NULLS) OVER "
                  f"({q.PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM {{prev}}"))(lambda s, d: cl.fill_median(with_infs(s, d), ["close"]))
register("zero_safe_division", "symbol ts:t | ratio", "PRJ16",
         q.stages("hourly", final="SELECT symbol, ts, CASE WHEN high - low = 0 THEN 0.5 ELSE (close - low) / (high - low) END AS ratio FROM {prev}"))(
    lambda s, d: hourly(s, d).select("symbol", "ts", ratio_or(F.col("close") - F.col("low"), F.col("high") - F.col("low"), 0.5).alias("ratio")))
for _m, _sql in (("zscore", "(close - avg(close) OVER p) / (stddev_samp(close) OVER p + 1e-10)"),
                 ("minmax", "(close - min(close) OVER p) / (max(close) OVER p - min(close) OVER p + 1e-10)")):
    register(f"normalized_{_m}", "symbol ts:t | close_norm", "PRJ18",
             q.stages("hourly", final=f"SELECT symbol, ts, {_sql} AS close_norm FROM {{prev}} WINDOW p AS (PARTITION BY symbol)"))(
        lambda s, d, m=_m: cl.normalize(hourly(s, d), "close", m))
register("normalized_robust", "symbol ts:t | close_norm", "PRJ18",
         q.stages("hourly", {"m": "quantile_cont(close, 0.5) OVER (PARTITION BY symbol)"}, {"mad": "quantile_cont(abs(close - m), 0.5) OVER (PARTITION BY symbol)"},
                  final="SELECT symbol, ts, (close - m) / (mad + 1e-10) AS close_norm FROM {prev}"))(lambda s, d: cl.normalize(hourly(s, d), "close", "robust"))
register("weekday_calendar", "day:t next_day:t n:i", "PRJ21",
         q.stages("hourly", final="SELECT day::TIMESTAMP AS day, (day + INTERVAL (CASE WHEN isodow(day) = 5 THEN 3 ELSE 1 END) DAY)::TIMESTAMP AS next_day, "
                  "(SELECT count(*) FROM {prev} b WHERE b.ts::DATE = day::DATE) AS n FROM range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY) t(day) WHERE isodow(day) < 6"))(
    lambda s, d: cl.weekdays(s, "2024-01-01", "2024-01-31").join(
        hourly(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")), "day", "left").fillna(0, ["n"])
    .select(F.col("day").cast("timestamp_ntz").alias("day"), F.col("next_day").cast("timestamp_ntz").alias("next_day"), "n"))
register("feature_share_check", "symbol n_rows:i null_cells:i features_found:i passed | null_share", "PRJ22",
         q.stages("hourly", {"sma_20": q.mean("close", 20), "sma_100": q.mean("close", 100)},
                  final="SELECT symbol, count(*) AS n_rows, sum((sma_20 IS NULL)::INT + (sma_100 IS NULL)::INT) AS null_cells, 2 AS features_found, "
                        "sum((sma_20 IS NULL)::INT + (sma_100 IS NULL)::INT) / (count(*) * 2) <= 0.1 AS passed, sum((sma_20 IS NULL)::INT + (sma_100 IS NULL)::INT) / (count(*) * 2) AS null_share FROM {prev} GROUP BY symbol"))(
    lambda s, d: cl.feature_share_check(CORE.compute(hourly(s, d), ["sma_20", "sma_100"]), ["sma_20", "sma_100"]))
register("zero_columns", "symbol ts:t | close flow", "PRJ26", q.stages("hourly", final="SELECT symbol, ts, close, 0 AS flow FROM {prev}"))(
    lambda s, d: cl.zero_columns(hourly(s, d), ["close", "flow"]))

# -- alignment ------------------------------------------------------------------------------
COMMON = "common AS (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars))"


def with_common(text):
    """Insert the common-date step after the bars step."""
    i = text.index(",\ns0 AS (") if ",\ns0 AS (" in text else text.rindex("\nSELECT")
    return text[:i] + ",\n" + COMMON + text[i:]


register("common_dates", "ts:t", "JN1", with_common(q.stages("hourly", final="SELECT ts FROM common")))(lambda s, d: al.require_common_dates(hourly(s, d)))
register("aligned_bars", "symbol ts:t pos:i | close volume", "JN2 JN19",
         with_common(q.stages("hourly", final="SELECT symbol, ts, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM {prev} WHERE ts IN (SELECT ts FROM common)")))(
    lambda s, d: al.align(hourly(s, d)))
register("alignment_report", "symbol n_rows:i missing:i aligned", "JN3",
         q.stages("hourly", final="SELECT symbol, count(*) AS n_rows, (SELECT count(DISTINCT ts) FROM bars) - count(*) AS missing, (SELECT count(DISTINCT ts) FROM bars) = count(*) AS aligned FROM {prev} GROUP BY symbol"))(
    lambda s, d: al.alignment_report(hourly(s, d)))
register("alignment_differences", "ts:t only_in", "JN3",
         q.stages("hourly", final="SELECT ts, 'click' AS only_in FROM {prev} WHERE symbol = 'click' AND ts NOT IN (SELECT ts FROM bars WHERE symbol = 'view') UNION ALL "
                  "SELECT ts, 'view' FROM {prev} WHERE symbol = 'view' AND ts NOT IN (SELECT ts FROM bars WHERE symbol = 'click')"))(
    lambda s, d: al.date_differences(hourly(s, d), "click", "view"))
register("aligned_features", "symbol ts:t | sma_20", "JN4",
         with_common(q.stages("hourly", {"sma_20": q.mean("close", 20)}, final=f"SELECT symbol, ts, coalesce(last_value(sma_20 IGNORE NULLS) OVER {q.RUN}, first_value(sma_20 IGNORE NULLS) OVER "
                              f"({q.PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS sma_20 FROM {{prev}} WHERE ts IN (SELECT ts FROM common)")))(
    lambda s, d: al.align(CORE.compute(hourly(s, d), ["sma_20"]), ["sma_20"]))
register("alignment_statistics", "common_dates:i first_common:t last_common:t", "JN19",
         with_common(q.stages("hourly", final="SELECT count(*) AS common_dates, min(ts) AS first_common, max(ts) AS last_common FROM common")))(
    lambda s, d: al.alignment_stats(hourly(s, d)))
register("sector_lookup", "symbol sector n:i", "JN8",
         q.stages("hourly", final="SELECT symbol, CASE symbol WHEN 'AAPL' THEN 'tech' WHEN 'JPM' THEN 'finance' ELSE 'unknown' END AS sector, count(*) AS n "
                  "FROM (SELECT CASE symbol WHEN 'click' THEN 'AAPL' WHEN 'view' THEN 'JPM' ELSE symbol END AS symbol FROM {prev}) GROUP BY 1, 2"))(
    lambda s, d: al.with_sector(hourly(s, d).replace({"click": "AAPL", "view": "JPM"}, subset=["symbol"])).groupBy("symbol", "sector").agg(F.count(F.lit(1)).alias("n")))
register("date_overlap_pairs", "a b shared:i | overlap", "JN11",
         q.stages("weekly", "SELECT DISTINCT symbol, ts::DATE AS day FROM {prev}", "SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM {prev}",
                  final="SELECT x.symbol AS a, y.symbol AS b, count(*) AS shared, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS overlap FROM {prev} x JOIN {prev} y ON x.day = y.day AND x.symbol < y.symbol GROUP BY 1, 2"))(
    lambda s, d: al.date_overlap(weekly(s, d)))
register("required_symbols_missing", "symbol", "JN16",
         "SELECT n_name AS symbol FROM nation WHERE n_name NOT IN (SELECT n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2)")(
    lambda s, d: al.missing_symbols(weekly(s, d).join(
        s.read.parquet(f"{d}/nation.parquet").where("n_regionkey != 2").select(F.col("n_name").alias("symbol")), "symbol", "left_semi"),
        s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("symbol"))))
register("common_columns", "symbol ts:t | close volume", "JN18", q.stages("weekly"))(
    lambda s, d: weekly(s, d).select(*al.common_columns(weekly(s, d), hourly(s, d))))
register("stacked_series", "symbol ts:t | close:4", "JN17",
         "SELECT symbol, ts, close FROM (" + q.stages("hourly", final="SELECT symbol, ts, close FROM {prev}") + ") UNION ALL SELECT symbol, ts, close FROM (" +
         q.stages("weekly", final="SELECT symbol, ts, close FROM {prev}") + ")")(
    lambda s, d: hourly(s, d).select("symbol", "ts", "close").unionByName(weekly(s, d).select("symbol", "ts", "close")))

# -- cross section ----------------------------------------------------------------------------
register("market_aggregates", "ts:t | market_return market_volume market_volatility market_momentum_5d market_momentum_20d", "XS1",
         with_common(q.stages("weekly", RET, "SELECT ts, avg(daily_return) AS market_return, sum(volume) AS market_volume, stddev_samp(daily_return) AS market_volatility, 0 AS symbol "
                              "FROM {prev} WHERE ts IN (SELECT ts FROM common) GROUP BY ts",
                              {"market_momentum_5d": q.mean("market_return", 5), "market_momentum_20d": q.mean("market_return", 20)})))(
    lambda s, d: market_aggregates(with_returns(weekly(s, d))))
SECTOR_SQL = ("SELECT m.symbol, g.ts, sum(p.daily_return) FILTER (WHERE p.symbol <> m.symbol) / nullif(count(p.daily_return) FILTER (WHERE p.symbol <> m.symbol), 0) AS sector_return, "
              "sum(p.volume) FILTER (WHERE p.symbol <> m.symbol) AS sector_volume, stddev_samp(p.daily_return) FILTER (WHERE p.symbol <> m.symbol) AS sector_volatility "
              "FROM (SELECT DISTINCT symbol, sector FROM s0) m JOIN (SELECT DISTINCT sector, ts FROM s0) g USING (sector) JOIN s0 p ON p.sector = g.sector AND p.ts = g.ts "
              "GROUP BY m.symbol, m.sector, g.ts HAVING count(*) FILTER (WHERE p.symbol <> m.symbol) = (SELECT count(DISTINCT symbol) FROM s0 z WHERE z.sector = m.sector) - 1")
register("sector_aggregates", "symbol ts:t | sector_return sector_volume sector_volatility:5 sector_momentum_5d sector_momentum_20d", "XS2 JN9",
         q.stages("weekly", RET, SECTOR_SQL, {"sector_momentum_5d": q.mean("sector_return", 5), "sector_momentum_20d": q.mean("sector_return", 20)}))(
    lambda s, d: sector_aggregates(with_returns(weekly(s, d))))


def _cov(a, b, n):
    pa, pb = (f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {x} END" for x in (a, b))
    return q.agg(f"covar_samp({pa}, {pb})", pa, 1 - n)


def _xbeta(m):
    return q.guard(f"coalesce({_cov('daily_return', m, 60)}, 0)", f"coalesce({q.agg(f'var_samp({m})', m, -59)}, 1e-8)")


XS_SQL = with_common(q.stages(
    "weekly", RET, SECTOR_SQL,
    {"sector_momentum_5d": q.mean("sector_return", 5), "sector_momentum_20d": q.mean("sector_return", 20)},
    "SELECT b.symbol, b.sector, b.ts, b.daily_return, b.volume, avg(b.daily_return) OVER (PARTITION BY b.ts) AS market_return, sector_return, sector_volume, sector_volatility, "
    "sector_momentum_5d, sector_momentum_20d FROM s0 b LEFT JOIN {prev} x ON x.symbol = b.symbol AND x.ts = b.ts WHERE b.ts IN (SELECT ts FROM common)",
    {"market_correlation_5d": f"coalesce({q.corr('daily_return', 'market_return', 5)}, 0)", "market_correlation_20d": f"coalesce({q.corr('daily_return', 'market_return', 20)}, 0)",
     "sector_correlation_20d": f"coalesce({q.corr('daily_return', 'sector_return', 20)}, 0)", "o20": q.total("daily_return", 20), "k20": q.total("market_return", 20),
     "x20": q.total("sector_return", 20), "beta_to_market": _xbeta("market_return"), "beta_to_sector": _xbeta("sector_return"), "mm20": q.mean("market_return", 20), "sd20": q.std("daily_return", 20)},
    "SELECT a.*, coalesce(p.pm, 0) AS peer_correlation_mean, coalesce(p.px, 0) AS peer_correlation_max, coalesce(p.pn, 0) AS peer_correlation_min FROM {prev} a LEFT JOIN ("
    "SELECT symbol, ts, avg(c) AS pm, max(c) AS px, min(c) AS pn FROM (SELECT symbol, ts, coalesce(" +
    q.corr("daily_return", "pr", 20).replace(q.PART, "PARTITION BY symbol, peer ORDER BY ts") +
    ", 0) AS c FROM (SELECT u.symbol, v.symbol AS peer, u.ts, u.daily_return, v.daily_return AS pr FROM {prev} u JOIN {prev} v ON u.sector = v.sector AND u.ts = v.ts AND u.symbol <> v.symbol)) "
    "GROUP BY 1, 2) p USING (symbol, ts)",
    "SELECT b.symbol, b.ts, b.pos, market_correlation_5d, market_correlation_20d, sector_correlation_20d, peer_correlation_mean, peer_correlation_max, peer_correlation_min, "
    "beta_to_market, beta_to_sector, CASE WHEN c.ts IS NOT NULL THEN coalesce(o20 - k20, 0) END AS relative_strength_market, CASE WHEN c.ts IS NOT NULL THEN coalesce(o20 - x20, 0) END AS relative_strength_sector, "
    "CASE WHEN c.ts IS NOT NULL THEN coalesce(o20 / (abs(k20) + 1e-8 + 1e-10), 1) END AS outperformance_ratio, CASE WHEN c.ts IS NOT NULL THEN coalesce(sector_momentum_5d, 0) END AS sector_momentum_5d, "
    "CASE WHEN c.ts IS NOT NULL THEN coalesce(sector_momentum_20d, 0) END AS sector_momentum_20d, CASE WHEN c.ts IS NOT NULL THEN coalesce(mm20, 0) END AS market_momentum_20d, "
    "CASE WHEN c.ts IS NOT NULL THEN coalesce(c.volume / (sector_volume + 1e-10), 1) END AS relative_volume_sector, "
    "CASE WHEN c.ts IS NOT NULL THEN coalesce(sd20 / (sector_volatility + 1e-10), 1) END AS relative_volatility_sector FROM bars b LEFT JOIN {prev} c USING (symbol, ts)",
    {"cs": q.std("market_correlation_20d", 20), "bs": q.std("beta_to_market", 20), "sq": q.quant("relative_strength_sector", 60, 0.7), "mq": q.quant("relative_strength_market", 60, 0.7)},
    {"correlation_stability": "1 / (coalesce(cs, 1) + 0.1)", "beta_stability": "1 / (coalesce(bs, 1) + 0.1)", "sector_leadership": q.flag("relative_strength_sector > sq"),
     "market_leadership": q.flag("relative_strength_market > mq"), "flow_divergence": "0", "sentiment_divergence": "0"}))
register("cross_sectional_features", "symbol ts:t | " + " ".join(c + ":4" for c in ALL_FEATURES), "XS3 XS4 XS5 XS6 XS7 XS8 XS9 XS10 XS11 XS12 JN10", XS_SQL)(
    lambda s, d: cross_sectional(weekly(s, d)))
register("cross_sectional_neutral", "symbol ts:t | beta_to_market sector_momentum_5d correlation_stability", "XS13",
         q.stages("hourly", final="SELECT symbol, ts, 1 AS beta_to_market, 0 AS sector_momentum_5d, 0.5 AS correlation_stability FROM {prev}"))(
    lambda s, d: neutral_features(hourly(s, d)))
