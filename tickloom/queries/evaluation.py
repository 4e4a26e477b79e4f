"""Queries over metrics, tests, validation and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..evaluate import leakage as lk, metrics as me, significance as sg, validate as va
from ..learn import sequences as sq, splits as sp
from ..learn.targets import fixed_targets
from ..plans.core_features import CORE
from ..plans.pattern_features import GROUPS, pattern_features
from ..plans.registry import Registry
from ..signals.ensemble import signal_pairs
from ..signals.strategies import RsiRules, run_strategies, run_strategy
from . import fit_sql as fs, sql as q
from .base import register
from .features import RET, hourly, weekly
from .learning import P, fixed_steps, nine
from .signals import ALL, NAMES

# -- predictions: truth = next return, prediction = two-row momentum -------------
PRED = ({**RET, "y_pred": q.pct("close", 2)}, {"y_true": q.lead("daily_return")},
        "SELECT * FROM {prev} WHERE y_true IS NOT NULL AND y_pred IS NOT NULL",
        {"x": "CASE WHEN y_pred > 0 THEN y_true WHEN y_pred < 0 THEN -y_true ELSE 0 END", "hit": "(sign(y_true) = sign(y_pred))::INT",
         "i": "row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1"})


def pred(s, d, table=weekly, keep=()):
    return me.prediction_table(table(s, d), keep)


def pq(*steps, final, kind="weekly"):
    return q.stages(kind, *PRED, *steps, final=final)


CORR = ("CASE WHEN stddev_pop({0}) > 0 AND stddev_pop({1}) > 0 THEN corr({0}, {1}) END")
PC = CORR.format("y_true", "y_pred")
EQ = ({"eq": f"product(1 + x) OVER {q.RUN}"}, {"hw": f"max(eq) OVER {q.RUN}"}, {"dd": "(eq - hw) / hw"})
RUNS = ({"grp": f"sum((dd >= 0)::INT) OVER {q.RUN}"},)
DD = "SELECT symbol, abs(min(dd)) AS max_drawdown FROM {prev} GROUP BY symbol"
register("metric_sharpe", "symbol | sharpe_annual sharpe_plain", "PERF1",
         pq(final="SELECT symbol, coalesce((avg(x) * 252 - 0.02) / nullif(stddev_pop(x) * sqrt(252.0), 0), 0) AS sharpe_annual, "
                  "coalesce(avg(x) / nullif(stddev_pop(x), 0), 0) AS sharpe_plain FROM {prev} GROUP BY symbol"))(
    lambda s, d: pred(s, d).groupBy("symbol").agg(me.sharpe_annual(me.traded()).alias("sharpe_annual"), me.sharpe_plain(me.traded()).alias("sharpe_plain")))
register("metric_drawdown", "symbol drawdown_duration:i | max_drawdown", "PERF2 WIN22 WIN23 WIN25",
         pq(*EQ, *RUNS,
            final="SELECT symbol, max_drawdown, coalesce(drawdown_duration, 0) AS drawdown_duration FROM (SELECT symbol, abs(min(dd)) AS max_drawdown FROM {prev} GROUP BY symbol) "
                  "LEFT JOIN (SELECT symbol, max(c) AS drawdown_duration FROM (SELECT symbol, grp, count(*) AS c FROM {prev} WHERE dd < 0 GROUP BY 1, 2) GROUP BY 1) USING (symbol)"))(
    lambda s, d: me.max_drawdown(me._renumber(pred(s, d).select("symbol", "ts", me.traded().alias("x"))), "x"))
register("metric_information_ratio", "symbol | information_ratio excess_ratio", "PERF3",
         pq(final="SELECT symbol, coalesce(avg(y_true) / nullif(stddev_pop(y_true), 0), 0) AS information_ratio, "
                  "coalesce(avg(y_true - y_pred) / nullif(stddev_pop(y_true - y_pred), 0), 0) AS excess_ratio FROM {prev} GROUP BY symbol"))(
    lambda s, d: pred(s, d).groupBy("symbol").agg(me.information_ratio().alias("information_ratio"), me.information_ratio(me.T(), me.P()).alias("excess_ratio")))
register("metric_hit_rate", "symbol | hit_rate hit_rate_significant profit_factor", "PERF4 PERF5",
         pq(final="SELECT symbol, avg(hit) FILTER (WHERE abs(y_true) > 0) * 100 AS hit_rate, avg(hit) FILTER (WHERE abs(y_true) > 0.01) * 100 AS hit_rate_significant, "
                  "sum(greatest(x, 0)) / sum(greatest(-x, 0)) AS profit_factor FROM {prev} GROUP BY symbol"))(
    lambda s, d: pred(s, d).groupBy("symbol").agg(me.hit_rate().alias("hit_rate"), me.hit_rate(0.01).alias("hit_rate_significant"), me.profit_factor().alias("profit_factor")))
register("trading_evaluation", "symbol drawdown_duration:i num_trades:i | total_return:4 annual_return:4 sharpe_ratio max_drawdown:4 hit_rate hit_rate_significant "
         "profit_factor calmar_ratio:4 information_ratio volatility:4", "PERF6 PERF7",
         pq(*EQ, *RUNS, final="SELECT a.*, coalesce(drawdown_duration, 0) AS drawdown_duration FROM (SELECT symbol, sum(x) * 100 AS total_return, avg(x) * 252 * 100 AS annual_return, "
            "(avg(x) * 252 - 0.02) / (stddev_pop(x) * sqrt(252.0)) AS sharpe_ratio, abs(min(dd)) * 100 AS max_drawdown, avg(hit) FILTER (WHERE y_true <> 0) * 100 AS hit_rate, "
            "avg(hit) FILTER (WHERE abs(y_true) > 0.01) * 100 AS hit_rate_significant, sum(greatest(x, 0)) / sum(greatest(-x, 0)) AS profit_factor, avg(x) * 252 / abs(min(dd)) AS calmar_ratio, "
            "avg(y_true) / stddev_pop(y_true) AS information_ratio, stddev_pop(x) * sqrt(252.0) * 100 AS volatility, count(*) FILTER (WHERE abs(y_pred) > 0.001) AS num_trades FROM {prev} GROUP BY symbol) a "
            "LEFT JOIN (SELECT symbol, max(c) AS drawdown_duration FROM (SELECT symbol, grp, count(*) AS c FROM {prev} WHERE dd < 0 GROUP BY 1, 2) GROUP BY 1) USING (symbol)"))(
    lambda s, d: me.trading_evaluation(pred(s, d)))
register("confidence_bands", "symbol level n_above:i | threshold percentage", "PERF8",
         pq({"l": "unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE])"}, "SELECT symbol, l, abs(y_pred) AS a FROM {prev}",
            "SELECT *, quantile_cont(a, 0.5) OVER w AS q5, quantile_cont(a, 0.7) OVER w AS q7, quantile_cont(a, 0.9) OVER w AS q9 FROM {prev} WINDOW w AS (PARTITION BY symbol, l)",
            {"t": "CASE l WHEN 0.5 THEN q5 WHEN 0.7 THEN q7 ELSE q9 END"},
            final="SELECT symbol, l AS level, max(t) AS threshold, avg((a >= t)::INT) * 100 AS percentage, count(*) FILTER (WHERE a >= t) AS n_above FROM {prev} GROUP BY 1, 2"))(
    lambda s, d: me.confidence_bands(pred(s, d)))
REG_SQL = ("count(*) AS n_samples, coalesce(" + PC + ", 0) AS correlation, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred)**2)) AS rmse, "
           "1 - sum((y_true - y_pred)**2) / (var_pop(y_true) * count(*)) AS r_squared, var_pop(y_pred) AS predictions_variance, avg(y_pred) AS predictions_mean, stddev_pop(y_pred) AS predictions_std")
REG_COLS = "n_samples:i | correlation mae rmse r_squared predictions_variance predictions_mean predictions_std"
register("regression_metrics", f"symbol {REG_COLS}", "PERF9 LK10", pq(final=f"SELECT symbol, {REG_SQL} FROM {{prev}} GROUP BY symbol"))(
    lambda s, d: me.regression_metrics(pred(s, d)))
register("regression_metrics_overall", REG_COLS.replace("n_samples:i |", "n_samples:i |"), "LK10",
         pq(final=f"SELECT {REG_SQL} FROM {{prev}}"))(lambda s, d: me.regression_metrics(pred(s, d), ()))
PM = ("avg(((y_true > 0.5) = (y_pred > 0.5))::INT) AS pattern_detection_accuracy, coalesce(" + PC + ", 0) AS correlation, "
      "coalesce(avg(((y_true > 0.5) = (y_pred > 0.5))::INT) FILTER (WHERE y_pred > 0.7), 0) AS pattern_precision, "
      "coalesce(avg(((y_true > 0.5) = (y_pred > 0.5))::INT) FILTER (WHERE y_true > 0.5), 0) AS pattern_recall, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred)**2)) AS rmse")
PM_COLS = "pattern_detection_accuracy correlation pattern_precision pattern_recall mae rmse"
register("pattern_metrics", f"symbol | {PM_COLS}", "PERF10", pq(final=f"SELECT symbol, {PM} FROM {{prev}} GROUP BY symbol"))(lambda s, d: me.pattern_metrics(pred(s, d)))

SPLIT3 = {"n": "count(*) OVER (PARTITION BY symbol)"}, {"sz": "floor(n * 0.2::DOUBLE)::BIGINT"}
FOLD3 = ("SELECT *, (SELECT count(*) FROM range(3) r(j) WHERE j > k AND n - j * (sz + 10) - sz - 10 > 0) AS fold FROM (SELECT *, unnest(range(3)) AS k FROM {prev}) "
         "WHERE n - k * (sz + 10) - sz - 10 > 0 AND i >= n - k * (sz + 10) - sz AND i < n - k * (sz + 10)")


def fold_scores(s, d):
    """Pattern metrics on the test parts of three gapped folds of the prediction rows."""
    table = sg.numbered(pred(s, d))
    return me.pattern_metrics(sp.gapped_folds(table, 3).where("part = 'test'"), ["symbol", "fold"])


register("fold_metrics", f"symbol fold:i | {PM_COLS}", "PERF19", pq(*SPLIT3, FOLD3, final=f"SELECT symbol, fold, {PM} FROM {{prev}} GROUP BY 1, 2"))(fold_scores)
AGG = ("SELECT symbol, unnest([" + ", ".join(f"{{{{'metric': '{m}', 'v': {m}}}}}" for m in PM_COLS.split()) + f"], recursive := true) FROM (SELECT symbol, fold, {PM} FROM {{prev}} GROUP BY 1, 2)",
       "SELECT symbol, metric, avg(v) AS metric_mean, stddev_pop(v) AS metric_std FROM {prev} GROUP BY 1, 2")
register("fold_summary", "symbol metric | metric_mean metric_std", "PERF11 SPL24", pq(*SPLIT3, FOLD3, *AGG, final="SELECT * FROM {prev}"))(
    lambda s, d: me.aggregate_folds(fold_scores(s, d), me.PATTERN_METRICS))
register("readiness_gate", "symbol targets_met:i ready", "PERF12",
         pq(*SPLIT3, FOLD3, *AGG, final="SELECT symbol, count(*) FILTER (WHERE metric_mean >= CASE metric WHEN 'correlation' THEN 0.1 ELSE 0.55 END) AS targets_met, "
            "bool_and(metric_mean >= CASE metric WHEN 'correlation' THEN 0.1 ELSE 0.55 END) AS ready FROM {prev} WHERE metric IN ('correlation', 'pattern_detection_accuracy') GROUP BY symbol"))(
    lambda s, d: me.readiness_gate(me.aggregate_folds(fold_scores(s, d), me.PATTERN_METRICS)))
register("direction_evaluation", "symbol n_samples:i n_correct:i | directional_accuracy ci_lower ci_upper high_magnitude mae mse", "PERF13",
         pq({"q75": "quantile_cont(abs(y_true), 0.75) OVER (PARTITION BY symbol)"},
            final="SELECT symbol, count(*) AS n_samples, sum(hit)::BIGINT AS n_correct, avg(hit) * 100 AS directional_accuracy, greatest(0, (avg(hit) - 1.96 * sqrt(avg(hit) * (1 - avg(hit)) / count(*))) * 100) AS ci_lower, "
                  "least(100, (avg(hit) + 1.96 * sqrt(avg(hit) * (1 - avg(hit)) / count(*))) * 100) AS ci_upper, avg(hit) FILTER (WHERE abs(y_true) > q75) * 100 AS high_magnitude, "
                  "avg(abs(y_true - y_pred)) AS mae, avg((y_true - y_pred)**2) AS mse FROM {prev} GROUP BY symbol"))(lambda s, d: me.direction_evaluation(pred(s, d)))
register("direction_weighted", "symbol | weighted_accuracy up_down_accuracy profit_loss", "PERF14",
         pq(final="SELECT symbol, sum(hit * abs(y_true)) / sum(abs(y_true)) AS weighted_accuracy, (sum(hit) FILTER (WHERE y_true > 0) / (count(*) FILTER (WHERE y_true > 0) + 1e-8) + "
                  "sum(hit) FILTER (WHERE y_true < 0) / (count(*) FILTER (WHERE y_true < 0) + 1e-8)) / 2 AS up_down_accuracy, avg(sign(y_pred) * y_true) AS profit_loss FROM {prev} GROUP BY symbol"))(
    lambda s, d: me.weighted_direction(pred(s, d)))


def _models(s, d):
    base = pred(s, d)
    rows = [base.withColumn("model", F.lit("momentum")), base.withColumn("y_pred", F.lit(0.001)).withColumn("model", F.lit("always_up")),
            base.withColumn("y_pred", -F.col("y_pred")).withColumn("model", F.lit("reversal"))]
    table = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return table.groupBy("symbol", "model").agg((me.match_rate(me.T(), me.P()) * 100).alias("dir_acc"), F.avg(F.abs(me.T() - me.P())).alias("mae"))


register("model_comparison", "symbol best_baseline assessment | baseline_dir_acc model_dir_acc dir_acc_improvement mae_improvement", "PERF15 WIN28",
         pq("SELECT symbol, y_true, unnest([{{'model': 'momentum', 'p': y_pred}}, {{'model': 'always_up', 'p': 0.001}}, {{'model': 'reversal', 'p': -y_pred}}], recursive := true) FROM {prev}",
            "SELECT symbol, model, avg((sign(y_true) = sign(p))::INT) * 100 AS da, avg(abs(y_true - p)) AS mae FROM {prev} GROUP BY 1, 2",
            "SELECT symbol, arg_max(model, (da, model)) FILTER (WHERE model <> 'reversal') AS best_baseline, max(da) FILTER (WHERE model <> 'reversal') AS baseline_dir_acc, "
            "arg_max(mae, (da, model)) FILTER (WHERE model <> 'reversal') AS bm, max(da) FILTER (WHERE model = 'reversal') AS model_dir_acc, max(mae) FILTER (WHERE model = 'reversal') AS mm FROM {prev} GROUP BY symbol",
            final="SELECT *, model_dir_acc - baseline_dir_acc AS dir_acc_improvement, bm - mm AS mae_improvement, CASE WHEN model_dir_acc - baseline_dir_acc > 2 THEN 'outperforms' "
                  "WHEN model_dir_acc - baseline_dir_acc > -2 THEN 'similar' ELSE 'underperforms' END AS assessment FROM {prev}"))(
    lambda s, d: me.compare_models(_models(s, d), "reversal"))
PARTS = ({"n": "count(*) OVER (PARTITION BY symbol)"}, {"part": "CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END"})


def parts(s, d):
    return sp.ratio_split(sg.numbered(pred(s, d)))


register("split_evaluation", "symbol part n_samples:i true_up:i true_down:i pred_up:i pred_down:i | direction_accuracy", "PERF21",
         pq(*PARTS, final="SELECT symbol, part, count(*) AS n_samples, avg(hit) AS direction_accuracy, count(*) FILTER (WHERE y_true > 0) AS true_up, count(*) FILTER (WHERE y_true < 0) AS true_down, "
            "count(*) FILTER (WHERE y_pred > 0) AS pred_up, count(*) FILTER (WHERE y_pred < 0) AS pred_down FROM {prev} GROUP BY 1, 2"))(lambda s, d: me.split_evaluation(parts(s, d)))
register("overfit_labels", "symbol risk generalization | train_val_gap cv_test_gap", "PERF16",
         pq(*PARTS, "SELECT symbol, avg(hit) FILTER (WHERE part = 'train') * 100 AS a, avg(hit) FILTER (WHERE part = 'validation') * 100 AS b, avg(hit) FILTER (WHERE part = 'test') * 100 AS c FROM {prev} GROUP BY symbol",
            final="SELECT symbol, a - b AS train_val_gap, abs(b - c) AS cv_test_gap, CASE WHEN a - b > 10 THEN 'High' WHEN a - b > 5 THEN 'Moderate' ELSE 'Low' END AS risk, "
                  "CASE WHEN abs(b - c) < 2 THEN 'Good' WHEN abs(b - c) < 5 THEN 'Fair' ELSE 'Poor' END AS generalization FROM {prev}"))(
    lambda s, d: me.fit_labels(parts(s, d).groupBy("symbol", "part").agg((me.match_rate(me.T(), me.P()) * 100).alias("accuracy"))))
register("prediction_statistics", "symbol n_samples:i unique_values:i constant n_findings:i | mean std lowest highest median", "PERF17 PERF18 WIN30",
         pq(final="SELECT symbol, count(*) AS n_samples, avg(y_pred) AS mean, stddev_pop(y_pred) AS std, min(y_pred) AS lowest, max(y_pred) AS highest, count(DISTINCT floor(y_pred * 10000 + 0.5)) AS unique_values, "
                  "quantile_cont(y_pred, 0.5) AS median, stddev_pop(y_pred) < 1e-6 AS constant, (stddev_pop(y_pred) < 1e-6)::INT + (count(DISTINCT floor(y_pred * 10000 + 0.5)) < 10)::INT + "
                  "(stddev_pop(y_pred) < stddev_pop(y_true) * 0.1)::INT + (abs(avg(y_pred) - avg(y_true)) > stddev_pop(y_true))::INT AS n_findings FROM {prev} GROUP BY symbol"))(
    lambda s, d: me.prediction_statistics(pred(s, d)).withColumn("n_findings", F.size("findings")))
# Epochs stand for consecutive chunks of 50 prediction rows.
EPOCH = {"epoch": "i // 50"}


def epochs(s, d):
    return sg.numbered(pred(s, d)).withColumn("epoch", F.floor(F.col("pos") / 50))


HIST_SQL = f"SELECT symbol, epoch, coalesce({PC}, 0) AS correlation, var_pop(y_pred) AS prediction_variance FROM {{prev}} GROUP BY 1, 2"
register("correlation_history", "symbol epoch:i alert | correlation prediction_variance", "PERF20",
         pq(EPOCH, HIST_SQL, final="SELECT *, CASE WHEN abs(correlation) > 0.15 THEN 'leakage' WHEN prediction_variance < 1e-6 THEN 'collapse' ELSE 'none' END AS alert FROM {prev}"))(
    lambda s, d: me.correlation_history(epochs(s, d)))
register("metric_progression", "symbol metric trend | first_value last_value lowest highest improvement", "PERF23",
         pq(EPOCH, HIST_SQL, "SELECT symbol, epoch, unnest([{{'metric': 'correlation', 'v': correlation}}, {{'metric': 'prediction_variance', 'v': prediction_variance}}], recursive := true) FROM {prev}",
            "SELECT symbol, metric, arg_min(v, epoch) AS first_value, arg_max(v, epoch) AS last_value, min(v) AS lowest, max(v) AS highest FROM {prev} GROUP BY 1, 2",
            final="SELECT *, last_value - first_value AS improvement, CASE WHEN last_value > first_value THEN 'increasing' ELSE 'decreasing' END AS trend FROM {prev}"))(
    lambda s, d: me.metric_progression(me.correlation_history(epochs(s, d)), ["correlation", "prediction_variance"]))
WALK = ["daily_return", "momentum_2d", "momentum_5d"]
register("walk_forward_scores", f"fold:i | {PM_COLS}", "PERF22 SPL22",
         q.stages("weekly", {**RET, "momentum_2d": q.pct("close", 2), "momentum_5d": q.pct("close", 5)}, {"y_true": q.lead("daily_return")}, *fs.folds(5),
                  "SELECT * FROM {prev} WHERE y_true IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in WALK), *fs.residuals(WALK, "y_true"),
                  "SELECT *, y_true - y_true_r AS y_pred FROM {prev} WHERE part = 'test'", final=f"SELECT k AS fold, {PM} FROM {{prev}} GROUP BY k"))(
    lambda s, d: me.walk_forward_scores(
        CORE.compute(weekly(s, d), WALK).join(pred(s, d).select("symbol", "ts", "y_true"), ["symbol", "ts"]),
        WALK, sp.standard_folds(weekly(s, d)).select("symbol", "ts", "fold", "part")))

# -- resampling tests -------------------------------------------------------------------
def h(seed, *parts):
    """The integer hash as SQL text."""
    out = f"{seed}::BIGINT"
    for k, part in enumerate(parts):
        out = f"(({out}) * 48271 + ({part}) * {69621 + 2 * k} + 12345) % 2147483647"
        for step in ("h * h + 6789", "h * 39373 + 1", "h * h + 97"):
            out = f"list_reduce([({out})::BIGINT], lambda a, b: a)"
            out = f"(list_transform([{out}], lambda h: ({step}) % 2147483647)[1])"
    return out


DRAWS = 1000
BOOT = (
    f"SELECT s.symbol, s.n, g.draw, k.k, {h(42, 'g.draw', 'k.k')} % (s.n - 4) AS a, {h(43, 'g.draw', 'k.k')} % (s.n - 4) AS b FROM (SELECT symbol, count(*) AS n FROM {{prev}} GROUP BY symbol) s, "
    f"range({DRAWS}) g(draw), range(2000) k(k) WHERE k.k < ceil(s.n / 5.0)",
    "SELECT p.symbol, p.draw, (sign(r.y_true) = sign(t.y_pred))::INT AS m, r.y_true AS rv, t.y_pred AS pv FROM {prev} p, range(5) o(o), BASE r, BASE t WHERE p.k * 5 + o.o < p.n AND r.symbol = p.symbol AND r.i = p.a + o.o "
    "AND t.symbol = p.symbol AND t.i = p.b + o.o",
)


def boot(metric):
    last = f"s{len(PRED) - 1}"
    return (BOOT[0], BOOT[1].replace("BASE", last), f"SELECT symbol, draw, {metric} AS v FROM {{prev}} GROUP BY 1, 2")


def null_sql(actual):
    last = f"s{len(PRED) - 1}"
    return (f"SELECT d.symbol, any_value(a.actual) AS actual_performance, avg(v) AS null_mean, stddev_pop(v) AS null_std, avg((v >= a.actual)::INT) AS p_value, count(*) AS draws, "
            f"quantile_cont(v, 0.025) AS ci_lower, quantile_cont(v, 0.975) AS ci_upper, (any_value(a.actual) - avg(v)) / nullif(stddev_pop(v), 0) AS test_statistic, avg((v >= a.actual)::INT) < 0.05 AS significant "
            f"FROM {{prev}} d JOIN (SELECT symbol, {actual} AS actual FROM {last} GROUP BY symbol) a USING (symbol) GROUP BY d.symbol")


NULL_COLS = "symbol draws:i significant | actual_performance null_mean null_std p_value ci_lower ci_upper test_statistic:4"
register("bootstrap_direction", NULL_COLS, "ST1 ST4 UDF3", q.stages("hourly", *PRED, *boot("avg(m)"), final=null_sql("avg(hit)")))(
    lambda s, d: sg.block_bootstrap(pred(s, d, hourly), DRAWS))
SH = "coalesce(avg({0}) / nullif(stddev_pop({0}), 0) * sqrt(252.0), 0)"
register("bootstrap_sharpe", NULL_COLS, "ST1 ST4 UDF3",
         q.stages("hourly", *PRED, *boot(SH.format("CASE WHEN pv > 0 THEN rv WHEN pv < 0 THEN -rv ELSE 0 END")), final=null_sql(SH.format("x"))))(
    lambda s, d: sg.block_bootstrap(pred(s, d, hourly), DRAWS, metric=sg.sharpe_metric))
BINS = ({f"e{i}": f"quantile_cont(abs(y_true), 0.{2 * i}) OVER (PARTITION BY symbol)" for i in (1, 2, 3, 4)},
        {"bin": "len(list_filter(list_distinct([e1, e2, e3, e4]), lambda e: e < abs(y_true)))"})


PRIME, ROUNDS = 2147483647, 16


def perm(by, stat, base):
    """Steps of the permutation test; base: the number of steps before them."""
    b = "".join(f", {c}" for c in by)
    keys = ", ".join(f"{h(43, 'draw', r)} AS k{r}, {h(44, 'draw', r)} % {PRIME - 1} + 1 AS a{r}, {h(45, 'draw', r)} AS b{r}" for r in range(ROUNDS))
    rounds = []
    for r in range(ROUNDS):
        rounds.append({"y": f"(((k{r} - x) % m) + m) % m"})
        rounds.append(f"SELECT * EXCLUDE (y, k{r}, a{r}, b{r}) REPLACE (CASE WHEN (a{r} * (greatest(x, y) % {PRIME}) + b{r}) % {PRIME} * 2 < {PRIME} THEN y ELSE x END AS x) FROM {{prev}}")
    return (
        f"SELECT symbol, i, y_true, y_pred{b}, row_number() OVER (PARTITION BY symbol{b} ORDER BY {h(42, 'i')}, i) - 1 AS slot, count(*) OVER (PARTITION BY symbol{b}) AS m FROM {{prev}}",
        f"SELECT s.symbol{b}, s.y_true, s.m, s.slot AS x, d.* FROM {{prev}} s, (SELECT draw, {keys} FROM range({DRAWS}) g(draw)) d", *rounds,
        f"SELECT r.symbol, r.draw, r.y_true, t.y_pred FROM {{prev}} r JOIN s{base} t ON t.symbol = r.symbol AND t.slot = r.x" + "".join(f" AND t.{c} = r.{c}" for c in by),
        f"SELECT symbol, draw, {stat} AS v FROM {{prev}} GROUP BY 1, 2")


BINNED = len(PRED) + len(BINS)
register("permutation_conditional", NULL_COLS.replace("draws:i", "draws:i bins_used:i"), "ST2",
         q.stages("hourly", *PRED, *BINS, *perm(["bin"], "avg((sign(y_true) = sign(y_pred))::INT)", BINNED),
                  final="SELECT z.*, (SELECT count(DISTINCT bin) FROM s5 WHERE s5.symbol = z.symbol) AS bins_used FROM (" + null_sql("avg(hit)") + ") z"))(
    lambda s, d: sg.conditional_permutation(pred(s, d, hourly), DRAWS))
register("permutation_correlation", NULL_COLS, "ST6",
         q.stages("hourly", *PRED, *perm([], f"abs({PC})", len(PRED)), final=null_sql(f"abs({PC})")))(lambda s, d: sg.correlation_permutation(pred(s, d, hourly), DRAWS))
register("significance_combined", "symbol recommendation | bootstrap_p permutation_p", "ST3 ST17",
         "SELECT a.symbol, a.p_value AS bootstrap_p, b.p_value AS permutation_p, CASE WHEN a.p_value < 0.05 AND b.p_value < 0.05 THEN 'PASS' ELSE 'FAIL' END AS recommendation FROM ("
         + q.stages("hourly", *PRED, *boot("avg(m)"), final=null_sql("avg(hit)")) + ") a JOIN (" +
         q.stages("hourly", *PRED, *BINS, *perm(["bin"], "avg((sign(y_true) = sign(y_pred))::INT)", BINNED), final=null_sql("avg(hit)")) + ") b USING (symbol)")(
    lambda s, d: sg.significance(pred(s, d, hourly), DRAWS))
RANK = {"rt": "rank() OVER (PARTITION BY symbol ORDER BY y_true) + (count(*) OVER (PARTITION BY symbol, y_true) - 1) / 2.0",
        "rp": "rank() OVER (PARTITION BY symbol ORDER BY y_pred) + (count(*) OVER (PARTITION BY symbol, y_pred) - 1) / 2.0"}
register("rank_correlation", "symbol n_samples:i | pearson spearman", "ST5",
         pq(RANK, final=f"SELECT symbol, count(*) AS n_samples, {PC} AS pearson, corr(rt, rp) AS spearman FROM {{prev}} GROUP BY symbol"))(
    lambda s, d: sg.rank_correlation(pred(s, d)))
register("correlation_significance", "symbol n_samples:i | pearson spearman p_value", "ST5",
         "SELECT a.symbol, a.n_samples, a.pearson, a.spearman, b.p_value FROM ("
         + q.stages("hourly", *PRED, RANK, final=f"SELECT symbol, count(*) AS n_samples, {PC} AS pearson, corr(rt, rp) AS spearman FROM {{prev}} GROUP BY symbol") + ") a JOIN ("
         + q.stages("hourly", *PRED, *perm([], f"abs({PC})", len(PRED)), final=null_sql(f"abs({PC})")) + ") b USING (symbol)")(
    lambda s, d: sg.correlation_tests(pred(s, d, hourly), DRAWS))

# -- series statistics ---------------------------------------------------------------------
def acf_sql(x, lags, kind="weekly", pre=(RET,)):
    return q.stages(kind, *pre, f"SELECT symbol, ts, {x} - avg({x}) OVER (PARTITION BY symbol) AS dv FROM {{prev}} WHERE {x} IS NOT NULL",
                    {f"p{k}": f"dv * {q.lag('dv', k)}" for k in range(1, lags + 1)},
                    "SELECT symbol, [" + ", ".join(f"sum(p{k}) / sum(dv * dv)" for k in range(1, lags + 1)) + "] AS a FROM {prev} GROUP BY symbol",
                    final="SELECT symbol, unnest(range(1, {0} + 1)) AS lag, unnest(a) AS acf FROM {{prev}}".format(lags).replace("{{prev}}", "{prev}"))


def rets(s, d, table=weekly):
    return CORE.compute(table(s, d), ["daily_return", "momentum_5d"])


register("autocorrelation", "symbol lag:i | acf", "ST7", acf_sql("daily_return", 20))(lambda s, d: sg.autocorrelation(rets(s, d), "daily_return", 20))
register("temporal_persistence", "symbol significant_lags:i | lag1 lag5", "VAL18",
         f"SELECT symbol, max(acf) FILTER (WHERE lag = 1) AS lag1, max(acf) FILTER (WHERE lag = 5) AS lag5, count(*) FILTER (WHERE abs(acf) > 0.1) AS significant_lags FROM ({acf_sql('daily_return', 20)}) GROUP BY symbol")(
    lambda s, d: sg.temporal_persistence(rets(s, d), "daily_return"))
register("autocorrelation_preservation", "symbol preserved interpretation | avg_difference max_difference", "ST8 ST16",
         "SELECT *, avg_difference < 0.1 AS preserved, CASE WHEN avg_difference < 0.05 THEN 'great' WHEN avg_difference < 0.1 THEN 'good' ELSE 'poor' END AS interpretation FROM "
         f"(SELECT symbol, avg(abs(a.acf - b.acf)) AS avg_difference, max(abs(a.acf - b.acf)) AS max_difference FROM ({acf_sql('daily_return', 20)}) a JOIN "
         f"({acf_sql('m5', 20, pre=({'m5': q.pct('close', 5)},))}) b USING (symbol, lag) GROUP BY symbol)")(
    lambda s, d: sg.acf_preservation(rets(s, d), "daily_return", "momentum_5d"))


def dirsql(where):
    f = f"FILTER (WHERE {where})"
    return (f"CASE WHEN count(*) {f} = 0 THEN 0 WHEN min(sign(y_pred)) {f} = max(sign(y_pred)) {f} THEN CASE WHEN min(sign(y_pred)) {f} = 0 THEN 0 ELSE avg(hit) {f} END "
            f"ELSE coalesce(avg(hit) FILTER (WHERE {where} AND y_true <> 0), 0.5) END")


register("direction_zero_rules", "symbol | direction_accuracy", "ST11", pq(final=f"SELECT symbol, {dirsql('true')} AS direction_accuracy FROM {{prev}} GROUP BY symbol"))(
    lambda s, d: sg.direction_accuracy(pred(s, d)))
REGIME = {"regime": "(i % 5 = 0)::INT"}


def regimes(s, d):
    return sg.numbered(pred(s, d)).withColumn("regime", (F.col("pos") % 5 == 0).cast("int"))


RT = (REGIME, f"SELECT symbol, count(*) FILTER (WHERE regime = 0) AS stable_samples, count(*) FILTER (WHERE regime = 1) AS transition_samples, {dirsql('regime = 0')} AS stable_accuracy, {dirsql('regime = 1')} AS transition_accuracy FROM {{prev}} GROUP BY symbol",
      {"degradation": "CASE WHEN stable_accuracy > 0 THEN (stable_accuracy - transition_accuracy) / stable_accuracy ELSE 1 END"},
      {"validation": "CASE WHEN degradation <= 0.3 THEN 'PASS' ELSE 'FAIL' END", "interpretation": "CASE WHEN degradation < 0.15 THEN 'great' WHEN degradation < 0.3 THEN 'good' ELSE 'poor' END"})
register("regime_transition", "symbol stable_samples:i transition_samples:i validation interpretation | stable_accuracy transition_accuracy degradation", "ST9 ST16",
         pq(*RT, final="SELECT * FROM {prev}"))(lambda s, d: sg.regime_transition(regimes(s, d)))
STRESS = ({"vol": q.agg("stddev_samp(y_true)", "y_true", -19, 0, 10)}, "SELECT * FROM {prev} WHERE vol IS NOT NULL", {"thr": "quantile_cont(vol, 0.8) OVER (PARTITION BY symbol)"},
          f"SELECT symbol, max(thr) AS volatility_threshold, count(*) FILTER (WHERE vol > thr) AS stress_periods, count(*) FILTER (WHERE NOT vol > thr) AS normal_periods, {dirsql('vol > thr')} AS stress_accuracy, {dirsql('NOT vol > thr')} AS normal_accuracy FROM {{prev}} GROUP BY symbol",
          {"validation": "CASE WHEN stress_accuracy >= 0.45 THEN 'PASS' ELSE 'FAIL' END", "interpretation": "CASE WHEN stress_accuracy >= 0.55 THEN 'excellent' WHEN stress_accuracy >= 0.45 THEN 'acceptable' ELSE 'poor' END"})
register("stress_test", "symbol stress_periods:i normal_periods:i validation interpretation | volatility_threshold stress_accuracy normal_accuracy", "ST10 ST16",
         pq(*STRESS, final="SELECT * FROM {prev}"))(lambda s, d: sg.stress_test(pred(s, d)))
register("robustness_suite", "symbol regime_result stress_result recommendation", "ST14",
         "SELECT a.symbol, a.validation AS regime_result, b.validation AS stress_result, CASE WHEN a.validation = 'PASS' AND b.validation = 'PASS' THEN 'PASS' ELSE 'INVESTIGATE' END AS recommendation FROM ("
         + pq(*RT, final="SELECT * FROM {prev}") + ") a JOIN (" + pq(*STRESS, final="SELECT * FROM {prev}") + ") b USING (symbol)")(lambda s, d: sg.robustness(regimes(s, d)))
# One test per symbol; its p-value stand-in is the share of misses.
register("p_value_correction", "test rejected | p_value fdr_p bonferroni_p", "ST12",
         pq("SELECT symbol AS test, avg(1 - hit) / 20 AS p FROM {prev} GROUP BY symbol", {"k": "row_number() OVER (ORDER BY p, test)", "n": "count(*) OVER ()"},
            {"raw": "p * n / k"}, {"fdr": "least(min(raw) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)"},
            final="SELECT test, p AS p_value, fdr AS fdr_p, least(p * n, 1) AS bonferroni_p, fdr <= 0.05 AS rejected FROM {prev}"))(
    lambda s, d: sg.corrected_p_values(pred(s, d).groupBy(F.col("symbol").alias("test")).agg((F.avg(F.when(F.signum("y_true") == F.signum("y_pred"), 0.0).otherwise(1.0)) / 20).alias("p_value"))))
register("effective_tests", "original_n_tests:i effective_n_tests:i | adjusted_alpha adjustment_factor", "ST13", None)(
    lambda s, d: sg.effective_tests(CORE.compute(weekly(s, d), ["daily_return", "momentum_2d", "momentum_5d", "momentum_10d"]), ["daily_return", "momentum_2d", "momentum_5d", "momentum_10d"]))
register("nonlinearity_score", "symbol n_rows:i | nonlinearity_score", "ST15 VAL19",
         q.stages("weekly", {"y": "close - avg(close) OVER (PARTITION BY symbol)", "n": "count(*) OVER (PARTITION BY symbol)"},
                  {"t": "pos - (n - 1) / 2.0"}, {"u": "t * t - avg(t * t) OVER (PARTITION BY symbol)"},
                  final="SELECT symbol, count(*) AS n_rows, greatest(pow(sum(u * y), 2) / sum(u * u) / (sum(y * y) - pow(sum(t * y), 2) / sum(t * t)), 0) AS nonlinearity_score FROM {prev} GROUP BY symbol"))(
    lambda s, d: sg.nonlinearity(weekly(s, d), "close"))

# -- validation ---------------------------------------------------------------------------
GAPS = ({**RET, "gap": f"epoch(ts) - epoch({q.lag('ts')})", "sm": f"(close = {q.lag('close')})::INT", "so": f"(open = {q.lag('open')})::INT", "sh": f"(high = {q.lag('high')})::INT", "sl": f"(low = {q.lag('low')})::INT"},
        {"mid": "quantile_cont(gap, 0.5) OVER (PARTITION BY symbol)", **{f"z_{c}": f"abs({c} - avg({c}) OVER (PARTITION BY symbol)) / nullif(stddev_pop({c}) OVER (PARTITION BY symbol), 0)" for c in ("open", "high", "low", "close", "volume")}})
OUT5 = " + ".join(f"count(*) FILTER (WHERE z_{c} > 5)" for c in ("open", "high", "low", "close", "volume"))
QUALITY = (*GAPS, f"SELECT symbol, count(*) AS total_rows, count(*) FILTER (WHERE gap > mid * 3) AS large_gaps, ({OUT5}) / count(*) * 100 / 5 AS outlier_pct, "
           "(count(*) FILTER (WHERE gap > mid * 3) > 0)::INT + (sum(sm) > count(*) * 0.05)::INT + (sum(so) > count(*) * 0.05)::INT + (sum(sh) > count(*) * 0.05)::INT + (sum(sl) > count(*) * 0.05)::INT AS n_warnings FROM {prev} GROUP BY symbol",
           {"quality_score": "greatest(0, least(1, 1 - n_warnings * 0.05 - outlier_pct / 100 * 0.3))", "n_issues": "0", "missing_pct": "0"})
register("quality_report", "symbol total_rows:i n_issues:i n_warnings:i large_gaps:i | missing_pct outlier_pct quality_score", "VAL1 VAL2", q.stages("hourly", *QUALITY))(
    lambda s, d: va.quality_report(hourly(s, d)).withColumn("n_issues", F.size("issues")).withColumn("n_warnings", F.size("warnings")))
RAWSQL = (*GAPS, "SELECT symbol, count(*) AS total_records, 0 AS invalid_ohlc, count(*) FILTER (WHERE abs(daily_return) > 0.5) AS extreme_moves, count(*) FILTER (WHERE gap > mid * 7) AS large_gaps FROM {prev} GROUP BY symbol",
          {"n_issues": "(extreme_moves > 0)::INT + (large_gaps > 0)::INT"}, {"is_valid": "n_issues = 0"})
register("raw_data_checks", "symbol total_records:i invalid_ohlc:i extreme_moves:i large_gaps:i n_issues:i is_valid", "VAL3", q.stages("weekly", *RAWSQL))(
    lambda s, d: va.raw_checks(weekly(s, d)).withColumn("n_issues", F.size("issues")))
FX = ["daily_return", "momentum_5d", "momentum_10d"]
FXS = {**RET, "momentum_5d": q.pct("close", 5), "momentum_10d": q.pct("close", 10)}


def feats(s, d, table=weekly):
    return CORE.compute(table(s, d), FX, keep=["close"])


LONG = "SELECT symbol, unnest([" + ", ".join(f"{{{{'feature': '{c}', 'v': {c}}}}}" for c in FX) + "], recursive := true) FROM {prev}"
MOM = ("SELECT *, avg(v) OVER (PARTITION BY symbol, feature) AS m, stddev_samp(v) OVER (PARTITION BY symbol, feature) AS sd FROM {prev}",
       "SELECT symbol, feature, count(*) AS n_rows, count(*) FILTER (WHERE v IS NULL) AS nan_count, 0 AS inf_count, count(v) AS n_known, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lowest, max(v) AS highest, "
       "skewness(v) AS skewness, kurtosis(v) AS kurtosis, count(*) FILTER (WHERE v = 0) AS zeros, count(*) FILTER (WHERE abs(v - m) / sd > 6) AS out6, count(*) FILTER (WHERE abs(v - m) / sd > 3) AS out3 FROM {prev} GROUP BY 1, 2")
register("feature_moments", "symbol feature n_rows:i nan_count:i inf_count:i n_known:i zeros:i | mean std lowest highest skewness:5 kurtosis:4", "VAL15 WIN9", q.stages("weekly", FXS, LONG, *MOM))(
    lambda s, d: va.feature_moments(feats(s, d), FX))
PAIRS = ("SELECT symbol, unnest([{{'a': 'daily_return', 'b': 'momentum_5d', 'corr': " + CORR.format("daily_return", "momentum_5d") + "}}, {{'a': 'daily_return', 'b': 'momentum_10d', 'corr': " + CORR.format("daily_return", "momentum_10d") +
         "}}, {{'a': 'momentum_5d', 'b': 'momentum_10d', 'corr': " + CORR.format("momentum_5d", "momentum_10d") + "}}], recursive := true) FROM {prev} GROUP BY symbol")
register("feature_pair_correlations", "symbol a b | corr", "VAL5", q.stages("weekly", FXS, PAIRS))(lambda s, d: va.pair_correlations(feats(s, d), FX))
register("feature_pairs_high", "symbol a b | corr", "VAL5", q.stages("weekly", FXS, PAIRS, final="SELECT * FROM {prev} WHERE abs(corr) > 0.3"))(
    lambda s, d: va.correlated_features(feats(s, d), FX, 0.3))
CHECK = (LONG, *MOM, "SELECT symbol, count(*) AS total_features, count(*) FILTER (WHERE nan_count > n_rows * 0.02) AS nan_features, count(*) FILTER (WHERE lowest = highest) AS constant_features, "
         "count(*) FILTER (WHERE out6 > 0) AS outlier_features, count(*) FILTER (WHERE abs(skewness) > 3) AS skewed_features FROM {prev} GROUP BY symbol")
register("feature_checks", "symbol total_features:i nan_features:i constant_features:i outlier_features:i skewed_features:i correlated_pairs:i n_issues:i", "VAL4",
         q.stages("weekly", FXS, *CHECK, final="SELECT c.*, coalesce(k, 0) AS correlated_pairs, (nan_features > 0)::INT + (constant_features > 0)::INT + (outlier_features > 0)::INT + (coalesce(k, 0) > 0)::INT + "
                  "(skewed_features > total_features * 0.5)::INT AS n_issues FROM {prev} c LEFT JOIN (SELECT symbol, count(*) AS k FROM (" + PAIRS.replace("{prev}", "s0") + ") WHERE abs(corr) > 0.3 GROUP BY 1) USING (symbol)"))(
    lambda s, d: va.feature_checks(feats(s, d), FX, 0.02, 6.0, 0.3).withColumn("n_issues", F.size("issues")))
W20 = q.rows(0, 19)
register("window_checks", "symbol n_windows:i lengths:i nan_windows:i inf_windows:i flat_windows:i partly_flat_windows:i extreme_targets:i n_issues:i | target_std", "VAL6",
         q.stages("hourly", {"a": f"max(close) OVER {W20} = min(close) OVER {W20}", "b": f"max(volume) OVER {W20} = min(volume) OVER {W20}", "y": q.lead("volume", 20), "ok": q.lead("pos", 20)},
                  "SELECT * FROM {prev} WHERE ok IS NOT NULL", {"p1": "quantile_cont(y, 0.01) OVER (PARTITION BY symbol)", "p99": "quantile_cont(y, 0.99) OVER (PARTITION BY symbol)"},
                  "SELECT symbol, count(*) AS n_windows, 1 AS lengths, 0 AS nan_windows, 0 AS inf_windows, count(*) FILTER (WHERE a AND b) AS flat_windows, count(*) FILTER (WHERE a OR b) AS partly_flat_windows, "
                  "stddev_pop(y) AS target_std, count(*) FILTER (WHERE (p1 <> 0 AND y < p1 * 10) OR (p99 <> 0 AND y > p99 * 10)) AS extreme_targets FROM {prev} GROUP BY symbol",
                  final="SELECT *, (flat_windows > n_windows * 0.1)::INT + (target_std = 0)::INT + (extreme_targets > 0)::INT AS n_issues FROM {prev}"))(
    lambda s, d: va.window_checks(sq.windows(hourly(s, d), ["close", "volume"], 20, 1, 1, ["volume"]), "y_volume").withColumn("n_issues", F.size("issues")))
register("prediction_checks", "symbol nan_predictions:i inf_predictions:i n_issues:i | prediction_std directional_accuracy correlation mae", "VAL7",
         pq("SELECT symbol, 0 AS nan_predictions, 0 AS inf_predictions, stddev_pop(y_pred) AS prediction_std, coalesce(avg(hit) FILTER (WHERE y_true <> 0), 0.5) * 100 AS directional_accuracy, "
            f"coalesce({PC}, 0) AS correlation, avg(abs(y_true - y_pred)) AS mae, max(y_true) - min(y_true) AS tr, max(y_pred) - min(y_pred) AS pr FROM {{prev}} GROUP BY symbol",
            final="SELECT *, (prediction_std = 0)::INT + (tr > 0 AND pr > tr * 10)::INT + (directional_accuracy < 45)::INT + (abs(correlation) < 0.1)::INT AS n_issues FROM {prev}"))(
    lambda s, d: va.prediction_checks(pred(s, d)).withColumn("n_issues", F.size("issues")))
# A history per symbol: loss = mean high, val_loss = mean close of each chunk of 25 rows.
HIST = ("SELECT symbol, pos // 25 AS epoch, avg(high) AS loss, avg(close) * 1.1 AS val_loss FROM {prev} GROUP BY 1, 2",)


def history(s, d):
    return hourly(s, d).groupBy("symbol", F.floor(F.col("pos") / 25).alias("epoch")).agg(F.avg("high").alias("loss"), (F.avg("close") * 1.1).alias("val_loss"))


register("training_history_checks", "symbol epochs:i nan_losses:i n_issues:i | initial_loss final_loss max_loss train_val_gap", "VAL8",
         q.stages("hourly", *HIST, {"n": "count(*) OVER (PARTITION BY symbol)"},
                  "SELECT symbol, count(*) AS epochs, 0 AS nan_losses, arg_min(loss, epoch) AS initial_loss, arg_max(loss, epoch) AS final_loss, max(loss) AS max_loss, avg(val_loss - loss) AS train_val_gap, avg(loss) AS m, "
                  "avg(loss) FILTER (WHERE epoch >= n - 10) AS rm, stddev_pop(loss) FILTER (WHERE epoch >= n - 10) AS rs FROM {prev} GROUP BY symbol",
                  final="SELECT *, (final_loss > initial_loss * 5)::INT + (max_loss > initial_loss * 10)::INT + (epochs >= 10 AND rs > rm * 0.5)::INT + (train_val_gap > m * 2)::INT AS n_issues FROM {prev}"))(
    lambda s, d: va.history_checks(history(s, d)).withColumn("n_issues", F.size("issues")))
register("validation_summary", "total_issues:i overall_status", "VAL9",
         q.stages("weekly", *RAWSQL, final="SELECT sum(n_issues) AS total_issues, CASE WHEN bool_and(is_valid) THEN 'PASS' ELSE 'FAIL' END AS overall_status FROM {prev}"))(
    lambda s, d: va.summary(va.raw_checks(weekly(s, d))))
register("validation_verdict", "symbol verdict n_issues:i", "VAL32",
         q.stages("weekly", *RAWSQL, final="SELECT symbol, CASE WHEN n_issues > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, n_issues FROM {prev}"))(
    lambda s, d: va.verdict(va.raw_checks(weekly(s, d))))
register("column_quality", "symbol feature nan_count:i inf_count:i low_variance", "VAL10",
         q.stages("weekly", FXS, LONG, *MOM, final="SELECT symbol, feature, nan_count, inf_count, abs(highest - lowest) < 1e-10 AS low_variance FROM {prev}"))(lambda s, d: va.column_checks(feats(s, d), FX))
READY = (*GAPS, "SELECT symbol, count(*) AS n_rows, count(*) FILTER (WHERE gap > mid * 5) AS large_gaps, (count(*) FILTER (WHERE gap > mid * 5) > count(*) * 0.05)::INT + " +
         " + ".join(f"(count(*) FILTER (WHERE z_{c} > 5) > count(*) * 0.01)::INT" for c in ("open", "high", "low", "close", "volume")) + " AS n_warnings, count(*) >= 100 AS pattern_ready FROM {prev} GROUP BY symbol")
register("pattern_readiness", "symbol n_rows:i large_gaps:i n_warnings:i pattern_ready", "VAL12", q.stages("hourly", *READY))(
    lambda s, d: va.pattern_readiness(hourly(s, d)).withColumn("n_warnings", F.size("warnings")))
DIST = (RET, "SELECT symbol, avg(daily_return) AS mean, stddev_samp(daily_return) AS std, skewness(daily_return) AS skew, kurtosis(daily_return) AS kurtosis, count(daily_return) AS n FROM {prev} GROUP BY symbol",
        {"divergent": "abs(skew) > 2 * (SELECT quantile_cont(abs(skew), 0.9) FROM s1)"})
register("return_distributions", "symbol n:i divergent | mean std skew:5 kurtosis:4", "VAL13", q.stages("weekly", *DIST))(lambda s, d: va.return_distributions(weekly(s, d)))
register("date_range_advice", "first_day:t last_day:t span_days:i before_2010 very_long", "VAL14",
         q.stages("weekly", final="SELECT min(ts)::DATE AS first_day, max(ts)::DATE AS last_day, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS span_days, min(ts)::DATE < DATE '2010-01-01' AS before_2010, "
                  "date_diff('day', min(ts)::DATE, max(ts)::DATE) > 365 * 15 AS very_long FROM {prev}"))(lambda s, d: va.range_advice(weekly(s, d)))
OVERLAP = ("(SELECT min(o) FROM (SELECT count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS o FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT DISTINCT symbol, ts::DATE AS day FROM bars)) x JOIN "
           "(SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT DISTINCT symbol, ts::DATE AS day FROM bars)) y ON x.day = y.day AND x.symbol < y.symbol GROUP BY x.symbol, y.symbol))")
register("cross_consistency", "divergent_symbols:i consistent | min_overlap", "VAL31", q.stages("weekly", *DIST, final=f"SELECT {OVERLAP} AS min_overlap, count(*) FILTER (WHERE divergent) AS divergent_symbols, {OVERLAP} >= 0.8 AS consistent FROM {{prev}}"))(
    lambda s, d: va.cross_consistency(weekly(s, d)))
register("portfolio_check", "total_tickers:i failed_tickers:i missing_tickers:i consistent overall_valid", "VAL11",
         "SELECT *, failed_tickers = 0 AND consistent AND missing_tickers = 0 AS overall_valid FROM (" +
         q.stages("hourly", *QUALITY, final=f"SELECT count(*) AS total_tickers, count(*) FILTER (WHERE NOT (quality_score > 0.5 AND total_rows >= 100)) AS failed_tickers, {OVERLAP} >= 0.8 AS consistent, 1 AS missing_tickers FROM {{prev}}") + ")")(
    lambda s, d: va.portfolio_check(hourly(s, d), s.createDataFrame([("click",), ("absent",)], "symbol string")))
register("portfolio_summary", "symbol n_rows:i first_ts:t last_ts:t | mean_return std_return min_close:4 max_close:4 null_share", "VAL16",
         q.stages("weekly", RET, final="SELECT symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, avg(daily_return) AS mean_return, stddev_samp(daily_return) AS std_return, min(close) AS min_close, max(close) AS max_close, "
                  "avg((daily_return IS NULL)::INT) AS null_share FROM {prev} GROUP BY symbol"))(lambda s, d: va.portfolio_summary(weekly(s, d)))
MICRO = {"intraday_range_expansion": f"(high - low) / (({q.mean('(high - low)', 20)}) + 1e-8)", "overnight_gap_behavior": f"(open - {q.lag('close')}) / {q.lag('close')}", "end_of_day_momentum": "(close - low) / (high - low + 1e-8)", "vix_term_structure": "0.0"}
register("pattern_category_checks", "symbol feature category n_known:i n_issues:i | zero_ratio", "VAL17 VAL20 VAL21",
         q.stages("hourly", MICRO, "SELECT symbol, unnest([{{'feature': 'intraday_range_expansion', 'category': 'market_microstructure', 'v': intraday_range_expansion}}, {{'feature': 'overnight_gap_behavior', 'category': 'market_microstructure', 'v': overnight_gap_behavior}}, "
                  "{{'feature': 'end_of_day_momentum', 'category': 'market_microstructure', 'v': end_of_day_momentum}}, {{'feature': 'vix_term_structure', 'category': 'cross_asset_relationships', 'v': vix_term_structure::DOUBLE}}], recursive := true) FROM {prev}",
                  final="SELECT symbol, feature, category, count(v) AS n_known, avg((v = 0)::INT) AS zero_ratio, CASE feature WHEN 'intraday_range_expansion' THEN (min(v) < 0 OR max(v) > 20)::INT WHEN 'overnight_gap_behavior' THEN (max(abs(v)) > 0.5)::INT "
                        "WHEN 'end_of_day_momentum' THEN (min(v) < 0 OR max(v) > 1)::INT ELSE 1 END AS n_issues FROM {prev} GROUP BY 1, 2, 3"))(
    lambda s, d: va.category_checks(
        pattern_features(hourly(s, d), columns=["intraday_range_expansion", "overnight_gap_behavior", "end_of_day_momentum", "vix_term_structure"]),
        {"market_microstructure": GROUPS["market_microstructure"], "cross_asset_relationships": ["vix_term_structure"]}).withColumn("n_issues", F.size("issues")))
register("distribution_report", "symbol feature outliers:i | mean std skewness:5 kurtosis:4 lowest highest outlier_ratio", "VAL22",
         q.stages("weekly", FXS, LONG, *MOM, final="SELECT *, out3 AS outliers, out3 / n_known AS outlier_ratio FROM {prev}"))(lambda s, d: va.distribution_report(feats(s, d), FX))
TGT = (RET, "SELECT symbol, count(*) AS n_rows, avg(daily_return) AS mean, stddev_pop(daily_return) AS std, count(*) FILTER (WHERE daily_return IS NULL) AS nan_count FROM {prev} GROUP BY symbol",
       {"spread": "max(mean) OVER () - min(mean) OVER ()"}, {"target_issues": "(abs(mean) > 0.01)::INT + (std > 0.1)::INT + (nan_count > 0)::INT + (spread > 0.005)::INT"})
register("target_construction_check", "symbol n_rows:i nan_count:i n_issues:i | mean std match_corr", "VAL23", q.stages("weekly", *TGT, final="SELECT *, 1 AS match_corr, target_issues AS n_issues FROM {prev}"))(
    lambda s, d: va.target_construction(feats(s, d)).withColumn("n_issues", F.size("issues")))
SCI = "(abs(mean) > 2)::INT + (std * sqrt((n_known - 1) / n_known) > 5 OR std * sqrt((n_known - 1) / n_known) < 0.1)::INT + (abs(lowest) > 10 OR abs(highest) > 10)::INT + (nan_count > 0)::INT"
register("scaling_check", "symbol feature nan_count:i n_issues:i | mean std lowest highest", "VAL24",
         q.stages("weekly", FXS, LONG, *MOM, final=f"SELECT symbol, feature, nan_count, mean, std * sqrt((n_known - 1) / n_known) AS std, lowest, highest, {SCI} AS n_issues FROM {{prev}}"))(
    lambda s, d: va.scaling_checks(feats(s, d), FX).withColumn("n_issues", F.size("issues")))
BEH = ("SELECT symbol, avg(y_true) AS true_mean, stddev_pop(y_true) AS true_std, avg(y_pred) AS pred_mean, stddev_pop(y_pred) AS pred_std, " + PC + " AS correlation, avg(hit) AS directional_accuracy FROM {prev} GROUP BY symbol")
register("prediction_behaviour", "symbol n_issues:i | true_mean true_std pred_mean pred_std correlation directional_accuracy", "VAL25",
         pq(BEH, final="SELECT *, (pred_std < true_std * 0.1)::INT + (pred_std > true_std * 3)::INT + (abs(pred_mean - true_mean) > abs(true_mean) * 2)::INT + (correlation IS NULL)::INT + coalesce((correlation < 0.01)::INT, 0) + (directional_accuracy < 0.52)::INT AS n_issues FROM {prev}"))(
    lambda s, d: va.prediction_behaviour(pred(s, d)).withColumn("n_issues", F.size("issues")))
register("training_check_suite", "symbol target_issues:i scaling_issues:i passed", "VAL26",
         "SELECT a.symbol, a.target_issues, b.scaling_issues, a.target_issues + b.scaling_issues = 0 AS passed FROM (" + q.stages("weekly", *TGT) + ") a JOIN (" +
         q.stages("weekly", FXS, LONG, *MOM, final=f"SELECT symbol, sum({SCI}) AS scaling_issues FROM {{prev}} GROUP BY symbol") + ") b USING (symbol)")(lambda s, d: va.training_suite(feats(s, d), FX))
register("strategy_data_check", "symbol data_points:i last_ts:t age_days:i n_issues:i | feature_coverage", "VAL27",
         q.stages("hourly", final="SELECT symbol, count(*) AS data_points, max(ts) AS last_ts, date_diff('day', max(ts)::DATE, DATE '2024-03-15') AS age_days, 5 / 7.0 AS feature_coverage, "
                  "(count(*) < 252)::INT + (date_diff('day', max(ts)::DATE, DATE '2024-03-15') > 30)::INT + 1 AS n_issues FROM {prev} GROUP BY symbol"))(
    lambda s, d: va.strategy_data_check(hourly(s, d), RsiRules().needs, as_of="2024-03-15").withColumn("n_issues", F.size("issues")))
register("signal_check", "symbol total_signals:i non_zero_signals:i invalid_positions:i n_issues:i | signal_frequency", "VAL28",
         q.stages("weekly", *ALL, final="SELECT symbol, count(*) AS total_signals, count(*) FILTER (WHERE r_pos <> 0) AS non_zero_signals, 0 AS invalid_positions, avg((r_pos <> 0)::INT) AS signal_frequency, "
                  "(avg((r_pos <> 0)::INT) = 0)::INT + (avg((r_pos <> 0)::INT) > 0.5)::INT + (avg((r_pos <> 0)::INT) > 0 AND avg((r_pos <> 0)::INT) < 0.01)::INT AS n_issues FROM {prev} GROUP BY symbol"))(
    lambda s, d: va.signal_check(run_strategy(weekly(s, d), "rsi_mean_reversion"), 0.1).withColumn("n_issues", F.size("issues")))
register("signal_diversity", "symbol n_pairs:i high_pairs:i diverse", "VAL29",
         q.stages("weekly", *ALL, final="SELECT symbol, 1 AS n_pairs, coalesce((abs(corr(r_pos, m_pos)) > 0.05)::INT, 0) AS high_pairs, coalesce((abs(corr(r_pos, m_pos)) > 0.05)::INT, 0) = 0 AS diverse FROM {prev} GROUP BY symbol"))(
    lambda s, d: va.diversity_check(signal_pairs(run_strategies(weekly(s, d)), NAMES), 0.05))
register("backtest_readiness", "symbol raw_issues:i n_rows:i span_days:i ready", "VAL30",
         "SELECT symbol, n_issues AS raw_issues, total_records AS n_rows, span AS span_days, false AS ready FROM (" + q.stages("weekly", *RAWSQL) + ") JOIN (" +
         q.stages("weekly", final="SELECT symbol, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS span FROM {prev} GROUP BY symbol") + ") USING (symbol)")(
    lambda s, d: va.backtest_readiness(CORE.compute(weekly(s, d), ["rsi_14", "atr"], keep=["open", "high", "low", "close", "volume"]), RsiRules().needs))

# -- leakage ------------------------------------------------------------------------------
LKB = ({**FXS}, {"y": q.lead("daily_return")})
LKR = ("SELECT symbol, unnest([" + ", ".join(f"{{{{'feature': '{c}', 'correlation': coalesce(CASE WHEN stddev_pop({c}) FILTER (WHERE y IS NOT NULL) > 1e-5 AND stddev_pop(y) FILTER (WHERE {c} IS NOT NULL) > 1e-5 THEN corr({c}, y) END, 0), 'valid_samples': count(*) FILTER (WHERE {c} IS NOT NULL AND y IS NOT NULL)}}}}" for c in FX)
       + "], recursive := true) FROM {prev} GROUP BY symbol")
SEV = {"severity": "CASE WHEN abs(correlation) > {1} THEN 'CRITICAL' WHEN abs(correlation) > {0} THEN 'WARNING' ELSE 'NORMAL' END", "suspicious": "abs(correlation) > {0}"}


def sev(a, b):
    return {k: v.replace("{0}", str(a)).replace("{1}", str(b)) for k, v in SEV.items()}


def with_next(s, d):
    reg = Registry(parent=CORE)
    reg.add("next", y=lambda f: f.lead("daily_return"))
    return reg.compute(weekly(s, d), [*FX, "y"], keep=["close"])


LK_COLS = "symbol feature valid_samples:i severity suspicious | correlation"
register("leakage_feature_target", LK_COLS, "LK1", q.stages("weekly", *LKB, LKR, sev(0.1, 0.15)))(lambda s, d: lk.feature_target(with_next(s, d), FX, "y"))
register("leakage_summary", "symbol features_checked:i suspicious_features:i critical_features:i leakage_detected worst_feature | max_correlation mean_correlation", "LK4",
         q.stages("weekly", *LKB, LKR, sev(0.1, 0.15), final="SELECT symbol, count(*) AS features_checked, count(*) FILTER (WHERE suspicious) AS suspicious_features, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_features, "
                  "max(abs(correlation)) AS max_correlation, avg(abs(correlation)) AS mean_correlation, arg_max(feature, (abs(correlation), feature)) AS worst_feature, bool_or(suspicious) AS leakage_detected FROM {prev} GROUP BY symbol"))(
    lambda s, d: lk.leakage_summary(lk.feature_target(with_next(s, d), FX, "y")))


def overlap_windows(s, d):
    return sq.windows(feats(s, d, hourly), ["daily_return", "momentum_5d"], 20, 1, 1, ["close"])


OV = ({**RET, "momentum_5d": q.pct("close", 5)}, {"a": "coalesce(daily_return, 0)", "b": "coalesce(momentum_5d, 0)", "y": q.lead("close", 20), "ok": q.lead("pos", 20)})
OVC = ("SELECT x.symbol, x.pos - o.o AS k, x.{0} AS u, z.{0} AS v FROM s1 x JOIN s1 z ON z.symbol = x.symbol AND z.pos = x.pos + 1 JOIN (SELECT symbol, count(*) AS n FROM s1 GROUP BY symbol) t ON t.symbol = x.symbol, "
       "range(20) o(o) WHERE x.pos - o.o BETWEEN 0 AND t.n - 22")
OVS = ("SELECT w.symbol, count(*) AS total_sequences, coalesce(any_value(p.c), 0) AS mean_sequence_correlation, "
       "coalesce(abs(corr(y, y1)), 0) AS autocorr_1, coalesce(abs(corr(y, y2)), 0) AS autocorr_2 FROM (SELECT *, lead(y, 1) OVER (PARTITION BY symbol ORDER BY ts) AS y1, lead(y, 2) OVER (PARTITION BY symbol ORDER BY ts) AS y2 FROM {prev} WHERE ok IS NOT NULL) w "
       f"LEFT JOIN (SELECT symbol, avg(c) AS c FROM (SELECT symbol, k, abs(corr(u, v)) AS c FROM ({OVC.format('a')} UNION ALL {OVC.format('b')}) GROUP BY symbol, k) GROUP BY symbol) p ON p.symbol = w.symbol GROUP BY w.symbol",
       {"overlap_percentage": "95", "data_reuse_factor": "20", "leakage_risk": "CASE WHEN mean_sequence_correlation > 0.8 OR greatest(autocorr_1, autocorr_2) > 0.3 THEN 'HIGH' ELSE 'MEDIUM' END"})
register("leakage_window_overlap", "symbol total_sequences:i leakage_risk | mean_sequence_correlation:5 autocorr_1 autocorr_2 overlap_percentage data_reuse_factor", "LK2", q.stages("hourly", *OV, *OVS))(
    lambda s, d: lk.window_overlap(overlap_windows(s, d), "y_close", 20, 1))
register("leakage_recommendations", "symbol leakage_risk n:i", "LK4", q.stages("hourly", *OV, *OVS, final="SELECT symbol, leakage_risk, CASE leakage_risk WHEN 'HIGH' THEN 4 ELSE 2 END AS n FROM {prev}"))(
    lambda s, d: lk.recommendations(lk.window_overlap(overlap_windows(s, d), "y_close", 20, 1)).withColumn("n", F.size("recommendations")))
register("leakage_early_epochs", "symbol epochs_analyzed:i alert_count:i steep_learning leakage_detected | max_early_correlation learning_slope", "LK3",
         pq(EPOCH, HIST_SQL, "SELECT symbol, count(*) AS epochs_analyzed, count(*) FILTER (WHERE abs(correlation) > 0.15) AS alert_count, max(abs(correlation)) AS max_early_correlation, "
            "(arg_max(abs(correlation), epoch) - arg_min(abs(correlation), epoch)) / count(*) AS learning_slope FROM {prev} WHERE epoch < 5 GROUP BY symbol",
            final="SELECT *, learning_slope > 0.05 AS steep_learning, alert_count > 0 OR learning_slope > 0.05 AS leakage_detected FROM {prev}"))(
    lambda s, d: lk.early_epochs(me.correlation_history(epochs(s, d)).withColumnRenamed("correlation", "val_corr")))
register("leakage_same_time", LK_COLS, "LK5", q.stages("weekly", FXS, {"y": "momentum_10d"}, LKR, sev(0.3, 0.4)))(
    lambda s, d: lk.same_time_audit(feats(s, d).withColumn("y", F.col("momentum_10d")), FX, "y"))
register("leakage_future_dependency", "symbol feature | dependency", "LK6",
         q.stages("weekly", FXS, {f"{c}_{k}": q.lead(c, k) for c in FX for k in (1, 3, 5)},
                  final="SELECT symbol, unnest([" + ", ".join("{{'feature': '" + c + "', 'dependency': (" + " + ".join(f"abs(corr({c}_{k}, close))" for k in (1, 3, 5)) + ") / 3}}" for c in FX) + "], recursive := true) FROM {prev} GROUP BY symbol"))(
    lambda s, d: lk.future_dependency(feats(s, d), FX, "close"))
register("leakage_random_target", LK_COLS, "LK7", q.stages("weekly", FXS, {"y": f"{h(42, 'pos')} / 2147483647.0::DOUBLE"}, LKR, sev(0.3, 0.4)))(lambda s, d: lk.random_target_test(feats(s, d), FX))
GS = tuple(f"coalesce(CASE WHEN stddev_pop(momentum_persistence_7d) FILTER (WHERE g{g} IS NOT NULL) > 0 AND stddev_pop(g{g}) FILTER (WHERE momentum_persistence_7d IS NOT NULL) > 0 THEN abs(corr(momentum_persistence_7d, g{g})) END, 0) AS gap_{g}" for g in (0, 1, 5, 10, 20))
register("leakage_gap_sensitivity", "symbol drop_class | gap_0 gap_1 gap_5 gap_10 gap_20 correlation_drop", "LK8",
         q.stages("weekly", *P, *fixed_steps(), {f"g{g}": q.lead("pattern_confidence_score", g + 1) for g in (0, 1, 5, 10, 20)}, "SELECT symbol, " + ", ".join(GS) + " FROM {prev} GROUP BY symbol",
                  {"correlation_drop": "greatest(gap_0, gap_1, gap_5, gap_10, gap_20) - least(gap_0, gap_1, gap_5, gap_10, gap_20)"},
                  final="SELECT *, CASE WHEN correlation_drop > 0.4 THEN 'sharp' WHEN correlation_drop > 0.2 THEN 'moderate' ELSE 'gradual' END AS drop_class FROM {prev}"))(
    lambda s, d: lk.gap_sensitivity(fixed_targets(nine(s, d), keep=["momentum_persistence_7d"]), "momentum_persistence_7d", "pattern_confidence_score"))
