"""GARCH(1,1) volatility refitted along the series.

Every 25 rows the parameters (omega, alpha, beta) are fitted by maximum likelihood to the last 100 returns of the symbol, and each
row runs the variance recursion with the parameters of its latest refit. Windows are bounded arrays, one row per refit, and all refits of an
Arrow batch are fitted at once: the recursion runs over the 100 places with a vector of windows, and carries the derivatives of the
variance along, so that a step costs one pass. A fit starts from the best point of a grid and takes damped Newton steps in
unbounded parameters; a step that does not raise the likelihood is shortened. So a fit is never below its grid point.

Where a window is constant, or the persistence alpha + beta ends at 0.999 or more, the fallback of the definition is used: 5% of the
window's variance, 0.05 and 0.90.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..session import materialize
from .core_features import CORE
from .registry import Registry

WINDOW, LEAST, REFIT, FLOOR = 100, 30, 25, 1e-8
GRID = [(a / 100, b / 100) for a in (2, 5, 10, 15, 20) for b in (60, 70, 80, 85, 90) if a + b < 99]
FALLBACK, LIMIT, STEPS = (0.05, 0.05, 0.90), 0.999, 200
FITTED = "omega double, alpha double, beta double, nll double, grid_nll double, slope double, fitted boolean"


def _head_variance(r: Column) -> Column:
    """Population variance of the first ten returns."""
    head = F.slice(r, 1, 10)
    n = F.size(head).cast("double")
    mean = F.aggregate(head, F.lit(0.0), lambda a, x: a + x) / n
    return F.aggregate(head, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n


def _last_variance(r: Column, omega, alpha, beta) -> Column:
    """Conditional variance of the last return of the array."""
    steps = F.slice(r, 1, F.size(r) - 1)
    return F.aggregate(steps, _head_variance(r), lambda s, x: F.greatest(omega + alpha * x * x + beta * s, F.lit(FLOOR)))


def fitter(grid=tuple(GRID)):
    """A function (returns, sizes) -> columns of `FITTED` for many windows at once; nested, so that it travels with the task."""
    floor, fallback, limit, steps = FLOOR, FALLBACK, LIMIT, STEPS

    def fit(r, sizes):
        import numpy as np

        m, width = r.shape
        there = np.arange(width) < sizes[:, None]
        r = np.where(there, r, 0.0)
        head = np.minimum(sizes, 10)
        first = np.arange(width) < head[:, None]
        mean = (r * first).sum(1) / head
        start = (((r - mean[:, None]) ** 2) * first).sum(1) / head
        centre = r.sum(1) / sizes
        variance = (((r - centre[:, None]) ** 2) * there).sum(1) / sizes

        def likelihood(p, rows, slopes=True):
            """Negative log likelihood of parameters (omega, alpha, beta) without its constant, its gradient and expected curvature."""
            omega, alpha, beta = p.T
            x = r[rows]
            s = np.maximum(start[rows], floor)
            raw = start[rows]
            total = np.zeros(len(rows))
            d, grad, curve = np.zeros((len(rows), 3)), np.zeros((len(rows), 3)), np.zeros((len(rows), 3, 3))
            for t in range(width):
                live = there[rows, t]
                if t:
                    before = raw
                    nxt = omega + alpha * x[:, t - 1] ** 2 + beta * before
                    if slopes:
                        step = np.column_stack([np.ones(len(rows)), x[:, t - 1] ** 2, before]) + beta[:, None] * d
                        d = np.where((nxt > floor)[:, None], step, 0.0)
                    raw = np.maximum(nxt, floor)
                    s = raw
                total += np.where(live, np.log(s) + x[:, t] ** 2 / s, 0.0)
                if slopes:
                    grad += np.where(live, (1 - x[:, t] ** 2 / s) / s, 0.0)[:, None] * d
                    curve += np.where(live, 1 / s**2, 0.0)[:, None, None] * d[:, :, None] * d[:, None, :]
            return 0.5 * total, 0.5 * grad, 0.5 * curve

        # the best point of the grid, with omega from the window's variance
        best, point = np.full(m, np.inf), np.zeros((m, 3))
        everyone = np.arange(m)
        for a, b in grid:
            p = np.column_stack([np.maximum(variance * (1 - a - b), floor), np.full(m, a), np.full(m, b)])
            value = likelihood(p, everyone, False)[0]
            better = (value < best) & (variance > 0)
            best[better], point[better] = value[better], p[better]
        usable = np.isfinite(best)
        grid_value = best.copy()

        # unbounded parameters: the logarithm of what omega is above its bound, and the shares of alpha, beta and the rest of 1
        def parameters(u):
            top = np.maximum(np.maximum(u[:, 1], u[:, 2]), 0.0)
            a, b, rest = np.exp(u[:, 1] - top), np.exp(u[:, 2] - top), np.exp(-top)
            return np.column_stack([floor + np.exp(np.clip(u[:, 0], -60, 20)), a / (a + b + rest), b / (a + b + rest)])

        def jacobian(p):
            j = np.zeros((len(p), 3, 3))
            j[:, 0, 0] = p[:, 0] - floor
            for i in (1, 2):
                for k in (1, 2):
                    j[:, i, k] = p[:, i] * ((i == k) - p[:, k])
            return j

        rows = np.flatnonzero(usable)
        slope = np.zeros(m)
        if len(rows):
            p = point[rows]
            rest = 1 - p[:, 1] - p[:, 2]
            u = np.column_stack([np.log(np.maximum(p[:, 0] - floor, 1e-26)), np.log(p[:, 1] / rest), np.log(p[:, 2] / rest)])
            value, damp = likelihood(parameters(u), rows, False)[0], np.full(len(rows), 1e-3)
            open_ = np.ones(len(rows), bool)
            for _ in range(steps):
                at = np.flatnonzero(open_)
                if len(at) == 0:
                    break
                p = parameters(u[at])
                _, g, h = likelihood(p, rows[at])
                j = jacobian(p)
                g = np.einsum("nij,ni->nj", j, g)
                h = np.einsum("nij,nik,nkl->njl", j, h, j)
                slope[rows[at]] = np.abs(g).max(1)
                size = np.einsum("nii->ni", h)
                lifted = h + np.eye(3) * (damp[at][:, None] * size + 1e-9)[:, :, None]
                move = np.clip(np.linalg.solve(lifted, g[:, :, None])[:, :, 0], -3, 3)
                tried = u[at] - move
                new = likelihood(parameters(tried), rows[at], False)[0]
                good = new < value[at]
                gain = value[at] - new
                u[at[good]], value[at[good]] = tried[good], new[good]
                damp[at] = np.where(good, damp[at] / 3, damp[at] * 4)
                open_[at] = ~((good & (gain < 1e-12 * (1 + np.abs(new)))) | (damp[at] > 1e12))
            p = parameters(u)
            slope[rows] = np.abs(np.einsum("nij,ni->nj", jacobian(p), likelihood(p, rows)[1])).max(1)
            point[rows], best[rows] = p, value
        worse = best > grid_value  # by rounding, where no step was taken
        best = np.where(worse, grid_value, best)
        fitted = usable & (point[:, 1] + point[:, 2] < limit)
        spare = np.column_stack([variance * fallback[0], np.full(m, fallback[1]), np.full(m, fallback[2])])
        point = np.where(fitted[:, None], point, spare)
        return [*point.T, best, grid_value, slope, fitted]

    return fit


def refits(table: DataFrame, grid=GRID) -> DataFrame:
    """The fitted parameters of rows with windows of returns (column _r): all other columns and those of `FITTED`."""
    keep = [c for c in table.columns if c != "_r"]
    schema = StructType([*[table.schema[c] for c in keep], *StructType.fromDDL(FITTED).fields])
    fit = fitter(tuple(grid))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(len(keep))
            sizes = np.array(lists.value_lengths().to_numpy(zero_copy_only=False), int)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            r = np.zeros((len(sizes), max(1, sizes.max())))
            r[np.arange(r.shape[1]) < sizes[:, None]] = values
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, fit(r, sizes))], names=schema.names)

    return table.select(*keep, "_r").mapInArrow(run, schema)


def garch_windows(bars: DataFrame) -> DataFrame:
    """symbol, ts, pos, the last 100 returns of each row and the row whose refit it uses (_anchor, NULL before the first)."""
    reg = Registry(parent=CORE)
    reg.add("g", _r=lambda f: f.window_list("_log_return", -(WINDOW - 1), 0))
    # index of the return: the first bar has none
    table = reg.compute(bars, ["_r"]).withColumn("_i", F.col("pos") - 1)
    first_refit = (LEAST // REFIT + 1) * REFIT
    anchor = F.when(F.col("_i") < first_refit, LEAST).otherwise(F.floor(F.col("_i") / REFIT) * REFIT)
    return table.withColumn("_anchor", F.when(F.col("_i") >= LEAST, anchor.cast("long")))


def garch_fits(bars: DataFrame, grid=GRID) -> DataFrame:
    """One row per symbol and refit: parameters, negative log likelihoods of the fit and of its grid point, and the largest slope left."""
    points = garch_windows(bars).where("_i = _anchor").select("symbol", "ts", "_anchor", "_r")
    return refits(points, grid)


def garch_volatility(bars: DataFrame, grid=GRID) -> DataFrame:
    table = materialize(garch_windows(bars))
    fits = refits(table.where("_i = _anchor").select("symbol", "_anchor", "_r"), grid).select("symbol", "_anchor", "omega", "alpha", "beta")
    fitted = table.where(F.col("_anchor").isNotNull()).join(fits, ["symbol", "_anchor"]).select(
        "symbol", "ts", F.sqrt(_last_variance(F.col("_r"), F.col("omega"), F.col("alpha"), F.col("beta"))).alias("garch_volatility"))
    return table.select("symbol", "ts", "pos").join(fitted, ["symbol", "ts"], "left")
