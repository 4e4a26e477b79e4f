"""Linear fits from sums of products.

Least squares, penalised fits and fold errors need only n, X'X, X'y and y'y. Those sums add up over rows, so one pass that
groups rows by the pieces of a split gives every train set as a sum of pieces, and every subset of features as a
part of the matrix: no row is copied per fold and none is read again per subset or penalty. Tasks add the outer products of
their Arrow batches; what is shuffled is one number per group and pair of columns.

Sums are taken about zero: with a mean of m deviations, about 2 log10(m) of 15 digits of a slope are lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .splits import sized

HELD_CELLS = 1 << 22


def products(df: DataFrame, vector: Column, by=()) -> DataFrame:
    """(by, i, j, v) for i <= j: sums of products of the entries of (1, vector), an array without NULLs of one length."""
    by, held = list(by), HELD_CELLS
    rows = df.select(*by, vector.cast("array<double>").alias("_z"))
    schema = StructType([*rows.schema.fields[: len(by)], StructField("i", IntegerType()), StructField("j", IntegerType()), StructField("v", DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums, kinds = {}, []

        def cells():
            keys = list(sums)
            size = next(iter(sums.values())).shape[0]
            i, j = np.triu_indices(size)
            repeated = [pa.array([k[c] for k in keys for _ in range(len(i))], kinds[c]) for c in range(len(kinds))]
            values = np.concatenate([s[i, j] for s in sums.values()])
            return pa.RecordBatch.from_arrays(
                [*repeated, pa.array(np.tile(i, len(keys)).astype(np.int32)), pa.array(np.tile(j, len(keys)).astype(np.int32)), pa.array(values)],
                names=schema.names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            z = np.column_stack([np.ones(n), batch.column(len(by)).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)])
            kinds = [batch.column(c).type for c in range(len(by))]
            places = {}
            for place, key in enumerate(zip(*[batch.column(c).to_pylist() for c in range(len(by))]) if by else [()] * n):
                places.setdefault(key, []).append(place)
            for key, at in places.items():
                own = z if len(at) == n else z[at]
                sums[key] = sums[key] + own.T @ own if key in sums else own.T @ own
            if len(sums) * z.shape[1] ** 2 > held:
                yield cells()
                sums = {}
        if sums:
            yield cells()

    return rows.mapInArrow(run, schema).groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def pair_products(df: DataFrame, columns, by=()) -> DataFrame:
    """(by, i, j, n, si, sj, qi, qj, p) for i < j: over rows where both columns are known their count, sums, sums of squares and of products.

    Values are taken from a centre, the mean of each column over all rows, so that close values of large size keep their digits.
    Tasks multiply masked matrices of their batches; what is shuffled is one row per group and pair.
    """
    by, columns, held = list(by), list(columns), HELD_CELLS
    centres = [c or 0.0 for c in df.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))) for c in columns]).first()]  # one number per column
    rows = df.select(*by, *[F.col(c).cast("double") for c in columns])
    names = ["n", "si", "sj", "qi", "qj", "p"]
    fields = [StructField("i", IntegerType()), StructField("j", IntegerType()), *[StructField(c, DoubleType()) for c in names]]
    schema = StructType([*rows.schema.fields[: len(by)], *fields])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        width, (i, j) = len(columns), np.triu_indices(len(columns), 1)
        sums, kinds = {}, []

        def cells():
            out = []
            for place, kind in enumerate(kinds):
                out.append(pa.array([k[place] for k in sums for _ in range(len(i))], kind))
            out += [pa.array(np.tile(x, len(sums)).astype(np.int32)) for x in (i, j)]
            for matrix, flip in ((0, False), (1, False), (1, True), (2, False), (2, True), (3, False)):
                out.append(pa.array(np.concatenate([s[matrix][j, i] if flip else s[matrix][i, j] for s in sums.values()])))
            return pa.RecordBatch.from_arrays(out, names=schema.names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.column_stack([batch.column(len(by) + c).to_numpy(zero_copy_only=False).astype(float) for c in range(width)]) - centres
            kinds = [batch.column(c).type for c in range(len(by))]
            places = {}
            for place, key in enumerate(zip(*[batch.column(c).to_pylist() for c in range(len(by))]) if by else [()] * n):
                places.setdefault(key, []).append(place)
            for key, at in places.items():
                own = x[at]
                known = (~np.isnan(own)).astype(float)
                own = np.where(known > 0, own, 0.0)
                more = [known.T @ known, own.T @ known, (own * own).T @ known, own.T @ own]
                sums[key] = [a + b for a, b in zip(sums[key], more)] if key in sums else more
            if 4 * len(sums) * width**2 > held:
                yield cells()
                sums = {}
        if sums:
            yield cells()

    return rows.mapInArrow(run, schema).groupBy(*by, "i", "j").agg(*[F.sum(c).alias(c) for c in names])


def filled(features, target: str) -> Column:
    """Features and the target as one array, NULL as 0."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in [*features, target]])


def standard_pieces(df: DataFrame, n_splits: int = 5, test_ratio: float = 0.15) -> DataFrame:
    """Column `piece`: 0 before all test parts of the standard folds, k + 1 in the test part of fold k."""
    size = F.floor(F.col("n_rows") * F.lit(test_ratio))
    start = F.col("n_rows") - n_splits * size
    piece = F.when((F.col("pos") < start) | (size == 0), 0).otherwise(F.floor((F.col("pos") - start) / F.greatest(size, F.lit(1))) + 1)
    return sized(df).withColumn("piece", F.least(piece, F.lit(n_splits)).cast("int")).drop("n_rows")


def fold_products(df: DataFrame, features, target: str, folds: int = 5, test_ratio: float = 0.15) -> DataFrame:
    """(fold, part, i, j, v) of the standard folds: a train part is the sum of all pieces before its test part."""
    cells = products(standard_pieces(df, folds, test_ratio), filled(features, target), ["piece"])
    fold = F.explode(F.sequence(F.greatest(F.col("piece") - 1, F.lit(0)), F.lit(folds - 1)))
    part = F.when(F.col("fold") == F.col("piece") - 1, "test").otherwise("train")
    return cells.withColumn("fold", fold).withColumn("part", part).groupBy("fold", "part", "i", "j").agg(F.sum("v").alias("v"))


def solver():
    """numpy routines for tasks; as nested functions they are sent by value, so executors need not have this package."""
    import numpy as np

    def matrix(cells):
        """The symmetric matrix of the cells of one group."""
        size = int(cells["j"].max()) + 1
        g = np.zeros((size, size))
        g[cells["i"], cells["j"]] = cells["v"]
        return np.triu(g) + np.triu(g, 1).T

    def centred(g, inputs, out):
        """Means, deviations (0 where a column is constant), correlations of the inputs and with the output."""
        n, ix = g[0, 0], np.asarray(inputs, int)
        mean, last = g[0, ix] / n, g[0, out] / n
        c = g[np.ix_(ix, ix)] - n * np.outer(mean, mean)
        cy = g[ix, out] - n * mean * last
        square = np.diag(c)
        dev = np.where(square > 1e-12 * np.maximum(g[ix, ix], 1e-300), np.sqrt(np.maximum(square, 0)), 0.0)
        inverse = np.divide(1.0, dev, out=np.zeros_like(dev), where=dev > 0)
        return mean, last, dev, c * np.outer(inverse, inverse), cy * inverse

    def least_squares(g, inputs, out):
        """Intercept and weights; constant inputs get 0, dependent ones the shortest solution."""
        mean, last, dev, r, ry = centred(g, inputs, out)
        scaled = np.linalg.lstsq(r, ry, rcond=1e-10)[0]
        weights = np.divide(scaled, dev, out=np.zeros_like(dev), where=dev > 0)
        return last - weights @ mean, weights

    def lasso(g, inputs, out, penalties, tolerance=1e-12, rounds=100_000):
        """Intercept and weights for each penalty, greatest first, each starting from the one before.

        Minimises half the mean squared error plus penalty x sum of |weight| x deviation, by coordinate descent with the
        gradient kept up to date from the matrix alone.
        """
        mean, last, dev, r, ry = centred(g, inputs, out)
        n = g[0, 0]
        # in units of one deviation: b = weight x deviation, and the mean product of an input with itself is 1
        b, gradient = np.zeros(len(ry)), ry / np.sqrt(n)
        live = np.flatnonzero(dev > 0)
        found = {}
        for penalty in sorted(penalties, reverse=True):
            for _ in range(rounds):
                change = 0.0
                for k in live:
                    pull = gradient[k] + b[k]
                    new = np.sign(pull) * max(abs(pull) - penalty, 0.0)
                    step = new - b[k]
                    if step:
                        gradient -= r[:, k] * step
                        b[k] = new
                        change = max(change, abs(step))
                if change <= tolerance * max(1e-300, np.abs(b).max(initial=0.0)):
                    break
            weights = np.divide(b * np.sqrt(n), dev, out=np.zeros_like(dev), where=dev > 0)
            found[penalty] = last - weights @ mean, weights
        return found

    def error(g, inputs, out, intercept, weights):
        """Mean squared error of a fit over the rows behind g."""
        at, w = [0, *inputs, out], np.concatenate([[intercept], weights, [-1.0]])
        return max(float(w @ g[np.ix_(at, at)] @ w) / g[0, 0], 0.0)

    return matrix, least_squares, lasso, error


def fold_errors(cells: DataFrame, subsets: dict[str, list[int]], out: int) -> DataFrame:
    """(subset, fold, error): the mean squared error on the test part of the fit on the train part, for every subset of inputs.

    Inputs and output are numbered from 1 as in the vector; a fold is one small task, whatever the number of rows behind its sums.
    """
    matrix, least_squares, _, error = solver()

    def run(key, part):
        import pandas as pd

        sides = {name: matrix(cells) for name, cells in part.groupby("part")}
        if len(sides) < 2:
            return pd.DataFrame({"subset": [], "fold": [], "error": []})
        rows = [(name, key[0], error(sides["test"], ix, out, *least_squares(sides["train"], ix, out))) for name, ix in subsets.items()]
        return pd.DataFrame(rows, columns=["subset", "fold", "error"])

    return cells.groupBy("fold").applyInPandas(run, "subset string, fold int, error double")


def fits(cells: DataFrame, inputs: list[int], out: int, by=("fold",)) -> DataFrame:
    """(by, intercept, weights): one least-squares fit per group of cells."""
    by = list(by)
    fields = [f for f in cells.schema.fields if f.name in by]
    matrix, least_squares, _, _ = solver()

    def run(key, part):
        import pandas as pd

        intercept, weights = least_squares(matrix(part), inputs, out)
        return pd.DataFrame({**{name: [k] for name, k in zip(by, key)}, "intercept": [intercept], "weights": [weights.tolist()]})

    schema = StructType([*sorted(fields, key=lambda f: by.index(f.name)), *StructType.fromDDL("intercept double, weights array<double>").fields])
    return cells.withColumn("_all", F.lit(0)).groupBy(*(by or ["_all"])).applyInPandas(run, schema)


def lasso_path(cells: DataFrame, inputs: list[int], out: int, penalties) -> DataFrame:
    """(penalty, error, weights) of every penalty from the cells of folds (fold, i, j, v).

    error: mean over the folds of the root mean squared error when the fold is left out; weights: the fit on all rows.
    Train sets are the whole sum less one fold, so no row is read again. The one task holds one matrix per fold.
    """
    penalties = [float(p) for p in penalties]
    matrix, _, lasso, error = solver()

    def run(part):
        import numpy as np
        import pandas as pd

        sides = [matrix(cells) for _, cells in part.groupby("fold")]
        total = sum(sides)
        found = lasso(total, inputs, out, penalties)
        errors = {p: [] for p in penalties}
        for side in sides:
            if total[0, 0] > side[0, 0] > 0:
                for p, fit in lasso(total - side, inputs, out, penalties).items():
                    errors[p].append(np.sqrt(error(side, inputs, out, *fit)))
        return pd.DataFrame([(p, float(np.mean(errors[p])) if errors[p] else None, found[p][1].tolist()) for p in penalties], columns=["penalty", "error", "weights"])

    return cells.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "penalty double, error double, weights array<double>")


def elimination_path(cells: DataFrame, whole: DataFrame, inputs: list[int], out: int) -> DataFrame:
    """(input, place, error): backward elimination by the smallest |weight x deviation| of the fit on all rows.

    place counts from 1, the first input to go; error is the mean fold error of the set that still holds the input when it goes.
    cells: (fold, part, i, j, v); whole: (i, j, v) of all rows. The one task holds two matrices per fold.
    """
    matrix, least_squares, _, error = solver()

    def run(part):
        import numpy as np
        import pandas as pd

        sides = {key: matrix(cells) for key, cells in part.groupby(["fold", "part"])}
        total, folds = sides.pop((-1, "all")), sorted({f for f, _ in sides if (f, "train") in sides and (f, "test") in sides})
        deviation = np.sqrt(np.maximum(np.diag(total) - total[0] ** 2 / total[0, 0], 0))
        left, rows = list(inputs), []
        while left:
            errors = [error(sides[f, "test"], left, out, *least_squares(sides[f, "train"], left, out)) for f in folds]
            weights = np.abs(least_squares(total, left, out)[1]) * deviation[left]
            weakest = left[int(np.argmin(weights))]
            rows.append((weakest, len(rows) + 1, float(np.mean(errors)) if errors else None))
            left.remove(weakest)
        return pd.DataFrame(rows, columns=["input", "place", "error"])

    both = cells.select("fold", "part", "i", "j", "v").unionByName(whole.select(F.lit(-1).alias("fold"), F.lit("all").alias("part"), "i", "j", "v"))
    return both.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "input int, place int, error double")
