"""DuckDB text for linear fits: elimination of one input after the other for least squares, coordinate steps for penalised fits."""

from __future__ import annotations

FOLDS = ({"n": "count(*) OVER (PARTITION BY symbol)"}, {"sz": "floor(n * 0.15::DOUBLE)::BIGINT"})


def folds(k: int) -> tuple:
    """Rows by fold k and part of the standard folds."""
    start = f"n - ({k} - k) * sz"
    return (*FOLDS, f"SELECT *, unnest(range({k})) AS k FROM {{prev}}",
            f"SELECT *, CASE WHEN pos < {start} THEN 'train' ELSE 'test' END AS part FROM {{prev}} WHERE pos < {start} + sz")


def residuals(inputs: list[str], y: str, by: str = "k", train: str = "part = 'train'") -> tuple:
    """Steps that leave in `{y}_r` what a least-squares fit on the train rows of each group does not explain.

    Each input in turn is taken out of the later ones and of y by its slope on the train rows.
    """
    names = [f"{c}_r" for c in inputs]
    steps: list[dict | str] = [{n: c for n, c in zip([*names, f"{y}_r"], [*inputs, y])}]
    for j, own in enumerate(names):
        rest = [*names[j + 1:], f"{y}_r"]
        slopes = {f"b{j}_{x}": f"coalesce(regr_slope({x}, {own}) FILTER (WHERE {train}) OVER (PARTITION BY {by}), 0)" for x in rest}
        steps.append(slopes)
        steps.append("SELECT * REPLACE (" + ", ".join(f"{x} - b{j}_{x} * {own} AS {x}" for x in rest) + ") FROM {prev}")
    steps.append("SELECT * REPLACE (" + f"{y}_r - avg({y}_r) FILTER (WHERE {train}) OVER (PARTITION BY {by}) AS {y}_r" + ") FROM {prev}")
    return tuple(steps)


def sums(p: int) -> str:
    """Aggregates of inputs c0 .. and y that fits need."""
    pairs = ", ".join(f"sum(c{a} * c{b}) AS q{a}_{b}" for a in range(p) for b in range(a, p))
    return "count(*)::DOUBLE AS m, sum(y) AS sy, " + ", ".join(f"sum(c{a}) AS s{a}, sum(c{a} * y) AS t{a}" for a in range(p)) + ", " + pairs


def standard(p: int) -> str:
    """Per row of sums: deviations and mean products of inputs in deviations, d, r_a_b and z_a."""
    dev = ", ".join(f"sqrt((q{a}_{a} - s{a} * s{a} / m) / m) AS d{a}" for a in range(p))
    both = ", ".join(f"(q{a}_{b} - s{a} * s{b} / m) / m / d{a} / d{b} AS r{a}_{b}" for a in range(p) for b in range(a, p))
    return f"SELECT *, {dev}, {both}, " + ", ".join(f"(t{a} - s{a} * sy / m) / m / d{a} AS z{a}" for a in range(p)) + " FROM {prev}"


def descent(source: str, p: int, rounds: int) -> str:
    """Coordinate descent from 0 for the rows of source (columns of `standard`, lam and mask): the weights b0 .. after all rounds."""
    r = lambda a, b: f"r{min(a, b)}_{max(a, b)}"
    steps = []
    for a in range(p):
        pull = f"(z{a} - " + " - ".join(f"{r(a, b)} * {f'n{b}' if b < a else f'b{b}'}" for b in range(p) if b != a) + ")"
        steps.append(f"CASE WHEN (mask >> {a}) & 1 = 1 THEN sign({pull}) * greatest(abs({pull}) - lam, 0) / r{a}_{a} ELSE 0 END AS n{a}")
    keep = ", ".join(f"b{a}" for a in range(p))
    new = ", ".join(f"n{a} AS b{a}" for a in range(p))
    return (f"WITH RECURSIVE cd AS (SELECT *, 0 AS it, " + ", ".join(f"0.0::DOUBLE AS b{a}" for a in range(p)) + f" FROM {source} UNION ALL "
            f"SELECT * EXCLUDE ({', '.join(f'n{a}' for a in range(p))}) REPLACE (it + 1 AS it, {new}) FROM (SELECT *, {', '.join(steps)} FROM cd WHERE it < {rounds})) "
            f"SELECT * EXCLUDE ({keep}), {keep} FROM cd WHERE it = {rounds}")
