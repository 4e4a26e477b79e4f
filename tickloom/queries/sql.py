"""Text helpers for the DuckDB oracles (independent of the Spark plans)."""

from __future__ import annotations

HOURLY = """hourly AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events WHERE value > 0 GROUP BY 1, 2)"""

WEEKLY = """weekly AS (
  SELECT n_name AS symbol, r_name AS sector, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS ts,
         arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close,
         CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM (SELECT n_name, r_name, l_shipdate, l_quantity, l_extendedprice / l_quantity AS price,
               (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  GROUP BY 1, 2, 3)"""

BASE = {
    "hourly": HOURLY + ",\nbars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM hourly)",
    "weekly": WEEKLY + ",\nbars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM weekly)",
}


def stages(kind: str, *steps: dict | str, final: str | None = None) -> str:
    """WITH chain: each dict adds columns to the previous step, a string replaces it
    (with {prev} as the name of the previous step)."""
    parts = [BASE[kind]]
    prev = "bars"
    for i, step in enumerate(steps):
        name = f"s{i}"
        if isinstance(step, str):
            parts.append(f"{name} AS ({step.format(prev=prev)})")
        else:
            cols = ", ".join(f"{e} AS {n}" for n, e in step.items())
            parts.append(f"{name} AS (SELECT *, {cols} FROM {prev})")
        prev = name
    last = final.format(prev=prev) if final else f"SELECT * FROM {prev}"
    return "WITH " + ",\n".join(parts) + "\n" + last


PART = "PARTITION BY symbol ORDER BY ts"


def rows(lo: int, hi: int = 0, part: str = PART) -> str:
    def edge(k):
        if k == 0:
            return "CURRENT ROW"
        return f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"

    return f"({part} ROWS BETWEEN {edge(lo)} AND {edge(hi)})"


RUN = f"({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE = f"({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def agg(fn: str, x: str, lo: int, hi: int = 0, need: int | None = None, part: str = PART) -> str:
    w = rows(lo, hi, part)
    need = hi - lo + 1 if need is None else need
    return f"CASE WHEN count({x}) OVER {w} >= {need} THEN {fn} OVER {w} END"


def mean(x, n, need=None):
    return agg(f"avg({x})", x, 1 - n, 0, need)


def total(x, n, need=None):
    return agg(f"sum({x})", x, 1 - n, 0, need)


def std(x, n, need=None):
    return agg(f"stddev_samp({x})", x, 1 - n, 0, need)


def lo(x, n):
    return agg(f"min({x})", x, 1 - n)


def hi(x, n):
    return agg(f"max({x})", x, 1 - n)


def quant(x, n, q):
    return agg(f"quantile_cont({x}, {q})", x, 1 - n)


def lag(x, n=1):
    return f"lag({x}, {n}) OVER ({PART})"


def lead(x, n=1):
    return f"lead({x}, {n}) OVER ({PART})"


def div(a, b):
    return (
        f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) WHEN ({b}) = 0 AND ({a}) > 0 THEN 'inf'::DOUBLE "
        f"WHEN ({b}) = 0 AND ({a}) < 0 THEN '-inf'::DOUBLE END"
    )


def guard(a, b, eps="1e-10"):
    return div(a, f"({b}) + {eps}")


def pct(x, n=1):
    return f"({div(x, lag(x, n))}) - 1"


def corr(a, b, n):
    """Correlation of two columns that are null together or complete."""
    w = rows(1 - n)
    pa = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END"
    pb = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END"
    return (
        f"CASE WHEN count({pa}) OVER {w} >= {n} AND max({pa}) OVER {w} > min({pa}) OVER {w} "
        f"AND max({pb}) OVER {w} > min({pb}) OVER {w} THEN corr({pa}, {pb}) OVER {w} END"
    )


def slope(x, n, first=None):
    first = 1 - n if first is None else first
    return agg(f"regr_slope({x}, pos)", x, first, first + n - 1)


def skew(x, n):
    w = rows(1 - n)
    return (
        f"CASE WHEN count({x}) OVER {w} < {n} THEN NULL WHEN max({x}) OVER {w} = min({x}) OVER {w} THEN 0 "
        f"ELSE skewness({x}) OVER {w} END"
    )


def ewm(x, alpha):
    """Normalised exponential mean by folding the list of all earlier values."""
    b = f"(1.0 - {alpha})"
    items = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {RUN}"
    num = f"list_reduce({items}, lambda a, v: {b} * a + v)"
    ones = f"list_reduce(list_transform({items}, lambda v: 1.0::DOUBLE), lambda a, v: {b} * a + v)"
    return f"({num}) / ({ones})"


def ewm_recursive(x, alpha):
    """Recursive exponential mean seeded by the first value."""
    items = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {RUN}"
    return f"list_reduce({items}, lambda a, v: (1.0 - {alpha}) * a + {alpha} * v)"


def flag(cond):
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def share(cond, n):
    return mean(f"(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)", n)


def clip(x, a, b):
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {a}), {b}) END"
