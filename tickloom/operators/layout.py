"""Row positions and overlapping blocks for long series.

Every series operator counts rows, not time. A plain window over a symbol would
send the whole history of a hot symbol to one task, so series are cut in blocks:

* ``with_positions`` numbers the rows of each symbol in two levels (inside a
  calendar span, then span offsets), so no task ever sorts a whole symbol;
* ``framed`` copies each row into the block it belongs to and into the blocks
  that need it as history or future, after which windows over (symbol, block)
  give the same values as windows over the symbol.

A frame of ``back`` rows costs back / block extra rows, and one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialize

BLOCK_ROWS = 2048
KEY = "symbol"


def block_rows(df: DataFrame, back: int = 0, ahead: int = 0) -> int:
    """Rows per block: large enough that the overlap stays under a third."""
    base = int(df.sparkSession.conf.get("tickloom.block.rows", str(BLOCK_ROWS)))
    return max(base, 3 * (back + ahead)) if base >= BLOCK_ROWS else base


def with_positions(df: DataFrame, span: str = "month", order=("ts",), name: str = "pos") -> DataFrame:
    """0-based row position inside each symbol.

    Rows are numbered inside (symbol, span) and shifted by the number of rows in
    earlier spans. Both windows work on bounded groups: the rows of one calendar
    span, and one row per span.
    """
    cut = df.withColumn("_span", F.date_trunc(span, F.col(order[0])))
    inside = W.partitionBy(KEY, "_span").orderBy(*order)
    sizes = cut.groupBy(KEY, "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(KEY).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(KEY, "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        cut.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, [KEY, "_span"])
        .withColumn(name, (F.col("_rn") + F.col("_off")).cast("long"))
        .drop("_rn", "_off", "_span")
    )


def framed(df: DataFrame, back: int, ahead: int, block: int) -> DataFrame:
    """Copy rows to every block that needs them; ``home`` marks the owner."""
    pos = F.col("pos")
    own = F.floor(pos / block)
    if back == 0 and ahead == 0:
        return df.withColumn("blk", own).withColumn("home", F.lit(True))
    first = F.greatest(F.floor((pos - ahead) / block), F.lit(0).cast("long"))
    last = F.floor((pos + back) / block)
    return df.withColumn("blk", F.explode(F.sequence(first, last))).withColumn("home", F.col("blk") == own)


def _bytes(df: DataFrame) -> int:
    """Rows times the width of their fixed fields, plus the elements of arrays."""
    lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(F.size(c)).alias(c) for c in lists]).first()
    return row[0] * 24 * len(df.columns) + 8 * sum(max(row[c] or 0, 0) for c in lists)


def attach(df: DataFrame, small: DataFrame, on, how: str = "left", bound: int = 64 << 20) -> DataFrame:
    """Join per-key values. They are written once; the small side is broadcast only if its estimated
    bytes are under the bound; above it the join is left to Spark, whose adaptive skew
    handling splits hot keys."""
    small = materialize(small)
    if _bytes(small) <= bound:
        small = F.broadcast(small)
    return df.join(small, on, how)


def looked_up(df: DataFrame, table: DataFrame, on, bound: int = 64 << 20) -> DataFrame:
    """Inner join with a stored table that has one row per key, without sorting the rows of df: broadcast under the bound,
    else by hash partitions."""
    return df.join(F.broadcast(table) if _bytes(table) <= bound else table.hint("shuffle_hash"), on)


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (a global aggregate) to every row."""
    key = F.lit(1).alias("_one")
    return df.select("*", key).join(F.broadcast(one_row.select("*", key)), "_one").drop("_one")
