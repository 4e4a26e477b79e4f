"""Date alignment of many series, and series lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..fixed import SECTORS
from .fill import fill_both
from .layout import attach, attach_scalar, with_positions

OHLCV = ["open", "high", "low", "close", "volume"]


def common_dates(df: DataFrame) -> DataFrame:
    """Times at which every symbol has a row.

    Repeated keys count once: rows are reduced to (symbol, ts) before they are counted per time.
    """
    keys = df.select("symbol", "ts").distinct()
    symbols = df.select("symbol").distinct().agg(F.count(F.lit(1)).alias("_all"))
    per_time = keys.groupBy("ts").agg(F.count(F.lit(1)).alias("_k"))
    return per_time.transform(attach_scalar, symbols).where(F.col("_k") == F.col("_all")).select("ts")


def require_common_dates(df: DataFrame) -> DataFrame:
    dates = common_dates(df)
    if dates.isEmpty():
        raise ValueError("No common dates found across all tickers")
    return dates


def align(df: DataFrame, columns=OHLCV) -> DataFrame:
    """Keep common times only, fill gaps in the price columns, renew positions."""
    kept = attach(df.drop("pos"), common_dates(df), ["ts"], "left_semi")
    found = [c for c in columns if c in df.columns]
    return with_positions(fill_both(kept, found), "year")


def alignment_report(df: DataFrame) -> DataFrame:
    """Missing times per symbol against the union of times; aligned when none is missing."""
    times = df.select("ts").distinct().agg(F.count(F.lit(1)).alias("_all"))
    per_symbol = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))
    return per_symbol.transform(attach_scalar, times).select(
        "symbol", "n_rows", (F.col("_all") - F.col("n_rows")).alias("missing"),
        (F.col("_all") == F.col("n_rows")).alias("aligned"),
    )


def date_differences(df: DataFrame, symbol: str, other: str) -> DataFrame:
    """Times that only one of two symbols has."""
    a = df.where(F.col("symbol") == symbol).select("ts")
    b = df.where(F.col("symbol") == other).select("ts")
    return (
        a.join(b, "ts", "left_anti").withColumn("only_in", F.lit(symbol))
        .unionByName(b.join(a, "ts", "left_anti").withColumn("only_in", F.lit(other)))
    )


def alignment_stats(df: DataFrame) -> DataFrame:
    return common_dates(df).agg(
        F.count(F.lit(1)).alias("common_dates"), F.min("ts").alias("first_common"), F.max("ts").alias("last_common")
    )


def missing_symbols(df: DataFrame, required: DataFrame) -> DataFrame:
    """Required symbols without a row."""
    return required.join(df.select("symbol").distinct(), "symbol", "left_anti")


WORD_DAYS, SPAN_WORDS, OVERLAP_SALTS = 63, 512, 16


def date_words(df: DataFrame) -> DataFrame:
    """(symbol, span, words): the days of a symbol as bits, 63 a word, 512 words (88 years) a row."""
    day = F.unix_date(F.to_date("ts")).cast("long")
    word = F.floor(day / WORD_DAYS)
    bits = df.select("symbol", word.alias("_word"), F.expr(f"shiftleft(1L, int(pmod(unix_date(to_date(ts)), {WORD_DAYS})))").alias("_bit"))
    words = bits.groupBy("symbol", "_word").agg(F.bit_or("_bit").alias("_bits"))
    span = words.groupBy("symbol", F.floor(F.col("_word") / SPAN_WORDS).alias("span")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.pmod("_word", F.lit(SPAN_WORDS)), "_bits"))).alias("_m"))
    return span.select("symbol", "span", F.expr(f"transform(sequence(0L, {SPAN_WORDS - 1}L), k -> coalesce(_m[k], 0L))").alias("words"))


def date_overlap(df: DataFrame) -> DataFrame:
    """Jaccard overlap of the date sets of each pair of symbols that share a day.

    Days are bits of words, so a pair costs a few hundred AND operations whatever the number of rows, and the join makes one row per
    pair of symbols (and 88 years). Pairs are spread over tasks by the first symbol.
    """
    words = date_words(df)
    count = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w))
    sizes = words.groupBy("symbol").agg(F.sum(count).alias("n"))
    a = words.select(F.col("symbol").alias("a"), "span", F.col("words").alias("_wa"), F.pmod(F.xxhash64("symbol"), F.lit(OVERLAP_SALTS)).cast("int").alias("_salt"))
    b = words.select(F.col("symbol").alias("b"), "span", F.col("words").alias("_wb"), F.explode(F.sequence(F.lit(0), F.lit(OVERLAP_SALTS - 1))).alias("_salt"))
    both = F.expr("aggregate(zip_with(_wa, _wb, (x, y) -> bit_count(x & y)), 0L, (s, n) -> s + n)")
    shared = a.join(b, ["span", "_salt"]).where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum(both).alias("shared")).where("shared > 0")
    names = sizes.select(F.col("symbol").alias("a"), F.col("n").alias("na"))
    others = sizes.select(F.col("symbol").alias("b"), F.col("n").alias("nb"))
    out = attach(attach(shared, names, ["a"]), others, ["b"])
    return out.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("overlap"))


def with_sector(df: DataFrame) -> DataFrame:
    """Sector of each mapped symbol, "unknown" for the rest."""
    rows = [(s, sector) for sector, names in SECTORS.items() for s in names]
    table = df.sparkSession.createDataFrame(rows, "symbol string, sector string")
    return df.drop("sector").join(F.broadcast(table), "symbol", "left").withColumn(
        "sector", F.coalesce("sector", F.lit("unknown"))
    )


def common_columns(*frames: DataFrame) -> list[str]:
    """Columns that all frames have, in the order of the first."""
    shared = set.intersection(*[set(f.columns) for f in frames])
    return [c for c in frames[0].columns if c in shared]
