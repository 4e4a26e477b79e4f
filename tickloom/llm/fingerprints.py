"""Document fingerprints by locally consistent parsing.

A text starts as its code points. One round names runs of equal symbols, tosses coins deterministically (a label is the
lowest bit in which a symbol differs from its left neighbour, with that bit's value; labels of labels shrink to a handful),
ends phrases at the local maxima of the labels, and names each phrase by a hash of what it holds. The names are the
next round's symbols. A phrase's end depends on a few symbols around it only, so equal substrings get equal names inside,
wherever they stand. Rounds end when one name is left for each text.

The fingerprint is a bottom sketch: the smallest 32-bit hashes of the distinct names from round `level` on, and of the
last name, written in hexadecimal. The likeness of two fingerprints is the Jaccard estimate from the smallest hashes of their
union. Equal texts have equal fingerprints, whatever stands around them.

A NULL text counts as empty; the empty text's fingerprint is the empty string, like itself (1) and like no other (0).
An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import in_arrow, mix, weights

SKETCH, LEVEL = 64, 3
SLICE_CHARS = 1 << 19
# The reduced label of each pair of labels: twice the lowest differing bit's place plus that bit of the first.
_PAIR = np.zeros(1 << 14, np.uint8)
for _a in range(128):
    for _b in range(128):
        _x = _a ^ _b
        _k = (_x & -_x).bit_length() - 1 if _x else 0
        _PAIR[_a << 7 | _b] = 2 * _k + (_a >> _k & 1)


def coin_labels(names: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Labels below 6 in which neighbours differ, for names in which neighbours differ. Gaps between texts are always labelled
    0, so that no text's labels depend on the text before."""
    before = np.empty_like(names)
    before[0] = ~names[0]
    before[1:] = names[:-1]
    differ = names ^ before
    low = differ & (~differ + np.uint64(1))
    place = (low.astype(np.float64).view(np.uint64) >> np.uint64(52)) - np.uint64(1023)
    label = ((place << np.uint64(1)) | ((names >> place) & np.uint64(1))).astype(np.uint16)
    label[gaps] = 0
    for _ in range(3):
        pair = label << np.uint16(7)
        pair[1:] |= label[:-1]
        pair[0] |= label[0] ^ np.uint16(1)
        label = _PAIR[pair].astype(np.uint16)
        label[gaps] = 0
    return label.astype(np.uint8)


def parse_round(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrase names of one round and the text of each. Names are never 0; 0 stands before each text and after the last."""
    fresh = np.ones(len(names), bool)
    fresh[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    if not fresh.all():
        at = np.flatnonzero(fresh)
        runs = np.diff(np.append(at, len(names)))
        names, text = names[at], text[at]
        long = runs > 1
        names[long] = mix(names[long] + runs[long].astype(np.uint64) * weights(3)[2]) | np.uint64(1)
    first = np.ones(len(names), bool)
    first[1:] = text[1:] != text[:-1]
    place = np.arange(len(names)) + np.cumsum(first)
    padded = np.zeros(len(names) + int(first.sum()) + 1, np.uint64)
    padded[place] = names
    label = coin_labels(padded, np.append(place[first] - 1, len(padded) - 1))
    own = label[place]
    starts = (own > label[place - 1]) & (own >= label[place + 1])
    starts[1:] &= ~first[:-1]  # so that each round makes a text shorter
    starts |= first
    at = np.flatnonzero(starts)
    sizes = np.diff(np.append(at, len(names)))
    inside = np.arange(len(names)) - np.repeat(at, sizes)
    sums = np.add.reduceat(names * weights(int(sizes.max()))[inside], at)
    return mix(sums + sizes.astype(np.uint64)) | np.uint64(1), text[at]


def sketches(texts: list[str], level: int = LEVEL, size: int = SKETCH) -> list[np.ndarray]:
    """For each text the smallest hashes of its names, ascending; none for an empty text."""
    lengths = np.array([len(t) for t in texts])
    out = [np.zeros(0, np.uint32)] * len(texts)
    if not lengths.sum():
        return out
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    kept_names, kept_texts, depth = [], [], 0
    while len(names):
        alone = np.ones(len(names), bool)
        alone[1:] &= text[1:] != text[:-1]
        alone[:-1] &= text[1:] != text[:-1]
        keep = np.ones(len(names), bool) if depth >= level else alone
        if keep.any():
            kept_names.append((mix(names[keep]) >> np.uint64(32)).astype(np.uint64))
            kept_texts.append(text[keep])
        if alone.any():
            names, text = names[~alone], text[~alone]
        if len(names):
            names, text = parse_round(names, text)
        depth += 1
    keys = np.unique((np.concatenate(kept_texts).astype(np.uint64) << np.uint64(32)) | np.concatenate(kept_names))
    owner = (keys >> np.uint64(32)).astype(np.int64)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    hashes = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [hashes[cut[t] : min(cut[t + 1], cut[t] + size)] for t in range(len(texts))]


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Share of common hashes among the smallest of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:size]
    return float((np.isin(union, a) & np.isin(union, b)).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, its number of code points and its fingerprint. No shuffle."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            found = [written(s) for part in _parts(texts) for s in sketches(texts[part])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.string())], [id_col, "n_chars", "fingerprint"])

    narrow = docs.select(docs[id_col], docs[text_col].alias("text"))
    return in_arrow(narrow, run, StructType(narrow.schema.fields[:1] + StructType.fromDDL("n_chars long, fingerprint string").fields))


def _parts(texts: list[str]):
    a, size = 0, 0
    for b, t in enumerate(texts, 1):
        size += len(t)
        if size >= SLICE_CHARS or b == len(texts):
            yield slice(a, b)
            a, size = b, 0


def edited_fingerprints(docs: DataFrame, share: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text with its last 1/share replaced by as much of the start of the next document, and
    their likeness.

    Ids are integers. The next document is the one of the next id (rows of NULL id first, rows of one id by text); after the last
    comes the first. Ids are dealt in ranges, one shuffle of the texts; each range also gets a copy of the row that
    starts the next one. Rows stream through a task in order, so it holds one batch at a time.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    order = F.coalesce(F.col("id").cast("double"), F.lit(float("-inf")))
    cuts = rows.select(order.alias("order")).where("id IS NOT NULL").approxQuantile("order", [i / parts for i in range(1, parts)], 0.1 / parts)
    splits = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="order", outputCol="range").transform(rows.withColumn("order", order))
    ranged = ranged.select("id", "text", F.col("range").cast("int").alias("part"))
    # at most one row a range comes to the driver: its first id
    heads = ranged.groupBy("part").agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("null")).orderBy("part").collect()
    follow = [(heads[k - 1].part, None if h.null else h.id) for k, h in enumerate(heads)]
    next_start = spark.createDataFrame(follow, f"behind int, head {kind}")
    # each row goes to its own range; the rows of a range's first id also to the range before, behind its own rows
    dealt = ranged.join(F.broadcast(next_start), F.col("id").eqNullSafe(F.col("head")), "left")
    late = F.when(F.col("behind").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = dealt.withColumn("late", F.explode(late)).withColumn("part", F.when(F.col("late") == 1, F.col("behind")).otherwise(F.col("part")))
    dealt = dealt.select("id", "text", "part", "late").repartitionById(parts, "part")
    dealt = dealt.sortWithinPartitions("part", "late", F.col("id").asc_nulls_first(), "text")

    def run(batches):
        held: list[tuple] = []  # rows whose next row has not come yet or not been worked on
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                held.append(row)
                size += len(row[1])
                if size >= SLICE_CHARS and row[3] == 0:
                    yield from work(held)
                    held, size = held[-1:], len(row[1])
        yield from work(held, True)

    def work(held, last=False):
        texts, pairs = [], []
        for k, row in enumerate(held):
            if row[3]:
                continue
            if k + 1 == len(held):
                if not last:
                    continue
                raise ValueError("a range has no row that follows it")
            following = held[k + 1]
            n = len(row[1])
            cut = n // share
            pairs.append((row, row[1][: n - cut] + following[1][:cut], following[1]))
        if not pairs:
            return
        for part in _parts([p[0][1] + p[1] for p in pairs]):
            own = pairs[part]
            texts = [p[0][1] for p in own] + [own[-1][2]]
            plain, edited = sketches(texts), sketches([p[1] for p in own])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0][0] for p in own], held_type), pa.array([len(p[0][1]) for p in own], pa.int64()),
                    pa.array([hashlib.sha256(p[1].encode("utf-8", "surrogatepass")).hexdigest() for p in own]),
                    pa.array([written(s) for s in plain[:-1]]), pa.array([written(s) for s in edited]),
                    pa.array([likeness(a, b) for a, b in zip(plain, edited)]), pa.array([likeness(a, b) for a, b in zip(plain, plain[1:])]),
                ],
                names,
            )

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    fields = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_arrow(dealt, run, StructType([docs.select(id_col).schema.fields[0], *StructType.fromDDL(fields).fields]))
