"""Best-fit packing of documents into sequences of a fixed number of tokens, by length patterns.

1. Each document becomes its ids and one end id, cut into pieces only where it is longer than a sequence. The pieces
   (a few numbers each) are written once.
2. The histogram of piece lengths, never more rows than a sequence has tokens, goes to the driver whatever the corpus is.
   There, patterns of a few length classes that fill a sequence are enumerated, non-negative least squares fits how
   often each repeats to the histogram, the counts are rounded down, and each repeat takes real lengths, the last one by best
   fit. Residual lengths go, longest first, to the fullest sequences they fit in.
3. Each piece gets its rank among the pieces of its length (numbered inside hashed parts of a length, so that one
   frequent length is many tasks) and looks up its place in the plan.

A NULL or empty text is the end id alone. Rows that repeat an id are packed each. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from .common import in_arrow, stored
from .tokens import word_tokenizer

CLASSES, MOST = 32, 4
BATCH_CHARS = 1 << 21


def token_pieces(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and on request the ids. No shuffle."""

    def rows(ids, texts, encoder):
        out = {k: [] for k in ("doc", "piece", "start", "length", "crc", "ids")}
        for doc, raw in zip(ids, encoder.ids(texts)):
            raw += end_id.to_bytes(4, "little")
            for piece, at in enumerate(range(0, len(raw), 4 * room)):
                own = raw[at : at + 4 * room]
                out["doc"].append(doc)
                out["piece"].append(piece)
                out["start"].append(at // 4)
                out["length"].append(len(own) // 4)
                out["crc"].append(zlib.crc32(own))
                if with_ids:
                    out["ids"].append(np.frombuffer(own, np.int32))
        return out

    def run(batches):
        encoder = word_tokenizer(tokenizer)
        for batch in batches:
            kind = batch.schema.field(0).type
            texts, a, size = batch.column(1).fill_null("").to_numpy(zero_copy_only=False).tolist() if batch.num_rows else [], 0, 0
            sizes = list(map(len, texts))
            for b, n in enumerate(sizes, 1):
                size += n
                if size >= BATCH_CHARS or b == len(sizes):
                    out = rows(range(a, b), texts[a:b], encoder)
                    columns = [batch.column(0).take(pa.array(out["doc"])).cast(kind), pa.array(out["piece"], pa.int32()),
                               *[pa.array(out[k], pa.int64()) for k in ("start", "length", "crc")]]
                    names = [id_col, "piece", "start", "length", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
                    a, size = b, 0

    narrow = docs.select(docs[id_col], docs[text_col].alias("text"))
    fields = StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")).fields
    return in_arrow(narrow, run, StructType(narrow.schema.fields[:1] + fields))


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that makes a @ x nearest to b, by the active-set method; columns outnumber rows, so few x are positive."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(20 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            trial = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[at] = trial
                break
            down = trial <= 0
            step = np.min(x[at][down] / np.maximum(x[at][down] - trial[down], 1e-300))
            x[at] += step * (trial - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def class_patterns(room: int) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """All choices of up to MOST length classes whose middles sum to a sequence but for less than a class."""
    width = room / CLASSES
    middles = (np.arange(CLASSES) + 0.5) * width
    out = [p for k in range(1, MOST + 1) for p in combinations_with_replacement(range(CLASSES - 1, -1, -1), k)
           if room - width < sum(middles[i] for i in p) <= room + width / 2]
    return middles, out


Sequence = list[tuple[int, int]]  # (length, copies) in order


class Plan:
    """Open sequences by free space, and the counts of lengths that still need a place."""

    def __init__(self, histogram: dict[int, int], room: int) -> None:
        self.room = room
        self.left = np.zeros(room + 1, np.int64)
        for length, count in histogram.items():
            self.left[length] = count
        self.open: dict[int, list[tuple[Sequence, int]]] = {}
        self.spaces: list[int] = []

    def put(self, space: int, sequence: Sequence, count: int) -> None:
        if space not in self.open:
            self.open[space] = []
            insort(self.spaces, space)
        self.open[space].append((sequence, count))

    def largest(self, low: int, high: int) -> int:
        """The largest length left in low..high, or 0."""
        found = np.flatnonzero(self.left[max(low, 1) : high + 1])
        return int(found[-1]) + max(low, 1) if len(found) else 0

    def fit_patterns(self) -> None:
        room, width = self.room, self.room / CLASSES
        self.put(0, [(room, 1)], int(self.left[room])) if self.left[room] else None
        self.left[room] = 0
        middles, patterns = class_patterns(room)
        lengths = np.arange(1, room + 1)
        owner = np.minimum((lengths - 1) // width, CLASSES - 1).astype(int)
        counts = np.bincount(owner, self.left[1:], minlength=CLASSES)
        matrix = np.zeros((CLASSES, len(patterns)))
        for j, p in enumerate(patterns):
            for i in p:
                matrix[i, j] += 1
        repeats = np.floor(least_squares(matrix * middles[:, None], counts * middles)).astype(np.int64)
        for j in np.argsort([-sum(map(float, p[:1])) for p in patterns], kind="stable"):
            self._repeat(patterns[j], int(repeats[j]), width)

    def _repeat(self, pattern: tuple[int, ...], times: int, width: float) -> None:
        while times > 0:
            free, took = self.room, []
            for i in pattern[:-1]:
                length = self.largest(int(i * width) + 1, min(int((i + 1) * width), free))
                if not length:
                    return
                took.append(length)
                free -= length
            last = self.largest(1, free)
            if not last or last < pattern[-1] * width - width:
                return
            took.append(last)
            need = {length: took.count(length) for length in took}
            many = min(times, *(int(self.left[length]) // n for length, n in need.items()))
            if many == 0:
                return
            for length, n in need.items():
                self.left[length] -= n * many
            self.put(free - last, [(length, n) for length, n in sorted(need.items(), reverse=True)], many)
            times -= many

    def fit_rest(self) -> None:
        """Longest first, into the least space that holds the length; else into new sequences."""
        for length in range(self.room, 0, -1):
            count = int(self.left[length])
            while count:
                at = bisect_left(self.spaces, length)
                if at == len(self.spaces):
                    copies = self.room // length
                    if count // copies:
                        self.put(self.room - copies * length, [(length, copies)], count // copies)
                    if count % copies:
                        self.put(self.room - count % copies * length, [(length, count % copies)], 1)
                    break
                space = self.spaces[at]
                sequence, many = self.open[space].pop()
                if not self.open[space]:
                    del self.open[space], self.spaces[at]
                if count < many:
                    self.put(space, sequence, many - count)
                    many = count
                copies = min(space // length, count // many)
                self.put(space - copies * length, [*sequence, (length, copies)], many)
                count -= copies * many
            self.left[length] = 0

    def slots(self) -> dict[str, np.ndarray]:
        """Runs of ranks of a length and where they go; ranks of a length count on from run to run."""
        rows, used, base = [], np.zeros(self.room + 1, np.int64), 0
        for space in self.spaces:
            for sequence, many in self.open[space]:
                offset = 0
                for length, copies in sequence:
                    rows.append((length, used[length], copies, base, offset))
                    used[length] += copies * many
                    offset += copies * length
                base += many
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        return {"key": (table[:, 0] << 40) | table[:, 1], "first": table[:, 1], "copies": table[:, 2], "base": table[:, 3], "offset": table[:, 4]}


def plan(histogram: dict[int, int], room: int) -> Plan:
    out = Plan(histogram, room)
    out.fit_patterns()
    out.fit_rest()
    return out


def placed(pieces: DataFrame, room: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset. The plan that executors look up is bounded by the room, not by the corpus."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = spark.sparkContext.broadcast(plan(histogram, room).slots())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64(id_col, "piece"), F.lit(parts)))
    sizes = salted.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy(id_col, "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(sizes, ["length", "part"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("before")).alias("rank"))
    at, names = pieces.columns.index("length"), [*pieces.columns, "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            s = slots.value
            i = np.searchsorted(s["key"], (length << 40) | rank, "right") - 1
            step = rank - s["first"][i] if len(rank) else rank
            found = [s["base"][i] + step // s["copies"][i], s["offset"][i] + step % s["copies"][i] * length] if len(rank) else [rank, rank]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found)], names=names)

    return in_arrow(ranked, run, StructType(pieces.schema.fields + StructType.fromDDL("sequence_id long, offset long").fields))


def packed(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """All documents in as few sequences of at most `room` tokens as the plan finds: one row per piece with its place."""
    return placed(stored(token_pieces(docs, tokenizer, room, end_id, with_ids, id_col, text_col), "pieces"), room, id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces with ids; a group holds at most one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
