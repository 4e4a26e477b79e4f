"""Shared pieces: stored intermediate tables, Arrow text batches as byte arrays, and hashed words.

Texts are handled as one UTF-8 byte array with document offsets, as Arrow keeps them, and cut into slices of about half a
megabyte of whole documents, so that the numpy temporaries stay small whatever the batch size is.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

SLICE = 1 << 19
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, kind: str = "table", by: str | None = None) -> DataFrame:
    """Write once as Parquet into the shared checkpoint folder and read back: lineage ends at files that outlive executors.

    With `by`, rows are first dealt over the shuffle partitions by that column's hash.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tickloom-{kind}-{uuid.uuid4().hex}"
    (df.repartition(by) if by else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Texts(NamedTuple):
    """Concatenated UTF-8 bytes of some documents and where each starts; the last offset is the end."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """Number of marked bytes in each text."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def texts_of(column: pa.Array) -> Texts:
    """A string column without copying its bytes; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return Texts(raw, offsets - first)


def slices(texts: Texts, size: int = SLICE) -> Iterator[tuple[int, int, Texts]]:
    """Whole documents in runs of about `size` bytes; a longer document is a run of its own."""
    a, n = 0, len(texts)
    while a < n:
        b = int(np.searchsorted(texts.offsets, texts.offsets[a] + size, "right")) - 1
        b = min(n, max(a + 1, b))
        lo, hi = texts.offsets[a], texts.offsets[b]
        yield a, b, Texts(texts.data[lo:hi], texts.offsets[a : b + 1] - lo)
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.array(x, dtype=np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def seeded(k: int) -> np.uint64:
    """A constant that differs for each small number."""
    return np.uint64((k * int(GOLDEN)) & 0xFFFFFFFFFFFFFFFF)


_weights = np.zeros(0, np.uint64)


def weights(n: int) -> np.ndarray:
    """Odd pseudo-random factors for positions 0 to n - 1."""
    global _weights
    if len(_weights) < n:
        size = max(64, 1 << int(n - 1).bit_length())
        _weights = mix((np.arange(1, size + 1, dtype=np.uint64)) * GOLDEN) | np.uint64(1)
    return _weights[:n]


_BYTES = mix(np.arange(1000, 1256, dtype=np.uint64) * GOLDEN)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SPACES)] = False


class Words(NamedTuple):
    """Byte ranges of the words of some texts; word `i` of text `t` is number first[t] + i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: Texts, in_word: np.ndarray = _IN_WORD) -> Words:
    """Maximal runs of marked bytes; of bytes other than space and 0x09 to 0x0D unless said otherwise."""
    data, n = texts.data, len(texts.data)
    if n == 0:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    inside = in_word[data]
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges ascend and don't overlap."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    total = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    place = np.arange(total[-1], dtype=np.int64) - np.repeat(total[:-1], sizes)
    value = (_LOWER if lower else _BYTES)[data[place + np.repeat(starts, sizes)]]
    value *= weights(int(sizes.max()) if len(sizes) else 1)[place]
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(value, total[:-1][full])
    return mix(out + sizes.astype(np.uint64) * GOLDEN)


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words inside texts, and the text of each; window order is word order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[:n] == text[size - 1 :]
    factor = weights(size)
    sums = np.zeros(n, np.uint64)
    for k in range(size):
        sums += hashes[k : k + n] * factor[k]
    return mix(sums[inside]), text[:n][inside]


def pass_batches(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the columns an operator reads; extra columns of the same names as its results do no harm."""
    return df.select(*[df[c] for c in columns])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of the table has them (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as a zip file that Spark hands out."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    name = Path(tempfile.mkdtemp(prefix="tickloom-package-")) / "tickloom_package.zip"
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted(root.joinpath("tickloom").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(name))
    _shipped.add(context.applicationId)


def give_back() -> None:
    """Hand memory that Arrow and the C library hold free back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with this package at hand on every executor, in batches of 16 MB where the session has the usual 64 MB.

    Workers give freed memory back after each task: they outlive it, beside the joins of later stages.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "16m")

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)
