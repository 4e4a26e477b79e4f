"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text is four bags of n-grams: lower-cased words and word pairs, and forms and form pairs. A form says which kinds of
characters a word holds and whether it equals the word before. Each n-gram is hashed to a weight; a text's score is the
sparse dot product of its n-gram frequencies (each bag sums to its scale) with the weights, plus a bias.

Training reads at most about `train_rows` labelled documents (a documented bound: the weights, not the corpus, limit
the fit), dealt by hash in `shards` groups. A task runs the updates over a group and returns one weight vector of
fixed size; their mean is the model. Scoring covers every document.

A NULL or empty text has no n-grams and scores by the bias alone. Rows with a NULL label or id don't train; equal ids
with different labels train on the mean label. Without any label every score is 1. Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import GOLDEN, Texts, give_back, in_arrow, mix, pass_batches, seeded, ship, slices, span_hashes, texts_of, words_of


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    train_rows: int = 24_000
    shards: int = 6
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.5
    threshold: float = 0.7


SCALES = (4.0, 4.0, 8.0, 8.0)
_KIND = np.full(256, 128, np.uint8)
for _chars, _bit in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 4), (b".,;:'\"()-", 8),
                     (b"!?", 16), (b"#*$%&<>@", 32), (b"|", 64)):
    _KIND[list(_chars)] = _bit
_KIND[128:] = 2
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0


def grams(texts: Texts, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four bags of a slice: for each the weight index of every n-gram and the first n-gram of every text."""
    words = words_of(texts)
    n, first = len(words.starts), words.first
    if n == 0:
        return [(np.zeros(0, np.int64), first)] * 4
    hashes = span_hashes(texts.data, words.starts, words.ends, lower=True)
    forms = np.bitwise_or.reduceat(_KIND[texts.data], words.starts).astype(np.uint64)
    pair = np.ones(n, bool)
    pair[first[1:][first[1:] > first[:-1]] - 1] = False
    same = np.zeros(n, bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & pair[:-1]
    forms = (forms << np.uint64(1)) | same
    seconds = np.concatenate([[0], np.cumsum(pair)])[first]
    shift = np.uint64(64 - bits)
    out = []
    for k, stream in enumerate((hashes, forms)):
        single = mix(stream + seeded(2 * k + 1))
        both = mix(single[:-1] * np.uint64(3) + single[1:] * GOLDEN)[pair[:-1]]
        out += [((single >> shift).astype(np.int64), first), ((both >> shift).astype(np.int64), seconds)]
    return out


def scores(texts: Texts, weights: np.ndarray, bias: float, bits: int) -> np.ndarray:
    total = np.full(len(texts), bias)
    for (index, first), scale in zip(grams(texts, bits), SCALES):
        if len(index):
            sums = np.concatenate([[0.0], np.cumsum(weights[index], dtype=np.float64)])
            total += scale * (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)
    return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def examples(texts: Texts, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct weight indexes and their values."""
    bags = grams(texts, bits)
    out = []
    for t in range(len(texts)):
        index, value = [], []
        for (all_, first), scale in zip(bags, SCALES):
            own = all_[first[t] : first[t + 1]]
            if len(own):
                index.append(own)
                value.append(np.full(len(own), scale / len(own)))
        if not index:
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        at, where = np.unique(np.concatenate(index), return_inverse=True)
        out.append((at, np.bincount(where, np.concatenate(value))))
    return out


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, float]], s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias after the updates over all rows, `epochs` times, in an order fixed by the rows' number."""
    size = 1 << s.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    base = min(max(float(np.mean([y for _, _, y in rows])), 0.01), 0.99)
    base = np.log(base / (1 - base))

    def weight(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)

    rows = [(np.append(at, size), np.append(x, 1.0), y) for at, x, y in rows]
    for epoch in range(s.epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[i]
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x + base, -30, 30)))
            g = (p - y) * x
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / s.alpha * w
            n[at] += g * g
    out = weight(np.arange(size + 1))
    return out[:-1].astype(np.float32), float(out[-1] + base)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> tuple[np.ndarray, float] | None:
    """Weights and bias, or None without labelled documents. What comes to the driver is `shards` vectors of 2^bits floats."""
    marked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna()
        .groupBy("id").agg(F.avg("label").alias("label"))
    )
    count = marked.count()
    if count == 0:
        return None
    part = min(1.0, settings.train_rows / count)
    sample = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < int(part * (1 << 31)))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    shard = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(settings.shards)).alias("shard")
    rows = rows.join(F.broadcast(sample), "id").select(shard, F.col("id").cast("string").alias("id"), "text", "label")

    def train(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("id", "ascending"), ("text", "ascending")])
        labels_ = table.column("label").to_numpy()
        seen = [(at, x, y) for a, b, part_ in slices(texts_of(table.column("text"))) for (at, x), y in zip(examples(part_, settings.bits), labels_[a:b])]
        w, bias = follow_leader(seen, settings)
        return pa.table({"n": [len(seen)], "bias": [bias], "weights": pa.array([w.tobytes()], pa.binary())})

    def task(table: pa.Table) -> pa.Table:
        try:
            return train(table)
        finally:
            give_back()

    ship(docs.sparkSession)
    got = rows.groupBy("shard").applyInArrow(task, "n long, bias double, weights binary").collect()
    if not got:
        return None
    share = np.array([r.n for r in got], float)
    share /= share.sum()
    weights = sum(p * np.frombuffer(r.weights, np.float32) for p, r in zip(share, got))
    return weights.astype(np.float32), float(sum(p * r.bias for p, r in zip(share, got)))


def held_out(id_col) -> F.Column:
    """Rows kept from training: crc32 of the id as text leaves 2 modulo 4. A NULL id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _scorer(docs: DataFrame, model, settings: Settings):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(column):
        texts = texts_of(column)
        if shared.value is None:
            return np.ones(len(texts))
        weights, bias = shared.value
        parts = [scores(part, weights, bias, settings.bits) for _, _, part in slices(texts)]
        return np.concatenate(parts) if parts else np.zeros(0)

    return score


def quality_scores(docs: DataFrame, model, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, whether it was held out, its score and the prediction at the threshold. No shuffle."""
    score = _scorer(docs, model, settings)
    narrow = pass_batches(docs, [id_col, text_col])

    def run(batches):
        for batch in batches:
            found = score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [id_col, "score"])

    out = in_arrow(narrow, run, StructType(narrow.schema.fields[:1] + StructType.fromDDL("score double").fields))
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def quality_accepted(docs: DataFrame, model, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    score = _scorer(docs, model, settings)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at)) >= settings.threshold))

    return in_arrow(docs, run, docs.schema)


def train_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where(~held_out(F.col(id_col)))
