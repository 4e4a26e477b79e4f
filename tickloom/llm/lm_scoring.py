"""Language-model scores as masked pseudo-likelihood: a network predicts each word of a text from the words on both sides.

Words of all documents are counted; the most frequent are the vocabulary, which grows with the square root of the number of
distinct words. All others fall into buckets by their kinds of characters and length. The network adds one vector for each
of the two words before and the two after, takes the hyperbolic tangent, and predicts the class of the masked word, then
the word within its class. Output biases start at the logarithms of the counts. A word outside the vocabulary is predicted
as its bucket, then as itself by its share of the bucket's counts; a word that was never counted has the share of half an
occurrence.

Training reads every document, and every word position is masked: the positions of a text are dealt over the rounds (over
`every` of them at most, then again). Texts are dealt into shards of about `shard` words by a hash of their words and id, as token numbers, and
stand in a shard in the order of that hash; a shard starts from the shared weights and takes steps of exactly `batch` positions. So what is
learnt depends on the corpus alone: not on files, tasks or cores. A shard sends its weights, in blocks that are added as they stream in; their mean,
weighted by masked words, is the next round's start. What is gathered so grows with the corpus, what the driver gets does not.

A text's score is the sum of the log-probabilities of all its words, each masked in turn. Counts of words outside the vocabulary
stay in a table, which is joined to the distinct words of each text: no process holds them all. A NULL or empty text has no
words and scores 0. Rows are scored each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import Texts, in_arrow, mix, seeded, slices, span_hashes, stored, texts_of, weights, words_of
from .quality_classifier import _KIND


@dataclass(frozen=True)
class Shape:
    words: int = 2048  # at least; `grow` times the root of the number of distinct words if that is more
    grow: float = 4.0
    buckets: int = 64
    classes: int = 48
    width: int = 32
    every: int = 8  # most rounds that the places of a text are dealt over
    rounds: int = 1
    shard: int = 1 << 22  # words that one task trains on in turn
    batch: int = 4096
    rate: float = 0.1

    @property
    def tokens(self) -> int:
        return self.words + self.buckets

    @property
    def members(self) -> int:
        return -(-self.tokens // self.classes)

    def grown(self, distinct: int) -> "Shape":
        words = max(self.words, math.isqrt(int(self.grow * self.grow * distinct)))
        return self if words == self.words else replace(self, words=words, classes=max(self.classes, math.isqrt(words + self.buckets)))


AROUND = (-2, -1, 1, 2)
BLOCKS = 64
# a capital letter is of the kind of its small one: words count in lower case, and so does their bucket
_FORM = _KIND.copy()
_FORM[65:91] = _KIND[97:123]


@dataclass
class Network:
    """Weights as float32: a table for each place around, a hidden bias, class and word outputs with biases."""

    near: np.ndarray  # places, tokens + 1 (the last is "no word"), width
    hidden: np.ndarray
    class_out: np.ndarray
    class_bias: np.ndarray
    word_out: np.ndarray  # classes, members, width
    word_bias: np.ndarray  # classes, members; -1e9 where a class has fewer members

    def arrays(self) -> list[np.ndarray]:
        return [self.near, self.hidden, self.class_out, self.class_bias, self.word_out, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def like(self, flat: np.ndarray) -> "Network":
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(*out)


@dataclass
class Language:
    """The vocabulary as sorted word hashes with their token numbers, the network, the counts of each bucket's words outside
    the vocabulary, and the table (word, bucket, count) of those words."""

    hashes: np.ndarray
    numbers: np.ndarray
    network: Network
    shape: Shape
    totals: np.ndarray
    rest: DataFrame | None = None


def word_counts(docs: DataFrame, shape: Shape, text_col: str = "text") -> DataFrame:
    """(word, bucket, count) over all documents; each batch sends a word once."""

    def run(batches):
        for batch in batches:
            words, forms = [], []
            for _, _, part in slices(texts_of(batch.column(0))):
                h, f = _hashed(part, shape)[:2]
                words.append(h)
                forms.append(f)
            if words:
                h, at, n = np.unique(np.concatenate(words), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.concatenate(forms)[at].astype(np.int32)), pa.array(n)], ["word", "bucket", "count"])

    rows = in_arrow(docs.select(docs[text_col]), run, "word long, bucket int, count long")
    return rows.groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("count").alias("count"))


def _hashed(texts: Texts, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = words_of(texts)
    if not len(words.starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), words.first
    hashes = span_hashes(texts.data, words.starts, words.ends, lower=True)
    kind = np.bitwise_or.reduceat(_FORM[texts.data], words.starts).astype(np.uint64)
    size = np.minimum(words.ends - words.starts, 15).astype(np.uint64)
    bucket = mix((kind << np.uint64(4) | size) + seeded(5)) % np.uint64(shape.buckets)
    return hashes, bucket.astype(np.int64), words.first


def tokens_of(texts: Texts, hashes: np.ndarray, numbers: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token number of each word, the first word of each text, the words around (tokens where there is none), and the hashes."""
    words, bucket, first = _hashed(texts, shape)
    token = shape.words + bucket
    if len(hashes) and len(words):
        at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
        known = hashes[at] == words
        token[known] = numbers[at[known]]
    return token.astype(np.int32), first, around_of(token, first, shape), words


def around_of(token: np.ndarray, first: np.ndarray, shape: Shape) -> np.ndarray:
    """The tokens at the places around each token of its text, `shape.tokens` where there is none."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    around = np.full((len(AROUND), len(token)), shape.tokens, np.int32)
    for row, step in zip(around, AROUND):
        if len(token) > abs(step):
            a, b = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -step), slice(step, None))
            same = text[a] == text[b]
            row[a][same] = token[b][same]
    return around


def start(counts: list[tuple[int, int]], bucket_counts: np.ndarray, shape: Shape) -> Language:
    """Vocabulary and first weights from the counts of frequent words and of the buckets of all others."""
    words = np.array([w for w, _ in counts], np.int64).view(np.uint64)
    order = np.argsort(words)
    numbers = np.arange(len(words))[order]
    total = np.full(shape.classes * shape.members, 0.0)
    total[: len(counts)] = [c for _, c in counts]
    total[shape.words : shape.tokens] = bucket_counts
    total[: shape.tokens] += 0.5
    # token t is member t // classes of class t % classes, so that frequent words spread over all classes
    grid = total.reshape(shape.members, shape.classes).T
    random = np.random.default_rng(7)
    word_bias = np.where(grid > 0, np.log(np.maximum(grid, 1e-9) / grid.sum(1, keepdims=True)), -1e9)
    network = Network(
        random.normal(0, 0.1, (len(AROUND), shape.tokens + 1, shape.width)).astype(np.float32), np.zeros(shape.width, np.float32),
        np.zeros((shape.classes, shape.width), np.float32), np.log(grid.sum(1) / grid.sum()).astype(np.float32),
        np.zeros((shape.classes, shape.members, shape.width), np.float32), word_bias.astype(np.float32),
    )
    return Language(words[order], numbers, network, shape, np.asarray(bucket_counts, np.float64))


def _hidden(net: Network, around: np.ndarray) -> np.ndarray:
    total = net.near[0][around[0]]
    for k in range(1, len(AROUND)):
        total += net.near[k][around[k]]
    total += net.hidden
    return np.tanh(total, out=total)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def _log_share(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each column at its chosen row; x is used up."""
    x -= x.max(0)
    own = x[chosen, np.arange(len(chosen))]
    np.exp(x, out=x)
    return own - np.log(x.sum(0))


def _in_classes(token: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The order of the tokens by class, and where each class starts in it."""
    group = token % shape.classes
    turn = np.argsort(group.astype(np.uint16) if shape.classes < 1 << 16 else group, kind="stable")
    return turn, np.searchsorted(group[turn], np.arange(shape.classes + 1))


def _word_logits(net: Network, h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One column a row of h, which stands in the order of the classes: the outputs of the members of its class."""
    out = np.empty((net.word_bias.shape[1], len(h)), h.dtype)
    for c in np.flatnonzero(np.diff(cut)):
        at = slice(cut[c], cut[c + 1])
        np.matmul(net.word_out[c], h[at].T, out=out[:, at])
        out[:, at] += net.word_bias[c][:, None]
    return out


def log_probabilities(net: Network, shape: Shape, token: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Of each token given the words around it."""
    out = np.zeros(len(token))
    for a in range(0, len(token), 1 << 14):
        t = token[a : a + (1 << 14)]
        turn, cut = _in_classes(t, shape)
        t = t[turn]
        h = _hidden(net, around[:, a : a + (1 << 14)][:, turn])
        own = _log_share(net.class_out @ h.T + net.class_bias[:, None], t % shape.classes).astype(np.float64)
        own += _log_share(_word_logits(net, h, cut), t // shape.classes)
        out[a : a + len(t)][turn] = own
    return out


class Trainer:
    """Adaptive gradient steps on masked words."""

    def __init__(self, net: Network, shape: Shape) -> None:
        self.net, self.shape = net.like(net.flat()), shape
        self.seen = [np.full_like(a, 1e-3) for a in net.arrays()]
        self.words = 0

    def _step(self, k: int, gradient: np.ndarray, at=slice(None)) -> None:
        seen = self.seen[k][at] + gradient * gradient
        self.seen[k][at] = seen
        self.net.arrays()[k][at] -= self.shape.rate * gradient / np.sqrt(seen)

    def learn(self, token: np.ndarray, around: np.ndarray) -> None:
        """One step. Words stand in the order of their classes, so that a class is a range; outputs have one column a word."""
        net, shape, n = self.net, self.shape, len(token)
        turn, cut = _in_classes(token, shape)
        token, place = token[turn], np.arange(n)
        around = around[:, turn].astype(np.uint16 if shape.tokens < 1 << 16 else np.int32)
        group, member = token % shape.classes, token // shape.classes
        h = _hidden(net, around)
        p = _softmax(net.class_out @ h.T + net.class_bias[:, None])
        p[group, place] -= 1
        here = np.flatnonzero(np.diff(cut))
        q = _softmax(_word_logits(net, h, cut))
        q[member, place] -= 1
        back = p.T @ net.class_out
        word_step = np.empty((len(here), shape.members, shape.width), h.dtype)
        for i, c in enumerate(here):
            at = slice(cut[c], cut[c + 1])
            back[at] += q[:, at].T @ net.word_out[c]
            np.matmul(q[:, at], h[at], out=word_step[i])
        word_step /= n
        all_or_some = slice(None) if len(here) == shape.classes else here
        self._step(4, word_step, all_or_some)
        self._step(5, np.add.reduceat(q, cut[here], axis=1).T / n, all_or_some)
        self._step(2, p @ h / n)
        self._step(3, p.sum(1) / n)
        back *= (1 - h * h) / n
        self._step(1, back.sum(0))
        for k in range(len(AROUND)):
            turn = np.argsort(around[k], kind="stable")
            rows = around[k][turn]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            self._step(0, np.add.reduceat(back[turn], first), (k, rows[first]))
        self.words += n


def masked(words: np.ndarray, first: np.ndarray, shape: Shape, turn: int) -> np.ndarray:
    """Places to train on in a round: each place of a text has its turn, which a hash of the text's words (or tokens) shifts."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words, out=total[1:], dtype=np.uint64)
    shift = mix(total[first[1:]] - total[first[:-1]] + seeded(1))
    sizes, parts = np.diff(first), min(shape.every, shape.rounds)
    place = np.arange(len(words)) - np.repeat(first[:-1], sizes)
    own = (place.astype(np.uint64) + np.repeat(shift >> np.uint64(1), sizes)) % np.uint64(parts)
    return np.flatnonzero(own == turn % parts)


def token_texts(docs: DataFrame, language: Language, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, key, tokens) of every text with a word; key is a hash of the words in their order and of the id."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(language, rest=None))
    kind = np.uint16 if language.shape.tokens < 1 << 16 else np.uint32

    def run(batches):
        lang = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, part in slices(texts_of(batch.column(1))):
                token, first, _, words = tokens_of(part, lang.hashes, lang.numbers, lang.shape)
                sizes = np.diff(first)
                place = np.arange(len(words)) - np.repeat(first[:-1], sizes)
                total = np.zeros(len(words) + 1, np.uint64)
                np.cumsum(words * weights(int(sizes.max(initial=1)))[place], out=total[1:])
                key = mix((total[first[1:]] - total[first[:-1]]) ^ mix(ids[a:b].astype(np.uint64) + seeded(11)))
                some = pa.array(sizes > 0)
                raw = pa.Array.from_buffers(
                    pa.large_binary(), b - a, [None, pa.py_buffer((first * kind().itemsize).astype(np.int64).tobytes()), pa.py_buffer(token.astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key % np.uint64(shards)).astype(np.int32)), pa.array(key.view(np.int64)), raw.cast(pa.binary())], ["shard", "key", "tokens"]).filter(some)

    narrow = docs.select(F.xxhash64(docs[id_col]).alias("id"), docs[text_col])
    return in_arrow(narrow, run, "shard int, key long, tokens binary")


def train_round(docs: DataFrame, language: Language, turn: int, shards: int, id_col: str = "doc_id", text_col: str = "text") -> Network:
    shared = docs.sparkSession.sparkContext.broadcast(replace(language, rest=None))
    kind = np.uint16 if language.shape.tokens < 1 << 16 else np.uint32

    def train(batches):
        lang = shared.value
        shard, trainer, held = None, None, None

        def learn(rest: bool = False):
            """Steps of exactly `batch` positions; what is left over waits for the shard's next rows."""
            nonlocal held
            token, around = held
            size = lang.shape.batch
            end = len(token) if rest else len(token) // size * size
            for a in range(0, end, size):
                trainer.learn(token[a : min(a + size, end)], around[:, a : min(a + size, end)])
            held = token[end:], around[:, end:]

        def learnt():
            learn(rest=True)
            if trainer.words:
                flat = np.array_split(trainer.net.flat().astype(np.float64) * trainer.words, BLOCKS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(BLOCKS), pa.int32()), pa.array([float(trainer.words)] * BLOCKS), pa.array([x.astype(np.float32).tobytes() for x in flat])],
                    ["block", "words", "weights"])

        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
            for lo, hi in zip(cuts, [*cuts[1:], len(of)]):
                if of[lo] != shard:
                    if trainer is not None:
                        yield from learnt()
                    shard, trainer = of[lo], Trainer(lang.network, lang.shape)
                    held = np.zeros(0, np.int32), np.zeros((len(AROUND), 0), np.int32)
                rows = [np.frombuffer(x.as_buffer(), kind).astype(np.int32) for x in batch.column(2).slice(lo, hi - lo)]
                for part in _runs(rows, 1 << 18):
                    token, first = np.concatenate(part), np.concatenate([[0], np.cumsum([len(r) for r in part])])
                    at = masked(token, first, lang.shape, turn)
                    held = np.concatenate([held[0], token[at]]), np.concatenate([held[1], around_of(token, first, lang.shape)[:, at]], axis=1)
                    learn()
        if trainer is not None:
            yield from learnt()

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for block, words, raw in zip(*[c.to_pylist() for c in batch.columns]):
                own = np.frombuffer(raw, np.float32).astype(np.float64)
                had = sums.get(block, (0.0, 0.0))
                sums[block] = (had[0] + words, had[1] + own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([w for w, _ in sums.values()], pa.float64()),
             pa.array([(x / w).astype(np.float32).tobytes() for w, x in sums.values()], pa.binary())], ["block", "words", "weights"])

    schema = "block int, words double, weights binary"
    texts = token_texts(docs, language, shards, id_col, text_col).repartition(shards, "shard").sortWithinPartitions("shard", "key")
    sent = in_arrow(texts, train, schema).repartition("block")
    got = sorted(in_arrow(sent, add, schema).collect(), key=lambda r: r.block)
    if not got:
        return language.network
    return language.network.like(np.concatenate([np.frombuffer(r.weights, np.float32) for r in got]))


def _runs(rows: list[np.ndarray], size: int):
    """Whole texts in runs of about `size` tokens."""
    run, held = [], 0
    for row in rows:
        run.append(row)
        held += len(row)
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def fit_language(docs: DataFrame, shape: Shape = Shape(), text_col: str = "text", id_col: str = "doc_id") -> Language:
    """Vocabulary from the counts over all documents, then rounds of training over all documents."""
    counts = stored(word_counts(docs, shape, text_col), "words")
    # the power of two that enough words reach: only words that reach it are sorted, few whatever the number of tasks
    size = F.floor(F.log2(F.col("count").cast("double"))).cast("int")
    sizes = sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("words"), F.sum("count").alias("total")).collect(), key=lambda r: -r["size"])
    shape = shape.grown(sum(r.words for r in sizes))
    found, least = 0, 0
    for r in sizes:
        found, least = found + r.words, r["size"]
        if found >= shape.words:
            break
    often = counts.where(size >= least)
    top = [(r.word, r["count"]) for r in often.orderBy(F.desc("count"), "word").limit(shape.words).collect()]
    # the last word taken and its count tell words inside the vocabulary from those outside
    if top:
        rest = counts.where((F.col("count") < top[-1][1]) | ((F.col("count") == top[-1][1]) & (F.col("word") > top[-1][0])))
    else:
        rest = counts
    buckets = np.zeros(shape.buckets)
    for r in rest.groupBy("bucket").agg(F.sum("count").alias("count")).collect():
        buckets[r.bucket] = r["count"]
    language = start(top, buckets, shape)
    shards = max(1, -(-sum(r.total for r in sizes) // shape.shard))
    for turn in range(shape.rounds):
        language.network = train_round(docs, language, turn, shards, id_col, text_col)
    language.rest = rest
    return language


# Logarithms of shares are added as whole multiples of 1 / UNIT, so that a sum does not depend on the order of its parts.
UNIT = float(1 << 32)


def _log_shares(language: Language) -> DataFrame:
    """(word, share) of the words outside the vocabulary: the logarithm of each one's part of its bucket, in units."""
    totals = F.array(*[F.lit(float(x)) for x in language.totals])
    share = F.log(F.col("count") / (F.get(totals, F.col("bucket")) + 0.5))
    return language.rest.select("word", F.round(share * UNIT).cast("long").alias("share"))


def lm_scores(docs: DataFrame, language: Language, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, its number of words, their summed conditional log-probability and its mean (NULL without
    words). Texts are not shuffled, only the hashes of their distinct words outside the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(language, rest=None))

    def run(batches):
        lang = shared.value
        never = np.round(np.log(0.5 / (lang.totals + 0.5)) * UNIT).astype(np.int64)
        for batch in batches:
            for a, b, part in slices(texts_of(batch.column(2))):
                row, n = batch.column(0).slice(a, b - a), b - a
                token, first, around, words = tokens_of(part, lang.hashes, lang.numbers, lang.shape)
                total = np.concatenate([[0.0], np.cumsum(log_probabilities(lang.network, lang.shape, token, around))])
                at = np.flatnonzero(token >= lang.shape.words)
                text, word, bucket = np.repeat(np.arange(n), np.diff(first))[at], words[at], token[at] - lang.shape.words
                turn = np.lexsort((word, text))
                text, word, bucket = text[turn], word[turn], bucket[turn]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
                new = np.flatnonzero(fresh)
                times = np.diff(np.append(new, len(at)))
                # one row for each text, dealt by its number, and one for each of its distinct words outside the vocabulary
                rows = row.to_numpy()
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([row, pa.array(rows[text[new]])]),
                    pa.concat_arrays([batch.column(1).slice(a, n), pa.nulls(len(new), batch.column(1).type)]),
                    pa.concat_arrays([pa.array(np.diff(first)), pa.nulls(len(new), pa.int64())]),
                    pa.concat_arrays([pa.array(total[first[1:]] - total[first[:-1]]), pa.nulls(len(new), pa.float64())]),
                    pa.array(np.concatenate([mix(rows.astype(np.uint64) + seeded(3)), word[new]]).view(np.int64)),
                    pa.array(np.concatenate([np.zeros(n, np.int64), times])),
                    pa.array(np.concatenate([np.zeros(n, np.int64), never[bucket[new]]])),
                ], ["row", id_col, "n_words", "network", "word", "times", "never"])

    narrow = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col], docs[text_col])
    fields = StructType.fromDDL("row long").fields + narrow.schema.fields[1:2] + StructType.fromDDL("n_words long, network double, word long, times long, never long").fields
    parts = in_arrow(narrow, run, StructType(fields))
    if language.rest is not None:
        parts = parts.join(_log_shares(language), "word", "left").withColumn("never", F.coalesce("share", "never"))
    scored = parts.groupBy("row").agg(
        F.first(id_col, ignorenulls=True).alias(id_col), F.max("n_words").alias("n_words"), F.max("network").alias("network"),
        F.sum(F.col("times") * F.col("never")).alias("units"))
    out = scored.select(id_col, "n_words", (F.col("network") + F.col("units") / UNIT).alias("log_probability"))
    return out.withColumn("mean_log_probability", F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words")))
