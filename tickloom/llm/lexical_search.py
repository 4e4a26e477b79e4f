"""Ranked lexical search: the best documents of every item of a query set, in integer BM25-like scores.

A document's score for an item is the sum, over the item's terms, of the term's impact in that document. The search takes the items in
blocks of bounded size and reads the documents twice a block:

1. Counts over all documents: how many have a term, all terms with repeats, and in how many each term of the block stands.
2. Each document's impacts of the block's terms fold into a sketch of fixed width, the maximum at every hashed coordinate. Looking up
   the coordinates of all items at once gives upper bounds of all scores of a slice of documents. For each item the documents are
   taken by descending bound and scored exactly, until the bound falls below the score that the item's k-th best document has
   reached so far in the task; equal bounds are still scored, since ties go to the smaller id. Each task returns k rows an item, a window
   takes the best of those.

No text is shuffled, no pair below the threshold is scored, and the memory of a task is a slice of documents times the width.
Terms are compared by 64-bit hashes.

A NULL text, of a document or an item, has no term: such documents don't count, such items get no row. Items that repeat an id with another
text are ranked each for itself, equal rows once. Documents that repeat an id are documents of their own. A NULL document id ranks behind
all others of its score. Empty tables give an empty result. Whole texts are read; columns of any other name are not.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import Texts, in_arrow, slices, span_hashes, texts_of, words_of

IN_TERM = np.zeros(256, bool)
IN_TERM[0x80:] = True
IN_TERM[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True

FILTER_BITS, MOST_DOCS, AT_ONCE = 20, 256, 16


class Items(NamedTuple):
    """The items of a block that have terms: ids, the different terms of all (hashes, ascending), and each item's terms and how often it has them."""

    ids: list
    terms: np.ndarray
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray

    def slots(self) -> np.ndarray:
        """For each possible start of a hash, whether a term starts so."""
        out = np.zeros(1 << FILTER_BITS, bool)
        out[self.terms >> np.uint64(64 - FILTER_BITS)] = True
        return out


def items_of(ids: list, texts: list[str | None]) -> Items:
    part = texts_of(pa.array(texts, pa.string()))
    found = words_of(part, IN_TERM)
    hashes = span_hashes(part.data, found.starts, found.ends, lower=True)
    terms, term = np.unique(hashes, return_inverse=True)
    owner = np.repeat(np.arange(len(part)), found.counts)
    pair, times = np.unique(owner * max(1, len(terms)) + term, return_counts=True)
    owner, term = np.divmod(pair, max(1, len(terms)))
    some, first = np.unique(owner, return_index=True)
    return Items([ids[i] for i in some], terms, np.append(first, len(term)), term, times)


class Found(NamedTuple):
    """Terms of the block in a slice of documents: per (document, term), ascending, how often; and all terms of each document."""

    doc: np.ndarray
    term: np.ndarray
    times: np.ndarray
    sizes: np.ndarray


def find(texts: Texts, items: Items, slots: np.ndarray) -> Found:
    words = words_of(texts, IN_TERM)
    hashes = span_hashes(texts.data, words.starts, words.ends, lower=True)
    at = np.flatnonzero(slots[hashes >> np.uint64(64 - FILTER_BITS)])
    term = np.minimum(np.searchsorted(items.terms, hashes[at]), len(items.terms) - 1)
    same = items.terms[term] == hashes[at]
    at, term = at[same], term[same]
    doc = np.searchsorted(words.first, at, "right") - 1
    pair, times = np.unique(doc * len(items.terms) + term, return_counts=True)
    doc, term = np.divmod(pair, len(items.terms))
    return Found(doc, term, times, words.counts)


class Weights(NamedTuple):
    """Corpus counts and the weight of each term of a block."""

    n_docs: int
    n_terms: int
    weight: np.ndarray

    def impacts(self, found: Found) -> np.ndarray:
        m = 100 - 25 + (25 * found.sizes * self.n_docs) // max(1, self.n_terms)
        return self.weight[found.term] * ((1000000000 * found.times) // (1000 * found.times + 12 * m[found.doc]))


def corpus_weights(docs: DataFrame, items: Items, text_col: str) -> Weights:
    """Over all documents: those with a term, terms with repeats, and the weight of each term of the block by the number of documents that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches):
        items = shared.value
        slots, total, n_docs, n_terms = items.slots(), np.zeros(len(items.terms), np.int64), 0, 0
        for batch in batches:
            for _, _, part in slices(texts_of(batch.column(0))):
                found = find(part, items, slots)
                total += np.bincount(found.term, minlength=len(total))
                n_docs += int((found.sizes > 0).sum())
                n_terms += int(found.sizes.sum())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, [-1, -2]), pa.int64()), pa.array(np.append(total[used], [n_docs, n_terms]), pa.int64())], ["term", "n"])

    rows = in_arrow(docs.select(docs[text_col]), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    known = {row.term: row.n for row in rows}
    n_docs = known.get(-1, 0)
    held = [known.get(t, 0) for t in range(len(items.terms))]
    return Weights(n_docs, known.get(-2, 0), np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in held], np.int64))


class Ranks:
    """The best documents so far of each item: (-score, id is NULL, id), ascending, at most k."""

    def __init__(self, items: Items, weights: Weights, width: int, k: int):
        self.items, self.weights, self.k = items, weights, k
        self.best: list[list[tuple]] = [[] for _ in items.ids]
        self.least = np.ones(len(items.ids), np.int64)
        used, self.place = np.unique(items.terms % np.uint64(width), return_inverse=True)
        self.width = len(used)
        self.scored = 0

    def bounds(self, found: Found, impacts: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Upper bounds of the scores of documents lo to hi - 1 (rows) for all items (columns)."""
        sketch = np.zeros((hi - lo) * self.width, np.int64)
        a, b = np.searchsorted(found.doc, [lo, hi])
        if b > a:
            cell = (found.doc[a:b] - lo) * self.width + self.place[found.term[a:b]]
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            sketch[cell[heads]] = np.maximum.reduceat(impacts[a:b][order], heads)
        looked = sketch.reshape(hi - lo, self.width)[:, self.place[self.items.term]] * self.items.times
        return np.add.reduceat(looked, self.items.first[:-1], axis=1)

    def take(self, found: Found, ids: list) -> None:
        """Rank one slice of documents."""
        impacts, n = self.weights.impacts(found), len(self.items.terms)
        keys = found.doc * n + found.term
        for lo in range(0, len(ids), MOST_DOCS):
            hi = min(len(ids), lo + MOST_DOCS)
            bounds = self.bounds(found, impacts, lo, hi)
            for item in np.flatnonzero((bounds >= self.least).any(axis=0)):
                column = bounds[:, item]
                open_ = np.flatnonzero(column >= self.least[item])
                open_ = open_[np.argsort(-column[open_], kind="stable")]
                a, b = self.items.first[item : item + 2]
                for start in range(0, len(open_), AT_ONCE):
                    docs = open_[start : start + AT_ONCE]
                    docs = docs[column[docs] >= self.least[item]]
                    if len(docs) == 0:
                        break
                    self.scored += len(docs)
                    want = (docs + lo)[:, None] * n + self.items.term[a:b]
                    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                    scores = (np.where(keys[at] == want, impacts[at], 0) * self.items.times[a:b]).sum(axis=1)
                    new = [(-int(s), ids[d + lo] is None, ids[d + lo]) for s, d in zip(scores, docs) if s >= self.least[item]]
                    if new:
                        self.best[item] = sorted(self.best[item] + new)[: self.k]
                        if len(self.best[item]) == self.k:
                            self.least[item] = max(1, -self.best[item][-1][0])


def _ranked(docs: DataFrame, items: Items, item_field: StructField, k: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(item, id, score) of the k best documents of each item of a block, with their rank."""
    weights = corpus_weights(docs, items, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((items, weights))
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col])
    schema = StructType([StructField("item_no", IntegerType()), StructField("item_id", item_field.dataType), narrow.schema[0], StructField("score", LongType())])

    def run(batches):
        items, weights = shared.value
        slots, ranks, kind = items.slots(), Ranks(items, weights, width, k), None
        for batch in batches:
            kind = batch.column(0).type
            for a, b, part in slices(texts_of(batch.column(1))):
                found = find(part, items, slots)
                if len(found.doc):
                    ranks.take(found, batch.column(0).slice(a, b - a).to_pylist())
        rows = [(no, items.ids[no], id_, -score) for no, best in enumerate(ranks.best) for score, _, id_ in best]
        if rows:
            no, item, id_, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), pa.array(item), pa.array(id_, kind), pa.array(score, pa.int64())], schema.names)

    best = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return in_arrow(narrow, run, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def lexical_search(
    docs: DataFrame, queries: DataFrame, k: int = 20, width: int = 1 << 14, block: int = 1000, item_col: str = "item_id", query_col: str = "text",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(item, rank, id, score) of the k best documents of each item with a score above 0.

    `width` is the number of coordinates of a sketch: any gives right results, a greater one tighter bounds. Items are dealt by a
    hash in blocks of about `block`, which are all that the driver and a task hold of them.
    """
    wanted = queries.select(queries[item_col].alias("item_id"), queries[query_col].alias("words")).where("words IS NOT NULL").distinct()
    blocks = -(-wanted.count() // block)
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(max(1, blocks))))
    out = None
    for number in range(blocks):
        rows = wanted.where(F.col("block") == number).collect()
        items = items_of([r.item_id for r in rows], [r.words for r in rows])
        if items.ids:
            part = _ranked(docs, items, wanted.schema["item_id"], k, width, id_col, text_col)
            out = part if out is None else out.unionByName(part)
    if out is None:
        fields = [wanted.schema["item_id"], StructField("rank", IntegerType()), StructField("id", docs.schema[id_col].dataType), StructField("score", LongType())]
        out = docs.sparkSession.createDataFrame([], StructType(fields))
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def oracle(k: int = 20) -> str:
    """The same in DuckDB's SQL: every document that holds a term of an item is scored."""
    upper, term = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{term}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
c AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
q AS (SELECT row_number() OVER () AS item, item_id, unnest({words}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
f AS (SELECT row, doc_id, size, t, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, len(w) AS size, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
v AS (SELECT t, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM f, c GROUP BY t),
s AS (SELECT item, item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n) // l))))::BIGINT AS score
      FROM q JOIN f USING (t) JOIN v USING (t), c GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""
