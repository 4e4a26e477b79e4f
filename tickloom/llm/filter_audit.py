"""Audit of filters that run one after the other: what each removes at each step of every possible order.

A document is a mask: bit i is set if it fails filter i, two more bits say whether it is labelled good and toxic. For n
filters there are n! orders of n steps. Every mask has one big integer, whose 64-bit fields hold what the document counts for at each
step of each order: kept, removed, redundant, good lost, toxic lost, then one field per filter that it alone fails. So the whole audit
of a part is a plain sum of integers: each task adds the integers of its rows, the sums of a part are added in two
levels, and the fields of the total are the counts. A field can't run into its neighbour before a count reaches 2^64, and counts are
returned as longs, so 2^63 - 1 documents are the limit.

Identical texts are found by SHA-256 without a join: rows are counted by text, part, labels and mask before they are shuffled, so
thousands of copies of a text are a few rows, and only the smallest id of all of these is compared.

A NULL text counts as empty, a NULL part as the empty string. A row with a NULL id has no labels and is never a copy; it is
not what others are copies of. Rows that repeat an id are documents of their own: equal texts under one id are not
copies of each other. A document with several label rows is good (toxic) if any of them says so. An empty table gives an empty
result. Texts of any length are judged whole; columns of any other name are not read.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import in_arrow

FIELD_BYTES, COUNTS, SALTS, MOST_PARTS = 8, 5, 32, 256
SPACE_RUN = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """True where a text fails: short (A), repetitive (B), shouting (C), with symbols (D)."""
    words = F.array_remove(F.split(text, SPACE_RUN), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counted rows (part, mask, good, toxic, n): bits 0 to 3 are the filters of a text, bit 4 (E) a text equal to one of a smaller id."""
    text = F.coalesce(docs[text_col], F.lit(""))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_filters(text).values())), F.lit(0))
    rows = docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), mask.alias("mask"),
        F.when(docs[id_col].isNotNull(), F.unhex(F.sha2(text, 256))).otherwise(F.lit(b"")).alias("digest"),
    ).groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    known = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(
        F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("good"), F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(known, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})

    # an id stands once among the rows of a group, so the least struct holds the number of rows of the least id
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    groups = groups.withColumn("first", F.min("least.id").over(Window.partitionBy("digest")))
    spared = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    groups = groups.select("part", "mask", "good", "toxic", "n", spared.alias("spared"))
    both = F.array(F.struct("mask", F.col("spared").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("spared")).alias("n")))
    return groups.select("part", "good", "toxic", F.inline(both)).where("n > 0")


def orders(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


@cache
def packed(letters: str, kind: int) -> int:
    """The big integer of a mask (low bits) with its labels (bit n: good, bit n + 1: toxic): one field per count of each step."""
    n = len(letters)
    good, toxic = kind >> n & 1, kind >> (n + 1) & 1
    fails = [kind >> i & 1 for i in range(n)]
    fields: list[int] = []
    for order in orders(letters):
        here = True
        for letter in order:
            failing = fails[letters.index(letter)]
            removed = here and failing
            redundant = failing and not here
            here = here and not failing
            fields += [here, removed, redundant, removed and good, removed and toxic]
    fields += [fails[i] and sum(fails) == 1 for i in range(n)]
    return int.from_bytes(np.array(fields, "<u8").tobytes(), "little")


def _sums(rows: dict[str, int], size: int, salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(rows), pa.string()), pa.array([salt] * len(rows), pa.int32()), pa.array([v.to_bytes(size, "little") for v in rows.values()], pa.binary())],
        ["part", "salt", "total"])


def audit(rows: DataFrame, letters: str) -> DataFrame:
    """Counts per part, order and step from rows (part string, mask int, good boolean, toxic boolean, n long); mask bit i: fails letters[i]."""
    n, size = len(letters), FIELD_BYTES * (COUNTS * len(letters) * len(orders(letters)) + len(letters))

    def pack(batches):
        """Integers of the rows of a task, added by part; many parts are handed on in turns."""
        salt, sums = TaskContext.get().partitionId() % SALTS, {}
        for batch in batches:
            for part, mask, good, toxic, times in zip(*(c.to_pylist() for c in batch.columns)):
                sums[part] = sums.get(part, 0) + times * packed(letters, mask | good << n | toxic << (n + 1))
                if len(sums) > MOST_PARTS:
                    yield _sums(sums, size, salt)
                    sums = {}
        yield _sums(sums, size, salt)

    def add(batches):
        """Sums of consecutive rows of one part."""
        part, total, salt = None, 0, TaskContext.get().partitionId() % SALTS
        for batch in batches:
            for name, more in zip(batch.column(0).to_pylist(), batch.column(2)):
                if name != part and part is not None:
                    yield _sums({part: total}, size, salt)
                part, total = name, int.from_bytes(more.as_buffer(), "little") + (total if name == part else 0)
        if part is not None:
            yield _sums({part: total}, size, salt)

    def unpack(batches):
        names = orders(letters)
        steps = [(o, k) for o in names for k in range(n)]
        letter = np.array([letters.index(o[k]) for o, k in steps])
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(2)):
                fields = np.frombuffer(raw.as_buffer(), "<u8").astype(np.int64)
                counts, unique = fields[: COUNTS * len(steps)].reshape(-1, COUNTS), fields[COUNTS * len(steps) :]
                share = np.zeros(n, np.int64)
                np.add.at(share, letter, counts[:, 1])
                kept, removed, redundant, good, toxic = counts.T
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(steps)), pa.array([o for o, _ in steps]), pa.array([k + 1 for _, k in steps], pa.int32()),
                     *map(pa.array, (kept, removed, redundant, unique[letter], good, toxic, share[letter]))],
                    ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])

    sums = "part string, salt int, total binary"
    partial = in_arrow(rows.select("part", "mask", "good", "toxic", "n"), pack, sums)
    partial = in_arrow(partial.repartition("part", "salt").sortWithinPartitions("part"), add, sums)
    totals = in_arrow(partial.repartition("part").sortWithinPartitions("part"), add, sums)
    return in_arrow(totals, unpack, "part string, filter_order string, step int, kept long, removed long, redundant long, "
                                    "unique_fails long, good_lost long, toxic_lost long, shapley long")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of the five filters A to E over whole tables."""
    return audit(masks(docs, labels, id_col, text_col, part_col), "ABCDE")


def oracle() -> str:
    """The same in DuckDB's SQL: the state of every mask at every step, weighted by its count."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT text AS same, min(doc_id) AS least FROM d GROUP BY text),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
      + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
      + 16 * coalesce(d.doc_id > c.least, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
      FROM d JOIN c ON c.same = d.text LEFT JOIN l ON l.doc_id = d.doc_id GROUP BY ALL),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM a, a b, a c, a d, a e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, (1 << (strpos('ABCDE', filter_order[step]) - 1))::INT AS bit,
      list_sum(list_transform(range(1, step), lambda j: (1 << (strpos('ABCDE', filter_order[j]) - 1))::INT)) AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
t AS (SELECT part, filter_order, step, bit,
      sum(CASE WHEN mask & (coalesce(before, 0)::INT | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
      sum(CASE WHEN mask & coalesce(before, 0)::INT = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
      sum(CASE WHEN mask & coalesce(before, 0)::INT > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
      sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
      sum(CASE WHEN mask & coalesce(before, 0)::INT = 0 AND mask & bit > 0 THEN n * good ELSE 0 END)::BIGINT AS good_lost,
      sum(CASE WHEN mask & coalesce(before, 0)::INT = 0 AND mask & bit > 0 THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM t"""
