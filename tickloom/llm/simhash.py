"""Near copies by SimHash: fingerprints that differ in at most two bits, found through a multi-index table.

Words are runs of bytes other than white space, A to Z in lower case; a text's shingles of `words` words, repeats
included, are hashed with XXH64, and a bit of the fingerprint is the majority of the hashes' bits. Texts of one fingerprint are one
node from there on, so thousands of copies cost one.

A fingerprint is two segments of 32 bits. Within each segment its Hamming ball of radius one is enumerated, the other segment stays as it
is: 33 values each, 65 different probes in all. Two fingerprints at a distance of two or less always share a probe. If one segment is equal,
some value of the other lies within one bit of both; if both segments differ by a bit, the probe takes one segment of each.
A table entry is the probe and the set of balls it lies in, as bits, so that matches are combined before and after the
shuffle by OR; a probe can only lie in 65 balls, whatever the number of copies: no list of a frequent segment value exists, and no pair is
made inside one. The members of an entry are linked with its least one, after the complete distance of both is verified.
Components then follow from these links.

A NULL text counts as empty; a text without words has fingerprint zero and links like any other. A row with a NULL id
gets its fingerprint and a NULL component, and links with nothing. Rows that repeat an id each have their own text's
fingerprint and component. An empty table gives an empty result. Whole texts are read, whatever their length; other columns never.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from .common import Texts, in_arrow, slices, stored, texts_of, words_of
from .components import components

HASH_SEED, LANES, LANE_MOST, HEAVY = 42, np.uint64(0x0101010101010101), 255, 1024


def shingle_hashes(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 of every shingle in text order, and how many each text has."""
    found = words_of(texts)
    counts = found.counts
    shingles = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    if len(found.starts) == 0:
        return np.zeros(0, np.uint64), shingles
    sizes = found.ends - found.starts
    ends = np.cumsum(sizes) + np.arange(len(sizes))
    starts = ends - sizes
    inside = np.zeros(len(texts.data) + 1, np.int8)
    inside[found.starts] = 1
    np.add.at(inside, found.ends, -1)
    chars = texts.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    chars = np.where((chars >= 65) & (chars <= 90), chars + 32, chars).astype(np.uint8)
    joined = np.full(int(ends[-1]) + 1, 0x20, np.uint8)
    joined[np.arange(len(chars)) + np.repeat(np.arange(len(sizes)), sizes)] = chars
    place = np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles) + np.repeat(found.first[:-1], shingles)
    last = place + np.repeat(np.minimum(counts, words), shingles) - 1
    raw = joined.tobytes()
    spans = zip(starts[place].tolist(), ends[last].tolist())
    return np.fromiter((xxh64_intdigest(raw[a:b], HASH_SEED) for a, b in spans), np.uint64, len(place)), shingles


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint per text: bits set in over half of its hashes.

    Eight bits are counted at once in the bytes of a 64-bit sum over at most 255 hashes.
    """
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some) == 0:
        return out
    counts = counts[some]
    runs = -(-counts // LANE_MOST)
    run_first = np.cumsum(runs) - runs
    within = np.arange(runs.sum()) - np.repeat(run_first, runs)
    cuts = np.repeat(np.cumsum(counts) - counts, runs) + within * LANE_MOST
    bits = np.zeros(len(some), np.uint64)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & LANES, cuts)
        lanes = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), run_first, axis=0)
        for lane in range(8):
            bits |= (2 * lanes[:, lane] > counts).astype(np.uint64) << np.uint64(8 * lane + k)
    out[some] = bits
    return out


def simhashes(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and fp, the fingerprint as a long."""

    def run(batches):
        for batch in batches:
            for a, b, part in slices(texts_of(batch.column(1))):
                prints = majorities(*shingle_hashes(part, words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(prints.view(np.int64))], ["id", "fp"])

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col])
    return in_arrow(narrow, run, StructType([narrow.schema[0], StructField("fp", LongType())]))


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) between different fingerprints (column fp) that connect all those within `distance` bits (0, 1 or 2)."""
    if distance not in (0, 1, 2):
        raise ValueError("a probe differs by one bit from each of two fingerprints: the distance is 0, 1 or 2")
    own = nodes.select(F.col("fp").alias("probe"), F.lit(0).cast("long").alias("bit"), F.lit(True).alias("own"))
    ball = F.expr("transform(sequence(0, 63), i -> struct(fp ^ shiftleft(1L, i) AS probe, shiftleft(1L, i) AS bit, false AS own))")
    table = own.union(nodes.select(F.inline(ball))).groupBy("probe").agg(F.bit_or("bit").alias("bits"), F.max("own").alias("own"))
    shared = table.where(F.expr("bit_count(bits) + int(own) > 1" if distance == 2 else "own AND bits <> 0"))
    members = F.expr("transform(filter(sequence(0, 63), i -> (bits & shiftleft(1L, i)) <> 0), i -> probe ^ shiftleft(1L, i))")
    shared = shared.select("probe", F.when(F.col("own"), F.concat(members, F.array("probe"))).otherwise(members).alias("members"))
    least = F.array_min("members") if distance == 2 else F.col("probe")
    met = shared.select(least.alias("a"), F.explode("members").alias("b"))
    return met.where(f"a <> b AND bit_count(a ^ b) <= {distance}").distinct()


def simhash_groups(docs: DataFrame, words: int = 5, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id, the smallest id that links reach."""
    rows = stored(simhashes(docs, words, id_col, text_col), "simhash")
    nodes = stored(rows.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "nodes")
    label = components(links(nodes, distance)).withColumnRenamed("node", "fp") if distance else nodes.select("fp", F.col("fp").alias("label"))
    rooted = nodes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = rooted.groupBy("label").agg(F.min("id").alias("component"))
    placed = stored(rooted.join(least, "label").select("fp", "n", "component"), "placed")

    # a fingerprint of over 1/1024 of all rows is one of at most 1,023: those are broadcast, all others are joined by shuffle
    total = nodes.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(placed.where(F.col("n") * HEAVY > total).select("fp", "component"))
    light = placed.where(F.col("n") * HEAVY <= total).select("fp", "component")
    named = rows.where("id IS NOT NULL")
    joined = named.join(heavy, "fp").unionByName(named.join(heavy, "fp", "left_anti").join(light, "fp"))
    joined = joined.unionByName(rows.where("id IS NULL").withColumn("component", F.col("id")))
    return joined.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
