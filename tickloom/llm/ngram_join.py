"""Near copies by the Jaccard likeness of word shingles: rare-first prefix filtering, each pair verified once.

Words are runs of bytes other than white space, A to Z in lower case. A text's set holds its distinct shingles of
`words` words (with fewer words the whole sequence as one). Two texts link when
100 * intersection >= percent * union. The steps, all over every document:

1. Count shingles in a hashed table of fixed size. The counts only set the order in which a text's shingles stand,
   rare first; any order is right, a good one keeps frequent shingles out of the prefixes.
2. One row per text: size of its set, a 128-bit signature and the tokens of its prefix. Texts of equal sets are one node from
   here on (thousands of copies cost one).
3. Prefix tokens seen once can't link. For the others, a first round pairs every text with one hub of its token list,
   the text with the fewest rarer tokens, so work is linear in the list. A second round takes only lists whose
   texts still lie in different components, and there only pairs across components: no link that could change a component is lost.
4. A pair must pass the length filter and, at some shared token, the positional filter (the tokens left on both sides
   suffice), which also bounds the prefix of the shorter text. The suffix filter then bounds the overlap with counts of both sets in fixed
   hash ranges. What remains is verified once on the whole sets.

A NULL or empty text has an empty set, links with nothing and is its own component. A row with a NULL id is returned with
a NULL component. Rows that repeat an id are compared each by its own text. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from .common import Texts, in_arrow, mix, seeded, slices, span_hashes, stored, texts_of, unused, window_hashes, words_of
from .components import components

COUNTER_BITS, BLOCK_BITS, MAP_BITS, RANGES = 20, 10, 26, 16


def shingle_sets(texts: Texts, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = words_of(texts)
    hashes = span_hashes(texts.data, found.starts, found.ends, lower=True)
    counts = found.counts
    shingles, owner = window_hashes(hashes, found.first, words)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = [np.unique(shingles[cut[t] : cut[t + 1]]) for t in range(len(texts))]
    for size in range(1, words):
        for t in np.flatnonzero(counts == size):
            a = found.first[t]
            whole, _ = window_hashes(hashes[a : a + size], np.array([0, size]), size)
            out[t] = mix(whole + seeded(int(size)))
    return out


def shingle_counts(docs: DataFrame, words: int, text_col: str = "text") -> np.ndarray:
    """Over all documents, how many hold a shingle of each of 2^20 hash slots. Tasks send counts, blocks are added as they stream in."""
    blocks, width = 1 << (COUNTER_BITS - BLOCK_BITS), 1 << BLOCK_BITS

    def count(batches):
        total = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            for _, _, part in slices(texts_of(batch.column(0))):
                sets = shingle_sets(part, words)
                slots = (np.concatenate(sets) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
                total += np.bincount(slots, minlength=len(total)).astype(np.uint32)
        used = [b for b in range(blocks) if total[b * width : (b + 1) * width].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([total[b * width : (b + 1) * width].tobytes() for b in used], pa.binary())], ["block", "counts"]
        )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = sums.setdefault(block, np.zeros(width, np.int64))
                own += np.frombuffer(raw.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "counts"]
        )

    schema = "block int, counts binary"
    parts = in_arrow(docs.select(docs[text_col]), count, schema).repartition("block")
    total = np.zeros(1 << COUNTER_BITS, np.int64)
    for row in in_arrow(parts, add, schema).collect():
        total[row.block * width : (row.block + 1) * width] = np.frombuffer(row.counts, np.int64)
    return total


def prefixes(docs: DataFrame, counts: np.ndarray, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, set size, signature, counts in hash ranges, and the rarest tokens that any partner must share one of.

    A token is the logarithm of the slot's count followed by 44 bits of the hash, so its order is rare first.
    """
    order = docs.sparkSession.sparkContext.broadcast((np.log2(counts + 1.0) * (1 << 14)).astype(np.uint64))

    def run(batches):
        for batch in batches:
            for a, b, part in slices(texts_of(batch.column(1))):
                sets = shingle_sets(part, words)
                sizes = np.array([len(s) for s in sets], np.int64)
                first = np.concatenate([[0], np.cumsum(sizes)])
                all_ = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                tokens = (order.value[(all_ >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)] << np.uint64(44)) | (all_ >> np.uint64(20))
                rare = [np.sort(tokens[first[t] : first[t + 1]])[: _prefix(int(sizes[t]), percent)] for t in range(len(sets))]
                text = np.repeat(np.arange(len(sets)), sizes)
                ranges = np.bincount(text * RANGES + (all_ >> np.uint64(60)).astype(np.int64), minlength=RANGES * len(sets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *signatures(sets), _lists([np.asarray(r) for r in ranges.reshape(-1, RANGES)], pa.int32()),
                     _lists([r.view(np.int64) for r in rare], pa.int64())],
                    ["id", "n", "sig1", "sig2", "ranges", "tokens"],
                )

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col])
    fields = StructType.fromDDL("n long, sig1 long, sig2 long, ranges array<int>, tokens array<long>").fields
    return in_arrow(narrow, run, StructType(narrow.schema.fields[:1] + fields))


def _prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values).cast(kind))


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of each id (column id), 2^26 of them whatever the number of ids; built by SQL functions."""
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << MAP_BITS)) + 1
    rows = ids.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for row in rows.collect():
        raw = np.frombuffer(row.bits, np.uint8)
        out[(row.bucket - 1) * 4096 : (row.bucket - 1) * 4096 + len(raw)] = raw
    return out


def in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def _slot(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(1 << MAP_BITS))


def signatures(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two sums of mixed hashes of each set: equal sets and no others have all three."""
    sizes = np.array([len(s) for s in sets], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    all_ = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    marks = [pa.array(sizes)]
    for seed in (1, 2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(all_ + seeded(seed)))])
        marks.append(pa.array((sums[first[1:]] - sums[first[:-1]]).view(np.int64)))
    return marks


KEY = ["n", "sig1", "sig2"]


def sets_of(docs: DataFrame, ids: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, sig1, sig2, shingles) of the rows of the ids (and of few others), repeated rows once; a bitmap of fixed size picks them.

    The signature is of the row's own text, so an id with several texts has a row for each. Sets are dealt by id and signature, and
    the joins that follow use that partitioning.
    """
    bits = docs.sparkSession.sparkContext.broadcast(id_bitmap(ids))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(in_bitmap(bits.value, batch.column(2).to_numpy(zero_copy_only=False))))
            for a, b, part in slices(texts_of(batch.column(1))):
                sets = shingle_sets(part, words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *signatures(sets), _lists([s.view(np.int64) for s in sets], pa.int64())], ["id", *KEY, "shingles"])

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col], _slot(docs[id_col]).alias("slot")).where("id IS NOT NULL")
    found = in_arrow(narrow, run, StructType(narrow.schema.fields[:1] + StructType.fromDDL("n long, sig1 long, sig2 long, shingles array<long>").fields))
    return found.groupBy("id", *KEY).agg(F.first("shingles").alias("shingles"))


def _needed(n1: str, n2: str, percent: int) -> str:
    """The least overlap of two sets that link."""
    return f"({percent} * ({n1} + {n2}) + {99 + percent}) div {100 + percent}"


def _positional(percent: int, x: str, y: str) -> str:
    """Length and positional filters for a token shared by rows x and y."""
    return (
        f"100 * least({x}n, {y}n) >= {percent} * greatest({x}n, {y}n) AND "
        f"least({x}n - {x}pos, {y}n - {y}pos) >= {_needed(f'{x}n', f'{y}n', percent)}"
    )


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) that link: suffix filter on the counts in hash ranges, then the overlap of the whole sets."""
    ends = ["id", *KEY]
    sides = [nodes.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in [*ends, "ranges"]]) for k in "ab"]
    apart = "aggregate(zip_with(ranges_a, ranges_b, (x, y) -> abs(x - y)), 0, (s, x) -> s + x)"
    close = pairs.join(sides[0], "a").join(sides[1], "b").where(f"(n_a + n_b - {apart}) div 2 >= {_needed('n_a', 'n_b', percent)}")
    close = stored(close.select("a", "b", *[f"{c}_{k}" for k in "ab" for c in ends]).distinct(), "pairs")
    ids = close.select(F.col("id_a").alias("id")).union(close.select("id_b")).distinct()
    sets = sets_of(docs, ids, words, id_col, text_col)
    left, right = (sets.select(*[F.col(c).alias(f"{c}_{k}") for c in ends], F.col("shingles").alias(f"s{k}")) for k in "ab")
    met = close.join(left, [f"{c}_a" for c in ends]).join(right, [f"{c}_b" for c in ends])
    overlap = F.size(F.array_intersect("sa", "sb"))
    return met.where((100 + percent) * overlap >= percent * (F.size("sa") + F.size("sb"))).select("a", "b").distinct()


def placed(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n, sig1, sig2 of its set, component, the smallest id that links reach, and label, the number of the component.

    Nodes are different sets, whatever ids their texts have; links and components are of nodes. Two components can have one smallest
    id, with another text each. Rows without an id or without words have no label.
    """
    counts = shingle_counts(docs, words, text_col)
    texts = stored(prefixes(docs, counts, words, percent, id_col, text_col), "prefixes")
    nodes = stored(
        texts.where("n > 0 AND id IS NOT NULL").groupBy(*KEY)
        .agg(F.min("id").alias("id"), F.first("ranges").alias("ranges"), F.first("tokens").alias("tokens"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers are fixed by the file they are written to
    postings = nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("tokens").alias("pos", "token"))
    # the hub of a list stands in the index prefix of its own size: only there a pair can first meet
    hub = f"pos <= n - {_needed('n', 'n', percent)}"
    place = F.when(F.expr(hub), F.shiftleft(F.col("pos").cast("long"), 44) + F.pmod(F.xxhash64("node"), F.lit(1 << 44)))
    lists = postings.groupBy("token").agg(F.count("*").alias("rows"), F.min(place).alias("place")).where("rows > 1 AND place IS NOT NULL")
    shared = stored(postings.join(lists.select("token", "place"), "token"), "lists")
    hubs = shared.where(place == F.col("place")).select("token", *[F.col(c).alias(f"hub_{c}") for c in ("node", "n", "pos")])
    shared = shared.select("token", "node", "n", "pos").join(hubs, "token")
    first = shared.where("node <> hub_node").where(_positional(percent, "", "hub_")).select(F.col("hub_node").alias("a"), F.col("node").alias("b")).distinct()
    same = nodes.select("node", "id", *KEY, "ranges")
    label = components(verified(first, same, docs, words, percent, id_col, text_col))

    # lists whose texts are still apart: pairs across components only, the rows outside the hub's component on one side
    named = shared.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.select("token", "node", "n", "pos", "label", "hub_node")
    mixed = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                       F.max(F.when(F.expr("node = hub_node"), F.col("label"))).alias("home")).where("low <> high")
    apart = stored(named.join(mixed.select("token", "home"), "token"), "apart")
    x = apart.where("label <> home OR home IS NULL").select("token", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "pos", "label")])
    y = apart.select("token", *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "pos", "label", "home")])
    second = (
        x.join(y, "token").where("x_label <> y_label AND (y_label = y_home OR x_node < y_node)").where(_positional(percent, "x_", "y_"))
        .select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    )
    second = stored(second.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    if not second.isEmpty():
        more = verified(second, same, docs, words, percent, id_col, text_col)
        label = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))

    whole = nodes.select("node", "id", *KEY).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = whole.groupBy("label").agg(F.min("id").alias("component"))
    whole = whole.join(least, "label").select(*KEY, "label", "component")
    rows = texts.select("id", *KEY).join(whole, KEY, "left")
    return rows.select("id", *KEY, "label", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id that links reach."""
    found = placed(docs, words, percent, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, the one of the smallest id, with all its columns.

    A row counts by its id and its own text: rows of other texts under a kept or dropped id are judged for themselves, rows of the same
    set under the kept id are reduced to one (if they differ in other columns, by a hash of those that can be hashed). Rows without
    id or without words stay. A bitmap of the ids concerned lets most texts pass without a shuffle; only rows whose bit is set are
    joined. Columns can have any name and type.
    """
    found = placed(docs, words, percent, id_col, text_col).where("id IS NOT NULL AND n > 0")
    groups = stored(found.groupBy("id", *KEY).agg(F.min("label").alias("label"), F.count("*").alias("copies")), "groups")
    best = groups.groupBy("label").agg(F.min(F.struct("id", *KEY)).alias("best"), F.count("*").alias("members"), F.max("copies").alias("copies"))
    touched = best.where("members > 1 OR copies > 1").select("label", "best")
    touched = stored(groups.join(touched, "label").select("id", *KEY, (F.struct("id", *KEY) == F.col("best")).alias("kept")), "touched")
    bits = docs.sparkSession.sparkContext.broadcast(id_bitmap(touched))
    at, text_at = len(docs.columns), docs.columns.index(text_col)
    slot, *marks = unused(docs, "slot", *KEY)
    marked = docs.select("*", F.coalesce(_slot(docs[id_col]), F.lit(-1)).alias(slot))

    def hit(batch):
        slots = batch.column(at).to_numpy(zero_copy_only=False)
        return (slots >= 0) & in_bitmap(bits.value, np.maximum(slots, 0))

    def others(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns[:at], names=batch.schema.names[:at]).filter(pa.array(~hit(batch)))

    def signed(batches):
        for batch in batches:
            batch = batch.filter(pa.array(hit(batch)))
            for a, b, part in slices(texts_of(batch.column(text_at))):
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(a, b - a) for c in batch.columns[:at]], *signatures(shingle_sets(part, words))], names=[*batch.schema.names[:at], *marks])

    longs = StructType.fromDDL("a long, b long, c long").fields
    checked = in_arrow(marked, signed, StructType([*docs.schema.fields, *[StructField(m, f.dataType) for m, f in zip(marks, longs)]]))
    # one struct per row, so that no name of the table meets one of the join
    whole = checked.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), *[F.col(m).alias(k) for m, k in zip(marks, KEY)])
    judged = whole.join(touched, ["id", *KEY], "left")
    free = judged.where("kept IS NULL").select("row.*")
    hashed = F.xxhash64(*[F.col("row")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    single = judged.where("kept").groupBy("id", *KEY).agg(F.min_by("row", hashed).alias("row")).select("row.*")
    return in_arrow(marked, others, docs.schema).union(free).union(single)


def oracle(words: int, percent: int) -> str:
    """The same in DuckDB's SQL, by comparing all pairs that share a shingle: for small tables."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i : i + {words - 1}] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id"""
