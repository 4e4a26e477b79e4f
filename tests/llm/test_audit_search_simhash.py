"""Filter audit, ranked search and SimHash against brute force on small tables with odd rows."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm.filter_audit import audit, filter_audit, packed
from tickloom.llm.lexical_search import Ranks, Weights, find, items_of, lexical_search
from tickloom.llm.common import texts_of
from tickloom.llm.simhash import links, majorities, simhash_groups
import pyarrow as pa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n, kinds=("th", "er", "an", "Ou", "é", "ing")):
    r = random.Random(seed)
    return " ".join("".join(r.choice(kinds) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows():
    """(doc_id, text, lang): copies, NULLs everywhere, repeated ids with equal and with other texts, long and unspaced texts."""
    out = [(i, prose(i, 3 + 9 * i), ["en", "de", None][i % 3]) for i in range(40)]
    base = prose(77, 150)
    for k in range(15):
        words = base.split(" ")
        words[7 * k] = f"Edit{k}"
        out.append((100 + k, " ".join(words), "en"))
    out += [(i, base, "en" if i % 2 else "de") for i in range(200, 240)]
    out += [(300, None, "en"), (301, "", None), (302, " \n\t", "de"), (303, "one", "en"), (304, "ONE two", "en"), (305, "a $ b", "fr"), (306, "SHOUT " * 120, "fr")]
    out += [(310, prose(5, 20000), "en"), (311, "x" * 200_000, "en"), (312, "w " * 700, "en"), (313, "😀 é\x1c\x85 ü" * 30, "es")]
    out += [(400, base, "en"), (400, base, "en"), (401, prose(401, 60), "en"), (401, prose(402, 60), "en"), (None, base, "en"), (None, None, None), (None, prose(3, 30), "en")]
    return out


LABELS = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 320, 2)] + [(200, 1, 0), (200, None, 1), (400, 1, 1), (None, 1, 1), (9999, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns named like helper and result columns clash with none of them; one is a map."""
    extra = ["part", "mask", "n", "id", "digest", "first", "least", "good", "toxic", "fp", "label", "component", "score", "rank", "item_id"]
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)], F.create_map(F.lit("a"), F.lit(1)).alias("probe")).repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(*r, 1, 2) for r in LABELS], "doc_id long, quality int, toxic int, id int, good int")


def simulated(table, known):
    """Every document through every order, one step after the other."""
    first = {}
    for i, text, _ in table:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, *q in known if i is not None and q[k] == 1} for k in (0, 1))
    out = collections.defaultdict(lambda: [0] * 6)
    removed_sum = collections.Counter()
    for i, text, lang in table:
        text, part = text or "", lang or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and i > first[text],
        }
        for order in itertools.permutations("ABCDE"):
            here = True
            for step, letter in enumerate(order, 1):
                row = out[part, "".join(order), step]
                removed = here and fails[letter]
                row[2] += fails[letter] and not here
                here = here and not fails[letter]
                row[0] += here
                row[1] += removed
                row[3] += fails[letter] and sum(fails.values()) == 1
                row[4] += removed and i in good
                row[5] += removed and i in toxic
                removed_sum[part, letter] += removed
    return {k: (*v, removed_sum[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_equals_a_simulation(docs, labels):
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit(docs, labels).collect()}
    assert got == simulated(rows(), LABELS)
    assert len(got) == 600 * len({lang or "" for _, _, lang in rows()})


def test_filter_audit_of_empty_tables(docs, labels):
    assert filter_audit(docs.limit(0), labels).collect() == []
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit(docs, labels.limit(0)).collect()}
    assert got == simulated(rows(), [])


def test_packed_fields_do_not_overflow(spark):
    """Two billion documents a row in many parts, and fields that stay apart."""
    many = spark.range(0, 3000).select(
        F.format_string("p%d", F.col("id") % 300).alias("part"), (F.col("id") % 4).cast("int").alias("mask"), F.lit(True).alias("good"),
        F.lit(False).alias("toxic"), F.lit(1 << 58).alias("n")).repartition(4)
    got = {(r.part, r.filter_order, r.step): r for r in audit(many, "AB").collect()}
    assert len(got) == 300 * 4
    for p in range(300):
        n = collections.Counter()
        for i in range(p, 3000, 300):
            n[i % 4] += 1 << 58
        a = got[f"p{p}", "AB", 1]
        assert (a.kept, a.removed, a.redundant, a.unique_fails) == (n[0] + n[2], n[1] + n[3], 0, n[1])
        b = got[f"p{p}", "AB", 2]
        assert (b.kept, b.removed, b.redundant, b.good_lost, b.toxic_lost) == (n[0], n[2], n[3], n[2], 0)
    assert packed("AB", 1) != packed("AB", 2)


def bm25(table, items, k):
    docs = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in table]
    held = [sum(c.values()) for _, c in docs if c]
    n_docs, n_terms = len(held), sum(held)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        terms = TERM.findall((text or "").translate(LOWER))
        scored = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(i, prose(i, 12)) for i in range(25)] + [(30, prose(77, 150)), (31, None), (32, ""), (33, "nowhereatall"), (34, "ONE one one-two"), (34, "w w"), (34, "w w"), (None, prose(9, 8)), (35, "x" * 200_000), (36, "é ü")]


@pytest.mark.parametrize("k,width,block", [(20, 1 << 14, 1000), (3, 4, 7), (500, 1, 1000)])
def test_lexical_search_equals_brute_force(spark, docs, k, width, block):
    """Narrow sketches and small blocks change nothing but the work."""
    items = spark.createDataFrame([(*r, 1, 2) for r in ITEMS], "item_id long, text string, score int, doc_id int")
    got = lexical_search(docs, items, k, width, block).collect()
    assert sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in got), key=str) == bm25([r[:2] for r in rows()], ITEMS, k)


def test_lexical_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for table, wanted in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.where("text = ''"))):
        found = lexical_search(table, wanted)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []


def test_bounds_hold_and_save_work():
    """No bound lies under its score, and few documents are scored where the sketch is wide."""
    texts = [prose(i, 60, ("ka", "lo", "mi", "ne", "ru", "sa", "ti", "vo")) for i in range(400)]
    items = items_of(list(range(30)), [prose(1000 + i, 8, ("ka", "lo", "mi", "ne", "ru", "sa", "ti", "vo")) for i in range(30)])
    found = find(texts_of(pa.array(texts)), items, items.slots())
    df = np.bincount(found.term, minlength=len(items.terms))
    weights = Weights(400, 400 * 60, np.array([math.floor(1000 * math.log(802 / (2 * n + 1))) for n in df], np.int64))
    for width in (1, 16, 1 << 14):
        ranks = Ranks(items, weights, width, 5)
        exact = np.zeros((400, 30), np.int64)
        impacts = dict(zip(zip(found.doc.tolist(), found.term.tolist()), weights.impacts(found).tolist()))
        for item in range(30):
            for at in range(items.first[item], items.first[item + 1]):
                for doc in range(400):
                    exact[doc, item] += items.times[at] * impacts.get((doc, int(items.term[at])), 0)
        assert (ranks.bounds(found, weights.impacts(found), 0, 400) >= exact).all()
        ranks.take(found, list(range(400)))
        for item, best in enumerate(ranks.best):
            assert [(-s, i) for s, _, i in best] == sorted(((int(exact[i, item]), i) for i in range(400) if exact[i, item] > 0), key=lambda x: (-x[0], x[1]))[:5]
    assert ranks.scored < 400 * 30 / 4


def fingerprint(text, words):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, distance):
    """Smallest id reachable of each id, by comparing all pairs."""
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= distance:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in prints}


@pytest.mark.parametrize("words,distance", [(3, 2), (5, 2), (1, 1), (2, 0)])
def test_simhash_groups_equal_brute_force(docs, words, distance):
    got = simhash_groups(docs, words, distance).collect()
    assert sorted((r.doc_id is None, r.fingerprint) for r in got) == sorted((i is None, f"{fingerprint(t, words):016x}") for i, t, _ in rows())
    assert all(r.component_id is None for r in got if r.doc_id is None)
    # one node per (id, text): rows that repeat an id are each of their own text
    prints = {(i, k): fingerprint(t, words) for k, (i, t, _) in enumerate(rows()) if i is not None}
    want = sorted((i, f"{prints[i, k]:016x}", root[0]) for (i, k), root in grouped(prints, distance).items())
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == want
    assert simhash_groups(docs.limit(0), words, distance).collect() == []


def test_links_find_every_close_pair(spark):
    """Dense clusters round some centres and in one segment: the components by links are those of all pairs."""
    r = random.Random(3)
    prints = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(60)}
        prints |= {centre ^ (r.getrandbits(5) << 3) for _ in range(20)}
    prints |= {0, (1 << 64) - 1, 1, 1 << 63, 3 << 62}
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    for distance in (1, 2):
        edges = [(x.a & (1 << 64) - 1, x.b & (1 << 64) - 1) for x in links(nodes, distance).collect()]
        assert all(0 < bin(a ^ b).count("1") <= distance for a, b in edges)
        parent = {p: p for p in prints}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        assert {p: root(p) for p in prints} == grouped({p: p for p in prints}, distance)
    with pytest.raises(ValueError):
        links(nodes, 3)


def test_majorities_of_long_texts_and_ties():
    counts = np.array([0, 1, 2, 255, 256, 1000, 0], np.int64)
    hashes = np.random.default_rng(1).integers(0, 1 << 63, counts.sum(), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    got, at = majorities(hashes, counts), 0
    for n, have in zip(counts, got):
        own = hashes[at : at + n]
        at += n
        assert int(have) == sum(1 << b for b in range(64) if 2 * int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > n)
