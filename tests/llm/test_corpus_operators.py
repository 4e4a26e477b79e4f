"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import queries as Q
from tickloom.llm.fingerprints import edited_fingerprints, fingerprints, likeness, sketches
from tickloom.llm.licences import TEXTS, licence_scan
from tickloom.llm.lm_scoring import Network, Shape, Trainer, fit_language, lm_scores, log_probabilities, masked, word_counts
from tickloom.llm.ngram_join import near_copies, without_near_copies
from tickloom.llm.packing import packed, plan, sequences, token_pieces, placed
from tickloom.llm.pieces import PieceCoder, decoded, encoded, round_trip
from tickloom.llm.pii import digest, personal_data, redacted
from tickloom.llm.quality_classifier import fit, held_out, quality_accepted, quality_scores, train_labels
from tickloom.llm.quality_rules import Limits, quality_kept, quality_report
from tickloom.llm.token_counts import Tree, edited, recounted, segments, token_trees, touched
from tickloom.llm.tokens import WordTokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "an", "Ou", "é", "ing"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows():
    """(doc_id, text): near and exact copies, repeats, odd characters, an empty and a NULL text, a NULL id, a repeated id."""
    out = [(i, prose(i, 5 + 7 * i)) for i in range(30)]
    base = prose(99, 120)
    words = base.split(" ")
    for k in range(12):
        own = list(words)
        own[10 * k % 120] = f"edit{k}"
        out.append((100 + k, " ".join(own)))
    out += [(150, base), (151, base), (152, base.upper()), (160, ""), (161, None), (162, " \n\t "), (163, "one"), (164, "One"), (165, "one two")]
    out += [(170, "line a\nline b\nline a\n\nline a"), (171, "x y z w v " * 40), (172, prose(7, 30000)), (173, "😀 é\x1c\x85 ü" * 20), (None, base), (175, prose(175, 80)), (175, prose(176, 80))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    """Columns named like results clash with none of them."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.5) for i, t in rows()], "doc_id long, text string, lang string, source string, n_chars long, score double")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def shingle_components(pairs, n, percent):
    sets = {}
    for i, t in pairs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 50)])
def test_near_copies_equal_brute_force(docs, n, percent):
    pairs = [(i, t) for i, t in rows() if i not in (None, 175)]
    got = near_copies(docs.where("doc_id IS NULL OR doc_id <> 175"), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == shingle_components(pairs, n, percent)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_near_copies_of_chains_and_stars(spark):
    """Links only through others, and a hub that is not the smallest id: no component may split."""
    words = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(40):  # each differs from the next by a few words, far ones do not link
        texts.append((1000 - k, " ".join(f"e{i}" if i < 3 * k else w for i, w in enumerate(words))))
    for k in range(30):  # copies around a centre, mutually too far
        own = [f"c{i}" for i in range(100)]
        own[3 * k] = own[3 * k + 1] = f"k{k}"
        texts.append((k, " ".join(own)))
    texts.append((500, " ".join(f"c{i}" for i in range(100))))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_copies(df, 3, 90).collect()}
    assert got == shingle_components(texts, 3, 90)


def test_one_of_each_group_stays(docs):
    kept = without_near_copies(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    want = shingle_components([(i, t) for i, t in rows() if i not in (None, 175)], 5, 80)
    assert sorted(i for i in ids if i not in (None, 175)) == sorted({c for _, c in want.values()})
    assert ids.count(175) == 2 and ids.count(None) == 1  # two texts under one id are not copies of each other


def test_ids_with_several_texts_link_by_text(spark):
    """Links join texts, not ids: neither groups nor kept rows may mix two texts of one id."""
    a, b = prose(1, 100).split(" "), prose(2, 100).split(" ")
    near = lambda w, k: " ".join(w[:k] + ["other"] + w[k + 1:])
    texts = [(5, " ".join(a)), (5, " ".join(b)), (2, near(a, 0)), (3, near(b, 99)), (9, near(b, 0)), (7, prose(3, 50)), (7, prose(3, 50)), (8, prose(4, 50)), (8, near(prose(4, 50).split(" "), 0))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in near_copies(df, 5, 80).collect())
    assert got == [(2, 2), (3, 3), (5, 2), (5, 3), (7, 7), (7, 7), (8, 8), (8, 8), (9, 3)]
    kept = sorted((r.doc_id, r.text) for r in without_near_copies(df, 5, 80).collect())
    eights = {t for i, t in texts if i == 8}
    assert [i for i, _ in kept] == [2, 3, 7, 8] and kept[3][1] in eights
    # text b has no other near copy than those of id 5 here: it stays
    few = spark.createDataFrame(texts[:3], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in without_near_copies(few, 5, 80).collect()) == sorted([texts[2], texts[1]])


def test_near_copies_of_tables_with_any_columns(spark):
    """Names of helper columns, in any case, and types that can't be compared."""
    texts = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z"), (None, "x y z"), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    names = ["rows", "row", "component", "SLOT", "__slot", "n", "sig1", "sig2", "id", "kept", "best", "copies", "node", "label", "spans", "__spans", "shingles"]
    df = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)], F.create_map(F.lit("k"), F.lit(1)).alias("map"))
    kept = without_near_copies(df, 5, 80)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "x y z"), (1, "a b c d e f g"), (3, "x y z"), (4, ""), (4, ""), (5, "")]
    assert all([r[c] for c in names] == list(range(len(names))) for r in kept.collect())
    assert redacted(df).columns == df.columns and all([r[c] for c in names] == list(range(len(names))) for r in redacted(df).collect())


def test_quality_rules_equal_brute_force(docs):
    got = by_id(quality_report(docs))
    for i, t in rows():
        if i in (None, 175):
            continue
        w, t = WORD.findall(t or ""), t or ""
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        longest = 0
        if len(w) < 300:
            longest = max((n for n in range(5, len(w)) for a in range(len(w) - n) if any(w[a : a + n] == w[b : b + n] for b in range(a + 1, len(w) - n + 1))), default=0)
            assert r.longest_repeat == longest
        covered = sum(len(w[p]) for p in repeated) / max(1, sum(map(len, w)))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r.covered_fraction == pytest.approx(covered)
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
        assert r.kept == (not r.base_failed and covered <= Limits().covered_fraction and r.longest_repeat <= Limits().longest_words)


def test_quality_kept_passes_all_columns(docs):
    kept = quality_kept(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality_report(docs).where("kept").count()


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_spans(text):
    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1]))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if holds(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_personal_data_equals_brute_force(spark):
    r = random.Random(4)
    parts = ["1", "2", "9", "25", ".", "-", " ", "+1", "+", "(", "@", "a", "b.c", "_", "é", "😀", "\n", "4111111111111111", "a@b.co", "1.2.3.4"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(800)] + [None, "", "1" * 50000, "1 " * 20000, "1.2.3.4 " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(digest(personal_data(df)))
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k, _ in PATTERNS] == [sum(w.startswith(k + ":") for w in want) for k, _ in PATTERNS]
        assert [s for s in got[i].spans.split(",") if s and s.split(":")[0] in dict(PATTERNS)] == want


def test_checked_and_context_spans(spark):
    texts = [
        ("IBAN DE89 3704 0044 0532 0130 00 ok", "iban:5:32"), ("DE89 3704 0044 0532 0130 01", ""), ("call (555) 123-4567", "phone_local:5:19"),
        ("score (555) 123-4567", ""), ("ssn 123-45-6789", "ssn:4:15"), ("part 123-45-6789", ""), ('token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"', "secret:9:49"),
    ]
    df = spark.createDataFrame([(i, t, 0) for i, (t, _) in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = by_id(digest(personal_data(df)))
    assert [got[i].spans for i in range(len(texts))] == [s for _, s in texts]
    clean = by_id(redacted(df))
    assert clean[4].text == "ssn [SSN]" and clean[4].n_chars == 9 and clean[5].text == "part 123-45-6789"


def test_ibans_end_where_their_country_says(spark):
    ibans = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "BE68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32", "AT611904300234573201", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"]
    after = ["", " Please pay", " Bank", " BIC COBADEFF", " COBADEFFXXX", " 2024", " 5 items", " BANK 12", ", ok", "\nX", " X"]
    texts = [f"to {i}{x}" for i in ibans for x in after] + ["to DE89370400440532013001 Bank", "DE89370400440532013000X", "A1" * 5000, "DE89 " * 3000]
    got = by_id(personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    found = [[t[s.start : s.end] for s in got[k].spans if s.kind == "iban"] for k, t in enumerate(texts)]
    assert found == [[i] for i in ibans for _ in after] + [[], [], [], []]


def test_secrets_of_any_length(spark):
    keys = ["aB3/" * k for k in (7, 8, 32, 33, 500, 50_000)]
    df = spark.createDataFrame([(i, f"secret key: {k}. end") for i, k in enumerate(keys)], "doc_id long, text string")
    got = by_id(redacted(df))
    assert [got[i].text for i in range(len(keys))] == [f"secret key: {keys[0]}. end"] + ["secret key: [SECRET]. end"] * 5


def test_tokens_equal_the_tokenizer():
    coder = WordTokenizer(Q.WORD_BPE, room=50)
    r = random.Random(1)
    parts = ["a", "B", "'s", "'S", "'", "é", " ", "\x1c", "\x85", "İ", "Σ", "9", "²", "<|endoftext|>", "😀", "ﬁ", "\n", "!!", "K", "́", "\x00"]
    texts = [""] + ["".join(r.choice(parts) for _ in range(12)) for _ in range(1500)]
    for a in range(0, len(texts), 100):
        want = [np.array(e.ids, np.uint32).tobytes() for e in coder.whole.encode_batch(texts[a : a + 100], add_special_tokens=False)]
        assert coder.ids(texts[a : a + 100]) == want


def test_words_are_met_once_whatever_their_marks():
    coder, learnt = WordTokenizer(Q.WORD_BPE), []
    learn = coder.learn
    coder.learn = lambda new: (learnt.extend(new), learn(new))
    texts = ["One, two. (ONE) two!?\xa0one\x1ctwo don't\x85won't ¼a½", "", " \n", "one" * 9000, "Ɓa ɏ ŉ ǅx", "two's.", "Ⱥb"] * 2
    want = [np.array(e.ids, np.uint32).tobytes() for e in coder.whole.encode_batch(texts, add_special_tokens=False)]
    assert coder.ids(texts) == want and coder.ids(texts[::-1]) == want[::-1]
    assert len(learnt) == len(set(learnt)) == len(coder.young)  # pre-tokens alone, once each
    coder.room = 1
    for _ in range(4):
        assert coder.ids(texts) == want


def test_packing_places_every_token_once(docs):
    pieces = packed(docs, Q.WORD_BPE, room=256, with_ids=True).persist()
    got = pieces.collect()
    coder = WordTokenizer(Q.WORD_BPE)
    want = collections.Counter()
    for i, t in rows():
        ids = np.array(coder.whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for p in range(0, len(ids), 256):
            own = ids[p : p + 256]
            want[i, p // 256, p, len(own), zlib.crc32(own.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(filled) <= -(-sum(r.length for r in got) // 256) + 2
    whole = {r.sequence_id: r.ids for r in sequences(pieces).collect()}
    assert all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in got)
    pieces.unpersist()


@pytest.mark.parametrize("histogram", [{}, {4096: 3}, {1: 100000}, {3000: 10, 1096: 7, 1: 5}, {n: 1 + n % 50 for n in range(1, 4097)}])
def test_plan_is_near_the_bound(histogram):
    found = plan(histogram, 4096)
    slots = found.slots()
    total = sum(n * c for n, c in histogram.items())
    sequences_ = sum(m for v in found.open.values() for _, m in v)
    placed_ = collections.Counter()
    for v in found.open.values():
        for sequence, many in v:
            assert sum(n * c for n, c in sequence) <= 4096
            for n, c in sequence:
                placed_[n] += c * many
    assert placed_ == collections.Counter({n: c for n, c in histogram.items() if c})
    assert sequences_ <= 1.005 * total / 4096 + 3 or histogram == {3000: 10, 1096: 7, 1: 5} and sequences_ == 10
    assert len(slots["key"]) == len(set(slots["key"].tolist()))


def test_fingerprints_keep_equal_parts(docs):
    found = by_id(fingerprints(docs))
    assert found[150].fingerprint == found[151].fingerprint and found[160].fingerprint == found[161].fingerprint == ""
    text = prose(5, 900)
    whole, moved, other = sketches([text, "zz " + text, prose(6, 900)])
    assert likeness(whole, moved) > 0.8 and likeness(whole, other) < 0.1 and likeness(whole, whole) == 1
    alone = [sketches([t or ""])[0].tolist() for _, t in rows()]
    assert [s.tolist() for s in sketches([t or "" for _, t in rows()])] == alone


@pytest.mark.parametrize("keep", ["true", "doc_id = 5", "doc_id < 20"])
def test_edited_texts(docs, keep):
    got = edited_fingerprints(docs.where(keep)).collect()
    want = sorted(((i, t or "") for i, t in rows() if keep == "true" or i is not None and eval(keep.replace("doc_id", "i").replace(" = ", " == "))),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    edits = collections.Counter()
    for k, (i, t) in enumerate(want):
        n = len(t) // 4
        edits[i, len(t), hashlib.sha256((t[: len(t) - n] + want[(k + 1) % len(want)][1][:n]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == edits
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_recounts_equal_counts():
    coder = WordTokenizer(Q.WORD_BPE)
    r = random.Random(5)
    parts = ["a", "the", "'s", "'", " ", "\n", "don't", "123", "é", "!!", "token.", "\t", "\x1c", "\xa0"]

    def count(t):
        return len(coder.whole.encode(t, add_special_tokens=False).ids)

    for _ in range(300):
        text = "".join(r.choice(parts) + r.choice(["", " ", "\n"]) for _ in range(r.choice([0, 1, 5, 300])))
        cut = segments(text)
        tree = Tree.of([len(s) for s in cut], [count(s) for s in cut])
        at = sorted(r.randint(0, len(text)) for _ in range(2 * r.randint(0, 4)))
        edits = [(at[k], at[k + 1], "".join(r.choice(parts) for _ in range(r.randint(0, 3)))) for k in range(0, len(at), 2)]
        for first, last, new in touched(tree, text, edits):
            tree.put(first, len(new), count(new))
            for leaf in range(first + 1, last + 1):
                tree.put(leaf, 0, 0)
        assert (tree.chars[1], tree.tokens[1]) == (len(edited(text, edits)), count(edited(text, edits)))


def test_recount_encodes_little(docs):
    some = docs.withColumn("edits", F.when(F.length("text") > 100, F.expr("array(named_struct('start', 50, 'end', 52, 'replacement', 'xyz'))")))
    got = recounted(token_trees(some, Q.WORD_BPE, more=["edits"]), Q.WORD_BPE).collect()
    coder = WordTokenizer(Q.WORD_BPE)
    assert len(got) == len(rows())
    for r in got:
        assert r.edited_tokens == len(coder.whole.encode(r.text, add_special_tokens=False).ids)
        assert r.encoded_chars < 900
    assert all(r.n_tokens == r.edited_tokens and r.encoded_chars == 0 for r in got if len(r.text) <= 100)


def test_pieces_equal_the_library_and_come_back(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=Q.PIECES)
    got = by_id(decoded(encoded(docs, Q.PIECES), Q.PIECES))
    for i, t in rows():
        if i not in (None, 175):
            assert got[i].ids == library.encode(t or "") and got[i].decoded == (t or "")
    for r in round_trip(docs, Q.PIECES).where("doc_id IS NOT NULL AND doc_id <> 175").collect():
        ids = np.array(got[r.doc_id].ids, "<u4")
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(got[r.doc_id].decoded.encode()).hexdigest()


def test_viterbi_finds_the_best_sum():
    coder = PieceCoder(Q.PIECES)
    coder.unigram = True
    r = random.Random(3)
    words = ["▁" + "".join(r.choice("thean") for _ in range(r.randint(1, 7))) for _ in range(60)]
    coder.learn(list(words))
    names = {i: p for p, i in coder.ids.items()}

    def best(word):
        table = [0.0] + [float("-inf")] * len(word)
        for end in range(1, len(word) + 1):
            table[end] = max(table[a] + coder.scores.get(word[a:end], coder.unknown if end - a == 1 else float("-inf")) for a in range(end))
        return table[-1]

    for word in words:
        pieces = [names[i] for i in np.frombuffer(coder.young[word], np.int32).tolist()]
        assert "".join(pieces) == word and sum(coder.scores[p] for p in pieces) == best(word)


def test_licences(spark):
    texts = [
        ("Copyright (c) 2020 Somebody\n\n" + TEXTS["MIT"].lower(), "MIT", ""), ("// (C) 2020 X\n" + TEXTS["BSD-3-Clause"].replace(",", " ,"), "BSD-3-Clause", ""),
        (None, None, ""), ("", None, ""), ("Licenced under the APACHE licence version 2.0\nx", None, "Apache-2.0"), (TEXTS["ISC"] + " and more", None, ""),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, (t, _, _) in enumerate(texts)], "doc_id long, text string, licence string")
    got = by_id(licence_scan(df))
    assert [(got[i].licence, got[i].notices) for i in range(len(texts))] == [(a, b) for _, a, b in texts]


def test_licence_lines_and_files(spark):
    texts = [
        ("x\nReleased under the MIT License.\ny", None, "MIT"), ("Licensed under CC BY-NC 4.0.", None, "CC-BY-NC-4.0"), ("Licensed under the Apache License, Version 2.0.", None, "Apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", None, "GPL-3.0"), ("released under the GNU LGPL v2.1 or later\nthis license is here", None, "LGPL-2.1"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", None, "CC-BY-SA-4.0"), ("MIT License", None, ""),
        ("MIT License\n\nCopyright (c) 2020 Somebody\n\n" + TEXTS["MIT"], "MIT", ""), ("BSD 3-Clause License\n\n" + TEXTS["BSD-3-Clause"], "BSD-3-Clause", ""),
    ]
    common = Path("/usr/share/common-licenses")
    texts += [((common / f).read_text(), n, "") for n, f in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0")) if (common / f).exists()]
    got = by_id(licence_scan(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)], "doc_id long, text string")))
    assert [(got[i].licence, got[i].notices) for i in range(len(texts))] == [(a, b) for _, a, b in texts]


def labelled(spark):
    good = [(i, prose(i, 60), 1) for i in range(300)]
    bad = [(300 + i, " ".join(w + "!!" for w in prose(i, 60).upper().split()), 0) for i in range(100)]
    return spark.createDataFrame(good + bad, "doc_id long, text string, quality int")


def test_classifier_separates_held_out_rows(spark, docs):
    df = labelled(spark)
    labels = df.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"))
    model = fit(df, train_labels(labels))
    got = quality_scores(df.drop("quality"), model).join(df.select("doc_id", "quality"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(out) > 50 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in out]) > 0.97
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    scored = quality_scores(docs, model)
    assert scored.count() == len(rows()) and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality_accepted(docs, model).columns == docs.columns
    assert fit(df, labels.limit(0)) is None and {r.score for r in quality_scores(docs, None).collect()} == {1.0}


def test_language_model_learns_and_sums(spark, docs):
    r = random.Random(2)
    chain = {w: [f"n{k}{j}" for j in range(2)] for k, w in enumerate("abcdefgh")}
    texts = [(i, " ".join(x for _ in range(60) for w in [r.choice("abcdefgh")] for x in (w, r.choice(chain[w])))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    shape = dict(words=64, buckets=8, classes=8, width=16, every=2, batch=256)
    flat = lm_scores(df, fit_language(df, Shape(**shape, rounds=0))).agg(F.sum("log_probability")).first()[0]
    language = fit_language(df, Shape(**shape, rounds=3))
    assert lm_scores(df, language).agg(F.sum("log_probability")).first()[0] > 0.95 * flat
    net, s = language.network, language.shape
    words = ["a", "n00", "b"]
    one = lm_scores(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), language).first()
    from tickloom.llm.common import span_hashes
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    hashes = span_hashes(data, np.array([0, 2, 6]), np.array([1, 5, 7]), lower=True)
    token = [int(language.numbers[np.searchsorted(language.hashes, h)]) for h in hashes]
    total = 0.0
    for i, t in enumerate(token):
        near = [token[i + k] if 0 <= i + k < 3 else s.tokens for k in (-2, -1, 1, 2)]
        h = np.tanh(sum(net.near[k][n] for k, n in enumerate(near)) + net.hidden)
        a = h @ net.class_out.T + net.class_bias
        c, m = t % s.classes, t // s.classes
        b = net.word_out[c] @ h + net.word_bias[c]
        total += a[c] - np.log(np.exp(a).sum()) + b[m] - np.log(np.exp(b).sum())
    assert one.n_words == 3 and one.log_probability == pytest.approx(total, abs=1e-3)
    scored = {r.doc_id: r for r in lm_scores(docs, language).collect()}
    assert scored[161].log_probability == 0 and scored[160].mean_log_probability is None


def test_learning_depends_on_the_corpus_alone(spark):
    """Equal weights and scores from one file and from many, in another order and cut in other batches."""
    r = random.Random(5)
    texts = [(i if i % 9 else None, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 120)))) for i in range(150)]
    texts += [(1000 + i, "the same text in many copies") for i in range(60)] + [(7, "the same text in many copies")] * 3
    shape = Shape(words=32, grow=0.0, buckets=8, classes=6, width=8, rounds=2, every=2, batch=64, shard=2000)
    found = []
    for order, parts, rows in ((1, 1, "10000"), (2, 9, "7")):
        shuffled = random.Random(order).sample(texts, len(texts))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(parts)
        language = fit_language(df, shape)
        found.append((language.network.flat(), {(x.doc_id, x.n_words, round(x.log_probability, 3)) for x in lm_scores(df, language).collect()}))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(found[0][0], found[1][0], atol=1e-5)
    assert not np.allclose(found[0][0], fit_language(df, replace(shape, rounds=0)).network.flat(), atol=1e-2)
    assert len(found[0][1] ^ found[1][1]) <= 4  # the third digit may fall on either side


def test_a_step_follows_the_gradient():
    """Every weight moves by the rate times its gradient over the root of its square, with gradients by differences."""
    random_ = np.random.default_rng(3)
    shape = Shape(words=10, grow=0.0, buckets=2, classes=3, width=4)
    net = Network(
        random_.normal(0, 0.5, (4, shape.tokens + 1, 4)), random_.normal(0, 0.5, 4), random_.normal(0, 0.5, (3, 4)), random_.normal(0, 0.5, 3),
        random_.normal(0, 0.5, (3, shape.members, 4)), random_.normal(0, 0.5, (3, shape.members)))
    token, around = random_.integers(0, 12, 40), random_.integers(0, 13, (4, 40))
    trainer = Trainer(net, shape)
    trainer.learn(token.astype(np.int32), around.astype(np.int32))
    for mine, moved in zip(net.arrays(), trainer.net.arrays()):
        for at in [tuple(random_.integers(0, d) for d in mine.shape) for _ in range(25)]:
            kept, sides = mine[at], []
            for step in (1e-5, -1e-5):
                mine[at] = kept + step
                sides.append(-log_probabilities(net, shape, token, around).mean())
            mine[at] = kept
            g = (sides[0] - sides[1]) / 2e-5
            assert kept - moved[at] == pytest.approx(shape.rate * g / np.sqrt(1e-3 + g * g), abs=1e-4)


def test_word_counts_hold_a_word_once(spark):
    df = spark.createDataFrame([(f"The cat {w}",) for w in ("the", "THE", "tHe", "The")], "text string").repartition(4)
    df = df.union(spark.createDataFrame([("the CAT",)], "text string"))
    found = word_counts(df, Shape()).collect()
    assert len(found) == len({r.word for r in found}) == 2 and sorted(r["count"] for r in found) == [5, 9]


@pytest.mark.parametrize("every, rounds", [(8, 2), (2, 3), (8, 8), (3, 1)])
def test_every_place_is_trained_on(every, rounds):
    random_words = np.random.default_rng(1).integers(0, 1 << 63, 40).astype(np.uint64)
    first = np.array([0, 1, 1, 13, 13 + 1, 40])
    turns = [masked(random_words, first, Shape(every=every, rounds=rounds), turn) for turn in range(rounds)]
    assert set(np.concatenate(turns)) == set(range(40))
    assert rounds > every or sum(map(len, turns)) == 40


def test_words_outside_the_vocabulary_are_predicted(spark):
    rare = ["abcde"] * 6 + ["fghij"] * 2 + ["klmno"]
    df = spark.createDataFrame([(i, f"often {w} often") for i, w in enumerate(rare)] + [(None, "often abcde ABCDE"), (7, "often zzzzz often"), (7, "often")], "doc_id long, text string")
    language = fit_language(df.where("text NOT LIKE '%zzzzz%'"), Shape(words=1, grow=0.0, buckets=1, classes=2, width=4, rounds=0))
    got = {r.text: r.log_probability for r in lm_scores(df, language, id_col="text").collect()}
    assert len(got) == len(set(rare)) + 3
    one = got["often abcde often"]
    assert one - got["often klmno often"] == pytest.approx(np.log(8), abs=1e-5) and one - got["often fghij often"] == pytest.approx(np.log(4), abs=1e-5)
    assert got["often klmno often"] - got["often zzzzz often"] == pytest.approx(np.log(2), abs=1e-5)
    assert sorted(r.n_words for r in lm_scores(df, language).where("doc_id = 7 OR doc_id IS NULL").collect()) == [1, 3, 3, 3]
    flat = np.exp(language.network.word_bias[language.network.word_bias > -1e8]).sum()
    assert flat == pytest.approx(2, abs=1e-4)
    assert Shape().grown(400_000).words == 2529 and Shape().grown(10) == Shape()


def test_empty_tables(spark, empty):
    model = fit(empty, empty.select("doc_id", F.lit(1).alias("quality")))
    for df in (
        near_copies(empty), without_near_copies(empty), quality_report(empty), quality_kept(empty), digest(personal_data(empty)), redacted(empty),
        packed(empty, Q.WORD_BPE), fingerprints(empty), edited_fingerprints(empty), encoded(empty, Q.PIECES), round_trip(empty, Q.PIECES), licence_scan(empty),
        quality_scores(empty, model), lm_scores(empty, fit_language(empty)), recounted(token_trees(empty.withColumn("edits", F.expr("CAST(NULL AS array<struct<start:int,end:int,replacement:string>>)")), Q.WORD_BPE, more=["edits"]), Q.WORD_BPE),
    ):
        assert df.count() == 0


LICENCE_FILES = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not LICENCE_FILES.is_dir(), reason="needs the system's licence files")
def test_licence_files_are_known_in_any_wrapping(spark):
    """Both digests of every long text are those of its file; its words are known as they stand, one line a paragraph, and at other widths."""
    import textwrap

    from tickloom.llm.licences import DIGESTS, FOLDED_DIGESTS, LEAST_FOLDED, canonical_text

    names = {"GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "GPL-1.0": "GPL-1", "LGPL-2.0": "LGPL-2", "LGPL-3.0": "LGPL-3", "Artistic-1.0": "Artistic"}
    rows = []
    for name, digest in FOLDED_DIGESTS.items():
        path = LICENCE_FILES / names.get(name, name)
        if not path.exists():
            continue
        text = path.read_text()
        assert len(text) >= LEAST_FOLDED
        assert hashlib.sha256(canonical_text(text, notices=True).encode()).hexdigest() == digest
        assert hashlib.sha256(canonical_text(text).encode()).hexdigest() in DIGESTS[name]
        paragraphs = re.split(r"\n\s*\n", text)
        rows += [(name, text), (name, "\n\n".join(" ".join(p.split()) for p in paragraphs)), (name, "\n\n".join(textwrap.fill(" ".join(p.split()), 100) for p in paragraphs)),
                 (name, " ".join(text.split())), ("", text[: len(text) // 2])]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licence or "" for r in licence_scan(df).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]


def test_workers_give_memory_back_after_a_task(spark):
    """A task frees 256 MB below one array that stays: its worker does not hold them when the next task starts."""
    from tickloom.llm.common import in_arrow

    def held(batches):
        import sys
        from pathlib import Path

        import pyarrow as pa

        for batch in batches:
            mb = int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
            if batch.column(0)[0].as_py():  # the second turn takes its arrays from the heap, where the first freed one of their size
                arrays = [np.ones(1 << 17)]
                arrays.clear()
                arrays = [np.ones(1 << 17) for _ in range(256)]
                sys.stays = arrays.pop()
                del arrays
            yield pa.RecordBatch.from_arrays([pa.array([mb])], ["mb"])

    fill, look = (spark.range(1).coalesce(1).select(F.lit(x).alias("fill")) for x in (True, False))
    before = in_arrow(fill, held, "mb double").collect()[0].mb
    after = in_arrow(look, held, "mb double").collect()[0].mb
    assert after < before + 100
