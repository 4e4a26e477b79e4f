"""Token ids of whole texts by a public tokenizer, by way of a bounded memory of pre-tokens.

The tokenizer lower-cases a text and cuts it into pre-tokens, none of which holds white space, before it merges inside each
of them. So a text's ids are the ids of its words between white space, and a word's those of its pre-tokens. Texts of Latin
characters in composed form are cut here by the same rule: each distinct word of some texts is cut and looked up once, and the
pre-tokens not met before are merged together in one call. Each pre-token ends with the only id of its whose symbol ends a
word, which tells their ids apart. The tokenizer itself encodes all other texts.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

ROOM = 200_000
RUN = 64  # pre-tokens merged as one text
CHARS = 32  # of a pre-token in the memory, on average at most
# Latin characters that composing leaves alone and that lower-case to one of them; the tokenizer's special tokens start with "<|".
ODD = re.compile("[^\\x00-\\u012f\\u0131-\\u024f]").search
LETTERS, NUMBERS = "a-zªµºß-öø-ɏ", "0-9²³¹¼½¾"
CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\t-\\r \\x85\\xa0{LETTERS}{NUMBERS}]+").findall
MARKS = frozenset(".,;:!?")


def odd(text: str) -> bool:
    if "<|" in text:
        return True
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return bool(ODD(text) or ODD(text.lower()))


class WordTokenizer:
    """ids(texts) for a lower-casing byte-level BPE tokenizer with word ends that drops white space."""

    def __init__(self, path: str, room: int = ROOM) -> None:
        self.whole = Tokenizer.from_file(path)
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for symbol, i in self.whole.get_vocab().items():
            self.ends[i] = symbol.endswith("</w>")
        # pre-tokens are in lower case and cut; only the letters that stand for bytes remain to be put in
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: letters(chr(c))[0][0] for c in range(0x250) if c != 32}
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room = room
        self.chars = 0

    def learn(self, new: list[str]) -> None:
        """Take pre-tokens into the memory."""
        runs = [" ".join(new[a : a + RUN]) for a in range(0, len(new), RUN)]
        runs = [r if r.isascii() and r.isprintable() else r.translate(self.letters) for r in runs]
        found = self.merges.encode_batch_fast(runs, add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(new):
            raise ValueError("the tokenizer does not end each pre-token with one word-end symbol")
        raw, stops = ids.tobytes(), (stops * 4).tolist()
        self.young.update(zip(new, (raw[a:b] for a, b in zip([0, *stops], stops))))
        self.chars += sum(map(len, new))

    def recall(self, some: set[str]) -> list[str]:
        """Words the young memory lacks: what the old one has is taken back, the others are returned."""
        back = {w: self.old[w] for w in some if w in self.old}
        self.young.update(back)
        self.chars += sum(map(len, back))
        return [w for w in some if w not in back] if back else list(some)

    def meet(self, words: list[str]) -> list[bytes]:
        """The ids of words that the young memory lacks; it takes in their pre-tokens."""
        # most words that are not one pre-token are letters and a mark
        cut = [(w,) if w.isalpha() else (w[:-1], w[-1]) if w[-1:] in MARKS and w[:-1].isalpha() else CUT(w) for w in words]
        young = self.young
        new = self.recall({p for c in cut for p in c if p not in young})
        if new:
            self.learn(new)
        get = young.__getitem__
        return [get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in cut]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        left = [i for i, t in enumerate(texts) if odd(t)]
        skip = set(left)
        plain = pa.array([t for i, t in enumerate(texts) if i not in skip] if left else texts, pa.large_string())
        lists = pc.ascii_split_whitespace(pc.utf8_lower(plain))
        lists, flat = (lists.offsets.to_numpy(), lists.values) if len(plain) else (np.zeros(1, np.int64), pa.array([], pa.large_string()))
        coded = flat.dictionary_encode()
        words, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.young) > self.room or self.chars > CHARS * self.room:  # those not met since the last turn are forgotten
            self.old, self.young, self.chars = self.young, {}, 0
        raw = list(map(self.young.get, words))
        unknown = [i for i, r in enumerate(raw) if r is None]
        for i, r in zip(unknown, self.meet([words[i] for i in unknown])):
            raw[i] = r
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        known, first = np.frombuffer(b"".join(raw), np.uint32), np.cumsum(sizes) - sizes
        sizes = sizes[code]
        ends = np.zeros(len(code) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        done = known[np.repeat(first[code] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = (ends[lists] * 4).tolist()
        done = iter([done[a:b] for a, b in zip(cuts, cuts[1:])])
        if not left:
            return list(done)
        whole = iter(self.whole.encode_batch_fast([texts[i] for i in left], add_special_tokens=False))
        return [np.array(next(whole).ids, np.uint32).tobytes() if i in skip else next(done) for i in range(len(texts))]


_ready: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process and vocabulary file."""
    if path not in _ready:
        _ready[path] = WordTokenizer(path)
    return _ready[path]
