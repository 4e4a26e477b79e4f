"""SentencePiece encoding and decoding with forward states shared across common prefixes.

White space is marked, a text is cut into marked words, and the distinct words that are not known yet are sorted, which puts
them in the depth-first order of their trie. A stack holds the forward state of each prefix of the word at hand; the
next word goes back to the common prefix and computes only what is new.

For a unigram model the state is the best score and last piece of the prefix (Viterbi). For a BPE model the best sum of
scores is not what its merges give, so the state is the last piece of the prefix's own encoding: the piece that ends
there and whose pair with the piece before encodes to itself. Characters without a piece become their bytes.

A NULL or empty text has no ids. Decoding undoes encoding exactly for models without a normaliser (others raise). An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from sentencepiece import sentencepiece_model_pb2

from .common import in_arrow

MARK = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM = 1
ROOM, PAIR_ROOM, BATCH_CHARS = 150_000, 400_000, 1 << 20


class PieceCoder:
    """Encodes and decodes texts by the pieces of a model file."""

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models that mark white space and change nothing else decode exactly")
        if not model.trainer_spec.byte_fallback:
            raise ValueError("the model has no pieces for bytes")
        self.unigram = model.trainer_spec.model_type == UNIGRAM
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.plain = {i: p.piece.replace(MARK, " ").encode() for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.plain |= {i: bytes([b]) for b, i in self.bytes.items()}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece goes over the start of a marked word")
        self.tails = {p[k:] for p in self.ids for k in range(len(p))}
        chars = set("".join(self.ids))
        lone = re.escape("".join(c for c in map(chr, range(32)) if c not in chars))
        self.cut = re.compile(f"{MARK}*[^{MARK}{lone}]+|[{lone}]|{MARK}+").findall
        self.unknown = min(self.scores.values()) - 10
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        # 1 for the best score; equal scores share a rank
        order = {score: k for k, score in enumerate(sorted({x for x in self.scores.values()}, reverse=True), 1)}
        self.ranks = {p: order[x] for p, x in self.scores.items() if len(p) > 1}
        self.halves: dict[str, tuple[str, str]] = {}

    def _stands(self, left: str, right: str) -> bool:
        """Whether merging the characters of a pair of pieces, best score first and leftmost, ends with that pair.

        The merges of both pieces are taken back from the latest on. The pair falls if, at some point, the two symbols that meet
        could have merged before the merge that was taken back last.
        """
        if len(self.pairs) > PAIR_ROOM:
            self.pairs.clear()
        ranks, halves = self.ranks, self.halves
        a, b, limit, stands = left, right, 1 << 60, True
        while True:
            both = ranks.get(a + b)
            if both is not None and both < limit:
                stands = False
                break
            rank_a, rank_b = len(a) > 1 and ranks[a], len(b) > 1 and ranks[b]
            if rank_a > rank_b:
                limit, a = rank_a, (halves.get(a) or self._halve(a))[1]
            elif rank_b:
                limit, b = rank_b + 1, (halves.get(b) or self._halve(b))[0]
            else:
                break
            if not a or not b:  # no merges make the piece
                stands = False
                break
        self.pairs[left, right] = stands
        return stands

    def _halve(self, piece: str) -> tuple[str, str]:
        """The two pieces whose merge makes a piece, or empty strings where merging its characters doesn't end with it."""
        parts = self.merged(piece, len(piece))
        self.halves[piece] = found = (parts[0], parts[1]) if len(parts) == 2 else ("", "")
        return found

    def merged(self, word: str, whole: int = 0) -> list[str]:
        """The symbols left when nothing merges any more, or when the next merge would make a symbol of `whole` characters."""
        parts, scores = list(word), self.scores
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None or len(parts) == 2 and len(word) == whole:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _best(self, word: str, low: int, end: int, last: list[str], best: list[float]) -> None:
        """The best sum of scores of word[:end], given those of all shorter prefixes; no piece that ends here starts before low."""
        piece, score = word[end - 1 : end], best[end - 1] + self.unknown
        for start in range(low, end):
            own = self.scores.get(word[start:end])
            if own is not None and best[start] + own > score:
                piece, score = word[start:end], best[start] + own
        last.append(piece)
        best.append(score)

    def learn(self, words: list[str]) -> None:
        """Encodes words in sorted order, going back to the prefix shared with the word before."""
        words.sort()
        before, last, best = "", [""], [0.0]
        ids, own_bytes, young = self.ids, self.bytes, self.young
        tails, pairs, stands = self.tails, self.pairs, self._stands
        for word in words:
            size = len(word)
            shared, most = 0, min(size, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, size + 1):
                low = end - 1
                while low > 0 and word[low - 1 : end] in tails:
                    low -= 1
                if self.unigram:
                    self._best(word, low, end, last, best)
                    continue
                for start in range(low, end):
                    piece = word[start:end]
                    if piece in ids:
                        left = last[start]
                        if start == 0 or left not in ids or pairs.get((left, piece)) or (left, piece) not in pairs and stands(left, piece):
                            break
                last.append(piece)
            out, end = [], size
            while end:
                piece = last[end]
                found = ids.get(piece)
                if found is None:
                    out += [own_bytes[b] for b in reversed(piece.encode("utf-8", "surrogatepass"))]
                else:
                    out.append(found)
                end -= len(piece)
            young[word] = array("i", out[::-1]).tobytes()
            before = word

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        cut = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.young) > ROOM:  # words not met since the last turn are forgotten
            self.old, self.young = self.young, {}
        met = set().union(*cut) - self.young.keys()
        if self.old:
            back = met & self.old.keys()
            self.young.update((w, self.old[w]) for w in back)
            met -= back
        if met:
            self.learn(list(met))
        get = self.young.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:]


_ready: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """One per worker process and model file."""
    if path not in _ready:
        _ready[path] = PieceCoder(path)
    return _ready[path]


def _runs(sizes: list[int], most: int):
    a, size = 0, 0
    for b, n in enumerate(sizes, 1):
        size += n
        if size >= most or b == len(sizes):
            yield a, b
            a, size = b, 0


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and its piece ids. No shuffle."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            for a, b in _runs([len(t) for t in texts], BATCH_CHARS):
                raw = coder(model).encode(texts[a:b])
                ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], [id_col, "ids"])

    narrow = docs.select(docs[id_col], docs[text_col].alias("text"))
    return in_arrow(narrow, run, StructType(narrow.schema.fields[:1] + StructType.fromDDL("ids array<int>").fields))


def decoded(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows and the text of their ids (NULL ids: empty) in a further column. No shuffle."""
    at = rows.columns.index(ids_col)
    names = [*rows.columns, text_col]

    def run(batches):
        for batch in batches:
            lists = batch.column(at)
            for a, b in _runs([len(x) if x.is_valid else 0 for x in lists], BATCH_CHARS // 4):
                texts = [coder(model).decode(x) if x else "" for x in lists.slice(a, b - a).to_pylist()]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    return in_arrow(rows, run, StructType(rows.schema.fields + StructType.fromDDL(f"`{text_col}` string").fields))


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the number and the CRC-32 of its piece ids (little-endian, 32 bits), and the SHA-256 of
    what the ids decode to. Both ways in one pass, so ids stay in the task. No shuffle."""
    names = [id_col, "n_pieces", "ids_crc32", "decoded_sha256"]

    def run(batches):
        own = coder(model)
        for batch in batches:
            sizes = pc.utf8_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in _runs(sizes, BATCH_CHARS):
                raw = own.encode(batch.column(1).slice(a, b - a).fill_null("").to_pylist())
                back = (own.decode(np.frombuffer(r, np.int32).tolist()).encode("utf-8", "surrogatepass") for r in raw)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string())],
                    names,
                )

    narrow = docs.select(docs[id_col], docs[text_col].alias("text"))
    fields = StructType.fromDDL("n_pieces long, ids_crc32 long, decoded_sha256 string").fields
    return in_arrow(narrow, run, StructType(narrow.schema.fields[:1] + fields))
