"""Edit-aware token counts: a segment tree of pre-tokens per document, updated where edits touch it.

A text is cut into segments of a few dozen pre-tokens, at places where the tokenizer cuts whatever stands around: between a
character and the white space after it. The leaves hold the characters and tokens of their segments, each inner node the
sums of its two children. An edit finds its leaves by descending the character sums, re-encodes their
text plus the segment on either side where the edit reaches the cut (the boundary context), and updates the sums on the
paths to the root; all other counts stand.

A NULL or empty text has one empty segment. Edits are (start, end, replacement) in code points of the original text; they
must not overlap, lie inside the text, and may come in any order; NULL edits mean none. Documents without edits keep their counts.
An empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import in_arrow
from .pii import folded
from .tokens import WordTokenizer, word_tokenizer

SEGMENT = 32
BATCH_CHARS = 1 << 20
# From one cut to the next: up to SEGMENT runs of white space with the word after them, else the white space at the end.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = re.compile(f"(?:[{_SPACE}]*[^{_SPACE}]+){{1,{SEGMENT}}}|[{_SPACE}]+").findall


@dataclass
class Tree:
    """Sums over 2 * size - 1 nodes, node 1 the root and node size + i the leaf of segment i."""

    chars: list[int]
    tokens: list[int]
    size: int

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> "Tree":
        size = 1
        while size < len(chars):
            size *= 2
        tree = cls([0] * size + chars + [0] * (size - len(chars)), [0] * size + tokens + [0] * (size - len(tokens)), size)
        for node in range(size - 1, 0, -1):
            tree.add(node)
        return tree

    def add(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The segment that holds the character at a place (the last one that starts there or before), and where it starts."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if place >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        self.chars[node], self.tokens[node] = chars, tokens
        while node > 1:
            node //= 2
            self.add(node)


def segments(text: str) -> list[str]:
    return _PIECES(text) or [""]


def touched(tree: Tree, text: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Regions to encode again: first and last segment, and their edited text. Regions that meet become one."""
    out: list[list] = []
    for start, end, new in sorted(edits, key=lambda e: e[:2]):
        first, a = tree.leaf_at(start)
        last, b = tree.leaf_at(max(end - 1, start))
        b += tree.chars[tree.size + last]
        if start <= a + 1 and first > 0:  # the edit may join with what stands before the cut
            first -= 1
            a -= tree.chars[tree.size + first]
        if end >= b - 1 and last + 1 < tree.size and tree.chars[tree.size + last + 1]:
            last += 1
            b += tree.chars[tree.size + last]
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
            out[-1][3] = max(out[-1][3], b)
            out[-1][4].append((start, end, new))
        else:
            out.append([first, last, a, b, [(start, end, new)]])
    done = []
    for first, last, a, b, own in out:
        parts, at = [], a
        for start, end, new in own:
            parts += [text[at:start], new]
            at = end
        done.append((first, last, "".join(parts) + text[at:b]))
    return done


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: e[:2]):
        parts += [text[at:start], new]
        at = end
    return "".join(parts) + text[at:]


def _counts(encoder: WordTokenizer, texts: list[str]) -> list[int]:
    return [len(raw) // 4 for raw in encoder.ids(texts)]


def _runs(sizes: list[int], most: int):
    a, size = 0, 0
    for b, n in enumerate(sizes, 1):
        size += n
        if size >= most or b == len(sizes):
            yield a, b
            a, size = b, 0


def token_trees(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", more: list[str] = []) -> DataFrame:
    """One row per document: id, text, the character and token sums of its tree (root first), and further columns. No shuffle."""
    narrow = docs.select(docs[id_col], F.coalesce(docs[text_col], F.lit("")).alias("text"), *[docs[c] for c in more])
    names = [id_col, "text", *more, "chars", "tokens"]

    def run(batches):
        encoder = word_tokenizer(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _runs([len(t) for t in texts], BATCH_CHARS):
                cut = [segments(t) for t in texts[a:b]]
                counts = iter(_counts(encoder, [s for c in cut for s in c]))
                trees = [Tree.of([len(s) for s in c], [next(counts) for _ in c]) for c in cut]
                lists = [pa.array([getattr(t, k)[1:] for t in trees], pa.list_(pa.int64())) for k in ("chars", "tokens")]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *lists], names)

    return in_arrow(narrow, run, StructType(narrow.schema.fields + StructType.fromDDL("chars array<long>, tokens array<long>").fields))


def recounted(trees: DataFrame, tokenizer: str, edits_col: str = "edits", id_col: str = "doc_id") -> DataFrame:
    """The trees after each row's edits: id, edited text, tokens before and after, characters encoded again, and the sums. No shuffle."""
    narrow = trees.select(id_col, "text", "chars", "tokens", edits_col)
    names = [id_col, "text", "n_tokens", "edited_tokens", "encoded_chars", "chars", "tokens"]

    def run(batches):
        encoder = word_tokenizer(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _runs([len(t) for t in texts], BATCH_CHARS):
                ids, _, chars, tokens, edits = (c for c in batch.slice(a, b - a).columns)
                edits = [[(e["start"], e["end"], e["replacement"] or "") for e in row or []] for row in edits.to_pylist()]
                own = [Tree([0, *c], [0, *t], (len(c) + 1) // 2) for c, t in zip(chars.to_pylist(), tokens.to_pylist())]
                before = [t.tokens[1] for t in own]
                regions = [touched(tree, text, e) for tree, text, e in zip(own, texts[a:b], edits)]
                counts = iter(_counts(encoder, [new for r in regions for _, _, new in r]))
                for tree, region in zip(own, regions):
                    for first, last, new in region:
                        tree.put(first, len(new), next(counts))
                        for leaf in range(first + 1, last + 1):
                            tree.put(leaf, 0, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array([edited(t, e) for t, e in zip(texts[a:b], edits)], pa.string()), pa.array(before, pa.int64()),
                        pa.array([t.tokens[1] for t in own], pa.int64()), pa.array([sum(len(new) for _, _, new in r) for r in regions], pa.int64()),
                        *[pa.array([getattr(t, k)[1:] for t in own], pa.list_(pa.int64())) for k in ("chars", "tokens")],
                    ],
                    names,
                )

    fields = "text string, n_tokens long, edited_tokens long, encoded_chars long, chars array<long>, tokens array<long>"
    return in_arrow(narrow, run, StructType(narrow.schema.fields[:1] + StructType.fromDDL(fields).fields))


def masking_edits(text: Column, source: Column) -> Column:
    """A data-cleaning job as edits, by SQL functions: each run of four or more digits becomes "0", and a line that names
    the source is added at the end."""
    digits = "[0-9]{4,}+"
    text = F.coalesce(text, F.lit(""))
    kind = "struct<start:int,end:int,replacement:string>"

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        edit = F.struct(start.alias("start"), end.alias("end"), F.lit("0").alias("replacement")).cast(kind)
        return F.struct(end.alias("at"), F.concat(state["edits"], F.array(edit)).alias("edits"))

    found = folded(F.regexp_extract_all(text, F.lit(digits), F.lit(0)), F.split(text, digits, -1), kind, step, "edits")
    line = F.concat(F.lit("\nsource: "), F.coalesce(source, F.lit("unknown")))
    end = F.struct(F.length(text).alias("start"), F.length(text).alias("end"), line.alias("replacement")).cast(kind)
    return F.concat(F.when(text.rlike("[0-9]{4}"), found).otherwise(F.array().cast(f"array<{kind}>")), F.array(end))
