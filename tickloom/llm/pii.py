"""Personal data by SQL functions only: patterns propose, checksums confirm, nearby words adjust the score.

Four base kinds (email, ip, card, phone) are found leftmost and non-overlapping, each on its own; a match that fails its
check (parts up to 255, Luhn, number of digits) is dropped without a retry. Further kinds need a score: IBANs are
confirmed by mod-97, and local phone numbers, social security numbers and secret keys by words in the characters before
them. Matched pieces and the gaps between them give the places, so no text is walked by Python code.

Possessive loops keep the pattern engine from recursing on long runs, and the look-behinds let a match start only where
a run of characters starts or the last match ended, which gives the same matches in linear time.

A NULL or empty text has no spans. Rows are handled each for itself; an empty table gives an empty table, and columns other than
the id and the text are not read (the redaction passes them on).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import unused

LOCAL = "A-Za-z0-9._%+-"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
# Countries by the length of their IBAN.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# The country's length ends a match, whatever follows a space; then a run without spaces, groups of four with a shorter last one, and any
# spacing, for countries that are not listed.
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(
    [rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{size - 4}}}(?![A-Za-z0-9])" for size, names in IBAN_LENGTHS.items()]
    + [rf"[A-Z]{{2}}[0-9]{{2}}{rest}(?![A-Za-z0-9])" for rest in
       ("[A-Z0-9]{11,30}+", r"(?:\x20[A-Z0-9]{4}){2,7}+\x20[A-Z0-9]{1,3}", r"(?:\x20[0-9]{4}){3,7}+", r"(?:\x20?[A-Z0-9]){11,30}+")]
) + ")"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _between(match: Column, low: int, high: int) -> Column:
    return F.length(_digits(match)).between(low, high)


def _mod97(match: Column) -> Column:
    plain = F.translate(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda s, c: F.when(c == "", s).when(c.rlike("[0-9]"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


@dataclass(frozen=True)
class Kind:
    """A kind of data. Its score is `score`, plus `checked` where the check holds and `near` after a word of `context`.

    A base kind counts when its check holds, whatever the score; another kind when the score reaches the threshold.
    `hint` is a cheaper test that every text with a match passes.
    """

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    check: Callable[[Column], Column] | None = None
    base: bool = False
    score: float = 0.4
    checked: float = 0.0
    context: str = ""
    near: float = 0.3


KINDS = (
    Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), None, True, 0.9),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]"),
         lambda m: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), True, 0.3, 0.4, r"\b(?:ip|host|server|address|client)\b"),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
         lambda m: _between(m, 12, 19) & F.call_function("luhn_check", _digits(m)), True, 0.2, 0.6, r"\b(?:card|visa|credit|debit|payment|iban)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]"), lambda m: _between(m, 9, 15), True, 0.3, 0.4,
         r"\b(?:phone|tel|call|mobile|fax|contact)\b"),
    Kind("iban", IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}[A-Z0-9 ]"),
         _mod97, False, 0.2, 0.6, r"\b(?:iban|account|bank|konto)\b"),
    Kind("phone_local", r"(?<![0-9+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
         lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), None, False, 0.4, 0.0, r"\b(?:phone|tel|call|mobile|fax|contact)\b"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
         lambda m: ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-|-0000$"), False, 0.2, 0.2, r"\b(?:ssn|social\s+security)\b"),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+(?![A-Za-z0-9+/_-])", lambda t: t.rlike("[A-Za-z0-9+/_-]{32}"),
         lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), False, 0.2, 0.2, r"\b(?:token|secret|password|passwd|api.?key|key|credential)\b"),
)
BASE = tuple(k.name for k in KINDS if k.base)
THRESHOLD, NEAR_CHARS = 0.6, 40
BLOCK = 256  # matches per inner fold
SPAN = "struct<start:int,place:int,end:int,kind:string,score:double>"


def folded(matches: Column, gaps: Column, kind: str, step: Callable[[Column, Column], Column], name: str) -> Column:
    """Fold step over the pairs (gap, match) of a text from left to right; its state is (at, an array of `kind` called `name`).

    Blocks of pairs are folded each into an array of their own, so that appending stays cheap for any number of matches.
    """
    none = F.array().cast(f"array<{kind}>")
    pairs = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    pairs = F.filter(pairs, lambda p: p["match"].isNotNull())

    def block(states: Column, first: Column) -> Column:
        start = F.struct(F.element_at(states, -1)["at"].alias("at"), none.alias(name))
        return F.concat(states, F.array(F.aggregate(F.slice(pairs, first, BLOCK), start, step)))

    blocks = F.when(F.size(pairs) > 0, F.sequence(F.lit(1), F.size(pairs), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    walked = F.aggregate(blocks, F.array(F.struct(F.lit(0).alias("at"), none.alias(name))), block)
    return F.flatten(F.transform(walked, lambda s: s[name]))


def _found(text: Column, place: int, kind: Kind, threshold: float) -> Column:
    pattern = F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    none = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, pair: Column) -> Column:
        gap, match = pair["gap"], pair["match"]
        start = state["at"] + F.length(gap)
        holds = kind.check(match) if kind.check else F.lit(True)
        score = F.lit(kind.score) + F.when(holds, F.lit(kind.checked)).otherwise(0.0)
        if kind.context:
            score = score + F.when(F.lower(F.right(gap, F.lit(NEAR_CHARS))).rlike(kind.context), F.lit(kind.near)).otherwise(0.0)
        span = F.struct(
            start.alias("start"), F.lit(place).alias("place"), (start + F.length(match)).alias("end"), F.lit(kind.name).alias("kind"),
            score.cast("double").alias("score"),
        )
        wanted = holds if kind.base else (score >= threshold)
        return F.struct(
            (start + F.length(match)).alias("at"), F.when(wanted, F.concat(state["spans"], F.array(span.cast(SPAN)))).otherwise(state["spans"]).alias("spans")
        )

    return F.when(kind.hint(text), folded(matches, gaps, SPAN, step, "spans")).otherwise(none)


def spans_of(text: Column, threshold: float = THRESHOLD) -> Column:
    """All spans of a text by start, then kind as listed: array of (start, place, end, kind, score), in code points."""
    return F.array_sort(F.concat(*[_found(text, i, k, threshold) for i, k in enumerate(KINDS)]))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and its spans with scores. No shuffle."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col], spans_of(text, threshold).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.expr(f"bigint(size(filter(spans, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind in brackets (overlapping spans by the first kind), and the
    number of characters brought up to date where the table has it."""
    text = docs[text_col]
    (found,) = unused(docs, "spans")

    def step(state: Column, span: Column) -> Column:
        before = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        tag = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        apart = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"), F.when(apart, F.concat(state["out"], before, tag)).otherwise(state["out"]).alias("out")
        )

    walked = F.aggregate(
        F.col(found), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, 2147483647)),
    )
    clean = F.when(F.size(found) > 0, walked).otherwise(text)
    out = docs.withColumn(found, spans_of(F.coalesce(text, F.lit("")), threshold)).withColumn(text_col, clean)
    if size_col in docs.columns:
        size = F.when(F.size(found) > 0, F.length(text_col).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col))
        out = out.withColumn(size_col, size)
    return out.select(*docs.columns)
