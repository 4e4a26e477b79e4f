"""Licence scans by canonical digest: whole texts and single lines joined to the digests of known licences.

A canonical text is in lower case, without copyright lines, with one spelling for equivalent words, and with one space for
each run of anything but letters and numbers. Whole texts are looked up by the SHA-256 of that; so are the lines of texts
that mention a licence, against the known one-line notices, in all their spellings. Texts are known with and without a heading
line; long ones by the digest of the usual file. A second form keeps copyright lines, so that the file is known in any wrapping. The known table is broadcast: its bound is `MOST_KNOWN` rows.

A NULL or empty text is canonically empty and matches nothing. Rows are looked up each for itself; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MOST_KNOWN = 10_000
LEAST_FOLDED = 2_000  # characters; the shortest text in FOLDED_DIGESTS has more

_ASIS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so"
)
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Public licence texts and notices, by their usual short names.
TEXTS = {
    "MIT": f"{_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in "
           f"all copies or substantial portions of the Software.\n{_ASIS}",
    "MIT-0": f"{_GRANT}.\n{_ASIS}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           f"provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
            f"{_ISC_END}",
    "BSD-2-Clause": _BSD_HEAD + _BSD_END,
    "BSD-3-Clause": f"{_BSD_HEAD}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                    f"promote products derived from this software without specific prior written permission.\n{_BSD_END}",
}
# Whole texts too long to hold here, as digests of their canonical form: the usual file, and it without the appendix on use.
DIGESTS = {
    "Apache-2.0": (
        "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100",
        "e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca",
        "1d2490e65bade4b7cde700178105759a1eeb6ed401841c01b9ff35e40e55c5ad",
    ),
    "Artistic-1.0": (
        "f7fec2048e2502b8b653a12ac095bcb0601f72bbd1d535b2e8adf8e097d2f915",
    ),
    "CC0-1.0": (
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ),
    "GFDL-1.2": (
        "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86",
    ),
    "GFDL-1.3": (
        "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb",
    ),
    "GPL-1.0": (
        "9caf042595280548f0149ac88169a7f2e04f35b2a642cf00b991f00d48bfa4ce",
        "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b",
        "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb",
    ),
    "GPL-2.0": (
        "c230c00f329737cb7ce3d97a266318b4c9d4c1fd321335e592b2ce1112179b88",
        "ae49934a47b15ec36e1ce1eb7504b3439c29f0e9be2ed0f60ba20ad7124dcb7c",
        "178d586a448701f01712744f9de166175b5625d05f71dd532a3d694e2b935def",
    ),
    "GPL-3.0": (
        "5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30",
        "f7bb29d9a31c3a1a68ccff0d8d9053350dc0b10b52b62d46d0f2e36a41e32975",
        "f37d587507fc579524cb06d1130d5899891a978ee008cfc033b3b4d95da28bee",
    ),
    "LGPL-2.0": (
        "96685b4d8003c3671feddcde58622afa814a3ac15dcc419f38b388aff5e16d1d",
        "a07313094d4e63b099417491ebc80c933bf85c36d5afddbf13be9a11457c8513",
        "a745f6517e6dd821b7e0352067dcf8f32789a02694b661bfad965280370e9b1a",
    ),
    "LGPL-2.1": (
        "22bd2802b7b313faf9750f494c8f07c9eaa0e00ba5b9f7a300e8fa36cfd1319e",
        "bfe8e5dc6cef43d0c4777d9c1891f596159cda682ef40545ad2105f66b9746f1",
        "4656c6936fdab5334aa4c4800c6a7881ffce24f3abb1f578c24da0bbb2735d0a",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",
    ),
    "MPL-2.0": (
        "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
    ),
}
# The same files with their copyright notices left in, which makes the form independent of line breaks.
FOLDED_DIGESTS = {
    "Apache-2.0": "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184",
    "Artistic-1.0": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "61501da4fb94cceda16cd9affa2c77a91451ac2041c3baac644d4090c86855de",
    "GFDL-1.3": "cdf3d9ad52a468f1e3a38b3cd70b6b38978b4acbb41cceee134bf4e2e6168fe4",
    "GPL-1.0": "8a9ccb74f73e459deea9ab73828583de1cd66754c9f8f0699cd2117a96b6b58c",
    "GPL-2.0": "1225d02cd36c293fc65ff6aedbed342e33fbb6ff556bc49cb670a60b6992e8c3",
    "GPL-3.0": "7d478223d8fcde6480339b8bbaadacf6b93d7007d04a13fbd30f71a80fd981a0",
    "LGPL-2.0": "9ccbf81e2fd78db81966e466a22ed39318d0a4b4550cd69d1144dcf09722ff10",
    "LGPL-2.1": "a9cc8dda4023821e198a2e1bee36afc3e68fce90828780c7bac37ffe33565e15",
    "LGPL-3.0": "3ce770135de37fc153de7af30789ebf6cf1e9ad54eb9b487647ea8aa9ccae9c2",
    "MPL-1.1": "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}
# Heading lines that files put before a text; a text is known with each of them and without.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT", "MIT"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License", "MIT-0", "MIT-0 License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause", "Simplified BSD License", "BSD-2-Clause", "BSD License",
                     "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause", "New BSD License", "BSD-3-Clause", "BSD License",
                     "BSD 3-Clause \"New\" or \"Revised\" License", "Modified BSD License"),
}
# A one-line notice is a lead-in and a name with or without an article; lead-ins are equivalent.
LEADS = ("licensed under", "released under", "distributed under", "this work is licensed under", "this software is licensed under",
         "this project is licensed under")


def _with_article(*names: str) -> tuple[str, ...]:
    return tuple(article + n for n in names for article in ("", "the "))


def _versions(names: tuple[str, ...], *numbers: str, later: bool = False) -> tuple[str, ...]:
    return _with_article(*[f"{n} {v}{x}{end}" for n in names for x in numbers for v in ("version ", "v", "") for end in (("", " or later") if later else ("",))])


def _creative(kind: str) -> dict[str, tuple[str, ...]]:
    """All versions of one Creative Commons licence, by its short and its long name."""
    long = kind.replace("BY", "Attribution").replace("NC", "NonCommercial").replace("SA", "ShareAlike").replace("ND", "NoDerivatives")
    out = {}
    for number, where in (("4.0", " International"), ("3.0", " Unported"), ("2.5", " Generic"), ("2.0", " Generic")):
        whole = [f"Creative Commons {long} {number}{place}{end}" for place in ("", where) for end in ("", " License", f" License (CC {kind} {number})")]
        out[f"CC-{kind}-{number}"] = _with_article(f"CC {kind} {number}", f"CC {kind} {number} License", *whole) + tuple(f"a {w}" for w in whole)
    return out


_GNU = {"GPL": ("General Public License", (1, 2, 3)), "LGPL": ("Lesser General Public License", (2, 3)), "AGPL": ("Affero General Public License", (3,))}
NAMES = {
    **{f"{short}-{n}.0": _versions((f"GNU {long}", f"GNU {short}", short), str(n), f"{n}.0", later=True) for short, (long, numbers) in _GNU.items() for n in numbers},
    "LGPL-2.1": _versions(("GNU Lesser General Public License", "GNU LGPL", "LGPL"), "2.1", later=True),
    "Apache-2.0": _versions(("Apache License", "Apache Software License", "Apache"), "2.0", "2") + _with_article("Apache 2.0 License"),
    "MPL-2.0": _versions(("Mozilla Public License", "MPL"), "2.0"),
    "MPL-1.1": _versions(("Mozilla Public License", "MPL"), "1.1"),
    "MIT": _with_article("MIT License", "MIT", "MIT License (MIT)"),
    "MIT-0": _with_article("MIT No Attribution License", "MIT-0 License"),
    "ISC": _with_article("ISC License", "ISC"),
    "0BSD": _with_article("BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License", "0BSD"),
    "BSD-2-Clause": _with_article("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause", "Simplified BSD License"),
    "BSD-3-Clause": _with_article("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause", "New BSD License", "Modified BSD License"),
    "Unlicense": _with_article("Unlicense"),
    "CC0-1.0": _with_article("CC0 1.0", "CC0", "CC0 License", "CC0 1.0 License", "CC0 1.0 Universal", "CC0 1.0 Universal License", "Creative Commons CC0 1.0 Universal License"),
    **{name: forms for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for name, forms in _creative(kind).items()},
}
NOTICES = {name: tuple(f"{lead} {form}" for lead in LEADS for form in forms) for name, forms in NAMES.items()}
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization",
    "acknowledgement": "acknowledgment", "favour": "favor", "fulfil": "fulfill", "judgement": "judgment", "merchantibility": "merchantability",
    "noncommercial": "non commercial", "programme": "program", "recognise": "recognize", "whilst": "while", "wilful": "willful",
    "authorise": "authorize", "authorised": "authorized", "initialise": "initialize", "utilisation": "utilization",
}
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"
GAPS = r"[^\p{L}\p{N}]+"


def canonical(text: Column, notices: bool = False) -> Column:
    """The canonical form of a text; with `notices`, copyright lines stay. Rarely needed steps stand behind a plain search for their words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if not notices:
        low = F.when(_marked(low), F.regexp_replace(low, COPYRIGHT, "")).otherwise(low)
    plain = F.trim(F.regexp_replace(low, GAPS, " "))
    same = plain
    for word, usual in SPELLINGS.items():
        same = F.regexp_replace(same, rf"\b{word}\b", usual)
    return F.when(plain.rlike(rf"\b(?:{'|'.join(SPELLINGS)})\b"), same).otherwise(plain)


def _marked(low: Column) -> Column:
    return low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("all rights reserved")


def canonical_text(text: str, notices: bool = False) -> str:
    """The same for one text outside of Spark, for the table of known licences and for tests."""
    low = text.lower() if notices else re.sub(r"(?m)^[^\w\n]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$", "", text.lower())
    plain = re.sub(r"[\W_]+", " ", low).strip(" ")
    return re.sub(r"\b[a-z]+\b", lambda m: SPELLINGS.get(m[0], m[0]), plain)


def digests(table: dict[str, str | tuple[str, ...]]) -> dict[str, str]:
    """Licence by digest of each spelling in a table."""
    return {hashlib.sha256(canonical_text(t).encode()).hexdigest(): name for name, found in table.items() for t in ((found,) if isinstance(found, str) else found)}


def text_digests(texts: dict[str, str]) -> dict[str, str]:
    """Licence by digest of each text, with and without its heading lines; the texts kept as digests belong to the usual table."""
    out = digests({name: (t, *[f"{title}\n{t}" for title in TITLES.get(name, ())]) for name, t in texts.items()})
    return out | ({d: name for name, found in DIGESTS.items() for d in found} | {d: name for name, d in FOLDED_DIGESTS.items()} if texts is TEXTS else {})


def known(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(digest, licence) of known texts."""
    rows = list(text_digests(texts).items())
    if len(rows) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    return spark.createDataFrame(rows, "digest string, licence string")


def licence_scan(docs: DataFrame, texts: dict[str, str] = TEXTS, notices: dict[str, str | tuple[str, ...]] = NOTICES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: its id, the digest of its canonical text, the licence it is (or NULL), and the licences its
    lines give notice of, sorted and joined by commas. No shuffle."""
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    names = F.from_json(F.lit(json.dumps(digests(notices))), "map<string,string>")
    found = F.transform(F.split(text, "\n"), lambda line: F.element_at(names, F.sha2(canonical(line).cast("binary"), 256)))
    noted = F.when(F.lower(text).rlike("licen[cs]e"), F.array_join(F.array_sort(F.array_distinct(F.array_compact(found))), ",")).otherwise("")
    digest = F.sha2(canonical(text).cast("binary"), 256)
    # a text that names no copyright is the same in both forms; shorter ones than any known long text need no second look
    folded = F.when(_marked(F.lower(text)) & (F.length(text) >= LEAST_FOLDED), F.sha2(canonical(text, True).cast("binary"), 256))
    rows = docs.select(docs[id_col], digest.alias("digest"), folded.alias("folded"), noted.alias("notices"))
    names = known(spark, texts)
    rows = rows.join(F.broadcast(names), "digest", "left")
    rows = rows.join(F.broadcast(names.select(F.col("digest").alias("folded"), F.col("licence").alias("again"))), "folded", "left")
    return rows.select(id_col, "digest", F.coalesce("licence", "again").alias("licence"), "notices")


def oracle(texts: dict[str, str] = TEXTS, notices: dict[str, str | tuple[str, ...]] = NOTICES) -> str:
    """The same in DuckDB's SQL."""
    def canon(x: str, notices: bool = False) -> str:
        low = f"lower(coalesce({x}, ''))"
        low = low if notices else f"regexp_replace({low}, '{COPYRIGHT}', '', 'g')"
        x = f"trim(regexp_replace({low}, '{GAPS}', ' ', 'g'))"
        for word, usual in SPELLINGS.items():
            x = f"regexp_replace({x}, '\\b{word}\\b', '{usual}', 'g')"
        return x

    def values(table: dict[str, str]) -> str:
        return ", ".join(f"('{d}', '{n}')" for d, n in table.items())

    return f"""
WITH known(digest, licence) AS (VALUES {values(text_digests(texts))}), notice(digest, licence) AS (VALUES {values(digests(notices))}),
d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({canon('text')}) AS digest, sha256({canon('text', True)}) AS folded FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d WHERE regexp_matches(lower(text), 'licen[cs]e')),
found AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM lines
          JOIN notice ON notice.digest = sha256({canon('line')}) GROUP BY r)
SELECT doc_id, d.digest, coalesce(known.licence, again.licence) AS licence, coalesce(found.notices, '') AS notices
FROM d LEFT JOIN known ON known.digest = d.digest LEFT JOIN known again ON again.digest = d.folded LEFT JOIN found USING (r)"""
