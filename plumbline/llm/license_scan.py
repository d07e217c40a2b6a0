"""Licence scan by canonical digests, in DataFrame functions alone.

A text is brought to a canonical form (case, copyright lines, punctuation, equivalent spellings, white space) and the
digest of the entire form is looked up among the digests of known licences.  No shuffle: the known table is small by
construction and broadcast.  Each line of a document is held against the same table, for one-line notices.
"""

from __future__ import annotations

import re
from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import text_or_empty

# Spellings that licence matching guidelines hold to be equal, one word to one word.
EQUAL_WORDS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense",
    "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "analogue": "analog", "authorisation": "authorization",
    "authorised": "authorized", "behaviour": "behavior", "cancelled": "canceled", "colour": "color", "favour": "favor",
    "fulfilment": "fulfillment", "honour": "honor", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "modelled": "modeled", "noncommercial": "non commercial", "organisation": "organization", "organisations": "organizations",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "https": "http",
}

# Texts of licences and of the one-line notices that stand for them.
_MIT = """MIT License
Copyright (c) <year> <holder>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """ISC License
Copyright <year> <holder>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Copyright (c) <year>, <holder>
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = [
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD2),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
]
_BSD3 = _BSD2.replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE")
_BSD0 = _ISC.split("\n", 1)[1].replace(", provided that the above copyright notice and this permission notice appear in all copies.", ".")
#: Known texts at most; eleven notices and about a hundred forms of whole texts are known by default.
MAX_KNOWN = 10_000
#: A copyright line begins with a mark and a year, or with two marks.  The statements of a foundation that are part of its
#: licences stay, and so do the examples in them: they are the same everywhere, and their lines are broken in many ways.
_MARKED = r"[^\n\p{L}\p{N}]*(copyright[ \t]*(\(c\)|©)|(copyright|\(c\)|©)[ \t:]*[<\[{]?[ \t]*(\d{4}|year|yyyy))"
_COPYRIGHT = rf"(?dm)^{_MARKED}(?![^\n]*(free software|name of (author|copyright)))[^\n]*$"
#: Title lines that whole texts come with, or without.
_TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause"],
    "Zlib": ["zlib License", "The zlib License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"],
}
#: Lines that open the texts in the folder `licenses`.
_OPENING = r"(Apache License|GNU (LESSER )?GENERAL PUBLIC LICENSE|Mozilla Public License Version 2\.0|Boost Software License.*|Creative Commons Legal Code|CC0 1\.0 Universal|Version \d.*|=+|https?://\S+)"


@cache
def whole_texts() -> tuple[tuple[str, str], ...]:
    """(license, text) of whole texts: each with and without its title lines, and with and without what stands after its
    end of terms.  A bounded table, read on the driver."""
    found = [("MIT", _MIT.split("\n", 1)[1]), ("ISC", _ISC.split("\n", 1)[1]), ("BSD-2-Clause", _BSD2), ("BSD-3-Clause", _BSD3), ("0BSD", _BSD0)]
    found += [(name, text.replace("<holder>\n", "<holder>\nAll rights reserved.\n")) for name, text in found]
    found += [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(files("plumbline.llm").joinpath("licenses").iterdir(), key=lambda f: f.name)]
    out = []
    for name, text in found:
        ended = re.search(r"(?m)^.*END OF TERMS AND CONDITIONS.*$", text)
        for whole in [text, *([text[: ended.end()], text[: ended.start()]] if ended else [])]:
            lines = whole.strip().split("\n")
            while lines and (not lines[0].strip() or re.fullmatch(_OPENING, lines[0].strip())):
                lines = lines[1:]
            out += [(name, whole), (name, "\n".join(lines)), *((name, title + "\n" + whole) for title in _TITLES.get(name, []))]
    return tuple(dict.fromkeys(out))


def plain_form(text: Column) -> Column:
    """Lower case; no copyright lines; letters, digits and line feeds alone, one space for what stands between."""
    out = F.lower(text)
    marked = F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("(c)")) | F.contains(out, F.lit("©"))
    out = F.when(marked, F.regexp_replace(out, _COPYRIGHT, " ")).otherwise(out)
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def canonical_lines(form: Column) -> Column:
    """The lines of a plain_form() of which something is left, with one spelling a word."""
    lines = F.filter(F.transform(F.split(form, "\n"), lambda line: F.trim(line)), lambda line: line != "")
    names = F.create_map(*[F.lit(x) for pair in EQUAL_WORDS.items() for x in pair])
    spelled = lambda line: F.array_join(F.transform(F.split(line, " "), lambda w: F.when(w.isin(*EQUAL_WORDS), names[w]).otherwise(w)), " ")
    other = F.arrays_overlap(F.split(F.translate(form, "\n", " "), " "), F.array(*map(F.lit, EQUAL_WORDS)))
    return F.when(other, F.transform(lines, spelled)).otherwise(lines)


def canonical(text: Column) -> Column:
    """The canonical lines in a row: how the words are dealt to lines doesn't count, but for copyright lines."""
    return F.array_join(canonical_lines(plain_form(text)), " ")


def canonical_digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, form, license), one row a digest; `known` is a list of (license, text), MAX_KNOWN at most."""
    pairs = known if known is not None else [*KNOWN, *whole_texts()]
    if len(pairs) > MAX_KNOWN:
        raise ValueError(f"the table of known licences goes with the plan; {MAX_KNOWN} texts are the most")
    names = spark.createDataFrame(pairs, "license string, text string").select("license", canonical(F.col("text")).alias("form"))
    return names.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("form").alias("form"), F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row: doc_id, text_digest, license (of the entire text, else null), notices (known licences of whole lines,
    sorted, each once, joined by a comma; empty if none), notice_lines (how many lines are a known notice).

    Other columns are ignored, so their names can't clash.  A null text counts as empty, and an empty form has no
    licence.  Repeated rows each give a row.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = [(r.digest, r.license, r.hash) for r in known_digests(spark, known).where("form <> ''").select("digest", "license", F.xxhash64("form").alias("hash")).collect()]
    known_rows = F.broadcast(spark.createDataFrame([t[:2] for t in table], "digest string, license string"))
    # a line's hash is looked up in a set, and only lines that are in it have their digest looked up
    names = F.create_map(*[F.lit(x) for t in table for x in t[:2]]) if table else F.expr("cast(map() as map<string, string>)")
    hits = F.transform(F.filter("lines", lambda line: F.xxhash64(line).isin([t[2] for t in table])), lambda line: names[F.sha2(line, 256)])
    # step by step, as each form is used more than once by the next
    rows = docs.select(F.col(doc_id).alias("doc_id"), plain_form(text_or_empty(text)).alias("form"))
    rows = rows.select("doc_id", canonical_lines(F.col("form")).alias("lines"))
    rows = rows.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("text_digest"), F.filter(hits, lambda name: name.isNotNull()).alias("hits"))
    return rows.join(known_rows, F.col("text_digest") == F.col("digest"), "left").select(
        "doc_id", "text_digest", "license", F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"), F.size("hits").alias("notice_lines")
    )


def oracle(known: list[tuple[str, str]] | None = None) -> str:
    """The same scan in DuckDB."""
    spelled = ", ".join(f"'{a}': '{b}'" for a, b in EQUAL_WORDS.items())

    def form(x: str) -> str:
        out = rf"list_filter(string_split(lower({x}), chr(10)), lambda l: NOT (regexp_matches(l, '^{_MARKED}') AND NOT regexp_matches(l, 'free software|name of (author|copyright)')))"
        out = rf"string_split(trim(regexp_replace(array_to_string({out}, ' '), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), ' ')"
        out = f"list_transform({out}, lambda w: coalesce(map {{{spelled}}}[w], w))"
        return f"sha256(array_to_string({out}, ' '))"

    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in (known if known is not None else KNOWN))
    return f"""
WITH known AS (SELECT {form('text')} AS digest, min(license) AS license FROM (VALUES {quoted}) AS k(license, text) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
hits AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*)::INT AS notice_lines
         FROM (SELECT doc_id, {form('line')} AS digest FROM lines) JOIN known USING (digest) GROUP BY doc_id),
docs AS (SELECT doc_id, {form("coalesce(text, '')")} AS text_digest FROM documents)
SELECT d.doc_id, text_digest, k.license, coalesce(notices, '') AS notices, coalesce(notice_lines, 0)::INT AS notice_lines
FROM docs d LEFT JOIN known k ON d.text_digest = k.digest LEFT JOIN hits h ON d.doc_id = h.doc_id
"""
