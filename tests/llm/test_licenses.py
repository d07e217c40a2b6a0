"""Whole licence texts of the production table."""

import re
import textwrap
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.llm import license_scan

FOLDER = Path(license_scan.__file__).parent / "licenses"


def test_whole_texts_with_and_without_titles(spark):
    mit = dict(license_scan.KNOWN[:3])["MIT"]
    body = mit.split("\n", 1)[1].replace("<year> <holder>", "2020 Somebody")
    rows = [("MIT", body), ("MIT", "The MIT License (MIT)\n\n" + body), ("MIT", mit), ("BSD-3-Clause", "BSD 3-Clause License\n" + license_scan._BSD3)]
    for name in ("Apache-2.0", "BSL-1.0", "GPL-1.0", "LGPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "Zlib"):
        text = (FOLDER / f"{name}.txt").read_text()
        rows += [(name, text), (name, text.upper().replace("\n", "\n\n "))]
        if "END OF TERMS" in text:
            rows.append((name, text[: text.index("END OF TERMS AND CONDITIONS") + 27]))
    rows += [(None, body + " and more"), (None, "The MIT License (MIT)")]
    found = license_scan.scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["license"] for r in found} == {i: n for i, (n, _) in enumerate(rows)}


def plain(text):
    """The canonical form, word by word."""
    lines = []
    for line in text.lower().split("\n"):
        start = re.match(r"[^a-z0-9]*(copyright\s*(\(c\)|©)|(copyright|\(c\)|©)[\s:]*[<\[{]?\s*(\d\d\d\d|year|yyyy))", line)
        if not start or "free software" in line or re.search("name of (author|copyright)", line):
            lines.append(line)
    words = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in "\n".join(lines)).split(" ")
    return " ".join(license_scan.EQUAL_WORDS.get(w, w) for w in words if w)


def test_canonical_form_by_plain_python(spark):
    texts = ["licence licence licence\nlicence https https://x", "Copyright notice and this\ncopyright 2019 X\n (c) 2020 Y\n(c) You must\n© 1999\nCopyright (C) Z\r\nend\rcopyright 2019 stays", "", "\n\n", "İ ß É½ ²x", "colour\nof_the-BEHAVIOUR, whilst"]
    texts += [t for _, t in license_scan.KNOWN] + [t for _, t in license_scan.whole_texts()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["form"] for r in df.select("i", license_scan.canonical(F.col("text")).alias("form")).collect()}
    assert {i: plain(t) for i, t in enumerate(texts)} == got


def test_line_breaks_do_not_count(spark):
    """Every whole text, its paragraphs broken at all widths, with a holder of its own."""
    rows = []
    for name, text in license_scan.whole_texts():
        text = text.replace("<year>, <holder>", "2020, Somebody").replace("<year> <holder>", "2020 Somebody")
        paragraphs = [p for part in re.split(r"\n\s*\n", text) for p in ([part] if "2020" not in part else part.split("\n"))]
        if len(text) > 20_000:  # a few widths of the longest
            widths = (40, 57, 72, 79, 100, 120)
        else:
            widths = range(40, 121)
        rows += [(name, "\n\n".join(textwrap.fill(" ".join(p.split()), w, break_long_words=False, break_on_hyphens=False) for p in paragraphs)) for w in widths]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(df).collect()}
    assert {rows[i][0] for i, n in found.items() if n != rows[i][0]} == set()


def test_holders_and_rights_reserved(spark):
    body = dict(license_scan.KNOWN[:3])["BSD-2-Clause"].split("\n", 1)[1]
    heads = ["Copyright 2001 A B", "Copyright (c) 2001-2005, A B", "© 2001 A B", "Copyright © A B", "(C) 2001 A B\nCopyright (c) 2002 C D\nAll rights reserved.", "Copyright: 2001 A B"]
    rows = [(i, f"{h}\n\n{body}") for i, h in enumerate(heads)] + [(99, f"A B holds this\n{body}")]
    found = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: "BSD-2-Clause" for i in range(len(heads))} | {99: None}


def test_the_known_table_is_bounded(spark):
    with pytest.raises(ValueError, match="the most"):
        license_scan.known_digests(spark, [("x", str(i)) for i in range(license_scan.MAX_KNOWN + 1)])
