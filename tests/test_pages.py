"""Delimited text against the csv module, and pages that used to end a job."""

import csv
import io
import time

import pandas as pd
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.sources import pages, tables
from plumbline.sources.delimited import find_separator, records


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from('ab",;\n\r \t|'), max_size=40), st.sampled_from(",;\t|"))
@example('a,"b\nc",d\n"e""f"g,,\n\n x', ",")
@example('a,"never closed\n1,2', ",")
def test_records_against_the_csv_module(text, separator):
    want = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=separator) if r]
    got = list(records(text, separator))
    blank = [r for r in want if len(r) == 1 and not r[0].strip()]
    assert [r for r in got if len(r) > 1 or r[0].strip()] == [r for r in want if r not in blank]


@pytest.mark.parametrize(
    ("first", "separator"),
    [("a,b", ","), ("a;b", ";"), ("a\tb|c", "\t"), ("a|b", "|"), ("abc", ","), ("", ","), ("1,5;2,7", ","), ('"a,b";"c,d";e', ";"), ('"x""y,z"|1', "|"), ('"a\nb"\t"c"', "\t"), ('a\nb;c', ","), ('5" pipe;x', ";")],
)
def test_separator(first, separator):
    assert find_separator(first + "\nrest;of,it\n") == separator


def test_time_grows_with_the_text():
    quoted = ",".join(f'"{i} ""x"" y"' for i in range(70_000))
    for text in (quoted, '"' + "ab" * 500_000, '""' * 500_000, "a" * 1_000_000, '"a' * 500_000, "\n" * 1_000_000):
        assert len(text) >= 1_000_000
        began = time.process_time()
        found = list(records(text + "\n1,2", find_separator(text)))
        assert time.process_time() - began < 1.5 and found
    assert len(next(records(quoted, find_separator(quoted)))) == 70_000


BAD = {
    "long field": "k,v\n" + "x" * 200_000 + ",1\n",
    "marked section": "<p>before</p><![foo bar]><ul><li><b>f</b><i>v</i></li></ul>",
    "quotes": '"a""b",' * 150_000 + "x\n" + "1,2\n",
    "unclosed section": "<table><tr><td>a</td></tr></table><![CDATA[",
    "doctype": "<!DOCTYPE [ <!ELEMENT x ]><p>a",
    "deep list": "<li>x" * 30_000,
}


def test_bad_pages_have_rows(spark):
    good = [(100 + i, "<table><tr><th>k</th></tr><tr><td>1</td></tr></table>") for i in range(5)]
    rows = [(i, h) for i, h in enumerate(BAD.values())] + good + [(50, None), (51, ""), (52, "a,b\n1,2,3\n")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    found = {r["page_id"]: r for r in pages.page_reports(df).collect()}
    assert len(found) == len(rows)
    ways = dict(zip(BAD, ((found[i]["method"], found[i]["rows"]) for i in range(len(BAD))), strict=True))
    assert ways == {"long field": ("text", 1), "marked section": ("list", 1), "quotes": ("text", 1), "unclosed section": ("table", 1), "doctype": (None, 0), "deep list": ("list", 29_999)}
    assert found[0]["fields"] == 2 and found[2]["fields"] == 150_001 and all(found[i]["reason"] for i in (50, 51, 52, 4)) and all(found[p]["method"] == "table" for p, _ in good)
    assert pages.read_pages(df.where("page_id = 0")).where("field = 'k'").first()["value"] == "x" * 200_000


def test_any_trouble_is_a_reason(spark, monkeypatch):
    def fail(*_):
        raise RecursionError("too deep")

    monkeypatch.setattr(pages, "_from_table", fail)
    assert pages.extract("<table><tr><td>a</td></tr></table>") == ([], "RecursionError: too deep")
    assert pages.extract("<li><b>a</b><i>b</i>")[0] == [("list", 0, "a", "b")]
    monkeypatch.setattr(pages._Page, "handle_starttag", fail)
    assert pages.extract("k,v\n1,2\n<p>3,4")[1] is None and pages.extract("<p>")[1].startswith("not read to its end: RecursionError")


def test_quoted_line_breaks_in_pages(spark):
    df = spark.createDataFrame([(1, '<pre>k,v\n"a\nb","1,2"\nc,3\n</pre>')], "page_id long, html string")
    assert sorted(tuple(r)[2:] for r in pages.html_text_csv(df).collect()) == [(0, "k", "a\nb"), (0, "v", "1,2"), (1, "k", "c"), (1, "v", "3")]


def test_large_pages_are_dealt_apart(spark):
    """A page of 50 MB goes to a task of its own, and the small ones stay where they are."""
    small = spark.range(0, 40, 1, 2).selectExpr("id as page_id", "'<li><b>a</b><i>b</i></li>' as html")
    large = spark.range(100, 103, 1, 1).selectExpr("id as page_id", "concat('<pre>k,v\\n', repeat('some text,1\\n', 1400000), '</pre>') as html")
    big = spark.range(200, 201, 1, 1).selectExpr("id as page_id", "concat('<ul>', repeat('<li><b>field</b><i>value of it</i></li>', 1300000), '</ul>') as html")
    df = small.union(big)
    dealt = pages._dealt(df.select("page_id", "html").union(large))
    where = {r["page_id"]: r["p"] for r in dealt.select("page_id", F.spark_partition_id().alias("p")).collect()}
    apart = [where[i] for i in (100, 101, 102, 200)]
    assert len(set(apart)) >= 3 and not set(apart) & {where[i] for i in range(40)}
    counts = {r["page_id"]: r["rows"] for r in pages.page_reports(df).collect()}
    assert counts == {i: 1 for i in range(40)} | {200: 1_300_000}


def test_quoted_line_breaks_in_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text('k;v\n"a\nb";1\n"say ""x""";2\n')
    (tmp_path / "t.csv").write_text('k,v\n"a\nb",1\n"say ""x""",2\n')
    (tmp_path / "plain.csv").write_text('k,v\n"a,b",1\n"say ""x""",2\n')
    want = [("a\nb", 1), ('say "x"', 2)]
    assert [tuple(r) for r in tables.read_delimited(spark, str(tmp_path / "t.txt")).collect()] == want
    assert [tuple(r) for r in tables.read_table_csv(spark, str(tmp_path / "t.csv")).collect()] == want
    assert [tuple(r) for r in tables.read_table_csv(spark, str(tmp_path / "plain.csv")).collect()] == [("a,b", 1), ('say "x"', 2)]
    assert tables._has_quoted_breaks(spark, str(tmp_path / "t.csv")) and not tables._has_quoted_breaks(spark, str(tmp_path / "plain.csv"))


def test_cells_leave_the_worker_in_pieces(monkeypatch):
    monkeypatch.setattr(pages, "MOST_CELLS", 100)
    batch = pd.DataFrame({"page_id": [1, 2, 3], "html": ["<li><b>a</b><i>b</i></li>" * 250, "", "<li><b>a</b><i>b</i></li>"]})
    out = list(pages._run(iter([batch])))
    assert [len(x) for x in out] == [100, 100, 50, 2] and list(out[-1]["page_id"]) == [2, 3]
