import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators.kanon import AnonymizeConfig
from plumbline.operators.quality import QualityConfig
from plumbline.plans import jobs
from plumbline.sources import pages, tables, versions
from plumbline.sources.delimited import find_separator


def test_types_are_inferred(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c,d,e\n1,1.5,true,NA,?\n2,,False,4,"x, y"\n')
    df = tables.read_table_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "double", "e": "string"}
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, True, None, "?"), (2, None, False, 4.0, "x, y")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_table_csv(spark, str(tmp_path / "none.csv"))


@pytest.mark.parametrize(("body", "columns"), [("a;b\n1;2\n", ["a", "b"]), ("a\tb\n1\t2\n", ["a", "b"]), ("a|b\n1|2\n", ["a", "b"]), ("abc\n1\n", ["abc"])])
def test_separators(spark, tmp_path, body, columns):
    (tmp_path / "t.DATA").write_text(body)
    assert tables.read_delimited(spark, str(tmp_path / "t.DATA")).columns == columns


def test_kinds_of_sources(spark):
    urls = ["data/x.csv", " example.org/a", "https://kaggle.com/datasets/o/d?x=1", "http://e.org/x.CSV", "https://", "https://e.org/x.html", "e.org/y.DATA"]
    df = tables.classify_sources(spark.createDataFrame([(u,) for u in urls], "url string"))
    assert [r["kind"] for r in df.collect()] == ["local_csv", "html", "kaggle", "raw_file", "invalid", "html", "raw_file"]
    assert [r[0] for r in df.select(tables.dataset_handle(F.col("url"))).collect()][2] == "o/d" and df.select(tables.dataset_handle(F.col("url"))).first()[0] is None


def test_first_csv_and_quotes(spark, tmp_path):
    (tmp_path / "z").mkdir()
    (tmp_path / "a").mkdir()
    (tmp_path / "z/1.csv").write_text("z\n1\n")
    (tmp_path / "a/2.csv").write_text("a\n1\n")
    assert tables.read_first_csv(spark, str(tmp_path)).columns == ["a"]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        tables.read_first_csv(spark, str(tmp_path / "none"))
    tables.write_csv_quoted(spark.createDataFrame([(1, 'say "x"')], "a int, b string").coalesce(1), str(tmp_path / "q"))
    text = next((tmp_path / "q").glob("part-*")).read_text()
    assert text == '"a","b"\n"1","say ""x"""\n'


PAGES = [
    (1, "<table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr><tr><td>b</td></tr></table><table><tr><td>z</td></tr></table>"),
    (2, "<html><script>var x = 1, y;\n</script><pre>k,v\na,1\nb\n</pre></html>"),
    (3, "<ul><li><b>field</b><span>value</span></li><li>alone</li><li>x|y|z</li></ul>"),
    (4, "<p>broken <table><tr"),
    (5, None),
    (6, "k,v\na,1,2\n"),
]


def test_pages(spark):
    rows = pages.extract_pages(spark.createDataFrame(PAGES, "page_id long, html string")).collect()
    assert sorted(tuple(r) for r in rows if r["page_id"] == 1) == [(1, "table", 0, "k", "a"), (1, "table", 0, "v", "1"), (1, "table", 1, "k", "b"), (1, "table", 1, "v", None)]
    assert [tuple(r)[1:] for r in rows if r["page_id"] == 2] == [("text", 0, "k", "a"), ("text", 0, "v", "1"), ("text", 1, "k", "b"), ("text", 1, "v", None)]
    assert [tuple(r)[1:] for r in rows if r["page_id"] == 3] == [("list", 0, "field", "value"), ("list", 1, "x", "y")]
    assert not [r for r in rows if r["page_id"] > 3]


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    one, two = spark.range(10).withColumn("v", F.lit("x")), spark.range(11).withColumn("v", F.lit("x"))
    assert versions.manifest(spark, root).count() == 0
    for df, tag in ((one, "a"), (two, "b"), (two, "a"), (one.repartition(3), "c")):
        versions.write_version(df, root, tag)
    assert [r[0] for r in versions.list_versions(spark, root).collect()] == ["c", "b", "a"]
    assert versions.read_version(spark, root, "a").count() == 11 and versions.read_version(spark, root, "c").count() == 10
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("version=")]) == 2
    assert [versions.status(one, root, t).first()["changed"] for t in "abc"] == [True, True, False]
    with pytest.raises(KeyError):
        versions.read_version(spark, root, "z")


def test_differences_count_copies(spark):
    old = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    new = spark.createDataFrame([(1, None), (3, "y"), (2, "x")], "a int, b string")
    assert sorted(tuple(r) for r in versions.diff_versions(old, new).collect()) == [(1, None, "removed", 1), (3, "y", "added", 1)]
    assert versions.diff_summary(old, old.repartition(3)).count() == 0


def test_job(spark, tmp_path):
    rows = [(i, f"name{i}", 20 + i % 5, "FM"[i % 2], float(i % 13), f"d{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, name string, age int, gender string, score double, remark string")
    config = jobs.JobConfig(AnonymizeConfig(k=3, strategy="hash", key="k"), output=str(tmp_path / "out"), version="v1")
    done = jobs.run_pipeline(df, config)
    assert done.success and done.steps_completed == ["collect", "anonymize", "verify", "transform", "version"] and done.version_tag == "v1"
    holes = df.withColumn("score", F.lit(None).cast("double"))
    stopped = jobs.run_pipeline(holes, jobs.JobConfig(AnonymizeConfig(k=3, strategy="drop")))
    assert not stopped.success and stopped.steps_completed == ["collect", "anonymize", "verify"] and stopped.table is None
    assert jobs.run_pipeline(df.limit(0)).error
    df.write.option("header", True).csv(str(tmp_path / "in.csv"))
    argv = ["--path", str(tmp_path / "in.csv"), "--output", str(tmp_path / "o"), "--strategy", "hash", "--key", "k"]
    assert [jobs.main([*argv, "--stage", s]) for s in ("anonymize", "verify", "transform", "all")] == [0, 0, 0, 0]
    assert QualityConfig().missing_threshold == jobs.arguments(argv).missing_threshold


def plain_rows(html):
    """Rows of a page without tables, by patterns: its text if that is delimited, else its items with two texts."""
    import csv as csv_module
    import html as html_module

    bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", html)
    text = html_module.unescape(re.sub(r"(?s)<!--.*?-->|<[^>]*>", "", bare)).strip()
    if "\n" in text and ("," in text or "\t" in text):
        lines = [x for x in text.splitlines() if x.strip()]
        found = list(csv_module.reader(lines, delimiter=find_separator(lines[0])))
        if all(len(r) <= len(found[0]) for r in found[1:]):
            return [("text", i, n, (r[j] or None) if j < len(r) else None) for i, r in enumerate(found[1:]) for j, n in enumerate(found[0])]
    return []


def test_web_pages_by_a_plain_reading(spark):
    from plumbline.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    want = [(r["page_id"], *cell) for r in spark.read.parquet(f"{folder}/pages.parquet").collect() for cell in plain_rows(r["html"])]
    got = [tuple(r) for r in QUERIES["extract_web_pages"](spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_collect_is_a_stage(spark, tmp_path):
    from plumbline.plans.jobs import main

    (tmp_path / "in.data").write_text("a;b\n1;x\n2;y\n3;y\n")
    assert main(["--stage", "collect", "--path", str(tmp_path / "in.data"), "--output", str(tmp_path / "out")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out/raw.csv")).count() == 3
    assert main(["--stage", "anonymize", "--k", "1", "--path", str(tmp_path / "out/raw.csv"), "--output", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out/anonymized")).count() == 3
    (tmp_path / "none.data").write_text("a;b\n")
    assert main(["--stage", "collect", "--path", str(tmp_path / "none.data"), "--output", str(tmp_path / "out2")]) == 1
