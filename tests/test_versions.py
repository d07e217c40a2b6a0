"""Marks of tables, the commit log, and comparing versions by buckets."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from plumbline.sources import commitlog, digests, versions


def mark(df):
    return tuple(digests.fingerprint(df).first())


def test_marks_tell_tables_apart(spark):
    make = lambda rows, schema="a int, b int": spark.createDataFrame(rows, schema)
    tables = [
        make([(5, None)]), make([(None, 5)]), make([(5, 5)]), make([(None, None)]), make([]), make([(5, None)] * 2), make([(5, None)] * 3), make([(5, None), (None, 5)]),
        make([(5, None)], "a int, c int"), make([(5, None)], "b int, a int"), make([(5, None)], "a long, b int"), make([(5, None)], "a int, b string"),
        make([("a", "bc")], "a string, b string"), make([("ab", "c")], "a string, b string"), make([("abc", "")], "a string, b string"), make([("abc", None)], "a string, b string"),
        make([([1, None],)], "a array<int>"), make([([None, 1],)], "a array<int>"), make([([1],)], "a array<int>"), make([([],)], "a array<int>"), make([(None,)], "a array<int>"), make([([None],)], "a array<int>"),
        make([([[1], []],)], "a array<array<int>>"), make([([[], [1]],)], "a array<array<int>>"), make([({"x": None, "y": 1},)], "a map<string,int>"), make([({"x": 1, "y": None},)], "a map<string,int>"),
        make([((1, None),)], "a struct<p:int,q:int>"), make([((None, 1),)], "a struct<p:int,q:int>"), make([((None, None),)], "a struct<p:int,q:int>"), make([(None,)], "a struct<p:int,q:int>"), make([((1, None),)], "a struct<p:int,r:int>"),
    ]
    marks = [mark(t) for t in tables]
    assert len(set(marks)) == len(marks)


def test_marks_do_not_depend_on_order(spark, tmp_path):
    df = spark.range(500).selectExpr("id % 7 as a", "if(id % 3 = 0, null, cast(id as string)) as b", "map('x', id, 'y', null) as c", "array(id, null) as d")
    df.write.parquet(str(tmp_path / "t"))
    assert mark(df) == mark(df.repartition(5, "b")) == mark(df.orderBy(F.desc("b"))) == mark(spark.read.parquet(str(tmp_path / "t")))
    fine = digests.bucket_digests(df)
    assert sorted(map(tuple, digests.coarser(fine, 16).collect())) == sorted(map(tuple, digests.bucket_digests(df, 16).collect()))
    assert tuple(digests.coarser(fine, 1).first())[1:] == mark(df)[:3]


def test_versions_keep_nulls_and_names(spark, tmp_path):
    root = str(tmp_path)
    one, two = (spark.createDataFrame([r], "a int, b int") for r in ((5, None), (None, 5)))
    named = one.withColumnRenamed("b", "c")
    for tag, df in (("v1", one), ("v2", two), ("v3", named), ("v4", one.select("b", "a")), ("v5", one.limit(0))):
        versions.write_version(df, root, tag)
    read = {t: versions.read_version(spark, root, t) for t in ("v1", "v2", "v3", "v4", "v5")}
    assert [tuple(read[t].first()) for t in ("v1", "v2", "v3", "v4")] == [(5, None), (None, 5), (5, None), (None, 5)]
    assert read["v3"].columns == ["a", "c"] and read["v4"].columns == ["b", "a"] and read["v5"].collect() == [] and read["v5"].columns == ["a", "b"]
    assert versions.status(two, root, "v1").first()["changed"] and not versions.status(two, root, "v2").first()["changed"]
    assert versions.status(named, root, "v1").first()["changed"]
    assert sorted(map(tuple, versions.diff_summary(one, two).collect())) == [("added", 1), ("removed", 1)]
    assert sorted(map(tuple, versions.diff_tags(spark, root, "v1", "v2").collect()), key=repr) == [(5, None, "removed", 1), (None, 5, "added", 1)]
    with pytest.raises(ValueError):
        versions.diff_tags(spark, root, "v1", "v3")


def test_clashing_and_partition_like_columns(spark, tmp_path):
    df = spark.range(30).selectExpr("id as `_bucket`", "id % 3 as `x.y`", "cast(id as string) as `__BUCKET`", "current_date() as day")
    versions.write_version(df, str(tmp_path), "v")
    back = versions.read_version(spark, str(tmp_path), "v")
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_only_changed_buckets_are_read(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    monkeypatch.setattr(versions, "BUCKET_ROWS", 100)
    old = spark.range(20_000).selectExpr("id", "if(id % 5 = 0, null, id * 3) as v", "'text' as t")
    new = old.withColumn("v", F.expr("if(id = 77, -1, v)")).where("id <> 4711")
    versions.write_version(old, root, "old")
    versions.write_version(new, root, "new")
    monkeypatch.setattr(versions, "BUCKET_ROWS", 2000)
    versions.write_version(new.union(new.where("id = 1")), root, "more")  # another level
    a, b, c = (versions.version_info(spark, root, t).first() for t in ("old", "new", "more"))
    assert (a["buckets"], c["buckets"]) == (256, 16)
    level, only = versions.changed_buckets(spark, root, a, b)
    assert level == 256 and 1 <= len(only) <= 3
    for x, y, n in (("old", "new", 3), ("new", "more", 1)):
        found = versions.diff_tags(spark, root, x, y)
        want = versions.diff_versions(versions.read_version(spark, root, x), versions.read_version(spark, root, y))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == n
    # the scans prune all but a hundredth of the rows, so no others can shuffle
    scanned = versions._rows(spark, root, a, level, only).count() + versions._rows(spark, root, b, level, only).count()
    assert scanned < 40_000 * 3 / 256 * 1.5
    plan = versions.diff_tags(spark, root, "old", "new")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("PartitionFilters: [pmod(_bucket") == 2
    assert versions.diff_tags(spark, root, "old", "old").count() == 0


@pytest.mark.parametrize("linked", [True, False])
def test_an_entry_is_created_once(spark, tmp_path, linked):
    folder = str(tmp_path / "log")
    assert commitlog.numbers(spark, folder) == []
    assert commitlog.create(spark, folder, "00000000000000000001.json", "{}", linked)
    assert not commitlog.create(spark, folder, "00000000000000000001.json", "[]", linked)
    assert (tmp_path / "log/00000000000000000001.json").read_text() == "{}" and commitlog.numbers(spark, folder) == [1]
    assert not [p for p in (tmp_path / "log").iterdir() if p.suffix != ".json" and not p.name.endswith(".crc")]


def test_many_writers(spark, tmp_path):
    folder = str(tmp_path / "log")
    done = []
    threads = [threading.Thread(target=lambda k=k: done.extend(commitlog.append(spark, folder, {"who": k}) for _ in range(5))) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(done) == list(range(1, 31)) == commitlog.numbers(spark, folder)
    rows = commitlog.entries(spark, folder, "number long, who int")
    assert rows.count() == 30 and rows.groupBy("who").count().where("count = 5").count() == 6


def test_two_writers_of_versions(spark, tmp_path):
    root = str(tmp_path)
    tables = [spark.range(k, k + 40) for k in range(4)]
    threads = [threading.Thread(target=versions.write_version, args=(t, root, f"v{k % 2}")) for k, t in enumerate(tables)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    entries = {r["number"]: r for r in commitlog.entries(spark, f"{root}/log", versions.ENTRY).collect()}
    assert sorted(entries) == [1, 2, 3, 4]
    for tag in ("v0", "v1"):
        last = max(n for n, r in entries.items() if r["tag"] == tag)
        assert versions.version_info(spark, root, tag).first()["number"] == last and versions.read_version(spark, root, tag).count() == 40


def test_equal_times_and_crashes(spark, tmp_path, monkeypatch):
    """Of two entries of one tag and time the later number wins; rows without an entry are no version."""
    root = str(tmp_path)
    versions.write_version(spark.range(3), root, "v")
    entry = json.loads((tmp_path / "log/00000000000000000001.json").read_text())
    commitlog.append(spark, f"{root}/log", entry | {"message": "again"})
    assert versions.version_info(spark, root, "v").first()["message"] == "again"

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(commitlog, "append", crash)
    with pytest.raises(RuntimeError):
        versions.write_version(spark.range(9), root, "v")
    assert versions.read_version(spark, root, "v").count() == 3
