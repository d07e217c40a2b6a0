"""Stages that run only when something changed, and duplicates by digests first."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plumbline.functions.members import may_be_among
from plumbline.operators.kanon import AnonymizeConfig
from plumbline.operators.quality import QualityConfig, duplicate_stats
from plumbline.plans import jobs, stages
from plumbline.sources import commitlog

NAMES = ["collect", "anonymize", "verify", "transform"]


def test_only_what_changed_runs(spark, tmp_path, monkeypatch):
    path, out = tmp_path / "in.csv", str(tmp_path / "out")
    lines = ["age,city,score"] + [f"{30 + i % 3},{'ab'[i % 2]},{i}" for i in range(24)]
    path.write_text("\n".join(lines) + "\n")
    config = jobs.JobConfig(AnonymizeConfig(k=2, strategy="drop"), output=out)

    def outcomes(config=config):
        found = jobs.reproduce(spark, str(path), config)
        return [found.get(n) for n in NAMES]

    ran, skipped, failed = stages.RAN, stages.SKIPPED, stages.FAILED
    assert outcomes() == [ran] * 4
    entries = commitlog.numbers(spark, f"{out}/stages")
    with monkeypatch.context() as m:
        m.setattr(jobs, "source", lambda *_: pytest.fail("a stage read its input though no file changed"))
        assert outcomes() == [skipped] * 4
    assert commitlog.numbers(spark, f"{out}/stages") == entries
    os.utime(path, (1, 1))  # another time, the same rows
    assert outcomes() == [skipped] * 4 and len(commitlog.numbers(spark, f"{out}/stages")) == len(entries) + 1
    other = replace(config, quality=QualityConfig(missing_threshold=0.25))
    assert outcomes(other) == [skipped, skipped, ran, skipped]
    spark.range(3).write.mode("overwrite").parquet(f"{out}/transformed")  # an output that isn't the stage's own
    assert outcomes(other) == [skipped, skipped, skipped, ran]
    assert spark.read.parquet(f"{out}/transformed").count() == 24
    path.write_text("\n".join([*lines, "31,b,99", "31,b,7"]) + "\n")
    assert outcomes(other) == [ran] * 4
    path.write_text("\n".join(["age,city,score", *["31,,"] * 9, *lines[1:9]]) + "\n")  # the gate rejects it, each time anew
    assert outcomes(other) == [ran, ran, failed, None]
    assert outcomes(other) == [skipped, skipped, failed, None]


def test_files_mark(spark, tmp_path):
    assert stages.files_mark(spark, str(tmp_path / "none")) is None
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x").write_text("1")
    one = stages.files_mark(spark, str(tmp_path / "a"))
    assert stages.files_mark(spark, str(tmp_path / "a")) == one
    (tmp_path / "a/b").mkdir()
    (tmp_path / "a/b/y").write_text("2")
    assert stages.files_mark(spark, str(tmp_path / "a")) != one


def test_duplicates_by_digests(spark):
    rows = [(1, None, float("nan"), "x"), (1, None, float("nan"), "x"), (None, 1, float("nan"), "x"), (2, 2, 0.0, None), (2, 2, -0.0, None), (3, 3, 1.0, ""), (2, 2, 0.0, None)]
    df = spark.createDataFrame(rows, "a long, `b.c` long, d double, _n string").repartition(3)
    for digest in ({}, {"digest": lambda df: F.lit(1).cast("long")}, {"digest": lambda df: F.pmod(F.xxhash64("a"), F.lit(2))}):  # collisions change nothing
        assert tuple(duplicate_stats(df, **digest).first())[:2] == (7, 3)
        assert tuple(duplicate_stats(df.limit(0), **digest).first()) == (0, 0, 0.0)
    assert tuple(duplicate_stats(df.select("a").dropna().distinct()).first()) == (3, 0, 0.0)


def test_few_rows_pass_a_bitmap(spark):
    rows = spark.range(200_000).withColumn("x.y", F.lit(1))
    keys = spark.range(0, 200_000, 100).select(F.col("id").alias("key"))
    passed = {r["id"] for r in may_be_among(rows, F.col("id"), keys).collect()}
    assert {*range(0, 200_000, 100)} <= passed and len(passed) < 2000 + 200_000 / 16
    assert may_be_among(rows, F.col("id"), keys.limit(0)).count() == 0


def test_unique_wide_rows_shuffle_their_digests_alone(spark, tmp_path):
    wide = spark.range(40_000).select("id", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 256).alias(f"c{i}") for i in range(8)])
    wide.write.parquet(str(tmp_path / "wide"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def written_bytes():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))

    before = written_bytes()
    assert tuple(duplicate_stats(spark.read.parquet(str(tmp_path / "wide"))).first())[:2] == (40_000, 0)
    assert written_bytes() - before < 40 * 40_000
