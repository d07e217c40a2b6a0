"""Tagged versions of a table: written, listed, read back, fingerprinted, compared.

A version's rows lie in folders by hash bucket, beside a table of each bucket's digest, so that two versions are compared by
digests first and only the buckets that differ are read.  Which versions there are says a log of numbered entries
(commitlog.py), written after the rows: what fails in between leaves the versions as they were.
"""

from __future__ import annotations

import json
import uuid
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import quoted
from plumbline.sources import commitlog
from plumbline.sources.digests import MOST_BUCKETS, bucket_digests, coarser, columns_digest, differing, fingerprint, row_digests

__all__ = ["default_tag", "diff_summary", "diff_tags", "diff_versions", "fingerprint", "list_versions", "manifest", "read_version", "status", "version_info", "write_version"]

ENTRY = "number long, tag string, created_at timestamp, rows long, columns array<string>, fingerprint string, message string, folder string, buckets int, schema string"
DIGESTS = "bucket int, rows long, hash_sum decimal(38,0), hash_xor long"
#: A version has about so many rows in a bucket, from 16 buckets to MOST_BUCKETS.
BUCKET_ROWS = 250_000


def _mark(row: Row, schema: T.StructType) -> str:
    return f"{row['rows']}-{row['hash_sum']}-{row['hash_xor']}-{columns_digest(schema)}"


def default_tag(day: date | None = None) -> str:
    return f"v1.0-anonymized-{day or date.today():%Y%m%d}"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The entry of each tag with the highest number."""
    rows = commitlog.entries(spark, f"{root}/log", ENTRY)
    return rows.groupBy("tag").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "tag"]), "number").alias("e")).select("tag", "e.*")


def _bucket_column(columns: list[str]) -> str:
    """A name that no column has, in upper or lower case."""
    taken, name = {c.lower() for c in columns}, "_bucket"
    while name in taken:
        name = f"_{name}"
    return name


def write_version(df: DataFrame, root: str, tag: str | None = None, message: str = "") -> str:
    """Save df under a tag, which an existing one gives up.  Content that some version holds already isn't written again.

    Rows are dealt by bucket once; AQE splits a bucket that equal rows make large into several files.  Of writers at a time
    each gets its own entry, and of the same tag the later number wins.
    """
    spark = df.sparkSession
    tag = tag or default_tag()
    fine = spark.createDataFrame(bucket_digests(df).collect(), DIGESTS)  # MOST_BUCKETS rows at the most
    whole = fine.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("hash_sum"), F.lit(0)).cast("decimal(38,0)").alias("hash_sum"), F.coalesce(F.bit_xor("hash_xor"), F.lit(0)).alias("hash_xor")).first()
    mark = _mark(whole, df.schema)
    same = commitlog.entries(spark, f"{root}/log", ENTRY).where(F.col("fingerprint") == mark).orderBy("number").select("folder", "buckets").first()
    now = datetime.now(timezone.utc)
    if same is None:
        folder = f"version={tag}-{now:%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        buckets = min(MOST_BUCKETS, max(16, 1 << max(0, -(-whole["rows"] // BUCKET_ROWS) - 1).bit_length()))
        name = _bucket_column(df.columns)
        dealt = df.withColumn(name, F.pmod(row_digests(df)[0], F.lit(buckets)).cast("int"))
        dealt.hint("rebalance", name).write.partitionBy(name).parquet(f"{root}/{folder}/rows")
        coarser(fine, buckets).coalesce(1).write.parquet(f"{root}/{folder}/digests")
    else:
        folder, buckets = same
    entry = {"tag": tag, "created_at": now.isoformat(), "rows": whole["rows"], "columns": df.columns, "fingerprint": mark, "message": message, "folder": folder, "buckets": buckets, "schema": df.schema.json()}
    commitlog.append(spark, f"{root}/log", entry)
    return tag


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    return manifest(spark, root).select("tag").distinct().orderBy(F.desc("tag"))


def version_info(spark: SparkSession, root: str, tag: str) -> DataFrame:
    return manifest(spark, root).where(F.col("tag") == tag)


def _entry(spark: SparkSession, root: str, tag: str) -> Row:
    found = version_info(spark, root, tag).first()
    if found is None:
        raise KeyError(tag)
    return found


def _rows(spark: SparkSession, root: str, entry: Row, level: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The version's rows, or those of some buckets of a coarser level, whose folders alone are read."""
    schema = T.StructType.fromJson(json.loads(entry["schema"]))
    name = _bucket_column(entry["columns"])
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(name, T.IntegerType())])).parquet(f"{root}/{entry['folder']}/rows")
    if only is not None:
        rows = rows.where(F.pmod(name, F.lit(level)).isin(only))
    return rows.select(*[quoted(c) for c in entry["columns"]])


def read_version(spark: SparkSession, root: str, tag: str) -> DataFrame:
    return _rows(spark, root, _entry(spark, root, tag))


def status(df: DataFrame, root: str, tag: str) -> DataFrame:
    """(tag, changed): whether df differs from the version's content: its rows, its columns' names, types or order."""
    mark = _mark(fingerprint(df).first(), df.schema)
    return version_info(df.sparkSession, root, tag).select("tag", (F.col("fingerprint") != mark).alias("changed"))


def diff_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(*columns, change, copies): rows that only one side has, or has more often.  Both sides are counted by row first."""
    if old.columns != new.columns:
        raise ValueError("the versions' columns differ")
    keys = [quoted(c) for c in old.columns]
    sides = old.withColumn("_side", F.lit(-1)).unionByName(new.withColumn("_side", F.lit(1)))
    counts = sides.groupBy(*keys).agg(F.sum("_side").alias("_n")).where(F.col("_n") != 0)
    return counts.select(*keys, F.when(F.col("_n") > 0, "added").otherwise("removed").alias("change"), F.abs("_n").alias("copies"))


def changed_buckets(spark: SparkSession, root: str, old: Row, new: Row) -> tuple[int, list[int]]:
    """(level, buckets) in which two versions differ, by their saved digests; the coarser level of the two."""
    level = min(old["buckets"], new["buckets"])
    sides = [coarser(spark.read.schema(DIGESTS).parquet(f"{root}/{e['folder']}/digests"), level) for e in (old, new)]
    return level, sorted(r["bucket"] for r in differing(*sides).collect())


def diff_tags(spark: SparkSession, root: str, old: str, new: str) -> DataFrame:
    """What diff_versions() gives for two saved versions; only buckets whose digests differ are read and shuffled."""
    a, b = _entry(spark, root, old), _entry(spark, root, new)
    schemas = [T.StructType.fromJson(json.loads(e["schema"])) for e in (a, b)]
    if columns_digest(schemas[0]) != columns_digest(schemas[1]):
        raise ValueError("the versions' columns differ")
    level, only = changed_buckets(spark, root, a, b) if a["folder"] != b["folder"] else (1, [])
    if not only:
        return spark.createDataFrame([], T.StructType([*schemas[0].fields, T.StructField("change", T.StringType()), T.StructField("copies", T.LongType())]))
    return diff_versions(_rows(spark, root, a, level, only), _rows(spark, root, b, level, only))


def diff_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, rows); nothing is shuffled when the fingerprints agree."""
    if fingerprint(old).first() == fingerprint(new).first():
        return old.sparkSession.createDataFrame([], T.StructType([T.StructField("change", T.StringType()), T.StructField("rows", T.LongType())]))
    return diff_versions(old, new).groupBy("change").agg(F.sum("copies").alias("rows"))
