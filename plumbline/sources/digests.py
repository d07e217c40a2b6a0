"""Digests of rows and of whole tables, which tell apart what a plain hash passes over."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import col

#: The finest level of buckets.  Levels are powers of two, so that a coarser level's buckets are sums of a finer one's.
MOST_BUCKETS = 4096


def encoded(value: Column, kind: T.DataType) -> Column:
    """The value in a form whose hash depends on everything in it: a mark for null beside each value, and the length of each
    array.  (Spark's hashes pass over nulls, so (5, null) and (null, 5) would agree, and don't take maps.)"""
    missing = value.isNull()
    if isinstance(kind, T.ArrayType):
        return F.struct(missing, F.size(value), F.transform(value, lambda x: encoded(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        return F.struct(missing, F.size(value), F.transform(keys, lambda k: F.struct(encoded(k, kind.keyType), encoded(F.element_at(value, k), kind.valueType))))
    if isinstance(kind, T.StructType):
        return F.struct(missing, *[encoded(value.getField(f.name), f.dataType) for f in kind.fields])
    return F.struct(missing, value)


def row_digests(df: DataFrame) -> tuple[Column, Column]:
    """Two independent 64-bit digests of a row."""
    cells = [encoded(col(f.name), f.dataType) for f in df.schema.fields]
    return F.xxhash64(F.lit(1), *cells), F.xxhash64(F.lit(2), *cells)


def _shape(kind: T.DataType) -> object:
    """A type without what reading a file back changes: whether values may be null."""
    if isinstance(kind, T.ArrayType):
        return ["array", _shape(kind.elementType)]
    if isinstance(kind, T.MapType):
        return ["map", _shape(kind.keyType), _shape(kind.valueType)]
    if isinstance(kind, T.StructType):
        return [[f.name, _shape(f.dataType)] for f in kind.fields]
    return kind.simpleString()


def columns_digest(schema: T.StructType) -> str:
    """A digest of the columns' names and types, in order."""
    return hashlib.sha256(json.dumps(_shape(schema)).encode()).hexdigest()[:32]


def _sums(first: Column, second: Column, n: Column) -> list[Column]:
    return [n.alias("rows"), F.coalesce(F.sum(first.cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)").alias("hash_sum"), F.coalesce(F.bit_xor(second), F.lit(0)).cast("long").alias("hash_xor")]


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, hash_sum, hash_xor, columns_hash): equal for equal rows in any order under equal columns; one pass, no shuffle
    of rows.  Sums and xors of row digests are a multiset's hash: they add up over any parts of a table."""
    digests = df.select(F.struct(*row_digests(df)).alias("h"))
    return digests.agg(*_sums(F.col("h.col1"), F.col("h.col2"), F.count(F.lit(1)))).withColumn("columns_hash", F.lit(columns_digest(df.schema)))


def bucket_digests(df: DataFrame, buckets: int = MOST_BUCKETS) -> DataFrame:
    """(bucket, rows, hash_sum, hash_xor) of the rows whose first digest falls into each bucket; empty ones are left out."""
    digests = df.select(F.struct(*row_digests(df)).alias("h"))
    bucket = F.pmod("h.col1", F.lit(buckets)).cast("int").alias("bucket")
    return digests.groupBy(bucket).agg(*_sums(F.col("h.col1"), F.col("h.col2"), F.count(F.lit(1))))


def coarser(digests: DataFrame, buckets: int) -> DataFrame:
    """The same at a coarser level."""
    return digests.groupBy(F.pmod("bucket", F.lit(buckets)).cast("int").alias("bucket")).agg(*_sums(F.col("hash_sum"), F.col("hash_xor"), F.sum("rows")))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket) where two tables of digests of one level differ."""
    names = ["rows", "hash_sum", "hash_xor"]
    met = a.join(b.select("bucket", *[F.col(c).alias(f"other_{c}") for c in names]), "bucket", "full")
    return met.where(~reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"other_{c}")) for c in names])).select("bucket")
