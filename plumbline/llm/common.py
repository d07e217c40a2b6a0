"""What several operators of this folder share: reading a table, durable intermediate tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.shared import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and no executor's loss repeats the work."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Rows of a range in in_order(), if they make more ranges than the session has shuffle partitions.
RANGE_ROWS = 1_000_000


def in_order(rows: DataFrame, order: list[Column], label: str) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """The rows dealt to ranges of an order: with _range and _at, the place in it from 0, and for each range the number of
    rows before it and in it.

    Rows that tie are dealt to several ranges as well, by a number of their own, so no key is one task's.  `rows` should
    be a written table, as it is read twice.  The driver sees one count a range.
    """
    tie = F.monotonically_increasing_id()
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    dealt = rows.withColumn("_tie", tie).repartitionByRange(ranges, *order, "_tie").sortWithinPartitions(*order, "_tie")
    dealt = dealt.withColumn("_mark", F.monotonically_increasing_id()).withColumns({"_range": F.shiftright("_mark", 33).cast("int"), "_at": F.col("_mark").bitwiseAND((1 << 33) - 1)})
    dealt = durable(dealt.drop("_tie", "_mark"), label)
    starts, total = {}, 0
    for r in sorted(dealt.groupBy("_range").count().collect(), key=lambda r: r["_range"]):
        starts[r["_range"]] = total, r["count"]
        total += r["count"]
    return dealt, starts


#: A member filter is sent to every executor, in blocks of 1024 longs; it has at most so many bits (16 MB).
MEMBER_BITS, BLOCK_BITS = 1 << 27, 1 << 16


def spots_of(packed: Column) -> Column:
    """The two positions that an int holds."""
    return F.array(packed.bitwiseAND(BLOCK_BITS - 1), F.shiftrightunsigned(packed, 16))


def bit_at(words: str, spot: str) -> str:
    return f"(shiftright(element_at({words}, shiftright({spot}, 6) + 1), {spot} & 63) & 1L) = 1L"


def with_maybe(rows: DataFrame, key: Column, keys: DataFrame, most: int = MEMBER_BITS) -> DataFrame:
    """rows with a column _maybe: true where the long `key` is one of `keys` (column key, distinct), and of few others.

    A Bloom filter of two positions in one block and about ten bits a key.  Beyond `most` bits more and more others pass
    as well, so it may decide which rows take the longer way and never what becomes of them.
    """
    keys = durable(keys, "keys")
    blocks = max(1, min(most, 1 << max(0, keys.count() * 10 - 1).bit_length()) // BLOCK_BITS)
    packed = keys.select(F.pmod("key", F.lit(blocks)).alias("block"), F.hash("key").alias("spots")).groupBy("block").agg(F.collect_list("spots").alias("spots"))
    hits = F.flatten(F.transform("spots", lambda x: F.transform(spots_of(x), lambda spot: F.struct(F.shiftright(spot, 6).alias("word"), spot.bitwiseAND(63).alias("bit")))))
    none = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda word: F.struct(word.alias("word"), F.lit(-1).alias("bit")))  # so that no word is missing
    each = packed.select("block", F.explode(F.concat(hits, none)).alias("x"))
    words = each.groupBy("block", "x.word").agg(F.bit_or(F.expr("if(x.bit < 0, 0L, shiftleft(1L, x.bit))")).alias("mask"))
    table = words.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("words")).select(F.col("block").alias("_block"), F.col("words.mask").alias("_words"))
    table = F.broadcast(durable(table, "members"))
    spotted = rows.withColumn("_key", key).withColumns({"_its": F.pmod("_key", F.lit(blocks)), "_spots": spots_of(F.hash("_key"))})
    met = spotted.join(table, F.col("_its") == F.col("_block"), "left")
    maybe = F.coalesce(F.expr(f"{bit_at('_words', '_spots[0]')} and {bit_at('_words', '_spots[1]')}"), F.lit(False))
    return met.select(*rows.columns, maybe.alias("_maybe"))


def without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """The rows that `gone` (columns `on`, null equal to null) doesn't name.  Only rows that may be named shuffle."""
    key = F.xxhash64(*on)
    flagged = with_maybe(rows, key, gone.select(key.alias("key")).distinct())
    named = gone.select(*[F.col(c).alias(f"_its_{c}") for c in on]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_its_{c}")) for c in on])
    return flagged.where(~F.col("_maybe")).unionByName(flagged.where("_maybe").join(named, same, "left_anti")).drop("_maybe")


_held: dict[Hashable, object] = {}


def held_by_worker[X](key: Hashable, make: Callable[[], X]) -> X:
    """What a Python worker keeps from one task to the next: one thing at a time, so that operators don't pile up memory."""
    if key not in _held:
        hold_nothing()
        _held[key] = make()
    return _held[key]


def hold_nothing() -> None:
    """For operators that keep nothing: what the one before kept goes, and its memory goes back to the machine."""
    if _held:
        _held.clear()
        gc.unfreeze()
        give_back()


def give_back() -> None:
    """What this process has freed goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
