"""A bitmap of long keys that every executor gets, to tell most rows of other keys apart before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import quoted

#: Bits a key, and the most of all (64 MB); a bitmap of bitmap_construct_agg() has PART bits.
BITS_A_KEY, MOST_BITS, PART = 32, 1 << 29, 1 << 15


def may_be_among(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose long key is one of `keys` (column key), and a few others: one in BITS_A_KEY, and more and more beyond
    MOST_BITS / BITS_A_KEY keys.  So it may spare rows a shuffle, and never decides what becomes of those that pass.  `keys`
    should be a written table, as it is read twice."""
    bits = min(MOST_BITS, max(PART, 1 << (keys.count() * BITS_A_KEY - 1).bit_length()))
    spot = F.pmod(F.xxhash64("key"), F.lit(bits))
    parts = keys.select(F.floor(spot / PART).cast("int").alias("_part"), (spot % PART).alias("bit")).groupBy("_part").agg(F.bitmap_construct_agg("bit").alias("_bits"))
    keyed = rows.withColumn("_spot", F.pmod(F.xxhash64(key), F.lit(bits))).withColumn("_part", F.floor(F.col("_spot") / PART).cast("int"))
    met = keyed.join(F.broadcast(parts), "_part")
    byte = F.expr(f"cast(conv(hex(substring(_bits, cast(_spot % {PART} as int) div 8 + 1, 1)), 16, 10) as int)")
    return met.where(F.getbit(byte, (F.col("_spot") % 8).cast("int")) == 1).select(*[quoted(c) for c in rows.columns])
