"""Exact dedup by two passes over a Bloom filter, in DataFrame functions alone.

Pass 1 notes for each text two positions in one block of the filter and keeps the positions that were hit more than once.
Pass 2 probes every row: a row with a position that was hit once has no equal, and goes straight to the result.  Only the
other rows shuffle, and their digests decide; the filter's size therefore changes how much shuffles and never the result.

What pass 1 shuffles is the positions, four bytes a row, packed by block within each task: a task sends a row for each
block of the filter that it hits and not for each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BLOCK_BITS, bit_at, durable, text_or_empty

#: The filter is broadcast as blocks of 1024 longs: 128 MB at the most.  Beyond a row for LEAST_BITS_PER_ROW of these bits a
#: filter would hold every row possibly repeated, and is left out.
MAX_FILTER_BITS = 1 << 30
BITS_PER_ROW, LEAST_BITS_PER_ROW = 16, 4
#: Rows whose positions one task gathers for a block at the most, were all of them in one block.
CELL_ROWS = 8_000_000


def squeezed(text: str) -> Column:
    """The text with each run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def filter_blocks(rows: int, most: int = MAX_FILTER_BITS) -> int:
    """A power of two of about BITS_PER_ROW bits a row, in blocks; none if `most` bits are too few to tell rows apart."""
    if rows * LEAST_BITS_PER_ROW > most:
        return 0
    bits = min(most, 1 << max(0, rows * BITS_PER_ROW - 1).bit_length())
    return max(1, bits // BLOCK_BITS)


def placed(rows: DataFrame, blocks: int) -> DataFrame:
    """rows (text_sha256) with a block and two positions in it, packed in an int."""
    return rows.withColumns({"block": F.pmod(F.xxhash64("text_sha256"), F.lit(blocks)), "spots": F.hash("text_sha256", F.lit(1))})


def repeated_spots(rows: DataFrame, blocks: int, cells: int = 1) -> DataFrame:
    """(block, words): for every block that is hit 1024 longs, whose bits are the positions that more than one row hits.

    rows (row, block, spots).  With several cells a block's rows are first dealt by `row` and each cell's positions are
    counted, so that a hot text is never one task's list; a cell then sends each of its positions once.
    """
    # position and count; a word's first position is named with a count of 0 as well, so that no word is missing
    none = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda word: F.struct((word * 64).alias("spot"), F.lit(0).alias("n")))
    hit = lambda spot: F.struct(spot.alias("spot"), F.lit(1).alias("n"))
    hits = F.flatten(F.transform("spots", lambda two: F.array(hit(two.bitwiseAND(65535)), hit(F.shiftrightunsigned(two, 16)))))
    if cells == 1:
        each = rows.groupBy("block").agg(F.collect_list("spots").alias("spots")).select("block", F.explode(F.concat(hits, none)).alias("x"))
    else:
        packed = rows.withColumn("cell", F.pmod("row", F.lit(cells))).groupBy("block", "cell").agg(F.collect_list("spots").alias("spots"))
        seen = packed.select("block", "cell", F.explode(hits).alias("x")).groupBy("block", "cell", "x.spot").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("n"))
        sent = seen.groupBy("block", "cell").agg(F.collect_list(F.col("spot") * 4 + F.col("n")).alias("spots")).repartition("block")
        back = F.transform("spots", lambda x: F.struct(F.shiftright(x, 2).alias("spot"), x.bitwiseAND(3).alias("n")))
        # the words of a block are named by each of its cells; a count of 0 adds nothing
        each = sent.select("block", F.explode(F.concat(back, none)).alias("x"))
    seen = each.groupBy("block", "x.spot").agg((F.sum("x.n") > 1).alias("again"))
    mask = F.bit_or(F.expr("if(again, shiftleft(1L, spot & 63), 0L)"))
    words = seen.where("again or spot & 63 = 0").groupBy("block", F.expr("shiftright(spot, 6)").alias("word")).agg(mask.alias("mask"))
    return words.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("words")).select("block", F.col("words.mask").alias("words"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_filter_bits: int = MAX_FILTER_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every row with the row that stays of its group of equal texts.

    Result: doc_id, keep_id (smallest doc_id of the group), group_size, kept, text_sha256 (of the squeezed text).
    Other columns of the input are ignored, so their names can't clash.  A null text equals an empty one.  Of rows that
    repeat a doc_id as well as its text exactly one is kept.  A null doc_id counts as smallest.  An empty table gives an
    empty result.
    """
    rows = durable(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.sha2(squeezed(text), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "exact-dedup",
    )
    count = rows.count()
    blocks = filter_blocks(count, max_filter_bits)
    if blocks:
        spotted = placed(rows, blocks)
        filter_ = repeated_spots(spotted.select("row", "block", "spots"), blocks, max(1, -(-count // cell_rows)))
        probed = spotted.join(F.broadcast(filter_), "block").withColumns({"s1": F.expr("spots & 65535"), "s2": F.expr("shiftrightunsigned(spots, 16)")})
        probed = probed.select("doc_id", "text_sha256", "row", F.expr(f"{bit_at('words', 's1')} and {bit_at('words', 's2')}").alias("maybe"))
    else:
        probed = rows.withColumn("maybe", F.lit(True))
    alone = probed.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    perhaps = probed.where("maybe").select("doc_id", "row", "text_sha256")
    groups = perhaps.groupBy("text_sha256").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = durable(groups, "exact-dedup-groups")  # a shuffle of its own, so that the join can split a hot group's rows
    met = perhaps.join(groups, "text_sha256").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(met)


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
"""
