"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `virtual_nodes` points on a ring of hashes; a row belongs to the arc that ends at the next point
clockwise.  A shard takes its arcs' rows, in ring order, up to its quota; rows that find their shard full go on
clockwise to the next shard with room.  The quotas add up to the number of rows and differ by one at most, so the law
`rows` holds.  The driver sees one count per arc (shards * virtual_nodes numbers, whatever the input's size) and turns
them into a plan of runs (arc, first rank, shard, first slot); a row's rank in its arc then decides its shard and slot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import durable, text_or_empty

LAW = "rows"
#: Ranks in an arc are below 2 ** _RANK_BITS.
_RANK_BITS = 44


def ring(shards: int, virtual_nodes: int) -> tuple[np.ndarray, list[int]]:
    """Points in clockwise order (signed 64-bit) and the shard of each."""
    points = sorted((xxhash.xxh64_intdigest(f"{s}/{v}", 42) - (1 << 63), s) for s in range(shards) for v in range(virtual_nodes))
    return np.array([p for p, _ in points], "int64"), [s for _, s in points]


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def runs(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, shard, first slot) for all rows, sorted by arc and rank."""
    room = quotas(sum(counts.values()), shards)
    filled = [0] * shards
    plan, over = [], []

    def put(arc: int, rank: int, shard: int, rows: int) -> None:
        plan.append((arc, rank, shard, filled[shard]))
        filled[shard] += rows
        room[shard] -= rows

    for arc in sorted(counts):
        shard = owners[arc]
        own = min(room[shard], counts[arc])
        if own:
            put(arc, 0, shard, own)
        if own < counts[arc]:
            over.append((arc, own))
    for arc, rank in over:
        step = arc
        while rank < counts[arc]:
            step = (step + 1) % len(owners)
            shard = owners[step]
            if room[shard]:
                more = min(room[shard], counts[arc] - rank)
                put(arc, rank, shard, more)
                rank += more
    return sorted(plan)


def assign(
    docs: DataFrame, shards: int = 40, virtual_nodes: int = 64, doc_id: str = "doc_id", text: str = "text", cell_rows: int = 1_000_000, chunk_rows: int = 100_000
) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot, grown_shard (null).

    Within a shard slots run from 0 without gaps; shards' row counts differ by one at most.  A null text has no bytes
    (size 16, crc32 0).  Rows that repeat a doc_id stand at one point of the ring and are told apart by their text;
    equal rows take neighbouring ranks.  A null doc_id has a point like any other.  With fewer rows than shards the
    last shards stay empty.  Other columns are ignored, so their names can't clash.  An empty table gives an empty result.

    Rows equal in doc_id, size and crc32 are counted first and dealt out again at the end, chunk_rows at a time.  Ranks
    are counted by cells, of which an arc and a doc_id have the more the more rows there are (about cell_rows in each),
    so neither an arc, a doc_id nor a text is one task's work.
    """
    points, owners = ring(shards, virtual_nodes)
    last = len(owners)

    @F.pandas_udf("int")
    def arc_of(hashed: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, hashed.to_numpy("int64"), side="left") % last).astype("int32"))

    spot = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # the plan needs doc_id alone, so this pass reads one column
    counted = docs.select(F.col(doc_id).alias("doc_id")).select(arc_of(spot).alias("arc")).groupBy("arc").count()
    counts = {r["arc"]: r["count"] for r in counted.collect()}
    plan = runs(counts, owners, shards)
    starts = np.array([(a << _RANK_BITS) + k for a, k, _, _ in plan], "int64")
    to_shard, to_slot = np.array([s for _, _, s, _ in plan], "int32"), np.array([slot - k for _, k, _, slot in plan], "int64")

    @F.pandas_udf("struct<shard: int, slot: bigint>")
    def place(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        ranks = rank.to_numpy("int64")
        at = np.searchsorted(starts, (arc.to_numpy("int64") << _RANK_BITS) + ranks, side="right") - 1
        return pd.DataFrame({"shard": to_shard[at], "slot": to_slot[at] + ranks})

    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(text_or_empty(text)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
    )
    groups = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")).withColumn("spot", spot).withColumn("arc", arc_of("spot"))
    total = sum(counts.values())
    # parts of an arc by some bits of the spot, and of a spot's texts by some bits of their crc32
    wide, deep = -(-total // (cell_rows * last)), min(4096, -(-total // (10 * cell_rows)))
    cell = F.struct(F.pmod(F.shiftright("spot", 32), F.lit(max(1, wide))).alias("s"), F.pmod("text_crc32", F.lit(max(1, deep))).alias("c"))
    groups = groups.withColumn("cell", cell)
    if wide > 1 or deep > 1:
        groups = durable(groups, "ring-groups")
        cells = groups.groupBy("arc", "cell").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("arc").orderBy("cell")) - F.col("n")
        cells = durable(cells.select("arc", "cell", before.alias("before")), "ring-cells")
        groups = groups.join(cells, ["arc", "cell"])
    else:
        groups = groups.withColumn("before", F.lit(0).cast("long"))
    upto = F.sum("n").over(Window.partitionBy("arc", "cell").orderBy("spot", "doc_id", "text_crc32", "size"))
    ranked = groups.withColumn("first", F.col("before") + upto - F.col("n"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk_rows).cast("long")))
    chunks = ranked.select("doc_id", "size", "text_crc32", "arc", "first", "n", chunk.alias("at"))
    each = F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("n"), F.col("at") + chunk_rows) - 1))
    return chunks.select("doc_id", "size", "text_crc32", "arc", each.alias("rank")).withColumn("at", place("arc", "rank")).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "at.shard", "at.slot", F.lit(None).cast("int").alias("grown_shard")
    )
