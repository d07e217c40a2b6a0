"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits need not share a variant within 1 bit of each, as 3 is odd.  So the 64 bits are taken as
four blocks of 16, and each block is left out in turn: of the 48 bits kept, every fingerprint emits all variants within
half the radius (1 bit), 4 * 49 in all.  If two fingerprints differ in at most 3 bits, and not in 3 bits of one block,
some block holds exactly one of their differing bits (or they differ in 2 at most), and without it their balls meet.
Three bits of one block: then the 48 bits kept are equal.

Fingerprints under one variant are within 2 bits on the bits kept, so what remains to verify is the block left out:
  equal there: linked; 1 bit apart there: linked; 2 or 3 bits apart there: linked if both carry the variant unflipped.
A group of equal blocks is linked as a star and the groups are matched through their blocks' values, of which there are
at most 65,536: no pairs within a group are emitted, and one variant's group is at most 49 * 65,536 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shipping import ship_package
from plumbline.llm.common import durable, hold_nothing, text_or_empty
from plumbline.llm.components import components, one_of_each

BLOCKS, WIDTH = 4, 16
_FLIPS = [0, *(1 << i for i in range(64 - WIDTH))]
_SLICE = 1 << 20
#: Variants that one task emits, about.
MADE_ROWS = 1_000_000


def fingerprint(text: str, words: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes.  No words: 0."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), "int64", len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    if len(parts) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[:n], ends[words - 1 :]
    total, digest = np.zeros(64, "int64"), xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        spans = zip(starts[at : at + _SLICE].tolist(), ends[at : at + _SLICE].tolist(), strict=True)
        hashes = np.array([digest(whole[a:b], 42) for a, b in spans], "<u8")
        total += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (signed 64-bit) of every row, from whole texts."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_nothing()
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            found = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def variants(prints: DataFrame) -> DataFrame:
    """(key, fp): key holds the number of the block left out above 48 bits, of which one at most is flipped."""
    kept = []
    for block in range(BLOCKS):
        low = block * WIDTH
        above = "0L" if low + WIDTH == 64 else f"shiftrightunsigned(fp, {low + WIDTH})"
        kept.append(f"(shiftleft({above}, {low}) | (fp & {(1 << low) - 1}L) | {block << 48}L)")
    based = prints.select("fp", F.explode(F.expr(f"array({', '.join(kept)})")).alias("base"))
    flipped = based.select("fp", "base", F.explode(F.array(*[F.lit(f).cast("long") for f in _FLIPS])).alias("flip"))
    return flipped.select(F.col("base").bitwiseXOR(F.col("flip")).alias("key"), "fp")


def _ball(width: int) -> np.ndarray:
    """All values of `width` bits with 1 to 3 bits set."""
    every = np.arange(1 << width, dtype="u4")
    ones = np.bitwise_count(every)
    return every[(ones > 0) & (ones <= 3)]


def links_of(key: int, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Verified links among the distinct fingerprints (unsigned) under one variant: as many as fingerprints, nearly."""
    block = key >> 48
    low = block * WIDTH
    above = fps >> np.uint64(low + WIDTH) if low + WIDTH < 64 else np.zeros_like(fps)
    kept = (above << np.uint64(low)) | (fps & np.uint64((1 << low) - 1))
    exact = kept == np.uint64(key & ((1 << 48) - 1))
    mine = ((fps >> np.uint64(low)) & np.uint64((1 << WIDTH) - 1)).astype("u4")
    order = np.lexsort((fps, mine))
    fps, exact, mine = fps[order], exact[order], mine[order]
    first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
    group = np.cumsum(np.concatenate([[False], mine[1:] != mine[:-1]]))
    star = fps[first][group]
    rest = np.ones(len(fps), bool)
    rest[first] = False
    out = [(star[rest], fps[rest])]
    value = mine[first]
    if len(value) > 1:
        heads = fps[first]
        own = np.zeros(len(value), "u8")
        has = np.zeros(len(value), bool)
        own[group[exact]], has[group[exact]] = fps[exact], True
        if len(value) <= 256:
            apart = np.bitwise_count(value[:, None] ^ value[None, :])
            i, j = np.nonzero(np.triu(apart <= 3, 1))
        else:  # look up the few values within 3 bits of each
            ball, found = _ball(WIDTH), []
            for at in range(len(value)):
                near = value[at] ^ ball
                near = near[near > value[at]]
                spot = np.searchsorted(value, near)
                spot = spot[(spot < len(value)) & (value[np.minimum(spot, len(value) - 1)] == near)]
                found.append(np.stack([np.full(len(spot), at), spot]))
            i, j = np.concatenate(found, 1)
        one = np.bitwise_count(value[i] ^ value[j]) == 1
        out.append((heads[i[one]], heads[j[one]]))
        both = ~one & has[i] & has[j]
        out.append((own[i[both]], own[j[both]]))
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal keys; the rows come sorted by key.  Runs of one row, nearly all, cost no loop."""
    held_key, held = np.zeros(0, "i8"), np.zeros(0, "i8")

    def answer(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        if not len(keys):
            return None
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        size = np.diff(edge)
        a, b = [], []
        for k in np.flatnonzero(size > 1):
            members = np.unique(fps[edge[k] : edge[k + 1]].view("u8"))
            for x, y in links_of(int(keys[edge[k]]), members):
                a.append(x)
                b.append(y)
        if not a:
            return None
        pairs = np.unique(np.stack([np.concatenate(a).view("i8"), np.concatenate(b).view("i8")], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_key, batch.column(0).to_numpy()])
        fps = np.concatenate([held, batch.column(1).to_numpy()])
        cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        if (done := answer(keys[:cut], fps[:cut])) is not None:
            yield done
        held_key, held = keys[cut:], fps[cut:]
    if (done := answer(held_key, held)) is not None:
        yield done


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join exactly those within 3 bits, through others or directly."""
    ship_package(prints.sparkSession)
    prints = durable(prints.select("fp"), "simhash-prints")
    parts = -(-prints.count() * BLOCKS * len(_FLIPS) // MADE_ROWS)  # each row becomes 196, so few rows want many tasks
    return variants(prints.repartition(max(1, parts), "fp")).repartition("key").sortWithinPartitions("key").mapInArrow(_meet, "a long, b long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at most 3 bits).

    A null or empty text has fingerprint zero and is linked like any other.  Rows with equal fingerprints, copies and
    repeated rows among them, meet once: only distinct fingerprints emit variants.  A null doc_id is never a
    component_id unless all of its component are null.  Other columns are ignored, so their names can't clash.  An empty
    table gives an empty result.
    """
    rows = durable(fingerprints(docs, doc_id, text, words), "simhash")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(prints.select("fp")))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = durable(named, "simhash-roots")
    smallest = durable(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")  # so that the joins can split hot rows
    chosen = named.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return rows.join(durable(chosen, "simhash-chosen"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """The rows of docs that stay: of each component over links of at most 3 bits the one with the smallest doc_id.

    Rows that share a doc_id are decided one by one, and rows without one come last; of rows equal in doc_id and text one
    stays.  A null text counts as empty.  An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text")).withColumn("body", F.xxhash64("text"))
    named = rows.select(F.struct("id", "body").alias("key"), "text")
    marks = durable(fingerprints(named, "key", "text", words).select("doc_id.id", "doc_id.body", F.col("fp").alias("node")), "simhash-marks")
    return one_of_each(docs, doc_id, text, marks, components(near_links(marks.select(F.col("node").alias("fp")).distinct())))
