"""The trie of conversations' beginnings: who shares which first turns, and what computing shared turns once saves.

1. Turns are numbered within their conversation along sampled ranges, so that no conversation is one task's, and each
   prefix of a rebuilt conversation gets a digest: the xor of 128-bit hashes of its turns and their depths.
2. Equal digests are one node.  Neighbours with the same members are one chain, so a path has as many chains as its members
   fall away, however many turns it has.
3. A chain's key lists the chains above it.  Sorted by key, chains are in preorder; sampled ranges of them are shards, and a
   shard's shape is encoded as balanced parentheses (parentheses.py): findclose delimits a subtree, the ranks of leaf pairs
   at both ends count its leaves, cumulative gains give its savings.
4. A chain that is still open at the end of its shard is part of the spine that the shards share.  It closes in the first
   later shard that comes back to its depth: sums of whole shards in between, and what that shard has up to there, complete it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.shipping import ship_package
from plumbline.llm.common import durable, hold_nothing, in_order
from plumbline.llm.parentheses import of_depths

#: Rebuilt conversations begin with up to so many turns of the first conversation of their family.
FAMILY, HEADS = 20, 4
#: Chains of a shard, and conversation ids of a range whose digests are joined, if they make more than the session has
#: shuffle partitions.
SHARD_CHAINS, RANGE_IDS = 500_000, 200_000
_NODES = "conv_id long, n long, place int, depth int, open boolean, leaves long, saved long"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, w): two hashes of role and text, and the text's words, null ones being empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(text, F.lit(1), role).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"),
    )


def _before(parts: DataFrame, part: str, sums: dict[str, tuple[str, str]]) -> DataFrame:
    """What the parts of a conversation before each have in all: {name: (sum or bit_xor, column)}.  A conversation has a part
    in each range that it reaches into."""
    earlier = Window.partitionBy("conv_id").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns({name: F.coalesce(getattr(F, how)(c).over(earlier), F.lit(0)).cast("long") for name, (how, c) in sums.items()})


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, d, x, y, w, size): the turns of the rebuilt conversations, each with its depth from 1 and its two
    hashes with the depth, and the textless root at depth 0.  `part` tells apart what different tasks know of it."""
    placed, _ = in_order(durable(turns_of(conversations), "turns"), [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("a"), F.asc("b")], "turns-in-order")
    parts = placed.groupBy("conv_id", "_range").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("lo"))
    parts = durable(_before(parts, "_range", {"before": ("sum", "n")}), "turn-parts")
    own = placed.join(parts.drop("n"), ["conv_id", "_range"]).withColumn("i", F.col("_at") - F.col("lo") + F.col("before") + 1)
    sizes = parts.groupBy("conv_id").agg(F.sum("n").alias("size"))
    wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = sizes.withColumns({"h": wanted, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    found = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(found, "base", "left").withColumn("cut", F.least("h", F.coalesce("base_size", F.lit(0))))
    rest = F.greatest(F.lit(0), F.col("size") - F.col("h"))
    convs = durable(convs.select("conv_id", "base", "h", "cut", (F.col("cut") + rest).alias("size")), "conversations")
    heads = durable(own.where(f"i < {HEADS} and conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), "i", "a", "b", "w"), "heads")

    def salted(depth: str) -> dict[str, Column]:
        return {"x": F.xxhash64(depth, "a", "b"), "y": F.xxhash64("b", depth, "a")}

    first = convs.where("cut > 0").join(heads, "base").where("i <= cut").withColumn("d", F.col("i")).withColumn("part", F.lit(-1))
    later = own.join(convs, "conv_id").where("i > h").withColumn("d", F.col("i") - F.col("h") + F.col("cut")).withColumnRenamed("_range", "part")
    names = ["conv_id", "part", "d", "x", "y", "w", "size"]
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", F.lit(-2).alias("part"), zero.alias("d"), zero.alias("x"), zero.alias("y"), zero.alias("w"), "size")
    return root.unionByName(first.withColumns(salted("d")).select(*names)).unionByName(later.withColumns(salted("d")).select(*names))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, d, px, py, w, upto, size): each prefix's digest, its last turn's words and those of all its turns."""
    turns = durable(turns, "rebuilt")
    along = Window.partitionBy("conv_id", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = turns.withColumns({"px": F.bit_xor("x").over(along), "py": F.bit_xor("y").over(along), "upto": F.sum("w").over(along)})
    parts = turns.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"), F.sum("w").alias("tw"))
    parts = durable(_before(parts, "part", {"bx": ("bit_xor", "tx"), "by": ("bit_xor", "ty"), "bw": ("sum", "tw")}), "prefix-parts")
    met = inside.join(parts.select("conv_id", "part", "bx", "by", "bw"), ["conv_id", "part"])
    return met.select("conv_id", "d", F.col("px").bitwiseXOR(F.col("bx")).alias("px"), F.col("py").bitwiseXOR(F.col("by")).alias("py"), "w", (F.col("upto") + F.col("bw")).alias("upto"), "size")


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard's chains, in preorder: leaves and savings of each subtree as far as the shard goes; then what the shard has
    before it comes back to each depth above its first chain's (conv_id null), and in all (n null too)."""
    hold_nothing()
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    conv, n, place, depth, leaf, gain = (pa.chunked_array([b.column(i) for b in held]).to_numpy() for i in range(6))
    shape, opens = of_depths(depth.astype("i8"), bool(leaf[-1]))
    closes = shape.find_close(opens)
    still = closes < 0
    upto = np.where(still, len(shape.bits) - 1, closes)
    gains = np.concatenate([np.zeros(1, "i8"), np.cumsum(gain)])
    node = np.arange(len(depth))
    leaves = shape.leaf_rank(upto) - np.where(opens, shape.leaf_rank(np.maximum(opens - 1, 0)), 0)
    saved = gains[shape.rank(upto)] - gains[node]
    lowest = np.minimum.accumulate(depth)
    back = np.flatnonzero(np.concatenate([[True], lowest[1:] < lowest[:-1]]))
    leaves_before = np.where(opens[back], shape.leaf_rank(np.maximum(opens[back] - 1, 0)), 0)
    where = int(place[0])

    def out(c: pa.Array, k: pa.Array, d: np.ndarray, o: np.ndarray, le: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        columns = [c, k, pa.array(np.full(len(d), where, "i4")), pa.array(d.astype("i4")), pa.array(o), pa.array(le.astype("i8")), pa.array(s.astype("i8"))]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "n", "place", "depth", "open", "leaves", "saved"])

    yield out(pa.array(conv), pa.array(n), depth, still, leaves, saved)
    yield out(pa.nulls(len(back), pa.int64()), pa.array(np.zeros(len(back), "i8")), depth[back], np.zeros(len(back), bool), leaves_before, gains[back])
    yield out(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), lowest[-1:], np.zeros(1, bool), shape.leaf_rank(np.array([len(shape.bits) - 1])), gains[-1:])


def _spines(done: DataFrame) -> DataFrame:
    """(conv_id, n, leaves, saved) of the chains that their shard leaves open, with what later shards add.  The driver sees one
    row a shard."""
    spark = done.sparkSession
    shards = sorted((r["place"], r["depth"], r["leaves"], r["saved"]) for r in done.where("conv_id is null and n is null").collect())
    places, least = np.array([s[0] for s in shards], "i8"), np.array([s[1] for s in shards], "i8")
    leaves, saved = (np.concatenate([np.zeros(1, "i8"), np.cumsum([s[k] for s in shards])]).astype("i8") for k in (2, 3))
    shared = spark.sparkContext.broadcast((places, least, leaves, saved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, least, leaves, saved = shared.value
        for batch in batches:
            at = np.searchsorted(places, batch.column("place").to_numpy())
            depth = batch.column("depth").to_numpy()
            to = np.empty(len(at), "i8")
            for i, (k, d) in enumerate(zip(at.tolist(), depth.tolist(), strict=True)):
                low = np.flatnonzero(least[k + 1 :] <= d)
                to[i] = k + 1 + low[0] if len(low) else len(places)
            closing = np.where(to < len(places), places[np.minimum(to, len(places) - 1)], -1)
            more = [pa.array(batch.column(c).to_numpy() + t[to] - t[at + 1]) for c, t in (("leaves", leaves), ("saved", saved))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("n"), pa.array(closing.astype("i4")), batch.column("depth"), *more], ["conv_id", "n", "closing", "depth", "leaves", "saved"])

    open_ = done.where("conv_id is not null and open").select("conv_id", "n", "place", "depth", "leaves", "saved")
    open_ = open_.mapInArrow(run, "conv_id long, n long, closing int, depth int, leaves long, saved long")
    backs = done.where("conv_id is null and n is not null").select("place", F.col("depth").alias("back"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    above = F.lag("back").over(Window.partitionBy("place").orderBy(F.desc("back")))
    backs = backs.withColumn("above", F.coalesce(above, F.lit(2**31 - 1)))
    met = open_.join(backs, (F.col("closing") == F.col("place")) & (F.col("depth") >= F.col("back")) & (F.col("depth") < F.col("above")), "left")
    more = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
    return met.select("conv_id", "n", more("leaves"), more("saved"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, joined by commas; the rows come in the order of (owner, d, conv_id)."""
    at, seq = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        owner, d, conv, place = (batch.column(c).to_numpy() for c in ("owner", "d", "conv_id", "place"))
        edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (d[1:] != d[:-1]), [True]]))
        texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        seq = seq + 1 if (owner[0], d[0]) == at else 0
        at = owner[-1], d[-1]
        nth = np.zeros(len(texts), "i8")
        nth[0] = seq
        seq = seq if len(texts) == 1 else 0
        yield pa.RecordBatch.from_arrays([pa.array(owner[edge[:-1]]), pa.array(d[edge[:-1]]), pa.array(place[edge[:-1]]), pa.array(nth), pa.array(texts)], ["owner", "d", "place", "nth", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, fed in order; a digest is all that is kept of them."""
    at, digest = None, None
    for batch in batches:
        out = []
        for owner, d, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "d", "ids")), strict=True):
            if (owner, d) == at:
                digest.update(b",")
            else:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = (owner, d), hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["owner", "d", "sha"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([digest.hexdigest()])], ["owner", "d", "sha"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(owner, d, sha) of the ids in ends (owner, d, conv_id) of each node.  Ids are joined within ranges; only the joined
    pieces of a node meet, to be fed to its digest one after another."""
    ranges = max(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ends.count() // RANGE_IDS))
    dealt = ends.repartitionByRange(ranges, "owner", "d", "conv_id").sortWithinPartitions("owner", "d", "conv_id")
    pieces = dealt.select("owner", "d", "conv_id", F.spark_partition_id().alias("place")).mapInArrow(_pieces, "owner long, d long, place int, nth long, ids string")
    return pieces.repartition("owner", "d").sortWithinPartitions("owner", "d", "place", "nth").mapInArrow(_digest, "owner long, d long, sha string")


def trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by turn, null first; turns that tie go by a hash of role and text.  Null roles and texts are empty; rows without
    a conv_id belong to no conversation and are left out.  Repeated rows are turns each.  A rebuilt conversation may have no
    turn: it is a member of the root and ends there.  Other columns are ignored.  An empty table gives an empty result.
    """
    ship_package(conversations.sparkSession)
    rows = durable(prefixes(rebuilt(conversations)), "prefixes")
    nodes = rows.groupBy("d", "px", "py").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("owner"), F.count_if(F.col("d") == F.col("size")).alias("ends"))
    named = durable(rows.join(durable(nodes, "nodes"), ["d", "px", "py"]), "named")
    top = F.min(F.struct("d", "px", "py", (F.col("upto") - F.col("w")).alias("above")))
    chains = named.groupBy("conv_id", "n").agg(top.alias("top"), F.max(F.struct("d", "upto", "ends")).alias("bottom"), F.min("owner").alias("owner"))
    step = F.struct((-F.col("n")).alias("order"), F.struct("top.px", "top.py").alias("key"), "n", "owner", F.col("top.d").alias("top"), "top.above", F.col("bottom.d").alias("bottom"), "bottom.upto", "bottom.ends")
    paths = chains.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("path"))
    each = paths.select("conv_id", "path", F.posexplode("path").alias("at", "its")).where("its.owner = conv_id")
    above = F.when(F.col("at") > 0, F.try_element_at("path", F.col("at")))
    each = each.select("conv_id", F.slice(F.col("path.key"), F.lit(1), F.col("at") + 1).alias("key"), "its.n", "its.top", "its.above", "its.bottom", "its.upto", "its.ends",
                       above["owner"].alias("parent"), above["n"].alias("parent_n"))
    each = durable(each, "chains")
    kids = each.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), F.col("parent_n").alias("n")).agg(F.count(F.lit(1)).alias("kids"))
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-each.count() // SHARD_CHAINS))
    shown = each.repartitionByRange(shards, "key").sortWithinPartitions("key").select(
        "conv_id", "n", F.spark_partition_id().alias("place"), (F.size("key") - 1).alias("depth"), (F.col("ends") == F.col("n")).alias("leaf"), ((F.col("n") - 1) * (F.col("upto") - F.col("above"))).alias("gain")
    )
    done = durable(shown.mapInArrow(_shard, _NODES), "shards")
    answers = done.where("conv_id is not null and not open").select("conv_id", "n", "leaves", "saved").unionByName(_spines(done))
    digests = end_digests(named.where("d = size").select("owner", "d", "conv_id"))
    whole = each.drop("key", "upto", "parent_n").join(answers, ["conv_id", "n"]).join(kids, ["conv_id", "n"], "left")
    whole = whole.join(digests.select(F.col("owner").alias("conv_id"), F.col("d").alias("bottom"), "sha"), ["conv_id", "bottom"], "left")
    whole = durable(whole, "chain-answers")
    met = named.where("conv_id = owner").select("conv_id", "n", "d", "w", "upto").join(whole, ["conv_id", "n"])
    inner = F.col("d") < F.col("bottom")
    return met.select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(inner, 1).otherwise(F.coalesce("kids", F.lit(0))).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * (F.col("upto") - F.col("w") - F.col("above"))).alias("saved_tokens"),
        F.when(inner | F.col("sha").isNull(), hashlib.sha256().hexdigest()).otherwise(F.col("sha")).alias("ends_sha256"),
    )


#: CRC-32 bit by bit; a prefix is the list of its turns.
ORACLE = r"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, count(*) OVER (PARTITION BY conv_id) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 20 AS base, size, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(c::VARCHAR)), lambda k: ascii(substr(c::VARCHAR, (k + 1)::BIGINT, 1))::BIGINT)),
    lambda v, x: list_reduce(list_prepend(xor(v, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda u, z: xor(u >> 1, (u & 1) * 3988292384)))) % 4 AS h
  FROM (SELECT DISTINCT c, size FROM own)),
cut AS (SELECT convs.c, convs.base, convs.h, least(convs.h, coalesce(b.size, 0)) AS cut, least(convs.h, coalesce(b.size, 0)) + greatest(0, convs.size - convs.h) AS size FROM convs LEFT JOIN convs b ON convs.base = b.c),
turns AS (
  SELECT cut.c, i AS d, r, t, cut.size FROM cut JOIN own ON own.c = base WHERE i <= cut
  UNION ALL SELECT cut.c, i - h + cut, r, t, cut.size FROM cut JOIN own USING (c) WHERE i > h),
rows AS (
  SELECT c, d, size, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, list({'r': r, 't': t}) OVER (PARTITION BY c ORDER BY d) AS prefix FROM turns
  UNION ALL SELECT c, 0, size, 0, [] FROM cut),
coded AS (SELECT c, d, size, w, md5(prefix::VARCHAR) AS p FROM rows),
nodes AS (
  SELECT d, p, min(c) AS owner, count(*) AS n, any_value(w) AS w, max(size) = d AS leaf, string_agg(CASE WHEN size = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends
  FROM coded GROUP BY d, p),
named AS (SELECT coded.c, coded.d, nodes.p, owner, n, nodes.w, leaf FROM coded JOIN nodes ON coded.d = nodes.d AND coded.p = nodes.p),
mine AS (SELECT c, d, p, owner, n, w, lag(owner) OVER (PARTITION BY c ORDER BY d) AS parent, lag(p) OVER (PARTITION BY c ORDER BY d) AS parent_p,
    sum(CASE WHEN c = owner THEN (n - 1) * w ELSE 0 END) OVER down AS saved, sum(CASE WHEN c = owner AND leaf THEN 1 ELSE 0 END) OVER down AS leaves
  FROM named WINDOW down AS (PARTITION BY c ORDER BY d DESC)),
below AS (SELECT d, p, sum(saved) AS saved, sum(leaves) AS leaves, any_value(parent) AS parent FROM mine GROUP BY d, p),
kids AS (SELECT d - 1 AS d, parent_p AS p, count(*) AS kids FROM (SELECT DISTINCT d, p, parent_p FROM mine WHERE d > 0) GROUP BY 1, 2)
SELECT owner AS conv_id, nodes.d::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(kids, 0) AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes JOIN below ON nodes.d = below.d AND nodes.p = below.p LEFT JOIN kids ON kids.d = nodes.d AND kids.p = nodes.p
"""
