"""Near copies by five-word shingles: rows whose shingle sets have a Jaccard similarity of 0.8 or more.

SimHash with meet-in-the-middle ball hashing, on part fingerprints.  A plain 64-bit SimHash differs in about 10 bits at that
similarity, too far for balls around it.  So several are taken, each of a few pieces: in a piece, a few shingles that their
hashes draw carry most of the weight.  Fingerprints within RADIUS bits in one part meet, as all variants within half that
radius are made.  What meets and is alike by a plain SimHash of 128 bits, which goes along, is verified by the shingle sets
themselves.  Sets of similarity 0.8 meet under one of the parts of WIDE with a probability of 0.999 or more.  Clusters of
many alike nodes are left to the parts of DEEP, of more pieces, under which sets of less similarity seldom meet; what is
crowded there too is settled through hubs.  Equal sets are one node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.shipping import ship_package
from plumbline.llm.common import durable, hold_nothing, text_or_empty, with_maybe
from plumbline.llm.components import components, one_of_each

#: Two sets are near if 5 times what they share is at least 4 times what either has.
SHARED, OF = 4, 5
WORDS = 5
#: Fingerprints within so many bits meet, as each emits all variants within half as many.
RADIUS = 2
#: Clusters of up to so many nodes, and of more that make no more pairs for each, are compared pair by pair.
ALL_PAIRS = 16
#: They are compared if they meet in so many parts of DEEP: a pair at 0.8 does in ten, one at 0.5 in a tenth.
DEEP_MEETS = 2
#: What differs in more bits of the plain fingerprint isn't compared: sets at 0.8 differ in 19, the smallest in 24 with a
#: standard deviation of 4.4, others in 64.
PLAIN = 44
#: All pairs of so many nodes under a variant are looked at by their plain fingerprints.
CHECKED = 512
#: Variants in a bucket, about, and in a task that emits them.
BUCKET_ROWS, MADE_ROWS = 250_000, 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 4096


class Scheme(NamedTuple):
    """Part fingerprints: how many, of how many pieces, and the bits of a piece that are made, and used at the least."""

    seed: int
    parts: int
    pieces: int
    bits: int
    least: int

    @cache
    def drawn(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 2**64, (4, self.parts * self.pieces, 1), dtype="u8")

    def width(self, nodes: int) -> int:
        """Bits of a part that are used: with so many nodes, one of 32 has a chance neighbour under a part."""
        tried = (self.pieces * b for b in range(self.least, self.bits))
        return next((w for w in tried if 32 * nodes * (1 + w + w * (w - 1) // 2) <= 1 << w), self.pieces * self.bits)

    def used(self, prints: np.ndarray, width: int) -> np.ndarray:
        b, out = width // self.pieces, np.zeros_like(prints)
        for i in range(self.pieces):
            out |= ((prints >> np.uint64(i * self.bits)) & np.uint64((1 << b) - 1)) << np.uint64(i * b)
        return out


WIDE, DEEP = Scheme(20, 9, 2, 24, 16), Scheme(21, 34, 13, 4, 3)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; all of its words are one if it has fewer; none without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(parts[i : i + words]), 42) for i in range(max(1, len(parts) - words + 1))} if parts else set()
    return np.sort(np.fromiter(found, "u8", len(found)))


def part_fingerprints(grams: np.ndarray, scheme: Scheme = WIDE) -> list[int]:
    """A SimHash for each part, its pieces above each other: a bit is 1 if it is set in over half of the shingles' weight.

    In each piece, a shingle's weight is the third power of the inverse of an exponential variate that its hash deals."""
    if not len(grams):
        return []
    drawn, n = scheme.drawn(), scheme.parts * scheme.pieces
    ones, whole = np.zeros((n, scheme.bits)), np.zeros(n)
    for at in range(0, len(grams), _SLICE):
        some = grams[at : at + _SLICE]
        dealt = ((some ^ drawn[0]) * (drawn[1] | np.uint64(1))) >> np.uint64(11)
        far = -np.log((dealt + 0.5) / 2**53)
        weight = 1 / (far * far * far)
        hashes = ((some ^ drawn[2]) * (drawn[3] | np.uint64(1))).astype(">u8")
        bits = np.unpackbits(hashes.view("u1").reshape(*weight.shape, 8)[:, :, : -(-scheme.bits // 8)], axis=2)[:, :, : scheme.bits]
        ones += np.matmul(weight[:, None, :], bits.astype("f8"))[:, 0]
        whole += weight.sum(1)
    pieces = ((2 * ones > whole[:, None]) @ (1 << np.arange(scheme.bits))).reshape(scheme.parts, scheme.pieces)
    return [int(x) for x in (pieces << scheme.bits * np.arange(scheme.pieces)).sum(1)]


def plain_fingerprint(grams: np.ndarray) -> list[int]:
    """A SimHash of 128 bits in two halves: a bit is 1 if it is set in over half of the shingles' hashes.  No shingles: 0."""
    ones = np.zeros(128, "i8")
    for at in range(0, len(grams), _SLICE):
        some = grams[at : at + _SLICE]
        other = (some ^ (some >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        other = (other ^ (other >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        hashes = np.stack([some, other ^ (other >> np.uint64(31))], 1)
        ones += np.unpackbits(hashes.view("u1"), axis=1, bitorder="little").sum(0, dtype="i8")
    return np.packbits(2 * ones > len(grams), bitorder="little").view("<i8").tolist()


class Deal(NamedTuple):
    """How variants of so many bits are dealt to 2 ** `parities` buckets: by the parities of bits i, i + parities, ...

    A fingerprint's variants then lie in its own bucket and those that differ from it in one parity, however many variants
    they are.  So a bucket is sent the fingerprint, and makes the variants that are its own.
    """

    width: int
    parities: int

    def bucket(self, prints: np.ndarray) -> np.ndarray:
        out = np.zeros(len(prints), "i8")
        for j in range(self.parities):
            its = np.uint64(sum(1 << i for i in range(j, self.width, self.parities)))
            out |= (np.bitwise_count(prints & its) & 1).astype("i8") << j
        return out

    def ball(self) -> dict[int, np.ndarray]:
        """What turns a fingerprint into its variants, all within half the radius, by what turns its bucket into theirs."""
        flips = [1 << i for i in range(self.width)]
        if not self.parities:
            return {0: np.array([0, *flips], "u8")}
        return {0: np.zeros(1, "u8")} | {1 << j: np.array(flips[j :: self.parities], "u8") for j in range(self.parities)}


def _sent(scheme: Scheme, deal: Deal) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, prints, nodes, plain): the part fingerprints of nodes (node, parts, plain), once for each bucket of their variants, packed."""
    moves, wide = np.array(list(deal.ball())), -(-deal.width // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_nothing()
        for batch in (whole.slice(at, _SLICE) for whole in batches for at in range(0, whole.num_rows, _SLICE)):
            prints = scheme.used(batch.column("parts").flatten().to_numpy().view("u8").reshape(-1, scheme.parts), deal.width)
            nodes, plain = batch.column("node").to_numpy(), batch.column("plain").flatten().to_numpy().reshape(-1, 2)
            for part in range(scheme.parts):
                bucket = (deal.bucket(prints[:, part])[:, None] ^ moves).ravel()
                order = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0, [True]]))
                its = order // len(moves)
                packed = np.ascontiguousarray(prints[its, part].astype("<u8").view("u1").reshape(-1, 8)[:, :wide])
                cuts = list(zip(edge[:-1], edge[1:], strict=True))
                columns = [[(part << deal.parities) + int(bucket[order[i]]) for i, _ in cuts], *([x[i:j].tobytes() for i, j in cuts] for x in (packed, nodes[its], plain[its]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), *[pa.binary()] * 3), strict=True)], ["bucket", "prints", "nodes", "plain"])

    return run


def dealt_pairs(its: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of nodes that follow each other in an order that the variant deals."""
    dealt = np.argsort((nodes.view("u8") ^ np.uint64(its)) * _ODD)
    return dealt[1:], dealt[:-1]


def joined(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n places the least that the links x, y join it to."""
    least = np.arange(n)
    while len(apart := np.flatnonzero(least[x] != least[y])):
        i, j = least[x[apart]], least[y[apart]]
        np.minimum.at(least, np.maximum(i, j), np.minimum(i, j))
        while (least != (further := least[least])).any():
            least = further
    return least


def _meet(deal: Deal, settle: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, key, part): what to compare of each bucket's nodes.  Rows come sorted by bucket.

    Under each variant, nodes make pairs that are alike by their plain fingerprints; of equal part fingerprints only under
    the variant that equals them.  What such pairs join in a bucket is a cluster.  Its pairs are made once each, with the
    number of the part, unless they are more than what ALL_PAIRS nodes have for each, or a variant alone has as many or
    more than CHECKED nodes.  Then each of the cluster's nodes makes one row, however many variants and pairs it has
    there: part is -1, key is the part fingerprint of the cluster's least node, b is the node, and a is the node itself
    or, if they are to be settled, the one most alike among the smaller that it met, else the least.
    """
    wide, ball = -(-deal.width // 8), deal.ball()

    def answer(bucket: int, held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        raw, nodes, plain = (b"".join(x) for x in zip(*held, strict=True))
        part, node, plain = bucket >> deal.parities, np.frombuffer(nodes, "i8"), np.frombuffer(plain, "u8").reshape(-1, 2)
        full = np.zeros((len(node), 8), "u1")
        full[:, :wide] = np.frombuffer(raw, "u1").reshape(-1, wide)
        order = np.argsort(node)
        prints, node, plain = full.view("<u8").ravel()[order], node[order], plain[order]  # so that smaller places are smaller nodes
        move = deal.bucket(prints) ^ (bucket & ((1 << deal.parities) - 1))
        made = [(prints[of, None] ^ flips, np.repeat(of, len(flips))) for m, flips in ball.items() for of in [np.flatnonzero(move == m)]]
        key, of = np.concatenate([k.ravel() for k, _ in made]), np.concatenate([o for _, o in made])
        order = np.argsort(key, kind="stable")
        key, of = key[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        own = prints[of]
        once = (np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)) | (own[first] == key[first])

        def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.bitwise_count(plain[x] ^ plain[y]).sum(-1, dtype="i8")

        def alike(x: np.ndarray, y: np.ndarray, its: np.ndarray | np.uint64) -> np.ndarray:
            return ((prints[x] != prints[y]) | (prints[x] == its)) & (apart(x, y) <= PLAIN)

        two = first[(size == 2) & once]
        two = two[alike(of[two], of[two + 1], key[two])]
        pairs, met, crowds = [(np.minimum(of[two], of[two + 1]), np.maximum(of[two], of[two + 1]))], [], []
        for k in np.flatnonzero((size > 2) & once):
            among, its = np.sort(of[first[k] : first[k] + size[k]]), key[first[k]]
            n = len(among)
            if n > CHECKED:
                x, y = dealt_pairs((part << 52) | int(its), node[among])
                met += [(np.full(n - 1, among[0]), among[1:]), (among[np.minimum(x, y)], among[np.maximum(x, y)])]
                crowds.append((np.full(n, among[0]), among))
                continue
            i, j = np.triu_indices(n, 1)
            keep = alike(among[i], among[j], its)
            i, j = among[i[keep]], among[j[keep]]
            if 2 * len(i) <= (ALL_PAIRS - 1) * n:
                pairs.append((i, j))
                continue
            best = np.lexsort((i, apart(i, j), j))
            best = best[np.concatenate([[True], np.diff(j[best]) > 0])]
            met.append((i[best], j[best]))
            its = np.union1d(i, j)
            crowds.append((np.full(len(its), its[0]), its))
        x, y = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        x, y = np.divmod(np.unique(x * len(node) + y), len(node))
        none = np.zeros(0, "i8")
        hot, its = (np.concatenate([none, *(c[i] for c in crowds)]) for i in (0, 1))
        cluster = joined(len(node), np.concatenate([x, hot]), np.concatenate([y, its]))
        crowded = 2 * np.bincount(cluster[x], minlength=len(node)) > (ALL_PAIRS - 1) * np.bincount(cluster, minlength=len(node))
        crowded[cluster[hot]] = True
        many = crowded[cluster[x]]
        b = np.flatnonzero(crowded[cluster])
        a = cluster.copy() if settle else np.arange(len(node))
        if settle and len(b):
            low, high = (np.concatenate([none, z[many], *(m[i] for m in met)]) for i, z in enumerate((x, y)))
            best = np.lexsort((low, apart(low, high), high))
            best = best[np.concatenate([[True], np.diff(high[best]) > 0])]
            a[high[best]] = low[best]
        named = np.concatenate([np.zeros(len(x) - many.sum(), "i8"), prints[cluster[b]].view("i8") | (part << 52)])
        paired = np.arange(len(named)) < len(named) - len(b)
        columns = [np.concatenate([node[x[~many]], node[a[b]]]), np.concatenate([node[y[~many]], node[b]])]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(named, mask=paired), pa.array(np.where(paired, part, -1))], ["a", "b", "key", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_nothing()
        last, held = None, []
        for batch in batches:
            for bucket, *rest in zip(*(batch.column(c).to_pylist() for c in ("bucket", "prints", "nodes", "plain")), strict=True):
                if bucket != last and held:
                    yield answer(last, held)
                    held = []
                last = bucket
                held.append(tuple(rest))
        if held:
            yield answer(last, held)

    return run


def _met(nodes: DataFrame, scheme: Scheme, settle: bool) -> DataFrame:
    """(a, b, key, part), as _meet() has them, of the nodes (node, parts, plain) that meet in a variant of a part fingerprint.
    Without plain, all are alike."""
    plain = F.col("plain") if "plain" in nodes.columns else F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    nodes = nodes.where("size(parts) > 0").select("node", "parts", plain.alias("plain"))
    n = nodes.count()
    width = scheme.width(n)
    made = n * (width + 1)
    deal, tasks = Deal(width, min(width, max(0, -(-made // BUCKET_ROWS) - 1).bit_length())), -(-made * scheme.parts // MADE_ROWS) or 1
    sent = nodes.repartition(tasks, "node").mapInArrow(_sent(scheme, deal), "bucket long, prints binary, nodes binary, plain binary")
    dealt = sent.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return durable(dealt.mapInArrow(_meet(deal, settle), "a long, b long, key long, part long").distinct(), "near-met")


def _deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
        grams = [np.array(g, "i8").view("u8") for g in batch.column("grams").to_pylist()]
        found = [pa.array([f(g) for g in grams], pa.list_(pa.int64())) for f in (partial(part_fingerprints, scheme=DEEP), plain_fingerprint)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), *found], ["node", "parts", "plain"])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold_nothing()
    for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
        found = [shingles(t) for t in batch.column("text").to_pylist()]
        node = pa.array([xxhash.xxh64_intdigest(g.tobytes()) - 2**63 for g in found], pa.int64())
        parts, plain = (pa.array([f(g) for g in found], pa.list_(pa.int64())) for f in (part_fingerprints, plain_fingerprint))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("body"), node, parts, plain], ["id", "body", "node", "parts", "plain"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold_nothing()
    for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
        grams = pa.array([shingles(t).view("i8") for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), grams], ["node", "grams"])


def _grams_of(nodes: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, grams) of the wanted nodes, from the text of one row each."""
    asked = durable(nodes.join(wanted, "node").select("node", F.col("least.id").alias("its_id"), F.col("least.body").alias("its_body")), "near-asked")
    rows = with_maybe(rows, F.xxhash64("id", "body"), asked.select(F.xxhash64("its_id", "its_body").alias("key"))).where("_maybe")  # few texts shuffle
    texts = rows.join(asked, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("body") == F.col("its_body"))).select("node", "text")
    return durable(texts.mapInArrow(_grams, "node long, grams array<long>").dropDuplicates(["node"]), "near-grams")


def _near(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are near."""
    both = pairs.join(grams.toDF("a", "x"), "a").join(grams.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(OF * shared >= SHARED * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _around_hubs(dealt: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, hub) of the nodes that have more than ALL_PAIRS in a cluster of DEEP (key), not all of one component.  The hub is
    the root of the component that has most of them."""
    named = dealt.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    parts = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.max_by("root", F.struct("n", "root")).alias("hub"))
    groups = durable(groups.where(f"n > {ALL_PAIRS} and parts > 1").select("key", "hub"), "near-unsettled")  # so that the join can split a hot key's rows
    return durable(named.join(groups, "key").where("node <> hub").select("node", "hub").distinct(), "near-open")


#: Sets that are near differ in size by a fourth at the most, so their bands by this factor are the same or neighbours.
_BAND = 1.26


def _centred(open_: DataFrame, grams: DataFrame, near: DataFrame) -> DataFrame:
    """(node, hub) of the same nodes with a hub for each two neighbouring bands of sizes, in which two near nodes always are
    together: the one of these nodes, the old hub among them, that has most of the links (a, b) found so far.

    Any hub would be right, but what one of another size or at the edge has or hasn't would be in the deltas of them all."""
    links = near.select("a").union(near.select("b")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    band = F.floor(F.log(F.size("grams")) / math.log(_BAND))
    sizes = grams.select("node", F.explode(F.array(band - 1, band)).alias("band"))
    every = open_.union(open_.select("hub", "hub")).distinct().join(sizes, "node").join(links, "node", "left")
    every = durable(every.select("node", "hub", "band", F.coalesce("n", F.lit(0)).alias("n")), "near-every")
    centres = durable(every.groupBy("hub", "band").agg(F.max_by("node", F.struct("n", "node")).alias("centre")), "near-centres")
    moved = every.join(centres, ["hub", "band"]).where("node <> centre")
    return durable(moved.select("node", F.col("centre").alias("hub")).distinct(), "near-centred")


def _deltas(open_: DataFrame, grams: DataFrame) -> DataFrame:
    """(node, hub, h, more, less, e, d): what a node's set has that its hub's of size h hasn't, and the other way, and how many."""
    hubs = open_.join(grams.select(F.col("node").alias("hub"), F.col("grams").alias("its")), "hub")
    both = hubs.join(grams, "node").select("node", "hub", F.size("its").alias("h"), F.array_except("grams", "its").alias("more"), F.array_except("its", "grams").alias("less"))
    return durable(both.withColumns({"e": F.size("more"), "d": F.size("less")}), "near-deltas")


def _tagged(grams: str, tag: int) -> Column:
    return F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(tag).alias("tag")))


#: With the deltas of two nodes to one hub, they are near if and only if 9 times the delta grams that they share is at least this.
_NEEDED = "4 * (e + other_e) + 5 * (d + other_d) - h"
_NEAR_HUB = "5 * (h - d) >= 4 * (h + e)"


def _beside_hubs(deltas: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): near pairs of different components among the nodes of each hub.

    A node x that isn't near its hub has 4 e + 5 d > h.  By _NEEDED it is near another node y of that hub only if they share
    more than (4 e + 5 d) / 9 of y's delta grams, and more than (4 e + 5 d - h) / 9 of its own.  So, in any order in which
    the grams that can be shared have their place, here the rarest first, both hold the first that they share within what is
    left of their deltas' length; and its place bounds how many more they can share.  Nodes near their hub are one component,
    so one of a pair isn't, and a gram that one component alone holds there makes no pair.  Hubs that all their nodes are near
    to, or whose nodes are one component, make no rows.  Rows are delta grams, of which a near copy has a few for each word that was changed.
    """
    out = (~F.expr(_NEAR_HUB)).alias("out")
    rooted = durable(deltas.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-beside-hubs")
    hubs = rooted.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or(out).alias("some"))
    kept = with_maybe(rooted, F.col("hub"), hubs.where("low < high and some").select(F.col("hub").alias("key"))).where("_maybe")
    tagged = F.concat(_tagged("more", 0), _tagged("less", 1))
    each = kept.select("node", "hub", "h", "e", "d", "root", out, F.explode(tagged).alias("x")).select("node", "hub", "h", "e", "d", "root", "out", "x.gram", "x.tag")
    each = durable(each, "near-each")  # read twice and made once
    times = each.groupBy("hub", "gram", "tag").agg(F.count(F.lit(1)).alias("times"), F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or("out").alias("some"))
    times = durable(times.where("low < high and some").select("hub", "gram", "tag", "times"), "near-times")
    live = each.join(times, ["hub", "gram", "tag"])
    own = Window.partitionBy("hub", "node")
    at = F.col("e") + F.col("d") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("times", "gram", "tag"))
    placed = live.withColumn("left", (F.col("e") + F.col("d") - at).cast("long"))  # delta grams after this one
    placed = durable(placed.where("left >= if(out, (4 * e + 5 * d - h) div 9, (4 * e + 5 * d) div 9)").drop("times"), "near-places")
    x = placed.where("out").drop("out")
    y = placed.where("left >= (4 * e + 5 * d) div 9").select("hub", "gram", "tag", *[F.col(c).alias(f"other_{c}") for c in ("node", "e", "d", "left", "root")])
    met = x.join(y, ["hub", "gram", "tag"]).where(f"node <> other_node and root <> other_root and 9 * (least(left, other_left) + 1) >= {_NEEDED}")
    pairs = durable(met.select("hub", "node", "other_node").distinct(), "near-beside")
    other = deltas.select("hub", *[F.col(c).alias(f"other_{c}") for c in ("node", "more", "less", "e", "d")])
    both = pairs.join(deltas, ["hub", "node"]).join(other, ["hub", "other_node"])
    shared = F.size(F.array_intersect("more", "other_more")) + F.size(F.array_intersect("less", "other_less"))
    return both.where(9 * shared >= F.expr(_NEEDED)).select(F.col("node").alias("a"), F.col("other_node").alias("b"))


def near_roots(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of linked nodes.  nodes (node, parts, plain, least: struct<unnamed, id, body>), rows (id, body, text)."""
    met = _met(nodes, WIDE, settle=False)
    crowded = durable(met.where("key is not null").select("b").distinct().toDF("node"), "near-crowded")
    pairs = met.where("a < b").select("a", "b").distinct()
    asked = crowded.union(pairs.select("a")).union(pairs.select("b")).distinct()
    grams = _grams_of(nodes, rows, asked)
    if crowded.isEmpty():
        return components(_near(pairs, grams))
    deep = durable(grams.join(crowded, "node", "left_semi").repartition("node").mapInArrow(_deep, "node long, parts array<long>, plain array<long>"), "near-deep")
    met = _met(deep, DEEP, settle=True)
    often = met.where("part >= 0").groupBy("a", "b").agg(F.count_distinct("part").alias("n")).where(f"n >= {DEEP_MEETS}")
    pairs = durable(pairs.union(often.select("a", "b")).union(met.where("part < 0 and a < b").select("a", "b")).distinct(), "near-pairs")
    near = durable(_near(pairs, grams), "near-links")
    roots = durable(components(near), "near-roots")
    open_ = _around_hubs(met.where("key is not null").select("key", F.col("b").alias("node")).distinct(), roots)
    if open_.isEmpty():
        return roots
    deltas = _deltas(_centred(open_, grams, near), grams)
    # what is joined already goes on as stars
    links = roots.toDF("a", "b").union(deltas.where(_NEAR_HUB).select(F.col("hub").alias("a"), F.col("node").alias("b")))
    if deltas.where(f"not ({_NEAR_HUB})").isEmpty():
        return components(links)
    roots = durable(components(links), "near-roots")
    return components(roots.toDF("a", "b").union(_beside_hubs(deltas, roots)))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component over near links the one with the smallest doc_id.

    A row is known by its doc_id and its text: rows that share a doc_id are decided one by one, and rows without one come
    last.  Of rows equal in both, one stays.  A null text counts as empty; texts without words are copies of each other.
    An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text")).withColumn("body", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    marks = durable(rows.select("id", "body", "text").mapInArrow(_nodes, f"id {kind}, body long, node long, parts array<long>, plain array<long>"), "near-marks")
    least = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "body"))
    nodes = durable(marks.groupBy("node").agg(least.alias("least"), F.min("parts").alias("parts"), F.min("plain").alias("plain")), "near-nodes")
    return one_of_each(docs, doc_id, text, marks, near_roots(nodes, rows))
