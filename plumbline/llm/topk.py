"""Exact top-k by inner product: ball-tree branch and bound in each shard.

Candidates are dealt to shards by the nearest of a few pivots, so that a shard is a ball of its own; each shard's vectors
are put into a ball tree once.  A query visits nodes in the order of their upper bound, query . centre + |query| * radius,
and stops when the bound can't reach its kth score.  Shards are nodes too: a query goes to its best shard, then to the
next four, sixteen and so on, as long as their bounds reach the kth score that it has by then, and takes that score along.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.shipping import ship_package
from plumbline.llm.common import durable

LEAF = 128
SCALE = 1024
#: Shards at most, and bytes of their centres at most, as these are sent to every executor; with more rows shards grow.
#: Pivots at least, as small tables go the same way, and at most.
MAX_SHARDS, CENTRE_BYTES, LEAST_PIVOTS, MAX_PIVOTS = 65_536, 64 << 20, 4, 1024
#: How many times as many shards a query visits from one wave to the next.
WIDER = 4


def bounds(query: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """What the query's inner product with a vector in each ball can't exceed, rounding included."""
    norm = np.sqrt((query**2).sum())
    value = centres @ query + norm * radii
    return value + 1e-9 * (np.abs(value) + norm * (np.sqrt((centres**2).sum(1)) + radii)) + 1e-6


class BallTree:
    """Nodes over integer vectors; leaves hold LEAF at most (more only of equal vectors), in a row."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        real = vectors.astype("float64")
        self.nodes: list[tuple[np.ndarray, float, tuple[int, int] | None, int, int]] = []  # centre, radius, rows of a leaf, children
        order: list[np.ndarray] = []
        todo = [(np.arange(len(ids)), -1, 0)] if len(ids) else []
        links: list[list[int]] = []
        filled = 0
        while todo:
            rows, parent, side = todo.pop()
            points = real[rows]
            centre = points.mean(0)
            far = ((points - centre) ** 2).sum(1)
            at = len(self.nodes)
            if parent >= 0:
                links[parent][side] = at
            links.append([-1, -1])
            if len(rows) > LEAF and far.max() > 0:
                a = points[far.argmax()]
                b = points[((points - a) ** 2).sum(1).argmax()]
                along = np.argsort(points @ (a - b), kind="stable")
                half = len(rows) // 2
                self.nodes.append((centre, float(np.sqrt(far.max())), None, -1, -1))
                todo += [(rows[along[:half]], at, 0), (rows[along[half:]], at, 1)]
            else:
                self.nodes.append((centre, float(np.sqrt(far.max())), (filled, filled + len(rows)), -1, -1))
                order.append(rows)
                filled += len(rows)
        self.nodes = [(c, r, rows, *links[i]) for i, (c, r, rows, _, _) in enumerate(self.nodes)]
        placed = np.concatenate(order) if order else np.arange(0)
        self.ids, self.vectors, self.real = ids[placed], vectors[placed], real[placed]
        self.centres, self.radii = np.array([n[0] for n in self.nodes]), np.array([n[1] for n in self.nodes])
        self.most = float(np.abs(self.real).max(initial=0))

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, -id) but `own`, none below floor, best first; ties go to smaller ids."""
        real = query.astype("float64")
        norm = float(np.sqrt((real**2).sum()))
        exact = len(query) * max(norm, self.most, 1.0) * max(1.0, self.most) < 2**52
        best: list[tuple[int, int]] = []  # a heap, the least first
        reach = bounds(real, self.centres, self.radii).tolist() if self.nodes else []
        queue = [(-reach[0], 0)] if self.nodes else []
        while queue:
            top, i = heapq.heappop(queue)
            least = best[0][0] if len(best) == k else floor
            if least is not None and -top < least:
                break
            _, _, rows, left, right = self.nodes[i]
            if rows is None:
                for child in (left, right):
                    if least is None or reach[child] >= least:
                        heapq.heappush(queue, (-reach[child], child))
                continue
            low, high = rows
            if exact:
                scores = self.real[low:high] @ real
            else:
                scores = np.array([sum(int(x) * int(y) for x, y in zip(v, query, strict=True)) for v in self.vectors[low:high]], object)
            near = np.flatnonzero(scores >= least) if least is not None else np.arange(high - low)
            near = near[self.ids[low + near] != own]
            if len(near) > k:
                near = near[np.lexsort((self.ids[low + near], -scores[near]))[:k]]
            for j in near.tolist():
                item = (int(scores[j]), -int(self.ids[low + j]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return sorted(best, reverse=True)


def integer_vectors(embeddings: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and floor(SCALE * component), components as double; without ids or vectors that are null, empty or not finite."""
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & sound).select("vec_id", F.transform("x", lambda x: F.floor(x * SCALE)).alias("x"))


def _nearest(x: pd.Series, pivots: dict[int, np.ndarray]) -> pd.Series:
    out = np.zeros(len(x), "int64")
    sizes = x.map(len).to_numpy()
    for size in np.unique(sizes):
        mine = np.flatnonzero(sizes == size)
        points, near = np.stack(x.iloc[mine].to_numpy()).astype("float64"), pivots[int(size)]
        out[mine] = ((near**2).sum(1)[None, :] - 2 * points @ near.T).argmin(1)
    return pd.Series(out)


def _tree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    tree = BallTree(rows["vec_id"].to_numpy("int64"), np.stack(rows["x"].to_numpy()).astype("int64"))
    centre, radius = tree.nodes[0][:2]
    return pd.DataFrame({"size": [key[0]], "pivot": [key[1]], "part": [key[2]], "centre": [centre.astype("<f8").tobytes()], "radius": [radius], "tree": [pickle.dumps(tree)]})


def _answers(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    found = []
    for blob in left["tree"] if len(right) else []:
        tree = pickle.loads(blob)
        for q in right.itertuples():
            floor = None if pd.isna(q.floor) else int(q.floor)
            found += [(q.vec_id, -i, s) for s, i in tree.search(np.asarray(q.x, "int64"), q.vec_id, k, floor)]
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")


def shard_trees(base: DataFrame, shard_rows: int) -> DataFrame:
    """(shard, size, centre, radius, tree): a tree of each shard of base (vec_id, x), written to the shared folder."""
    spark = base.sparkSession
    counts = {r["size"]: r["count"] for r in base.groupBy(F.size("x").alias("size")).count().collect()}  # a row for each length of vectors
    most = max(1, min(MAX_SHARDS, CENTRE_BYTES // (8 * max(counts, default=1))))
    shard_rows = max(shard_rows, 2 * -(-sum(counts.values()) // most))
    wanted = {size: max(LEAST_PIVOTS, min(n // shard_rows, MAX_PIVOTS)) for size, n in counts.items()}
    # one vector of each bucket of ids, by hash order: each task keeps one of each, and no task gets all
    room = F.create_map(*[F.lit(v) for pair in wanted.items() for v in pair])[F.size("x")] if wanted else F.lit(1)
    drawn = base.select(F.size("x").alias("size"), F.pmod(F.xxhash64("vec_id"), room).alias("bucket"), F.struct(F.xxhash64(F.col("vec_id") + 1).alias("at"), "vec_id", "x").alias("its"))
    first = drawn.groupBy("size", "bucket").agg(F.min("its").alias("its")).select("size", "its.x", "its.vec_id").orderBy("size", "vec_id")
    pivots: dict[int, list] = {}
    for r in first.select("size", "x").collect():
        pivots.setdefault(r["size"], []).append(r["x"])
    shared = spark.sparkContext.broadcast({size: np.array(x, "float64") for size, x in pivots.items()})
    nearest = F.pandas_udf(lambda x: _nearest(x, shared.value), "long")
    placed = durable(base.select("vec_id", "x", F.size("x").alias("size"), nearest("x").alias("pivot")), "placed")
    # a pivot with many vectors, equal ones perhaps, has several shards
    parts = placed.groupBy("size", "pivot").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))
    dealt = placed.join(F.broadcast(parts), ["size", "pivot"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    trees = dealt.groupBy("size", "pivot", "part").applyInPandas(_tree, "size int, pivot long, part long, centre binary, radius double, tree binary")
    return durable(trees.withColumn("shard", F.xxhash64("size", "pivot", "part")), "trees")


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 2_000, query_rows: int = 2_000, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all rows but its own id.

    Fewer than k if there are fewer; ties go to the smaller vec_id.  Vectors that are null, empty, or hold null or
    non-finite components take no part; vectors of another length than the query's aren't scored.  Rows that repeat a
    vec_id and vector are candidates each, and as queries one.  A shard holds about shard_rows candidates (more beyond half of MAX_SHARDS, or of CENTRE_BYTES) and meets
    query_rows queries at a time.  Scores have to fit a long.  Other columns are ignored, so their names can't clash.
    Empty tables give an empty result.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    repeated = integer_vectors(embeddings, vec_id, vector).groupBy("vec_id", "x").agg(F.count(F.lit(1)).alias("n"))
    copies = F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")))  # more than k copies of a row can't be among k
    base = durable(repeated.select("vec_id", "x", copies.alias("_copy")).drop("_copy"), "vectors")
    asked = durable(integer_vectors(queries, vec_id, vector).dropDuplicates(["vec_id", "x"]), "queries")
    trees = shard_trees(base, shard_rows)
    balls = trees.select("shard", "size", "centre", "radius").orderBy("shard").collect()  # MAX_SHARDS at most
    table = {}
    for size in {b["size"] for b in balls}:
        mine = [b for b in balls if b["size"] == size]
        table[size] = np.array([b["shard"] for b in mine]), np.stack([np.frombuffer(b["centre"], "<f8") for b in mine]), np.array([b["radius"] for b in mine])
    shared = spark.sparkContext.broadcast(table)

    def visits(low: int, high: int):
        """To which shards, from the low-th best on, a query goes next."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = []
                for q in batch.itertuples():
                    shards, centres, radii = shared.value.get(len(q.x), (np.zeros(0, "int64"), np.zeros((0, len(q.x))), np.zeros(0)))
                    reach = bounds(np.asarray(q.x, "float64"), centres, radii)
                    best = np.argsort(-reach, kind="stable")[low:high]
                    if not pd.isna(q.floor):
                        best = best[reach[best] >= q.floor]
                    found += [(s, q.vec_id, q.x, q.floor) for s in shards[best].tolist()]
                out = pd.DataFrame(found, columns=["shard", "vec_id", "x", "floor"])
                yield out.astype({"floor": "Int64"})

        return run

    best = None
    low, high = 0, 1
    while low < len(balls):
        if best is None:
            known = asked.withColumn("floor", F.lit(None).cast("long"))
        else:
            floors = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
            known = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").drop("query_id")
        pairs = durable(known.mapInPandas(visits(low, high), "shard long, vec_id long, x array<long>, floor long"), "visits")
        if pairs.isEmpty():
            break
        parts = durable(pairs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("blocks")), "blocks")
        dealt = pairs.join(parts, "shard").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).drop("blocks")
        copies = trees.select("shard", "tree").join(parts, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        more = copies.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(lambda left, right: _answers(left, right, k), "query_id long, vec_id long, score long")
        every = more if best is None else best.select("query_id", "vec_id", "score").union(more)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = durable(every.withColumn("rank", rank).where(F.col("rank") <= k), "best")  # Spark keeps k a query in each task before it shuffles
        low, high = high, high + (high - low) * WIDER
    if best is None:
        best = spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    return best.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
