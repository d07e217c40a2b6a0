"""SimHash, top-k, line dedup."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, simhash, topk
from plumbline.llm.components import components

from .helpers import clashing, empty, odd, odd_rows, prose


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    array = np.array(prints, "u8")
    for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(array[:, None] ^ array[None, :]) <= 3, 1)), strict=True):
        parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_by_brute_force(spark):
    near = [(1000 + i, prose(3, 400) + f" extra{i}", "en", "s", 1) for i in range(30)]
    rows = odd_rows() + near
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = simhash.simhash_components(clashing(df, "fp", "key", "component_id", "least", "root")).collect()
    prints = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(prints)
    least = {}
    for (doc, *_), root in zip(rows, roots, strict=True):
        least[root] = min(doc, least.get(root, doc))
    want = Counter((doc, f"{p:016x}", least[root]) for (doc, *_), p, root in zip(rows, prints, roots, strict=True))
    assert Counter(tuple(r) for r in got) == want
    assert simhash.simhash_components(empty(spark)).count() == 0
    stay = simhash.near_dedup(clashing(df, "_x")).collect()
    assert sorted(r["doc_id"] for r in stay) == sorted(set(least.values()))


@pytest.mark.parametrize("width", [8, 16, 64])
def test_dense_balls(spark, width):
    """Many fingerprints near each other, within one block or over all: the same components as all pairs give."""
    rng = np.random.default_rng(width)
    base = [int(x) for x in rng.integers(0, 2**64, 12, dtype="u8")]
    prints = list(base)
    for b in base:
        for _ in range(25):
            x = b
            for bit in rng.choice(width, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit + (64 - width) * (b & 1))
            prints.append(x)
    prints += [base[0] ^ int(i) for i in range(600)]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(int(np.array([p], "u8").view("i8")[0]),) for p in prints], "fp long")
    links = simhash.near_links(df).collect()
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 3 for r in links)
    root = {r["node"] & (2**64 - 1): r["root"] for r in components(simhash.near_links(df)).collect()}
    mine, want = {}, {}
    for p, w in zip(prints, brute_components(prints), strict=True):
        mine.setdefault(root.get(p, ("alone", p)), []).append(p)
        want.setdefault(w, []).append(p)
    assert sorted(mine.values()) == sorted(want.values())


def test_near_dedup_decides_by_row(spark):
    a, b = prose(1, 60), " ".join(f"w{i}" for i in range(60))
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (None, a), (None, "alone among these")]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, a), (2, b), (None, "alone among these")])


def test_nameless_rows(spark):
    df = spark.createDataFrame([(None, prose(1, 60)), (None, None), (4, prose(1, 60)), (9, "alone among these words")], "doc_id long, text string")
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.simhash_components(df).collect()}
    assert sorted(got.values(), key=str) == [4, 4, 9, None] and got[None, "0" * 16] is None


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (7, 6), (7, 6)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {0} and {found[1000 + i] for i in range(50)} == {1000} and len(found) == 111
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- top-k ---------------------------------------------------------------------------------------------------------


def brute_topk(rows, k, every):
    vectors = [(i, [int(np.floor(v * 1024)) for v in x]) for i, x in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for q, x in dict(vectors).items():  # repeated queries are one, repeated candidates aren't
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in vectors if i != q and len(y) == len(x))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block", "large"), [(10_000, 1000, 1.0), (37, 3, 1.0), (50, 1000, 3e4)])
def test_topk_by_brute_force(spark, shard, block, large):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6).round(1) * large).tolist()) for i in range(300)] + [(300 + i, [0.5 * large] * 6) for i in range(150)]
    rows += [(500, None), (510, []), (520, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (530, [float("nan")] * 6), (540, [float("inf")] * 6), (550, [1.0] * 5), (560, [2.0] * 5), (None, [1.0] * 6), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(clashing(df, "x", "shard", "block", "score"), df.where("vec_id % 10 = 0"), k=7, shard_rows=shard, query_rows=block).collect()
    assert sorted(tuple(r) for r in got) == brute_topk(rows, 7, 10)


@pytest.mark.parametrize("limit", [None, 3000])
def test_repeated_candidates_by_the_sql(spark, monkeypatch, limit):
    """Rows that repeat vec_id and vector are candidates each, many of them too; centres keep to their bytes."""
    if limit:
        monkeypatch.setattr(topk, "CENTRE_BYTES", limit)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(250)]
    rows += [rows[7]] * 3 + [rows[31]] * 40 + [(31, [0.5, 0.25, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = sorted(con.execute(topk.ORACLE).fetchall())
    assert sorted(tuple(r) for r in topk.top_k(df.repartition(3), df.where("vec_id % 100 = 0"), shard_rows=20).collect()) == want
    balls = topk.shard_trees(df.withColumn("x", F.transform("embedding", lambda v: F.floor(v * 1024))).select("vec_id", "x"), 20).count()
    assert balls <= (limit // 32 if limit else 40)


def test_topk_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_the_tree_skips_what_cannot_reach_the_kth_score():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(2000, 4)), rng.normal(size=(2000, 4)) + 9]).round(2) * 1024
    tree = topk.BallTree(np.arange(4000), points.astype("int64"))
    seen = []

    class Counting(list):
        def __getitem__(self, i):
            seen.append(i)
            return list.__getitem__(self, i)

    tree.nodes = Counting(tree.nodes)
    tree.search(np.array([1024] * 4), -1, 10, None)
    assert len(set(seen)) < len(tree.nodes) / 2


# --- line dedup ----------------------------------------------------------------------------------------------------


def brute_line_dedup(rows, least=10):
    """Every line against every earlier document; a run of lines that earlier documents hold goes if it has enough words."""
    split = lambda t: [(i, " ".join(x.split())) for i, x in enumerate((t or "").split("\n")) if x.split()]
    out, holder = {}, {}
    for doc, text in rows:
        for _, line in split(text):
            holder[line] = min(doc, holder.get(line, doc))
    for doc, text in rows:
        gone, run, words = set(), [], 0
        for place, line in [*split(text), (None, None)]:
            if line is not None and holder[line] < doc:
                run.append(place)
                words += len(line.split())
            else:
                gone |= set(run) if words >= least else set()
                run, words = [], 0
        out[doc] = text if not gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def line_docs():
    rng = np.random.default_rng(2)
    lines = [prose(i, int(rng.integers(2, 20))) for i in range(60)] + ["Of.", "And so.", ""]
    docs = []
    for d in range(120):
        own = [prose(1000 + d * 7 + i, 12) for i in range(3)]
        body = own + [lines[j] for j in rng.integers(0, len(lines), rng.integers(0, 12))]
        rng.shuffle(body)
        docs.append((d, "\n".join(body)))
    docs += [(500, docs[3][1]), (501, docs[3][1]), (502, None), (503, "")]
    return docs


def test_line_dedup_by_brute_force(spark):
    docs = line_docs()
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"), "row", "id", "body", "blocks", "hash", "line", "place")
    got = {r["row"]["doc_id"]: r for r in line_dedup.drop_repeated_lines(df).collect()}
    want = brute_line_dedup(docs)
    assert {d: r["row"]["text"] for d, r in got.items()} == want
    assert got[502]["row"]["text"] is None and got[503]["row"]["text"] == "" and got[500]["row"]["body"] == "x"
    kept = {r["doc_id"] for r in line_dedup.cleaned(df).collect()}
    assert kept == {d for d, t in want.items() if not (got[d]["blocks"] and not t.strip())} and 501 not in kept


def test_line_dedup_odd_rows(spark):
    rows = line_dedup.summary(odd(spark)).collect()
    want = brute_line_dedup([(d, t) for d, t, *_ in odd_rows()])
    assert Counter((r["doc_id"], r["text_sha256"]) for r in rows) == Counter((d, hashlib.sha256((want[d] or "").encode()).hexdigest()) for d, *_ in odd_rows())
    assert line_dedup.summary(empty(spark)).count() == 0
    nameless = spark.createDataFrame([(None, prose(1, 30)), (1, prose(1, 30)), (2, prose(1, 30))], "doc_id long, text string")
    assert Counter(r["deleted_lines"] for r in line_dedup.summary(nameless).collect()) == {0: 2, 1: 1}


def test_patience_alignment():
    assert line_dedup.patience_chain([(0, 5), (1, 2), (2, 3), (3, 9), (4, 4)]) == [(1, 2), (2, 3), (4, 4)]
    chains = line_dedup.align([(0, 5), (1, 0), (2, 1), (3, 2), (4, 2)])
    assert chains[0] == [(1, 0), (2, 1)] and sorted(p for c in chains for p in c) == [(0, 5), (1, 0), (2, 1), (3, 2), (4, 2)]


def test_hot_lines_give_no_pairs(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(prose(1, 15) + "\n"), F.lit("unlike "), F.col("id").cast("string")).alias("text"))
    assert line_dedup.repeated_blocks(df).select(F.size("blocks")).distinct().collect()[0][0] == 1
    assert line_dedup.summary(df).where("deleted_lines = 1 and first_source = 0").count() == 2999
