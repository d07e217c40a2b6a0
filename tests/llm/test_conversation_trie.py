"""The trie against a dictionary of prefixes, and parentheses against a stack."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import conversation_trie
from plumbline.llm.parentheses import of_depths

SCHEMA = "conv_id long, turn long, role string, text string"
SMALL = "/root/testdata/sf0.01"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            own[c].append((role or "", text or ""))
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(turns[d - 1])
        ends[tuple(turns)].append(c)
    out, leaves, saved = [], defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        saved[p] += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        leaves[p] += not kids[p]
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
        ids = ",".join(map(str, sorted(ends[p])))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, shuffle=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in conversation_trie.trie(df.repartition(shuffle) if shuffle else df).collect()), key=repr)


@pytest.fixture
def partitions(spark):
    """So many shuffle partitions, and so shards, as a test asks for."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=900), st.booleans())
def test_parentheses(wishes, last):
    depths = [3]
    for w in wishes:
        depths.append(min(depths[-1] + 1, w) if w % 3 else depths[-1] + 1)
    shape, opens = of_depths(np.array(depths, "i8"), last)
    stack, closes, pairs, n = [], [-1] * len(depths), [], 0
    at = {int(p): i for i, p in enumerate(opens)}
    for p, bit in enumerate(shape.bits.tolist()):
        if bit:
            stack.append(at[p])
            n += 1
        elif stack:
            closes[stack.pop()] = p
        pairs.append(bit and p + 1 < len(shape.bits) and not shape.bits[p + 1])
        assert shape.rank(np.array([p]))[0] == n
    assert shape.find_close(opens).tolist() == closes
    assert shape.leaf_rank(np.arange(len(shape.bits))).tolist() == np.cumsum(pairs).tolist()


def test_long_sequence():
    """Closing over many blocks: a comb, a chain, and a bush."""
    for depths in ([0] + [1, 2] * 3000, list(range(5000)) + [1] * 5, [0] + [1] * 4000):
        shape, opens = of_depths(np.array(depths, "i8"), True)
        close = shape.find_close(opens)
        for i in (0, 1, len(depths) // 2, len(depths) - 1):
            after = next((j for j in range(i + 1, len(depths)) if depths[j] <= depths[i]), None)
            assert close[i] == (-1 if after is None and i < len(depths) - 1 else close[i])
            if after is not None:
                assert shape.rank(close[i : i + 1])[0] == after


def conversations(seed, convs=120, most=7, kinds=2):
    rng = random.Random(seed)
    return [(c, t if rng.random() > 0.05 else None, "user" if t % 2 == 0 else "assistant", "w " * rng.randrange(kinds) + f"{rng.randrange(kinds)}") for c in range(convs) for t in range(rng.randint(1, most))]


def one_null_turn(rows):
    """At most one turn of a conversation is null, so that the order is defined."""
    seen, out = set(), []
    for c, t, r, x in rows:
        out.append((c, t if t is not None or c not in seen else 99, r, x))
        seen |= {c} if t is None else set()
    return out


@pytest.mark.parametrize("seed,shards", [(1, 1), (2, 4), (3, 40), (4, 90)])
def test_random_conversations(spark, partitions, seed, shards):
    rows = one_null_turn(conversations(seed))
    partitions(shards)
    assert got(spark, rows, 3) == brute(rows)


def test_odd_rows(spark, partitions):
    partitions(5)
    rows = [(0, 1, None, None), (0, 0, "user", ""), (3, None, "user", "a b"), (3, 5, None, "c"), (None, 1, "user", "lost"), (None, None, None, None), (21, 0, "user", "x"), (45, 0, "user", None),
            (7, 0, "user", "same"), (7, 1, "user", "same"), (7, 2, "user", "same"), (8, 0, "a\x1fb", "c"), (9, 0, "a", "\x1fbc"), (10, 1, "user", " \t\n\x0b x ")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows + rows[8:11]) == brute(rows + rows[8:11])  # repeated rows are turns each
    assert got(spark, []) == []
    assert got(spark, [(None, 0, "user", "x")]) == []


def test_hot_groups(spark, partitions):
    """A third of all rows in one conversation, whose turns several tasks number; many copies of one conversation."""
    partitions(16)
    rows = [(40, t, "user", f"word {t}") for t in range(700)] + [(c, t, "user", f"same {t}") for c in range(100, 300) for t in range(3)] + one_null_turn(conversations(9, 90))[:400]
    rows = [r for r in rows if r[0] != 40 or r[3].startswith("word")]
    assert got(spark, rows, 5) == brute(rows)
    twice = [*rows, *[(59, t, "user", f"word {t}") for t in range(650)]]  # a long copy: one chain of many turns
    twice = [r for r in twice if r[0] != 59 or r[3].startswith("word")]
    assert got(spark, twice, 5) == brute(twice)


def test_end_digests(spark, partitions):
    partitions(9)
    rows = [(1, 2, c) for c in range(2000)] + [(5, 2, 70000), (5, 3, 8)]
    df = spark.createDataFrame(rows, "owner long, d long, conv_id long")
    found = {(r["owner"], r["d"]): r["sha"] for r in conversation_trie.end_digests(df).collect()}
    want = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in {(1, 2): ",".join(map(str, range(2000))), (5, 2): "70000", (5, 3): "8"}.items()}
    assert found == want


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SMALL}/conversations.parquet')")
    want = sorted(con.execute(conversation_trie.ORACLE).fetchall(), key=repr)
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    found = sorted((tuple(r) for r in conversation_trie.trie(df.selectExpr("*", "1 as depth", "'x' as size", "2 as n")).collect()), key=repr)
    assert found == want == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
