"""Resampling against a plain reading: zlib on every word run, one sort, and the prefix CRCs against zlib."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import resampling
from plumbline.llm.prefixcrc import blocks, bytes_of, words

from .helpers import SCHEMA, clashing, empty, odd, prose

SMALL = "/root/testdata/sf0.01"


def brute_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_runs(text, longest):
    w = brute_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, longest=1, buckets=10_000, least=20, percent=10):
    made = [(d, [c % buckets for c in brute_runs(t, longest)], len(brute_words(t))) for d, t in rows]
    s, t = Counter(b for _, x, _ in made for b in x), Counter(c % buckets for x in target for c in brute_runs(x, longest))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in s}
    out = []
    for d, x, n in made:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        out.append((d, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    k = percent * len(drawn) // 100
    ranked = [(*r[:4], i + 1 if i < k else None) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in out if not r[4]]
    return sorted(ranked, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=8), st.integers(1, 4))
def test_run_crcs(texts, longest):
    found = words(*bytes_of(pa.array(texts, pa.string())), resampling.CLASSES)
    for n in range(1, longest + 1):
        crc, of = found.crcs(n)
        for i, t in enumerate(texts):
            w = brute_words(t)
            assert crc[of == i].tolist() == [zlib.crc32(" ".join(w[k : k + n]).encode()) for k in range(len(w) - n + 1)]
            assert found.per_text[i] == len(w)


def test_long_words_and_lanes():
    """Words and runs over many lanes of the scan, beside texts of a byte."""
    texts = ["x" * 5000 + " " + "é" * 3000, "a", "", " ".join(prose(s, 900) for s in range(3)), "--"]
    found = words(*bytes_of(pa.array(texts)), resampling.CLASSES)
    for n in (1, 2, 700):
        crc, of = found.crcs(n)
        want = [(zlib.crc32(" ".join(w[k : k + n]).encode()), i) for i, t in enumerate(texts) for w in [brute_words(t)] for k in range(len(w) - n + 1)]
        assert list(zip(crc.tolist(), of.tolist(), strict=True)) == want


def test_blocks():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 50, "d", "", "e"])], ["text"])
    assert [p.num_rows for p in blocks(batch, "text", 3)] == [2, 1, 3]
    assert sum(p.num_rows for p in blocks(batch.slice(1, 4), "text", 3)) == 4


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 97), (2, 100_000)])
def test_odd_rows(spark, longest, buckets):
    docs = odd(spark).union(spark.createDataFrame([(None, prose(1, 40), None, None, None), (None, prose(1, 40), None, None, None)], SCHEMA))
    target = spark.createDataFrame([("river bends8 near an old mill",), (None,), ("",)], "text string")
    found = resampling.resample(clashing(docs, "score", "rank", "weight", "_range", "_at", "buckets"), target, longest=longest, buckets=buckets)
    assert got(found) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], longest, buckets)


def test_whole_share_and_ties(spark):
    """A third of the rows are one row; all ranks are given once."""
    docs = spark.createDataFrame([(7, prose(3, 30)) for _ in range(60)] + [(i, prose(i, 25)) for i in range(100, 220)], "doc_id long, text string")
    found = resampling.resample(docs, docs.limit(3), percent=100).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 181))
    spread = sorted(r["rank"] for r in found if r["doc_id"] == 7)
    assert spread == list(range(spread[0], spread[0] + 60))


def test_empty_tables(spark):
    assert resampling.resample(empty(spark), empty(spark)).collect() == []
    alone = resampling.resample(odd(spark), empty(spark))
    assert got(alone) == brute([(r["doc_id"], r["text"]) for r in odd(spark).collect()], [])


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    docs, target = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    found = got(resampling.resample(docs, target))
    assert found == sorted(con.execute(resampling.ORACLE).fetchall(), key=repr)
    assert found == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])


def test_drawn_texts_are_nearer_the_target(spark):
    docs = spark.createDataFrame([(i, " ".join((["salt", "pepper"] if i % 4 == 0 else ["stone", "timber"])[(i + k) % 2] + str(k % 5) for k in range(30))) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(f"{w}{k}" for k in range(5) for w in ("salt", "pepper")),)], "text string")
    drawn = resampling.resample(docs, target).where("rank is not null").collect()
    assert len(drawn) == 40 and np.mean([r["doc_id"] % 4 == 0 for r in drawn]) > 0.9
