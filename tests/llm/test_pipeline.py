"""The registered queries against SQL, and the pipeline stage by stage against plain Python."""

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm import queries

from ..test_queries import SF, same
from .helpers import SCHEMA, WORDS, odd_rows
from .test_aligned import brute_aligned
from .test_near_copies import brute_stay


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    same(spark, con, name, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_stages(spark, tmp_path):
    SF = "/root/testdata/sf0.01"  # noqa: N806
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            assert len(gone & {d for d, t in labels.items() if t}) >= 0.9 * sum(labels.values()) and not [d for d in gone if labels.get(d) == 0]
        if name == "language":
            assert len(after) >= 0.99 * len(before)
        if name == "lines":
            want = brute_aligned([(r["doc_id"], r["text"]) for r in before])
            whole = {r["doc_id"]: r["text"] for r in before}
            assert {r["doc_id"]: r["text"] for r in after} == {d: t for d, t in want.items() if t.strip() or t == whole[d]}
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        if name == "near copies":
            rows = [(r["doc_id"], r["text"]) for r in before]
            assert sorted(r["doc_id"] for r in after) == sorted(rows[i][0] for i in brute_stay(rows))
        if name == "packing":
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            total = sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before)
            assert sum(r["length"] for r in after) == total and {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
        before = after
    assert np.isclose(len(before), corpus_pipeline.run(spark, SF).count())


def test_nameless_and_repeated_rows_in_every_stage(spark, tmp_path):
    """Rows without a doc_id and rows that share one are decided one by one, in each stage on the same table."""
    clean, toxic = [" ".join(f"{w}{i}" for w in WORDS * 2) for i in range(60)], "vile wretched filth " * 12
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)] + [(100 + i, toxic + f"v{i} w{i * 7}", "en", "s", 1) for i in range(40)]
    odd = [(None, toxic + "again", "en", "s", 1), (None, "12 34 !!", "en", "s", 8), (None, clean[3] + " tail", "en", "s", 1), (5, "56 78 !!", "en", "s", 8), (5, clean[5], "en", "s", 1), (7, "some other text of its own that nobody else has", "en", "s", 1)]
    spark.createDataFrame([(r[0], int(r[0] >= 100)) for r in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    kept = lambda stage: {(r["doc_id"], r["text"]) for r in stage(spark, docs, str(tmp_path)).collect()}
    left = kept(corpus_pipeline.drop_toxic)
    assert {t for _, t in left} >= {*clean, "12 34 !!"} and not any("vile" in t for _, t in left) and (7, odd[5][1]) in left
    left = kept(corpus_pipeline.drop_unknown_language)
    assert (None, "12 34 !!") not in left and (5, "56 78 !!") not in left and {(5, clean[5]), (None, odd[2][1])} <= left
    left = kept(corpus_pipeline.drop_near_copies)
    assert {(3, clean[3]), (5, clean[5]), (5, "56 78 !!"), (7, clean[7]), (7, odd[5][1])} <= left and (None, odd[2][1]) not in left
    assert corpus_pipeline.drop_repeated_lines(spark, docs, "").where("doc_id is null").count() == 3
    packed = corpus_pipeline.pack(spark, docs, "").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in rows + odd}


def test_odd_rows_pass_every_stage(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
    assert docs.count() > 0
    nothing = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
