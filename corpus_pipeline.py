"""The corpus pipeline: reject toxic documents, reject texts in no known language, delete repeated lines, keep one of each
group of near copies, pack what is left into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
rereads as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.values import col
from plumbline.llm import language_id, line_dedup, near_copies, packing, toxicity
from plumbline.llm.common import durable, give_back, table, without

#: A document goes if the model holds it likelier than not that its grade is above 0.
TOXIC_FROM = 0.5
#: A document goes if its best language has less than this share of its words: no language carries it.
LEAST_LANGUAGE_SCORE = 0.4


def _row_key() -> Column:
    """What a row is known by: its doc_id, or that it has none, and its text.  Never null; equal rows share a decision."""
    name = F.when(F.col("doc_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("doc_id").cast("string")))
    return F.concat(name, F.lit(":"), F.hex(F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))


def _kept(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose key is in `gone` (column doc_id)."""
    whole = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), _row_key().alias("key"))
    return without(whole, gone.select(F.col("doc_id").alias("key")), ["key"]).select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_row_key().alias("doc_id"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are likelier toxic than not; the model is fitted on docs and the table of labels.

    A null or empty text has no words and stays.  Rows without a doc_id and rows that share one are decided one by one by
    their texts, equal rows alike.  Without labels of both kinds nothing goes.  An empty table gives an empty result.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    give_back()  # the driver's share of the fit
    graded = toxicity.predict(_keyed(docs), model)
    return _kept(docs, durable(graded.where(F.col("p_toxic") >= TOXIC_FROM).select("doc_id"), "toxic"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of no language that the table names: texts without letters, null and empty ones among them, and
    texts of whose words no language has LEAST_LANGUAGE_SCORE.

    Rows without a doc_id and rows that share one are decided one by one by their texts, equal rows alike.  If no row
    names a language every document goes.  An empty table gives an empty result.
    """
    model = language_id.fit(docs, learn_from=~language_id.held_out("doc_id"))
    give_back()
    found = language_id.predict(_keyed(docs), model)
    out = (F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < LEAST_LANGUAGE_SCORE)
    return _kept(docs, durable(found.where(out).select("doc_id"), "language"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose passages that they share with an earlier document; n_chars follows; documents that lose every word go.

    Null and empty texts, and rows without a doc_id, stay as they are; rows that share a doc_id are one document's and
    leave each other's lines alone.  An empty table gives an empty result.
    """
    out = line_dedup.cleaned(docs, aligned=True)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id; those without one come last.

    Rows that share a doc_id are decided one by one; of rows equal in doc_id and text one stays.  Texts without words,
    null ones among them, are copies of each other.  An empty table gives an empty result.
    """
    return near_copies.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in training sequences, cut where it has to be; a null text counts as empty: the end's id alone.

    Rows without a doc_id and repeated rows are packed each.  An empty table gives an empty result.
    """
    return packing.digests(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("lines", drop_repeated_lines),
    ("near copies", drop_near_copies),
    ("packing", pack),
]

#: SQL can't express the fitted models, the alignment, the components or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
