"""Importance resampling of a corpus towards a target distribution of hashed word runs.

Features are runs of 1 to `longest` consecutive words; a feature's bucket is its CRC-32 modulo the number of buckets.  The
CRCs come from one scan of each document (prefixcrc.py).  A bucket's gain is the logarithm of how much likelier the target
makes it than the corpus, a document's weight the sum of its features' gains, and Gumbel noise that its doc_id decides,
added to the weight, makes the highest scores a sample without replacement in proportion to the weights' exponentials.

Buckets of a document are written once, two bytes a feature; counts and weights read those and never the texts again.
The driver sees the counts of the buckets, whose number is a parameter.  Ranks come from sampled ranges of the scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shipping import ship_package
from plumbline.llm.common import durable, hold_nothing, in_order
from plumbline.llm.prefixcrc import POLYNOMIAL, blocks, bytes_of, words

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
LEAST_WORDS, PERCENT = 20, 10


def _classes() -> np.ndarray:
    """Digits, letters and all bytes of other characters stay; A-Z are lower-cased; everything else separates."""
    table = np.full(256, 0x20, "u1")
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


CLASSES = _classes()


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """Per row: doc_id, n_words, n_features, buckets (binary: the little-endian bucket of every feature).  A null text has none."""
    ship_package(docs.sparkSession)
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_nothing()
        for piece in (p for batch in batches for p in blocks(batch, "text")):
            found = words(*bytes_of(piece.column("text")), CLASSES)
            made = [found.crcs(n) for n in range(1, longest + 1)]
            crc, of = (np.concatenate(x) for x in zip(*made, strict=True))
            if longest > 1:
                order = np.argsort(of, kind="stable")
                crc, of = crc[order], of[order]
            count = np.bincount(of, minlength=piece.num_rows)
            held = (crc % np.uint32(buckets)).astype(kind)
            ends = np.concatenate([[0], np.cumsum(count)]) * held.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), piece.num_rows, [None, pa.py_buffer(ends.astype("i8")), pa.py_buffer(held)])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found.per_text), pa.array(count), packed.cast(pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, buckets binary")


def bucket_counts(held: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a features() table fall into each bucket; every task adds up its own first."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "i8")
        for batch in batches:
            total += np.bincount(bytes_of(batch.column("buckets"))[0].view(kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, "i8")
    for r in held.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of the ratio of both smoothed shares, rounded down."""
    b, t_all, s_all = float(len(corpus)), float(target.sum()), float(corpus.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for t, s in zip(target.tolist(), corpus.tolist(), strict=True)], "i8")


def weights(held: DataFrame, gain: np.ndarray) -> DataFrame:
    """Per row of a features() table: doc_id, n_words, n_features, weight."""
    kind = _kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("buckets"))
            upto = np.concatenate([np.zeros(1, "i8"), np.cumsum(gain[data.view(kind)])])
            ends = offsets // np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(upto[ends[1:]] - upto[ends[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    return held.mapInArrow(run, f"doc_id {held.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST,
    buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """Per row: doc_id, n_features, weight, score, and rank among the drawn (1, 2, 3, ... by falling score), else null.

    Drawn are floor(percent * N / 100) of the N rows with least_words words at least, ties to the smaller doc_id, rows
    without a doc_id last; their noise is that of an empty doc_id.  A null or empty text has no features and weight 0.
    Repeated rows count, and are drawn, each by itself; equal rows take ranks next to each other.  An empty target or
    corpus counts as no features.  Other columns are ignored, so their names can't clash.  An empty table gives an empty
    result.
    """
    held = durable(features(docs, doc_id, text, longest, buckets), "resample-features")
    aimed = features(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")), "doc_id", "text", longest, buckets)
    scored = weights(held, gains(bucket_counts(aimed, buckets), bucket_counts(held, buckets)))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = durable(scored.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), "resample-scores")
    enough = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    placed, starts = in_order(scored.where(enough), order, "resample-order")
    most = percent * sum(n for _, n in starts.values()) // 100
    row_place = F.col("_at") + 1
    if starts:
        first = F.broadcast(docs.sparkSession.createDataFrame([(r, s) for r, (s, _) in starts.items()], "_range int, _start long"))
        placed, row_place = placed.join(first, "_range"), row_place + F.col("_start")
    rank = F.when(row_place <= most, row_place).cast("long").alias("rank")
    out = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*out, rank).unionByName(scored.where(~enough).select(*out, F.lit(None).cast("long").alias("rank")))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words_sql(table: str) -> str:
    return f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM {table}"


#: CRC-32 bit by bit over each distinct word's bytes.
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_words_sql('documents')}),
bw AS (SELECT unnest(words) AS word FROM (SELECT {_words_sql('benchmark')})),
dw AS (SELECT row, unnest(words) AS word FROM d),
vocabulary AS (SELECT word FROM dw UNION SELECT word FROM bw),
coded AS (
  SELECT word, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))::BIGINT), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda r, x: list_reduce(list_prepend(xor(r, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * {POLYNOMIAL})))) % {BUCKETS} AS bucket
  FROM vocabulary),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN coded USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN coded USING (word) GROUP BY bucket),
gain AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS})::DOUBLE
    / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM dw JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY row),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN w USING (row)),
ranked AS (SELECT doc_id, n_features, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n, weight, score FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < {LEAST_WORDS}
"""
