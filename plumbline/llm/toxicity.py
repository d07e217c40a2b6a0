"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - score): one weight vector, shared by all thresholds, and ordered thresholds.
A document's score is the mean over its words of the summed weights of the word's features, so a word's share of the
text counts and not the text's length.  Result: expected severity, the sum over grades of grade times probability.

Labels say toxic or not.  The grades above 0 are made from them: a first fit with one threshold scores the labelled toxic
documents, and thirds of that score are grades 1, 2 and 3 (the more of a document's words are such as clean documents
don't use, the more severe).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.shipping import ship_package
from plumbline.llm.common import held_by_worker, text_or_empty
from plumbline.llm.wordfeatures import WordScores, blocks, features, words_of

BITS = 18
PREFIXES, SUFFIXES, GRAMS = (3, 4, 5, 6), (3,), ()
SCALE = 100.0
#: Added to a document's number of words, so that one word of a very short text doesn't decide alone.
PRIOR_WORDS = 5
BLOCK_WORDS = 100_000


@dataclass
class Model:
    weights: np.ndarray  # float32, 2**BITS
    thresholds: np.ndarray  # ordered, one less than grades


def word_weights(words: list[str], weights: np.ndarray) -> np.ndarray:
    feature, word = features(words, BITS, PREFIXES, SUFFIXES, GRAMS)
    return np.bincount(word, weights[feature], len(words))


def _log_loss(score: np.ndarray, grade: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row: probability, d(-log p)/d(score), and of the upper and lower cut the logistic slope over p."""
    edge = np.concatenate([[-np.inf], cuts, [np.inf]])
    hi, lo = 1 / (1 + np.exp(-np.clip(edge[grade + 1] - score, -40, 40))), 1 / (1 + np.exp(-np.clip(edge[grade] - score, -40, 40)))
    hi, lo = np.where(grade == len(cuts), 1.0, hi), np.where(grade == 0, 0.0, lo)
    p = np.maximum(hi - lo, 1e-12)
    up, down = hi * (1 - hi) / p, lo * (1 - lo) / p
    return p, up - down, up, down


def _telling(docs: list[tuple[np.ndarray, np.ndarray]], table: tuple[np.ndarray, np.ndarray, int], toxic: np.ndarray, least_gain: float) -> np.ndarray:
    """Which features' documents are toxic so much more or less often than others that chance won't explain it.

    By the log-likelihood ratio of two proportions; 8 is about one in 200 by chance.
    """
    feature, word, n_words = table
    order = np.argsort(word, kind="stable")
    bounds = np.searchsorted(word[order], np.arange(n_words + 1))
    with_it = np.zeros((2, 1 << BITS))
    for (words, _), c in zip(docs, toxic, strict=True):
        if len(words):
            spans = [order[bounds[i] : bounds[i + 1]] for i in words]
            with_it[c, np.unique(feature[np.concatenate(spans)])] += 1
    n = np.bincount(toxic, minlength=2).astype("float64")
    gain, total = np.zeros(1 << BITS), with_it.sum(0)
    for c in (0, 1):
        for seen, expected in ((with_it[c], total * n[c] / n.sum()), (n[c] - with_it[c], (n.sum() - total) * n[c] / n.sum())):
            gain += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    return gain >= least_gain


def _fit(docs: list[tuple[np.ndarray, np.ndarray]], table: tuple[np.ndarray, np.ndarray, int], grade: np.ndarray, weight: np.ndarray, telling: np.ndarray, steps: int, penalty: float) -> Model:
    """Adam on the penalised log loss.  docs: (word places, counts) each; table: (feature, word) pairs and number of words."""
    feature, word, n_words = table
    doc = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
    place = np.concatenate([d[0] for d in docs]).astype("int64")
    feature, word = feature[telling[feature]], word[telling[feature]]
    used, local = np.unique(feature, return_inverse=True)
    share = np.concatenate([d[1] * (SCALE / (d[1].sum() + PRIOR_WORDS)) for d in docs])
    k = int(grade.max())
    w = np.zeros(len(used))
    base = np.array([np.average(grade <= j, weights=weight) for j in range(k)]).clip(1e-3, 1 - 1e-3)
    logit = np.log(base / (1 - base))
    cuts = np.concatenate([logit[:1], np.log(np.maximum(np.diff(logit), 1e-2))])  # the first and the logs of the gaps
    moments = [np.zeros(len(w)), np.zeros(len(w)), np.zeros(k), np.zeros(k)]
    total = weight.sum()
    for step in range(1, steps + 1):
        at = np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])]))
        score = np.bincount(doc, share * np.bincount(word, w[local], n_words)[place], len(docs))
        _, slope, up, down = _log_loss(score, grade, at)
        pull = weight * slope / total
        gw = np.bincount(local, np.bincount(place, share * pull[doc], n_words)[word], len(w)) + penalty * w
        ga = np.zeros(k)
        np.add.at(ga, np.minimum(grade, k - 1), np.where(grade < k, -weight * up / total, 0.0))
        np.add.at(ga, np.maximum(grade - 1, 0), np.where(grade > 0, weight * down / total, 0.0))
        tail = np.cumsum(ga[::-1])[::-1]
        gc = np.concatenate([tail[:1], tail[1:] * np.exp(cuts[1:])])
        for x, g, m, v, rate in ((w, gw, moments[0], moments[1], 0.05), (cuts, gc, moments[2], moments[3], 0.05)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(1 << BITS, "float32")
    weights[used] = w
    return Model(weights, np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])])))


def sample_labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, max_fit_rows: int) -> list[tuple[str, int, float]]:
    """(text, toxic, weight) of at most max_fit_rows labelled documents, half of the room for each class, by hash order.

    Labels without a doc_id and documents without one, or without a label, are left out; equal rows count each.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    half = max_fit_rows // 2
    chosen = None
    for c in (0, 1):
        one = marks.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half)
        chosen = one if chosen is None else chosen.union(one)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    # a doc_id that repeats has several texts: of each class the first by hash again, so that the bound holds
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", "text"), "doc_id")
    held = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= half)
    return [(r["text"], r["toxic"], max(1.0, counts[r["toxic"]] / half)) for r in held.collect()]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_fit_rows: int = 6000, steps: int = 150, penalty: float = 1e-4, least_gain: float = 8.0) -> Model:
    """Fit on a sample of labelled documents, max_fit_rows at most.  Without both classes no document is held toxic."""
    return fit_rows(sorted(sample_labelled(docs, labels, doc_id, text, max_fit_rows)), steps, penalty, least_gain)


def fit_rows(rows: list[tuple[str, int, float]], steps: int, penalty: float, least_gain: float) -> Model:
    """The fit itself, of (text, toxic, weight) rows."""
    toxic = np.array([r[1] for r in rows], "int64")
    if not len(rows) or toxic.min() == toxic.max():
        return Model(np.zeros(1 << BITS, "float32"), np.array([40.0]))
    place: dict[str, int] = {}
    counted = []
    for body, _, _ in rows:
        ids, times = np.unique(np.array([place.setdefault(w, len(place)) for w in words_of(body)], "int64"), return_counts=True)
        counted.append((ids.astype("int32"), times.astype("float32")))
    table = (*features(list(place), BITS, PREFIXES, SUFFIXES, GRAMS), len(place))
    weight = np.array([r[2] for r in rows])
    telling = _telling(counted, table, toxic, least_gain)
    first = _fit(counted, table, toxic, weight, telling, steps, penalty)
    by_word = np.bincount(table[1], first.weights[table[0]], table[2])
    score = np.array([(by_word[i] * t).sum() / (t.sum() + PRIOR_WORDS) if len(i) else 0.0 for i, t in counted])
    thirds = np.quantile(score[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + np.searchsorted(thirds, score, side="left"), 0)
    _, grade = np.unique(grade, return_inverse=True)  # grades that nobody has are left out
    return _fit(counted, table, grade, weight, telling, steps, penalty)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, severity (expected grade), grade (the likeliest), p_toxic (of a grade above 0), from whole texts."""
    spark = docs.sparkSession
    ship_package(spark)
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds))  # 2**18 floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = shared.value
        scores = held_by_worker(("toxicity", name), lambda: WordScores(lambda words: word_weights(words, weights)[:, None], 1))
        for batch in batches:
            parts = []
            for block in blocks(batch.column("text"), BLOCK_WORDS):
                size = np.array([len(words) for words in block])
                summed = np.cumsum(np.concatenate([[0.0], scores.of(list(chain.from_iterable(block)))[:, 0]]))
                ends = np.cumsum(size)
                parts.append(SCALE * (summed[ends] - summed[ends - size]) / (size + PRIOR_WORDS))
            score = np.concatenate(parts) if parts else np.zeros(0)
            below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - score[:, None], -40, 40)))
            p = np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], 1), axis=1)
            columns = [batch.column("doc_id"), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1).astype("int32")), pa.array(1 - p[:, 0])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "severity", "grade", "p_toxic"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, severity double, grade int, p_toxic double")


def grade_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_fit_rows: int = 6000) -> DataFrame:
    """predict() with a model fitted on docs and labels (doc_id, toxic).

    A null or empty text has no words and the score 0.  Repeated rows each give a row; a doc_id with two labels counts as
    toxic if one is.  Null labels are left out of the fit.  Other columns are ignored, so their names can't clash.  An
    empty table gives an empty result.
    """
    return predict(docs, fit(docs, labels, doc_id, text, max_fit_rows), doc_id, text)
