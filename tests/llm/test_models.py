"""Language identification and toxicity: held-out accuracy, odd rows, forward-backward and gradients by brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language_id, toxicity

from .helpers import clashing, empty, odd, odd_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_marginals_by_brute_force():
    rng = np.random.default_rng(0)
    emission, start, step = rng.normal(size=(9, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    first = np.array([1, 0, 0, 0, 1, 0, 0, 1, 0], bool)
    got = language_id.marginals(emission, first, start, step)
    plain, _ = language_id._expected(emission, first, start, step)
    assert np.allclose(got, plain)
    z = np.zeros((4, 3))
    for y in itertools.product(range(3), repeat=4):
        weight = np.exp(start[y[0]] + sum(emission[i, y[i]] for i in range(4)) + sum(step[y[i - 1], y[i]] for i in range(1, 4)))
        for i in range(4):
            z[i, y[i]] += weight
    assert np.allclose(got[:4], z / z.sum(1, keepdims=True))
    long = rng.normal(size=(5000, 3)) * 5
    begins = np.arange(5000) % 4000 == 0
    assert np.allclose(language_id.marginals(long, begins, start, step), language_id._expected(long, begins, start, step)[0])


def test_language_on_held_out_documents(documents):
    rows = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    assert held[0] >= 0.97 and held[1] > 200 and 0 <= held[2] <= held[3] <= 1


def test_code_switched_text(documents, spark):
    texts = {r["lang"]: r["text"] for r in documents.where("length(text) > 800").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    model = language_id.fit(documents)
    mixed = " ".join(texts["en"].split()[:60] + texts["de"].split()[:40] + texts["en"].split()[60:90])
    row = language_id.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert row["lang_pred"] == "en" and 2 <= row["switches"] <= 12 and 0.5 < row["score"] < 0.85


def test_language_of_odd_rows(spark, documents):
    model = language_id.fit(documents)
    rows = language_id.predict(clashing(odd(spark), "lang_pred", "score"), model).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(odd_rows()) and {d for d, r in found.items() if r["lang_pred"] == "und"} == {0, 1, 2, 9} and found[0]["score"] == 0
    assert language_id.identify(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_cumulative_link_gradient():
    rng = np.random.default_rng(0)
    score, grade, cuts = rng.normal(size=50), rng.integers(0, 4, 50), np.array([-1.0, 0.2, 1.5])
    p, slope, up, down = toxicity._log_loss(score, grade, cuts)
    edge = np.concatenate([[-np.inf], cuts, [np.inf]])
    logistic = lambda x: 1 / (1 + np.exp(-x))
    assert np.allclose(p, logistic(edge[grade + 1] - score) - logistic(edge[grade] - score))
    near = (-np.log(toxicity._log_loss(score + 1e-6, grade, cuts)[0]) + np.log(toxicity._log_loss(score - 1e-6, grade, cuts)[0])) / 2e-6
    assert np.allclose(near, slope, atol=1e-4)
    assert np.allclose(up - down, slope)


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learn, test = labels.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 = 1")
    model = toxicity.fit(docs, learn)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    rows = toxicity.predict(docs.join(test.select("doc_id"), "doc_id"), model).join(test, "doc_id")
    found = {r["toxic"]: r for r in rows.groupBy("toxic").agg(F.avg((F.col("p_toxic") >= 0.5).cast("double")).alias("held"), F.avg("severity").alias("severity")).collect()}
    assert found[0]["held"] <= 0.01 and found[1]["held"] >= 0.85 and found[1]["severity"] > 1 > found[0]["severity"]


def test_toxicity_of_odd_rows(spark):
    docs = clashing(odd(spark), "severity", "grade")
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(100, 140)] + [(None, 1, 1), (3, 1, None), (101, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.grade_toxicity(docs, labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["p_toxic"] <= 1 and 0 <= r["severity"] <= 3 for r in rows)
    assert toxicity.grade_toxicity(empty(spark), labels).count() == 0
    clean = toxicity.grade_toxicity(docs, labels.withColumn("toxic", F.lit(0))).collect()
    assert max(r["p_toxic"] for r in clean) < 1e-6


def plain_severity(text, model):
    """Word by word, as a sum of each word's own features."""
    words = toxicity.words_of(text or "")
    total = 0.0
    for w in words:
        feature, _ = toxicity.features([w], toxicity.BITS, toxicity.PREFIXES, toxicity.SUFFIXES, toxicity.GRAMS)
        total += sum(float(model.weights[f]) for f in feature)
    score = toxicity.SCALE * total / (len(words) + toxicity.PRIOR_WORDS)
    upto = [1 / (1 + np.exp(-(c - score))) for c in model.thresholds] + [1.0]
    p = [b - a for a, b in zip([0.0, *upto], upto, strict=False)]
    return sum(i * x for i, x in enumerate(p)), int(np.argmax(p)), 1 - p[0]


def test_toxicity_by_a_plain_reading(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 200").collect()}
    rows = toxicity.predict(docs.where("doc_id < 200"), model).collect()
    for r in rows:
        severity, grade, p = plain_severity(texts[r["doc_id"]], model)
        assert np.isclose(r["severity"], severity, atol=1e-6) and np.isclose(r["p_toxic"], p, atol=1e-6) and r["grade"] == grade


def test_fits_do_not_depend_on_the_order_of_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame([(None, "nameless", "en", "s", 8), (1, "again", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = docs.repartition(7)
    a, b = (sorted(toxicity.sample_labelled(d, labels, "doc_id", "text", 100)) for d in (docs, turned))
    assert a == b and len(a) <= 100
    a, b = (language_id.fit(d, fit_rows_per_language=20, sequences=60) for d in (docs, turned))
    assert np.array_equal(a.weights, b.weights) and a.lexicon == b.lexicon
