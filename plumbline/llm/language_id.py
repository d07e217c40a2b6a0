"""Language identification of code-switched text by a linear-chain conditional random field over words.

Each word has features (itself, affixes, n-grams, and the lexicons that hold it) with a weight for each language; moving
from one language to the next has a learned weight.  Forward-backward gives each word's probability of each language;
a document's language is the one with the largest sum over its words, its score the mean probability of it.

Documents name one language each.  The training sequences are made from stretches of one to three of them, labelled word
by word, so that the transitions see switches.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.shipping import ship_package
from plumbline.llm.common import held_by_worker, text_or_empty
from plumbline.llm.wordfeatures import HAS_LETTER, WordScores, blocks, features, words_of

BITS = 16
PREFIXES, SUFFIXES, GRAMS = (1, 2, 3), (1, 2, 3), (2, 3)
UNKNOWN = "und"
BLOCK_WORDS = 100_000
#: Training sequences, and words in each, unless the caller says otherwise.
SEQUENCES, SEQUENCE_WORDS = 3000, 48


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # 2**BITS x languages
    lexicon: dict[str, int]  # word to the language whose lexicon holds it
    lexicon_weights: np.ndarray  # languages x languages
    start: np.ndarray
    step: np.ndarray  # from x to


def _emission(words: list[str], model: Model) -> np.ndarray:
    feature, word = features(words, BITS, PREFIXES, SUFFIXES, GRAMS)
    out = np.stack([np.bincount(word, model.weights[feature, c], len(words)) for c in range(len(model.languages))], 1)
    held = [(i, at) for i, w in enumerate(words) if (at := model.lexicon.get(w)) is not None]
    if held:
        rows, at = np.array(held).T
        out[rows] += model.lexicon_weights[at]
    return out


def marginals(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Probability of each language for each word, by forward-backward over many chains laid end to end.

    first marks the words that begin a chain.  The words are cut into stretches of equal length; the stretches' transfer
    matrices are multiplied out side by side, messages pass from stretch to stretch, and are filled in side by side.
    """
    n, k = emission.shape
    if not n:
        return emission.copy()
    length = max(1, int(np.sqrt(n)))
    rows = -(-n // length)
    pad = rows * length - n
    local = np.exp(emission - emission.max(1, keepdims=True))
    local = np.concatenate([local, np.ones((pad, k))]).reshape(rows, length, k)
    begins = np.concatenate([first, np.ones(pad, bool)]).reshape(rows, length)
    move, begin = np.exp(step - step.max()), np.exp(start - start.max())

    def transfer(s: int) -> np.ndarray:
        """From each language before word s of every stretch to each language at it."""
        return np.where(begins[:, s, None, None], begin, move) * local[:, s, None, :]

    total = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for s in range(length):
        total = total @ transfer(s)
        total /= total.max((1, 2), keepdims=True)
    into, onto = np.ones((rows, k)), np.ones((rows, k))
    for r in range(1, rows):
        into[r] = into[r - 1] @ total[r - 1]
        into[r] /= into[r].sum()
    for r in range(rows - 2, -1, -1):
        onto[r] = total[r + 1] @ onto[r + 1]
        onto[r] /= onto[r].sum()
    forward, backward = np.empty((rows, length, k)), np.empty((rows, length, k))
    a, b = into, onto
    for s in range(length):
        a = (a[:, None, :] @ transfer(s))[:, 0]
        a /= a.sum(1, keepdims=True)
        forward[:, s] = a
    for s in range(length - 1, -1, -1):
        backward[:, s] = b
        b = (transfer(s) @ b[:, :, None])[:, :, 0]
        b /= b.sum(1, keepdims=True)
    p = (forward * backward).reshape(-1, k)[:n]
    return p / p.sum(1, keepdims=True)


def _sequences(rows: list[tuple[int, str, int]], rng: np.random.Generator, sequences: int, sequence_words: int) -> list[tuple[list[str], list[int]]]:
    """Training sequences of one to three stretches of documents; half of them switch languages."""
    texts = [(words, c) for _, text, c in rows if (words := words_of(text))]
    out = []
    for _ in range(sequences if texts else 0):
        parts = 1 + int(rng.integers(0, 2) * rng.integers(1, 3))
        words, labels = [], []
        for d in rng.integers(0, len(texts), parts):
            body, c = texts[d]
            size = max(1, sequence_words // parts)
            at = int(rng.integers(0, max(1, len(body) - size + 1)))
            words += body[at : at + size]
            labels += [c] * len(body[at : at + size])
        out.append((words, labels))
    return out


def fit_rows(
    rows: list[tuple[int, str, int]], languages: list[str], epochs: int = 6, penalty: float = 1e-6, seed: int = 7, sequences: int = SEQUENCES, sequence_words: int = SEQUENCE_WORDS
) -> Model:
    """Adam on the mean log likelihood of the sequences.  rows: (doc_id, text, place of its language)."""
    k = len(languages)
    counts: list[Counter] = [Counter() for _ in languages]
    for _, text, c in rows:
        counts[c].update(set(words_of(text)))
    together = Counter()
    for c in counts:
        together.update(c)
    lexicon = {w: c for c in range(k) for w, times in counts[c].items() if times >= 5 and times >= 0.9 * together[w]}
    model = Model(languages, np.zeros((1 << BITS, k)), lexicon, np.zeros((k, k)), np.zeros(k), np.zeros((k, k)))
    rng = np.random.default_rng(seed)
    made = _sequences(rows, rng, sequences, sequence_words)
    params = [model.weights, model.lexicon_weights, model.start, model.step]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(made))
        for at in range(0, len(order), 150):
            batch = [made[i] for i in order[at : at + 150]]
            words = list(chain.from_iterable(b[0] for b in batch))
            gold = np.array(list(chain.from_iterable(b[1] for b in batch)))
            first = np.zeros(len(words), bool)
            first[np.cumsum([0, *(len(b[0]) for b in batch[:-1])])] = True
            feature, word = features(words, BITS, PREFIXES, SUFFIXES, GRAMS)
            emission = np.stack([np.bincount(word, model.weights[feature, c], len(words)) for c in range(k)], 1)
            held = np.array([lexicon.get(w, -1) for w in words])
            emission[held >= 0] += model.lexicon_weights[held[held >= 0]]
            p, pairs = _expected(emission, first, model.start, model.step)
            miss = (p - np.eye(k)[gold]) / len(batch)
            used, place = np.unique(feature, return_inverse=True)
            gw = np.stack([np.bincount(place, miss[word, c], len(used)) for c in range(k)], 1)
            gl = np.zeros((k, k))
            np.add.at(gl, held[held >= 0], miss[held >= 0])
            gs = miss[first].sum(0)
            inner = np.flatnonzero(~first)
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
            gt = (pairs - seen) / len(batch)
            t += 1
            for i, (p_, g) in enumerate(zip(params, (gw, gl, gs, gt), strict=True)):
                rows_ = used if i == 0 else slice(None)
                g = g + penalty * p_[rows_]
                m[i][rows_] += 0.1 * (g - m[i][rows_])
                v[i][rows_] += 0.01 * (g * g - v[i][rows_])
                p_[rows_] -= 0.03 * (m[i][rows_] / (1 - 0.9**t)) / (np.sqrt(v[i][rows_] / (1 - 0.99**t)) + 1e-8)
    return model


def _expected(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and the expected number of each move within chains; plain forward-backward, for chains of like length."""
    k = emission.shape[1]
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(first)))
    longest = int(size.max())
    padded = np.zeros((len(at), longest, k))
    real = np.arange(longest)[None, :] < size[:, None]
    padded[real] = emission
    local = np.exp(padded - padded.max(2, keepdims=True))
    move, begin = np.exp(step), np.exp(start)
    a, b = np.zeros_like(local), np.ones_like(local)
    a[:, 0] = begin * local[:, 0]
    a[:, 0] /= a[:, 0].sum(1, keepdims=True)
    for s in range(1, longest):
        a[:, s] = (a[:, s - 1] @ move) * local[:, s]
        a[:, s] /= a[:, s].sum(1, keepdims=True)
    for s in range(longest - 2, -1, -1):
        x = (local[:, s + 1] * b[:, s + 1]) @ move.T
        x /= x.sum(1, keepdims=True)
        b[:, s] = np.where(real[:, s + 1, None], x, 1.0)
    p = a * b
    p /= p.sum(2, keepdims=True)
    pairs = np.zeros((k, k))
    for s in range(1, longest):
        both = a[:, s - 1, :, None] * move[None] * (local[:, s] * b[:, s])[:, None, :]
        both /= both.sum((1, 2), keepdims=True)
        pairs += both[real[:, s]].sum(0)
    return p[real], pairs


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows_per_language: int = 1000, learn_from: Column | None = None, sequences: int = SEQUENCES, sequence_words: int = SEQUENCE_WORDS) -> Model:
    """Fit on a sample by hash order of the rows where learn_from holds: fit_rows_per_language of each language at most.

    The lexicons are made from the sample's whole texts.  The transitions and weights are fitted on `sequences` sequences
    of `sequence_words` words, which are drawn from those texts at any place.

    Without any row that has a language, no language is known and every text gets `und`.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & (learn_from if learn_from is not None else F.lit(True)))
    rows = rows.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0)), {}, np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    # somewhat more than is wanted by hash, so that few rows are ordered, and of those the first of each language
    rate = F.create_map(*[x for c in languages for x in (F.lit(c), F.lit(min(1.0, (2.0 * fit_rows_per_language + 20) / counts[c])))])
    drawn = F.xxhash64("doc_id", "text")
    some = rows.where(F.pmod(drawn, F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30))
    order = Window.partitionBy("lang").orderBy(F.pmod(drawn, F.lit(1 << 30)), "doc_id", "text")
    found = some.withColumn("at", F.row_number().over(order)).where(F.col("at") <= fit_rows_per_language).drop("at").collect()
    place = {c: i for i, c in enumerate(languages)}
    return fit_rows(sorted((r["doc_id"], r["text"], place[r["lang"]]) for r in found), languages, sequences=sequences, sequence_words=sequence_words)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, switches (how often the likeliest language changes from a word to the next).

    Whole texts.  `und` with score 0 if the text is null or has no letter, or no language is known.  Repeated rows each
    give a row.  Other columns are ignored, so their names can't clash.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(model)  # 2**16 rows of weights and a sample's lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: Model = shared.value
        k = len(mine.languages)
        scores = held_by_worker(("language", name), lambda: WordScores(lambda words: _emission(words, mine), k)) if k else None
        for batch in batches:
            names, sure, turns = [], [], []
            texts = batch.column("text")
            for block in blocks(texts, BLOCK_WORDS) if k else []:
                size = np.array([len(words) for words in block])
                ends = np.cumsum(size)
                begins = ends - size
                first = np.zeros(int(ends[-1]), bool)
                first[begins[size > 0]] = True
                p = marginals(scores.of(list(chain.from_iterable(block))), first, mine.start, mine.step)
                summed = np.concatenate([np.zeros((1, k)), np.cumsum(p, 0)])
                share = (summed[ends] - summed[begins]) / np.maximum(size, 1)[:, None]
                best = p.argmax(1)
                change = np.concatenate([[0], np.cumsum(np.concatenate([[0], (best[1:] != best[:-1])]) * ~first)]) if len(best) else np.zeros(1)
                names += [mine.languages[c] if n else UNKNOWN for c, n in zip(share.argmax(1), size, strict=True)]
                sure += list(np.where(size > 0, np.clip(share.max(1), 0.0, 1.0), 0.0))
                turns += list((change[ends] - change[begins]).astype("int32"))
            if not k:
                names, sure, turns = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
            bare = [HAS_LETTER.search(t.as_py()) is None for t in texts]
            names = [UNKNOWN if x else n for x, n in zip(bare, names, strict=True)]
            sure = [0.0 if x else s for x, s in zip(bare, sure, strict=True)]
            columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(sure, pa.float64()), pa.array(turns, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "switches"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, switches int")


def identify(docs: DataFrame) -> DataFrame:
    """predict() for documents, learning from those that held_out() leaves; held_out is returned too."""
    found = predict(docs, fit(docs, learn_from=~held_out("doc_id")))
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "switches")
