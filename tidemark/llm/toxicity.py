"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A text is toxic if any of its sentences is: its probability is the noisy-or of the sentence probabilities. The
sentence model is logistic on hashed words; its weights are found by gradient steps through the noisy-or on
document labels, so the sentences that make a text toxic are located without ever being labelled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import Batches, batch, map_batches, texts

BITS = 18  # hash buckets of words: 2 ** 18
SAMPLE = 6_000  # labelled documents that the model is trained on, at most, in order of hash
SAMPLE_CHARS = 10_000_000  # characters of them together, and a hundredth of it from one, so that long texts do not fill the task that trains
EPOCHS = 200
RATE = 0.2
DECAY = 1e-5  # pull of weights towards zero
BIAS = -12.0  # log-odds of a sentence without known words: ten thousand of them say nothing
STEMS = (4, 5, 6, 7)  # word beginnings of so many letters are features beside the words
LEAST_DOCS = 5  # words in fewer training documents have no weight
LEAST_SIGNS = 5.0  # nor those whose share of toxic documents is fewer standard errors above that of all documents
COPY = 0.5  # a training text with more than this share of its sentences in earlier ones is a copy and left out
MAX_WORDS = 200_000  # words of a worker that are remembered

_SENTENCE = re.compile(r"[.!?\n\r]+")
_WORD = re.compile(r"\w+")


def sentences_of(text: str) -> list[str]:
    """Sentences with a word, in order; they end at ``.``, ``!``, ``?`` or a line break."""
    return [s for s in _SENTENCE.split(text) if _WORD.search(s)]


def word_buckets(word: str) -> list[int]:
    """Hash buckets of a word and of its beginnings, in lower case."""
    word = word.lower()
    return [xxhash.xxh32_intdigest(f) >> (32 - BITS) for f in [word, *[f"{word[:n]}-" for n in STEMS if len(word) > n]]]


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the documents, which no model may learn from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _chosen(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``doc_id, _toxic, text`` of at most ``sample`` labelled documents that are not held out; half of them toxic where there are enough.

    The sample is taken in order of a hash of the id. Only ids are ordered; the texts of the sample meet them by broadcast. Of a text
    beyond its share of the memory of training, sentences are drawn by hash over the whole of it (for training, never for scoring).
    Rows without id or label are left out; an id with several labels counts as toxic if one says so.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).withColumn("_order", F.xxhash64("doc_id"))
    here = known.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    half = [here.filter(F.col("_toxic") == y).orderBy("_order", "doc_id").limit(sample // 2) for y in (0, 1)]
    chosen = half[0].unionByName(half[1]).select("doc_id", "_toxic")
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    most = max(1, SAMPLE_CHARS // 100)
    text = F.coalesce("text", F.lit(""))
    share = F.lit(1_000_000.0 * most) / F.length(text)
    drawn = F.filter(F.split(text, r"(?<=[.!?\n\r])"), lambda s: (F.pmod(F.xxhash64(s), F.lit(1_000_000)) < share) & (F.length(s) <= most))
    cut = F.when(F.length(text) <= most, text).otherwise(F.array_join(drawn, ""))
    return rows.groupBy("doc_id", "_toxic").agg(F.min(cut).alias("text"))


def _within(rows: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    """The first rows, up to the one that reaches SAMPLE_CHARS characters. The others are read and left out."""
    out, left = [], SAMPLE_CHARS
    for text, toxic in rows:
        if left > 0:
            out.append((text, toxic))
            left -= len(text)
    return out


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str, int]]:
    """Texts and labels that :func:`learn` trains on, in its order."""
    found = _chosen(documents, labels, sample).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return _within((r["text"], r["_toxic"]) for r in found)


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[int, float]:
    """The model of :func:`train` on a bounded sample of ``documents`` and ``labels``.

    A task trains it, so the driver holds neither the texts nor what training makes of them, only the weights.
    """
    schema = pa.schema([("bucket", pa.int32()), ("weight", pa.float64())])

    def run(batches: Batches) -> Batches:
        model = train(_within(row for rows in batches for row in zip(texts(rows.column(0)), rows.column(1).to_pylist())))
        yield batch(schema, [list(model), list(model.values())])

    rows = _chosen(documents, labels, sample).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = map_batches(rows.select("text", "_toxic"), run, "bucket int, weight double").collect()
    return {r["bucket"]: r["weight"] for r in found}


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> dict[int, float]:
    """Weights of word buckets, by Adam steps on the mean log loss of a leaky noisy-or.

    The leak is one more cause that every text shares. It takes up labels that no sentence explains, and is left out of scores.
    """
    said: set[str] = set()
    remembered = lru_cache(MAX_WORDS)(word_buckets)
    signs = lambda sentence: {b for w in set(_WORD.findall(sentence)) for b in remembered(w)}
    fresh, docs, toxic = [], np.zeros(1 << BITS), np.zeros(1 << BITS)
    for text, label in rows:  # copies would let chance words of one text look like evidence
        parts = sentences_of(text)
        if sum(s in said for s in parts) <= COPY * len(parts):
            fresh.append((parts, label))
            shown = list(set().union(*map(signs, parts)))
            docs[shown] += 1
            toxic[shown] += label
        said.update(parts)
    y = np.array([label for _, label in fresh], float)
    if not len(y) or y.min() == y.max():
        return {}
    share = y.mean()
    used = np.flatnonzero((docs >= LEAST_DOCS) & (toxic - docs * share >= LEAST_SIGNS * np.sqrt(docs * share * (1 - share))))
    if not len(used):
        return {}
    at = {b: i for i, b in enumerate(used.tolist())}
    place, sentence, owner = [], [], []  # signs and their sentences; texts of the sentences
    for i, (parts, _) in enumerate(fresh):
        for s in parts:
            known = [at[b] for b in signs(s) if b in at]
            place += known
            sentence += [len(owner)] * len(known)
            owner.append(i)
    place, sentence, doc = np.array(place), np.array(sentence), np.array(owner)
    w = np.append(np.zeros(len(used)), np.log(y.mean()))  # the last is the logarithm of the leak
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, epochs + 1):
        z = BIAS + np.bincount(sentence, w[place], len(owner))
        calm = np.logaddexp(0, z)  # -log(1 - p) of each sentence
        leak = np.exp(w[-1])
        total = np.bincount(doc, calm, len(fresh)) + leak  # -log of the probability that nothing makes the text toxic
        # Loss: y = 0 pays `total`, y = 1 pays -log(1 - exp(-total)).
        slope = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) / len(y)
        p = 1 / (1 + np.exp(-z))
        g = np.append(np.bincount(place, (slope[doc] * p)[sentence], len(used)), slope.sum() * leak)
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {int(b): float(x) for b, x in zip(used, w[:-1]) if x}


class _Weights(dict):
    """Weight of a word as written, remembered up to a bound."""

    def __init__(self, model: dict[int, float]):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = value = sum(self.model.get(b, 0.0) for b in word_buckets(word))
        return value


def _score(parts: list[str], weights: _Weights) -> tuple[float, np.ndarray]:
    """Noisy-or of the sentences of a text, and their log-odds."""
    z = BIAS + np.array([sum(map(weights.__getitem__, set(_WORD.findall(s)))) for s in parts])
    return float(-np.expm1(-np.logaddexp(0, z).sum())) if parts else 0.0, z


def score_column(text: Column, model: dict[int, float]) -> Column:
    """The score of :func:`score_documents` as a column, beside all others of a row."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = _Weights(model)
        for series in batches:
            yield pd.Series([_score(sentences_of(t or ""), weights)[0] for t in series], dtype=float)

    return score(text)


def score_documents(documents: DataFrame, model: dict[int, float]) -> DataFrame:
    """``doc_id, score, sentence, sentence_score, sentence_text`` of every row of ``documents`` (``doc_id, text``).

    ``score`` is the noisy-or of all sentences of the whole text, 0 where there are none; ``sentence`` is the number (from 0) of the sentence that
    is most likely toxic, the first among equals, null without sentences. Null and empty texts score 0. Rows are never merged: equal
    ids or texts give one row each. Other columns are not read. An empty table gives no rows.
    """
    kind = dict(documents.dtypes)["doc_id"]
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("sentence", pa.int64()),
                        ("sentence_score", pa.float64()), ("sentence_text", pa.string())])

    def run(batches: Batches) -> Batches:
        weights = _Weights(model)
        for rows in batches:
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(rows.column(0).to_pylist(), texts(rows.column(1))):
                parts = sentences_of(text)
                score, z = _score(parts, weights)
                best = int(np.argmax(z)) if parts else None
                found = (doc, score, best, float(1 / (1 + np.exp(-z[best]))) if parts else None, parts[best] if parts else None)
                for column, value in zip(out, found):
                    column.append(value)
            yield batch(schema, out)

    docs = documents.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    scored = map_batches(docs, run, "doc_id bigint, score double, sentence bigint, sentence_score double, sentence_text string")
    return scored.withColumn("doc_id", F.col("doc_id").cast(kind))


def detect_toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score every document by a model trained on ``labels`` (``doc_id, toxic``): the columns of :func:`score_documents`,
    ``held_out`` and ``predicted`` (1 from a score of 0.5). Without labels of both kinds every score is near 0."""
    model = learn(documents, labels, sample)
    return score_documents(documents, model).withColumns({
        "held_out": F.coalesce(held_out(F.col("doc_id")), F.lit(False)), "predicted": (F.col("score") >= 0.5).cast("int")})
