"""Toxicity by multiple-instance learning: sentences are instances, documents carry the labels.

A logistic score per sentence, p = sigmoid(bias + sum of word weights), is
combined over the document by noisy-or, 1 - prod(1 - p). Only document labels
are needed to train, and the highest sentence score shows where the offence is.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posigauge.functions.shipping import ship_by_value
from posigauge.llm.common import blocks, hash_share, worker_cache

BLOCK_BYTES = 4 << 20
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
PREFIXES = (3, 4, 5, 6, 7)
CACHE_WORDS = 300_000


@dataclass
class ToxicityModel:
    """Bounded: one weight per chosen feature (a word, or a word's beginning) and a bias."""

    weights: dict[str, float]
    bias: float


def features(word: str) -> list[str]:
    """The word itself and its beginnings, which inflected forms share."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def sentences(text: str | None) -> list[str]:
    """Runs of text between sentence marks or line ends, lower-cased; empty texts have one empty sentence."""
    found = [s for s in SENTENCE.split(text.lower()) if s.strip()] if text else []
    return found or [""]


def _document_counts(sample: DataFrame) -> DataFrame:
    """In how many sampled documents of each label a feature occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            rows: Counter = Counter()
            pairs = zip(block.column("toxic").to_pylist(), block.column("text").to_pylist(), strict=True)
            for toxic, text in pairs:
                words = set(WORD.findall((text or "").lower()))
                rows.update((feature, toxic) for feature in {f for w in words for f in features(w)})
            if rows:
                word, toxic = zip(*rows, strict=True)
                yield pa.record_batch(
                    [pa.array(word), pa.array(toxic, pa.int32()), pa.array(list(rows.values()), pa.int64())],
                    names=["word", "toxic", "docs"],
                )

    counted = sample.select("toxic", "text").mapInArrow(count, "word string, toxic int, docs long")
    return counted.groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("in_toxic"),
        F.sum(F.when(F.col("toxic") == 0, F.col("docs")).otherwise(0)).alias("in_clean"),
    )


def choose_features(sample: DataFrame, max_features: int, min_docs: int = 3, lift: int = 3) -> list[str]:
    """Features that toxic documents hold at least ``lift`` times as often as clean ones.

    The ``max_features`` with the largest log-likelihood ratio, ties by name.
    """
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    a, b = F.col("in_toxic"), F.col("in_clean")
    both = a + b

    def term(seen, group):
        expected = both * (group / (toxic + clean))
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = F.round(term(a, toxic) + term(b, clean), 9)
    ranked = (
        _document_counts(sample)
        .where((both >= min_docs) & (a * clean > b * (lift * toxic)))
        .select("word", ratio.alias("gain"))
        .orderBy(F.desc("gain"), "word")
        .limit(max_features)
    )
    return sorted(r["word"] for r in ranked.collect())


def _bags(sample: DataFrame, vocabulary: list[str], key: str) -> DataFrame:
    """(toxic, sentences, hits): chosen features of each sampled document as sentence * size + feature."""
    index = {word: i for i, word in enumerate(vocabulary)}
    size = max(1, len(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            counts, hits = [], []
            for text in block.column("text").to_pylist():
                parts = sentences(text)
                counts.append(len(parts))
                words = [(n, w) for n, s in enumerate(parts) for w in set(WORD.findall(s))]
                hits.append([n * size + index[f] for n, w in words for f in features(w) if f in index])
            yield pa.record_batch(
                [
                    block.column(key).cast(pa.string()),
                    block.column("toxic").cast(pa.int32()),
                    pa.array(counts, pa.int64()),
                    pa.array(hits, pa.list_(pa.int64())),
                ],
                names=["id", "toxic", "sentences", "hits"],
            )

    schema = "id string, toxic int, sentences long, hits array<long>"
    return sample.select(key, "toxic", "text").mapInArrow(encode, schema)


def noisy_or_fit(
    labels: np.ndarray, counts: np.ndarray, hits: list, size: int, *, steps: int, penalty: float
) -> tuple[np.ndarray, float]:
    """Minimise the documents' log loss under noisy-or by Adam; sentences without a chosen word share the bias."""
    owner = np.repeat(np.arange(len(labels)), [len(h) for h in hits])
    flat = np.concatenate([np.asarray(h, np.int64) for h in hits]) if len(owner) else np.zeros(0, np.int64)
    word = flat % size
    span = int(counts.max()) + 1
    pairs, sentence = np.unique(owner * span + flat // size, return_inverse=True)
    home = pairs // span
    bare = counts - np.bincount(home, minlength=len(labels))
    weights, bias = np.zeros(size), -np.log(max(1.0, counts.mean())) - 2.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(sentence, weights[word], minlength=len(pairs))
        clean = bare * np.logaddexp(0, bias) + np.bincount(home, np.logaddexp(0, z), minlength=len(labels))
        p = -np.expm1(-clean)  # of the document
        pull = np.where(labels == 1, -(1 - p) / np.maximum(p, 1e-12), 1.0)
        at_sentence = pull[home] / (1 + np.exp(-z))
        gradient = np.empty(size + 1)
        gradient[:size] = np.bincount(word, at_sentence[sentence], minlength=size) + penalty * weights
        gradient[size] = at_sentence.sum() + (pull * bare).sum() / (1 + np.exp(-bias))
        gradient /= len(labels)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:size], bias - move[size]
    return weights, float(bias)


def fit(
    labelled: DataFrame,
    *,
    max_docs: int = 12_000,
    max_features: int = 1_000,
    steps: int = 400,
    penalty: float = 0.05,
    key: str = "doc_id",
) -> ToxicityModel:
    """Train on rows with text and a label ``toxic`` of 0 or 1.

    Bounds: about ``max_docs`` training documents (by hash of key) and
    ``max_features`` features. What reaches the driver is the sample's hits of
    these features. With one label only, or none, nothing is learnt and every
    score is close to 0.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("toxic").isin(0, 1)).select(key, "text", "toxic")
    total = rows.select(F.count(F.lit(1))).first()[0]
    if total > max_docs:
        rows = rows.where(hash_share([key], max_docs / total))
    vocabulary = choose_features(rows, max_features)
    if not vocabulary:
        return ToxicityModel({}, -10.0)
    table = _bags(rows, vocabulary, key).toArrow().sort_by([("id", "ascending"), ("sentences", "ascending")])
    weights, bias = noisy_or_fit(
        table["toxic"].to_numpy(),
        table["sentences"].to_numpy().astype(float),
        table["hits"].to_pylist(),
        len(vocabulary),
        steps=steps,
        penalty=penalty,
    )
    return ToxicityModel(dict(zip(vocabulary, weights.tolist(), strict=True)), bias)


def score_text(model: ToxicityModel, known: dict[str, float], text: str | None) -> tuple[float, int, float, str]:
    """(document score, its worst sentence's number, that sentence's score, the sentence).

    Where no sentence holds a chosen feature, the first one stands for all.
    ``known`` remembers the weights of whole words.
    """
    parts = sentences(text)
    weights, clean, worst, at = model.weights, 0.0, -math.inf, 0
    for n, part in enumerate(parts):
        words = set(WORD.findall(part))
        for word in [w for w in words if w not in known]:
            known[word] = sum(weights[f] for f in features(word) if f in weights)
        z = model.bias + sum(map(known.__getitem__, words))
        clean += math.log1p(math.exp(z)) if z < 30 else z
        if z > worst:
            worst, at = z, n
    if len(known) > CACHE_WORDS:
        known.clear()
    return -math.expm1(-clean), at, 1 / (1 + math.exp(-min(700.0, max(-700.0, worst)))), parts[at]


def score(documents: DataFrame, model: ToxicityModel, key: str = "doc_id") -> DataFrame:
    """Toxicity of every text: key, score, sentence (0-based), sentence_score, sentence_text.

    A null or empty text is one empty sentence. One narrow pass; the model is
    of bounded size and broadcast.
    """
    kind = documents.schema[key].dataType.simpleString()
    shared, name = documents.sparkSession.sparkContext.broadcast(vars(model)), uuid.uuid4().hex

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = worker_cache("toxicity", dict, name), ToxicityModel(**shared.value)
        for block in blocks(batches, "text", BLOCK_BYTES):
            found = [score_text(model, known, text) for text in block.column("text").to_pylist()]
            document, at, worst, part = zip(*found, strict=True)
            yield pa.record_batch(
                [block.column(key), pa.array(document), pa.array(at, pa.int32()), pa.array(worst), pa.array(part)],
                names=[key, "score", "sentence", "sentence_score", "sentence_text"],
            )

    schema = f"`{key}` {kind}, score double, sentence int, sentence_score double, sentence_text string"
    return documents.select(key, "text").mapInArrow(predict, schema)


ship_by_value(__name__)
