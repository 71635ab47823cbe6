"""Language identification by words first, then by shorter and shorter character n-grams.

A known word votes with its log frequency in every language. An unseen word
backs off to its longest n-grams that are known, then to shorter ones.
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
from posigauge.session import materialize

LETTERS = re.compile(r"[^\W\d_]+")
BLOCK_BYTES = 4 << 20
CACHE_WORDS = 150_000
UNKNOWN = "und"
NO_GRAM = 0.5  # smoothing count of a word or n-gram in a language
UNIT = 256  # counts are kept in whole parts of one


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; signs like a raised 2, which the pattern lets through, part them."""
    found = LETTERS.findall(text.lower()) if text else []
    if text and not text.isascii() and not all(map(str.isalpha, found)):
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return found


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between blanks; single characters without the blanks."""
    if n == 1:
        return list(word)
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class LanguageModel:
    """Bounded tables: log frequencies per language of words and of n-grams by length."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, np.ndarray]
    grams: dict[int, dict[str, np.ndarray]]

    def vector(self, word: str) -> np.ndarray:
        """The word's vote: one log frequency per language."""
        found = self.words.get(word)
        if found is not None:
            return found
        for n in sorted(self.grams, reverse=True):
            table = self.grams[n]
            known = [table[g] for g in grams(word, n) if g in table]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(self.langs))


def weights(text: str | None) -> Counter:
    """log2(1 + count) of every word, in parts of ``UNIT``: one long text weighs little more than a short one."""
    return Counter({word: round(UNIT * math.log2(1 + n)) for word, n in Counter(words_of(text)).items()})


def _count(sample: DataFrame, max_gram: int) -> DataFrame:
    """(lang, kind, item, n): words (kind 0) and n-grams (kind their length), combined per task.

    n adds up the documents' ``weights``, so a text that repeats a word ten
    thousand times does not decide its language's frequencies.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            by_lang: dict[str, Counter] = {}
            pairs = zip(block.column("lang").to_pylist(), block.column("text").to_pylist(), strict=True)
            for lang, text in pairs:
                by_lang.setdefault(lang, Counter()).update(weights(text))
            rows: Counter = Counter()
            for lang, counts in by_lang.items():
                for word, n in counts.items():
                    rows[lang, 0, word] += n
                    for size in range(1, max_gram + 1):
                        for gram in grams(word, size):
                            rows[lang, size, gram] += n
            if rows:
                lang, kind, item = zip(*rows, strict=True)
                yield pa.record_batch(
                    [
                        pa.array(lang, pa.string()),
                        pa.array(kind, pa.int32()),
                        pa.array(item, pa.string()),
                        pa.array(list(rows.values()), pa.int64()),
                    ],
                    names=["lang", "kind", "item", "n"],
                )

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, kind int, item string, n long")
    return counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def fit(
    labelled: DataFrame,
    *,
    max_docs: int = 10_000,
    max_words: int | None = 60_000,
    max_grams: int | None = 20_000,
    max_gram: int = 4,
    key: str = "doc_id",
) -> LanguageModel:
    """Fit on rows with a language.

    Bounds: ``max_docs`` training documents (about that many, by hash of key),
    the ``max_words`` most frequent words and the ``max_grams`` most frequent
    n-grams of each length, so the tables that every task gets have a fixed
    size. None keeps all words or n-grams of the training documents. Ties in
    frequency go to the smaller item. Languages are labels and taken to be few.
    Repeated rows count each; rows without a text or a language do not. Without
    training rows the model knows no language. Other columns are not read.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(key, "lang", "text")
    total = rows.select(F.count(F.lit(1))).first()[0]
    if total > max_docs:
        rows = rows.where(hash_share([key], max_docs / total))
    docs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(docs)
    by_item = materialize(
        _count(rows, max_gram)
        .groupBy("kind", "item")
        .agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("total"))
    )
    parts = []
    for kind in range(max_gram + 1):
        part, most = by_item.where(F.col("kind") == kind), max_grams if kind else max_words
        parts.append(part if most is None else part.orderBy(F.desc("total"), "item").limit(most))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    counts: dict[int, dict[str, np.ndarray]] = {}
    for row in union.collect():
        counts.setdefault(row["kind"], {})[row["item"]] = np.array([row["by"].get(lang, 0) for lang in langs], float)
    tables = {}
    for kind, items in counts.items():
        least = NO_GRAM * UNIT
        size = least * len(items) + np.sum(list(items.values()), axis=0)
        tables[kind] = {item: np.log((n + least) / size) for item, n in items.items()}
    shares = np.array([docs[lang] for lang in langs], float)
    prior = np.log(shares / shares.sum()) if langs else shares
    return LanguageModel(langs, prior, tables.pop(0, {}), tables)


class Votes:
    """Votes of the words seen so far, one row each, forgotten when there are too many."""

    def __init__(self, langs: int):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((CACHE_WORDS, langs))

    def learn(self, model: LanguageModel, words: set[str]) -> None:
        if len(self.at) + len(words) > len(self.rows):
            self.at.clear()
            if len(words) > len(self.rows):
                self.rows = np.zeros((len(words), self.rows.shape[1]))
        for word in words:
            if word not in self.at:
                self.rows[len(self.at)] = model.vector(word)
                self.at[word] = len(self.at)


def score_texts(model: LanguageModel, votes: Votes, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, posterior) of each text."""
    tokens = [words_of(t) for t in texts]
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return names, scores
    votes.learn(model, set().union(*tokens))
    for i, words in enumerate(tokens):
        if words:
            at = np.fromiter(map(votes.at.__getitem__, words), np.int64, len(words))
            total = model.prior + votes.rows[at].sum(axis=0)
            best = int(total.argmax())
            names[i] = model.langs[best]
            scores[i] = 1.0 / np.exp(total - total[best]).sum()
    return names, scores


def identify(documents: DataFrame, model: LanguageModel, key: str = "doc_id") -> DataFrame:
    """Language of every text: key, lang_pred, score.

    A null text and one without a letter are ``und`` with score 0, as is every
    text when the model knows no language. Ties go to the first language by
    name. Repeated rows and null keys give a result each, an empty table gives
    none; other columns of ``documents`` are not read and cannot clash. One
    narrow pass; the model is of bounded size and broadcast.
    """
    kind = documents.schema[key].dataType.simpleString()
    spark = documents.sparkSession
    shared, name = spark.sparkContext.broadcast(vars(model)), uuid.uuid4().hex

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_cache("language model", lambda: LanguageModel(**shared.value), name)
        votes = worker_cache("language votes", lambda: Votes(len(model.langs)), name)
        for block in blocks(batches, "text", BLOCK_BYTES):
            names, scores = score_texts(model, votes, block.column("text").to_pylist())
            yield pa.record_batch(
                [block.column(key), pa.array(names, pa.string()), pa.array(scores)],
                names=[key, "lang_pred", "score"],
            )

    return documents.select(key, "text").mapInArrow(predict, f"`{key}` {kind}, lang_pred string, score double")


ship_by_value(__name__)
