"""Token counts of a BPE vocabulary with word ends by rank-synchronous merging.

Unique pre-tokens of a block of texts are held as one ragged array of symbol
ids. In each round every sequence's lowest-rank pair is looked up, all its
occurrences are merged at once, and sequences without a mergeable pair leave.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posigauge.functions.shipping import ship_by_value
from posigauge.llm.common import blocks, group_counts, worker_cache

# The byte ranges that byte-level vocabularies write as themselves.
PLAIN_BYTES = ((33, 126), (161, 172), (174, 255))
CACHE_WORDS = 600_000
BLOCK_BYTES = 4 << 20
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself, or the next free code point from 256."""
    plain = {b for low, high in PLAIN_BYTES for b in range(low, high + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeTable:
    """The parts of a tokenizer file that counting needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.inner = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_letters()], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.rank = order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        specials = [regex.escape(t["content"]) for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(specials)) if specials else None
        self.marks = [t["content"] for t in spec["added_tokens"] if t["special"]]

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.rank[at], NO_RANK)

    def symbol_counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty word when no pair can be merged."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        left = sizes.copy()
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        rank = self.pair_ranks(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            first, lengths = group_counts(owner)
            lowest = np.repeat(np.minimum.reduceat(rank, first), lengths)
            keep = lowest < NO_RANK
            merged = np.flatnonzero(keep & (rank == lowest))
            if not len(merged):
                break
            # Of overlapping equal pairs (a a a) every second one counts, from the left.
            begins = np.flatnonzero(np.concatenate([[True], np.diff(merged) > 1]))
            place = np.arange(len(merged)) - np.repeat(begins, np.diff(np.append(begins, len(merged))))
            merged = merged[place % 2 == 0]
            symbols[merged] = self.made[rank[merged]]
            left -= np.bincount(owner[merged], minlength=len(left))
            keep[merged + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            # Only the merged symbols and those before them have new pairs.
            merged = (np.cumsum(keep) - 1)[merged]
            before = merged[merged > 0] - 1
            rank[merged] = self.pair_ranks(symbols, owner, merged)
            rank[before] = self.pair_ranks(symbols, owner, before)
        return left

    def pair_ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each position, none across sequences."""
        after = np.minimum(at + 1, len(symbols) - 1)
        found = self.ranks(symbols[at] * self.width + symbols[after])
        return np.where((after > at) & (owner[after] == owner[at]), found, NO_RANK)


def normalise(text: str) -> list[str]:
    """Lower-cased canonical text, cut at white space."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    text = text.lower()
    # str.split() also cuts at the four separator controls, which are no white space here.
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in regex.split(r"\s+", text) if w]
    return text.split()


def count_texts(table: MergeTable, known: dict[str, int], texts: list[str | None]) -> list[int]:
    """Tokens of each text; ``known`` remembers counts of runs between white space."""
    runs, special = [], []
    for text in texts:
        text = text or ""
        n = 0
        if table.special is not None and any(m in text for m in table.marks):
            parts = table.special.split(text)
            n = len(parts) - 1
            runs.append([w for part in parts for w in normalise(part)])
        else:
            runs.append(normalise(text))
        special.append(n)
    unseen = set().union(*runs) - known.keys()
    if len(known) + len(unseen) > CACHE_WORDS:
        known.clear()
        unseen = set().union(*runs)
    if unseen:
        unseen = list(unseen)
        pieces = [[w] if w.isalpha() and w.isascii() else table.pattern.findall(w) for w in unseen]
        fresh = list({p for ps in pieces for p in ps} - known.keys())
        if fresh:
            known.update(zip(fresh, table.symbol_counts([p.encode() for p in fresh]).tolist(), strict=True))
        for word, ps in zip(unseen, pieces, strict=True):
            known[word] = sum(map(known.__getitem__, ps))
    return [n + sum(map(known.__getitem__, words)) for n, words in zip(special, runs, strict=True)]


def token_counts(documents: DataFrame, vocabulary: str, limit: int = 2048, key: str = "doc_id") -> DataFrame:
    """Bytes and tokens of every text: key, n_bytes, n_tokens, over_limit.

    ``vocabulary`` is the path of a tokenizer file that every executor has
    installed. One narrow pass, no shuffle: each task counts its own rows, and
    what a worker remembers is bounded by ``CACHE_WORDS``. A null text counts
    as empty; repeated rows give repeated results; an empty table gives none.
    """
    kind = documents.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_cache(f"merges:{vocabulary}", lambda: MergeTable(vocabulary))
        known = worker_cache(f"merge counts:{vocabulary}", dict)
        for block in blocks(batches, "text", BLOCK_BYTES):
            counts = count_texts(table, known, block.column("text").to_pylist())
            sizes = pa.compute.fill_null(pa.compute.binary_length(block.column("text")), 0)
            yield pa.record_batch(
                [block.column(key), sizes.cast(pa.int64()), pa.array(counts, pa.int64())],
                names=[key, "n_bytes", "n_tokens"],
            )

    counted = documents.select(key, "text").mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


ship_by_value(__name__)
