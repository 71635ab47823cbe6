"""Helpers shared by the operators: folds, blocks of texts, word hashes, worker-side caches.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which is what
``bytes.split()`` gives. Hash arithmetic is on uint64 and wraps.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posigauge.functions.shipping import ship_by_value

BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2^64
_U = np.uint64


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts


def hash_share(keys: list[str], share: float) -> Column:
    """True for about ``share`` of the distinct keys, always the same ones."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(share * (1 << 30))


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: sizes the number of hash buckets, so that none outgrows a task."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def worker_cache(slot: str, make, name: str = ""):
    """A value that outlives one task of a Python worker; ``make`` builds it where it is absent.

    A slot holds one value: asking for another name replaces it.
    """
    kept = sys.modules.setdefault("_posigauge_worker", types.ModuleType("_posigauge_worker")).__dict__
    if slot not in kept or kept[slot][0] != name:
        kept[slot] = (name, make())
    return kept[slot][1]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows of at most ``limit`` text bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start, before = 0, 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def raw_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, row offsets); a null text has no bytes."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, per-row offsets into them) of the words of every row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    blank = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = ~blank
    starts[1:] &= blank[:-1] | edge[1:n]
    ends = ~blank
    ends[:-1] &= blank[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling; kept by the worker."""
    kept = worker_cache(f"powers{base}", dict)
    have = kept.get("p", np.ones(1, _U))
    if len(have) < n:
        while len(have) < n:
            have = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
        if len(have) <= 1 << 23:
            kept["p"] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit Rabin-Karp hash of every word's bytes, mixed with its length."""
    if not len(starts):
        return np.zeros(0, _U)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(len(data)), out=sums[1:])
    inverse = powers(len(data), pow(BASE, -1, 1 << 64))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes unchanged."""
    return data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0)).astype(np.uint8)


def group_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of runs of equal values in a sorted array."""
    if not len(keys):
        none = np.zeros(0, np.int64)
        return none, none
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.diff(np.append(starts, len(keys)))


ship_by_value(__name__)
