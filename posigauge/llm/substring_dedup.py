"""Substring deduplication over token windows.

Rabin-Karp hashes of every window of ``size`` words are counted in Spark: each
task packs the windows of a chunk of documents by hash bucket, and a bucket
finds the windows that start in more than one document. Repeats travel back to
their chunk, where they merge into maximal intervals of words to remove.

What is shuffled per window are 7 bytes of its hash and about 2 of its place.
The bucket comes from a second, independent hash, so a window is told apart by
56 bits and the bucket's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from posigauge.functions.shipping import ship_by_value
from posigauge.llm.common import (
    BASE,
    blocks,
    group_counts,
    mix,
    partitions,
    powers,
    raw_text,
    text_bytes,
    word_hashes,
    word_spans,
)

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20  # of text, for the number of buckets
SECOND_BASE = 0xD1B54A32D192ED03
HASH_BYTES = 7


def planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian integers, byte plane after byte plane: planes of zeros compress to nothing."""
    little = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return little[:, :width].T.tobytes()


def unplanes(data: memoryview, count: int, width: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, count * width).reshape(width, count).T
    return out.reshape(-1).view("<u8")


def deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=0).astype(np.int64).view(np.uint64)


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of the window that starts at each word, from prefix sums; the last size-1 are left out."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words), base), out=sums[1:])
    inverse = powers(len(words), pow(base, -1, 1 << 64))
    return mix((sums[size:] - sums[:-size]) * inverse[: len(words) - size + 1])


def pack_windows(block: pa.RecordBatch, size: int, buckets: int, chunk: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, chunk, payload) of one chunk; bucket < 0 carries the chunk's documents and local repeats."""
    data, offsets = raw_text(block.column("text"))
    starts, ends, word_at = word_spans(data, offsets)
    docs = np.asarray(block.column("key"), dtype=np.int64)
    text_key = np.asarray(block.column("text_key"), dtype=np.int64)
    words = word_hashes(data, starts, ends)
    lengths = np.diff(word_at)
    inside = np.maximum(lengths - size + 1, 0)
    total = int(inside.sum())
    local = np.zeros(0, np.int64)
    if total:
        owner = np.repeat(np.arange(len(docs)), inside)
        place = np.arange(total) - np.repeat(np.cumsum(inside) - inside, inside) + word_at[owner]
        window = window_hashes(words, size, BASE)[place]
        bucket = (window_hashes(words, size, SECOND_BASE)[place] % np.uint64(buckets)).astype(np.int64)
        window &= np.uint64((1 << 8 * HASH_BYTES) - 1)
        # Rows come sorted by key, so a stable sort puts the smallest document of a window first.
        order = np.argsort(window, kind="stable")
        at, counts = group_counts(window[order])
        doc = docs[owner]
        first = np.repeat(order[at], counts)
        repeat = np.zeros(total, bool)
        repeat[order] = (doc[order] > doc[first]) & (bucket[order] == bucket[first])
        local = place[repeat]
        sent = np.flatnonzero(~repeat)
        sent = sent[np.argsort(bucket[sent], kind="stable")]
        at, counts = group_counts(bucket[sent])
        for start, count in zip(at.tolist(), counts.tolist(), strict=True):
            part = sent[start : start + count]
            yield (
                int(bucket[part[0]]),
                chunk,
                planes(window[part], HASH_BYTES) + planes(deltas(place[part]), 4) + planes(deltas(doc[part]), 8),
            )
    head = np.array([len(docs), len(local)], "<i8").tobytes()
    payload = head + docs.tobytes() + text_key.tobytes() + word_at.astype("<i8").tobytes() + planes(deltas(local), 4)
    yield -1 - chunk, chunk, payload


def find_repeats(chunks: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(chunk, places) of the bucket's windows that also start in a document with a smaller key."""
    width = HASH_BYTES + 12
    counts = np.array([len(p) // width for p in payloads], np.int64)
    window, place, doc = (np.empty(int(counts.sum()), t) for t in (np.uint64, np.int64, np.int64))
    at = 0
    for payload, count in zip(payloads, counts.tolist(), strict=True):
        view, to = memoryview(payload), slice(at, at + count)
        window[to] = unplanes(view, count, HASH_BYTES)
        place[to] = np.cumsum(unplanes(view[HASH_BYTES * count :], count, 4).view(np.int64))
        doc[to] = np.cumsum(unplanes(view[(HASH_BYTES + 4) * count :], count, 8).view(np.int64))
        at += count
    order = np.argsort(window, kind="stable")
    starts, sizes = group_counts(window[order])
    smallest = np.minimum.reduceat(doc[order], starts) if len(starts) else doc
    repeat = np.zeros(len(window), bool)
    repeat[order] = doc[order] > np.repeat(smallest, sizes)
    ends = np.cumsum(counts)
    for chunk, start, end in zip(chunks, (ends - counts).tolist(), ends.tolist(), strict=True):
        found = place[start:end][repeat[start:end]]
        if len(found):
            yield chunk, planes(deltas(found), 4)


def merge_intervals(places: np.ndarray, word_at: np.ndarray, size: int) -> list[tuple[int, list[int]]]:
    """(row, [start, end, ...]) in words of the row: maximal intervals covered by windows at ``places``."""
    places = np.unique(places)
    if not len(places):
        return []
    row = np.searchsorted(word_at, places, side="right") - 1
    fresh = np.ones(len(places), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (places[1:] > places[:-1] + size)
    begin = np.flatnonzero(fresh)
    rows = row[begin]
    start = places[begin] - word_at[rows]
    end = places[np.append(begin[1:], len(places)) - 1] + size - word_at[rows]
    out: list[tuple[int, list[int]]] = []
    for r, s, e in zip(rows.tolist(), start.tolist(), end.tolist(), strict=True):
        if not out or out[-1][0] != r:
            out.append((r, []))
        out[-1][1].extend((s, e))
    return out


def chunk_intervals(payloads: list[tuple[bool, bytes]], size: int) -> tuple[list, list, list]:
    """Keys, text keys and intervals of a chunk's documents that lose words."""
    table = next(p for is_table, p in payloads if is_table)
    n, local = np.frombuffer(table, "<i8", 2).tolist()
    docs = np.frombuffer(table, "<i8", n, 16)
    text_key = np.frombuffer(table, "<i8", n, 16 + 8 * n)
    word_at = np.frombuffer(table, "<i8", n + 1, 16 + 16 * n)
    rest = memoryview(table)[16 + 8 * (3 * n + 1) :]
    places = [np.cumsum(unplanes(rest, local, 4).view(np.int64))]
    for is_table, payload in payloads:
        if not is_table:
            places.append(np.cumsum(unplanes(memoryview(payload), len(payload) // 4, 4).view(np.int64)))
    found = merge_intervals(np.concatenate(places), word_at, size)
    rows = [r for r, _ in found]
    return docs[rows].tolist(), text_key[rows].tolist(), [spans for _, spans in found]


def removal_spans(documents: DataFrame, size: int = 13, key: str = "doc_id") -> DataFrame:
    """(key, text_key, spans) of every document that loses words; spans are [start, end) pairs in words.

    A word goes if a window that covers it also starts in a document with a
    smaller key. ``key`` is an integer column; rows with a null key or text
    take no part, and equal keys are one document. A window that a third of
    all documents hold reaches its bucket once per chunk, not once per
    document, since repeats within a chunk are settled there. Chunks are
    numbered by partition and place, so the input's partitions have to be the
    same when a task is run again (files are).
    """
    rows = documents.select(F.col(key).cast("long").alias("key"), "text").where(
        F.col("key").isNotNull() & F.col("text").isNotNull()
    )
    buckets = max(256, partitions(documents.sparkSession), text_bytes(rows) // BUCKET_BYTES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 32
        for block in blocks(batches, "text", CHUNK_BYTES):
            block = block.take(pa.compute.sort_indices(block, sort_keys=[("key", "ascending")]))
            bucket, number, payload = zip(*pack_windows(block, size, buckets, chunk), strict=True)
            yield pa.record_batch(
                [pa.array(bucket, pa.int64()), pa.array(number, pa.int64()), pa.array(payload, pa.binary())],
                names=["bucket", "chunk", "payload"],
            )
            chunk += 1

    def repeats(table: pa.Table) -> pa.Table:
        chunks, payloads = table["chunk"].to_pylist(), table["payload"].to_pylist()
        if table["bucket"][0].as_py() < 0:
            found, is_table = list(zip(chunks, payloads, strict=True)), True
        else:
            found, is_table = list(find_repeats(chunks, payloads)), False
        return pa.table(
            {
                "chunk": pa.array([c for c, _ in found], pa.int64()),
                "is_table": pa.array([is_table] * len(found), pa.bool_()),
                "payload": pa.array([p for _, p in found], pa.binary()),
            }
        )

    def intervals(table: pa.Table) -> pa.Table:
        pairs = list(zip(table["is_table"].to_pylist(), table["payload"].to_pylist(), strict=True))
        docs, text_key, spans = chunk_intervals(pairs, size)
        return pa.table(
            {
                "key": pa.array(docs, pa.int64()),
                "text_key": pa.array(text_key, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.int32())),
            }
        )

    packed = rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(
        pack, "bucket long, chunk long, payload binary"
    )
    found = packed.groupBy("bucket").applyInArrow(repeats, "chunk long, is_table boolean, payload binary")
    spans = found.groupBy("chunk").applyInArrow(intervals, "key long, text_key long, spans array<int>")
    return spans.dropDuplicates(["key", "text_key"])


def keep_words(text: str, spans: list[int] | None) -> tuple[int, int, str]:
    """(words, removed words, kept words joined by one space)."""
    words = text.encode().split()
    kept = words
    if spans:
        kept, at = [], 0
        for start, end in zip(spans[::2], spans[1::2], strict=True):
            kept += words[at:start]
            at = end
        kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept).decode()


def cut_text(text: str, spans: list[int] | None) -> str:
    """The text without the words of ``spans``; white space elsewhere stays as it is."""
    if not spans:
        return text
    data = text.encode()
    starts, ends, _ = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    kept, at = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        kept.append(data[at : starts[start]])
        at = int(starts[end]) if end < len(starts) else int(ends[-1])
    kept.append(data[at:])
    return b"".join(kept).decode()


def remove_repeats(documents: DataFrame, size: int = 13, key: str = "doc_id") -> DataFrame:
    """All rows and columns of ``documents`` with n_words, n_removed, spans, kept_text and cut_text.

    kept_text has the kept words joined by one space, cut_text keeps the other
    white space. A null text has no words; its kept_text is empty and its
    cut_text null. Rows with a null key lose nothing. New columns replace
    columns of the same name. Empty tables give empty results.
    """
    added = ["n_words", "n_removed", "spans", "kept_text", "cut_text"]
    documents = documents.drop(*added)
    spans = removal_spans(documents, size, key).withColumnRenamed("spans", "_spans")
    joined = documents.withColumn("_text_key", F.xxhash64("text")).join(
        spans,
        (F.col(key).cast("long") == spans["key"]) & (F.col("_text_key") == spans["text_key"]),
        "left",
    )
    joined = joined.select(*[documents[c] for c in documents.columns], F.col("_spans"))
    names = [f for f in documents.schema]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", CHUNK_BYTES):
            texts, spans = block.column("text").to_pylist(), block.column("_spans").to_pylist()
            done = [keep_words(t or "", s) for t, s in zip(texts, spans, strict=True)]
            cuts = [t if t is None else cut_text(t, s) for t, s in zip(texts, spans, strict=True)]
            yield pa.record_batch(
                [block.column(f.name) for f in names]
                + [
                    pa.array([d[0] for d in done], pa.int64()),
                    pa.array([d[1] for d in done], pa.int64()),
                    block.column("_spans"),
                    pa.array([d[2] for d in done], pa.string()),
                    pa.array(cuts, pa.string()),
                ],
                names=[f.name for f in names] + added,
            )

    kinds = [LongType(), LongType(), ArrayType(IntegerType()), StringType(), StringType()]
    return joined.mapInArrow(keep, StructType([*names, *map(StructField, added, kinds)]))


ship_by_value(__name__)
