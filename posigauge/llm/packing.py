"""Packing token sequences into fixed windows by non-negative least squares.

Whole windows are cut from long documents. What remains of each document has
one of ``window`` - 1 lengths; their histogram is matched by repeat counts of
shallow combinations of lengths that fill a window exactly. The counts come
from non-negative least squares and are rounded down; documents of a length
that no combination takes are laid end to end and cut at window borders.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posigauge.functions.shipping import ship_by_value
from posigauge.llm.common import blocks, worker_cache
from posigauge.session import scratch_path

BLOCK_BYTES = 4 << 20
CACHE_WORDS = 400_000
FULL = 1 << 62  # sequence ids: whole windows of one document
REST = 1 << 61  # sequence ids: documents laid end to end
PART_BITS = 40  # whole windows are numbered within their part: 2^51 tokens in each of 2^22 parts


class Encoder:
    """Token ids as little-endian bytes; words between single blanks are remembered.

    In the pre-tokenizer's pattern a run between single spaces or line ends is
    encoded on its own (with the space before it), so texts without any other
    white space are looked up word by word. Other texts are encoded whole.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int], width: int):
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = list(special)
        self.kind = f"<u{width}"
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if any(mark in text for mark in self.special):
            return self.pack(self.bpe.encode(text, allowed_special="all"))
        lines = [line.split(" ") for line in text.split("\n")]
        if sum(map(len, lines)) != len(text.split()):
            return self.pack(self.bpe.encode_ordinary(text))
        if len(self.first) + len(self.later) > CACHE_WORDS:
            self.first.clear()
            self.later.clear()
        parts, end = [], self._get(self.first, "\n", "\n")
        for words in lines:
            parts.append(self._get(self.first, words[0], words[0]))
            known = self.later
            for word in words[1:]:
                found = known.get(word)
                parts.append(found if found is not None else self._get(known, word, " " + word))
            parts.append(end)
        return b"".join(parts[:-1])

    def _get(self, known: dict[str, bytes], word: str, text: str) -> bytes:
        found = known.get(word)
        if found is None:
            found = known[word] = self.pack(self.bpe.encode_ordinary(text))
        return found


def combinations(histogram: np.ndarray, frequent: int = 48) -> list[tuple[int, ...]]:
    """Pairs of present lengths that fill the window, and triples with two of the ``frequent`` lengths."""
    window = len(histogram)
    present = set(np.flatnonzero(histogram).tolist()) - {0}
    found = {(a, window - a) for a in present if a <= window - a and window - a in present}
    weight = histogram * np.arange(window)
    often = [int(a) for a in np.argsort(-weight, kind="stable")[:frequent] if histogram[a] and a]
    for a, b in itertools.combinations_with_replacement(sorted(often), 2):
        if window - a - b in present:
            found.add(tuple(sorted((a, b, window - a - b))))
    return sorted(found)


def nnls_counts(histogram: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that minimise |A x - histogram|, by coordinate descent.

    Every sweep lowers the error; sweeps end when no count moves by a tenth of
    a window, or after ``sweeps``, where any x is still a valid packing and
    only leaves more to be laid end to end.
    """
    columns = [tuple(Counter(c).items()) for c in combos]
    norms = [sum(n * n for _, n in column) for column in columns]
    left = histogram.astype(float).copy()
    left[0] = 0
    left = left.tolist()
    x = [0.0] * len(combos)
    for _ in range(sweeps):
        moved = 0.0
        for j, column in enumerate(columns):
            step = sum(n * left[a] for a, n in column) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for a, n in column:
                    left[a] -= n * step
        if moved < 0.1:
            break
    return np.array(x)


@dataclass
class Plan:
    """Where the n-th remainder of each length goes; bounded by the number of combinations."""

    window: int
    keys: np.ndarray  # length << 40 | first rank of the slot
    sequence: np.ndarray  # sequence id of the slot's first rank
    offset: np.ndarray  # the slot's place in its sequences
    used: np.ndarray  # ranks of each length that combinations take
    stream: np.ndarray  # where the other remainders of each length begin, end to end
    full: int  # tokens of the stream that fill whole windows
    borders: list[int]  # the stream's borders after them

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence id, offset) of the pieces of one remainder."""
        if not length:
            return []
        if rank < self.used[length]:
            slot = int(np.searchsorted(self.keys, (length << 40) + rank, side="right")) - 1
            first = int(self.keys[slot]) - (length << 40)
            return [(0, length, int(self.sequence[slot]) + rank - first, int(self.offset[slot]))]
        at = int(self.stream[length]) + (rank - int(self.used[length])) * length
        end, start, out = at + length, at, []
        while at < end:
            if at < self.full:
                begin = at // self.window * self.window
                number, border = at // self.window, begin + self.window
            else:
                later = int(np.searchsorted(self.borders, at, side="right"))
                begin, border = self.borders[later - 1], self.borders[later]
                number = self.full // self.window + later - 1
            stop = min(end, border)
            out.append((at - start, stop - at, REST + number, at - begin))
            at = stop
        return out


def make_plan(histogram: np.ndarray) -> Plan:
    """Combinations, their rounded counts, and the end-to-end rest, whose last windows are powers of two."""
    window = len(histogram)
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    combos = combinations(histogram)
    x = nnls_counts(histogram, combos)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(window, np.int64)
    sequence = 0
    # rounded down first; then what is left is filled greedily by combinations that still fit
    for target in (np.floor(x).astype(np.int64).tolist(), [None] * len(combos)):
        for j in np.argsort(-x, kind="stable").tolist():
            need = Counter(combos[j])
            most = min(int(left[a]) // n for a, n in need.items())
            count = most if target[j] is None else min(most, target[j])
            if count <= 0:
                continue
            offset = 0
            for a in combos[j]:
                slots.setdefault(a, []).append((int(used[a]), sequence, offset))
                used[a] += count
                left[a] -= count
                offset += a
            sequence += count
    flat = sorted(((a << 40) + first, number, offset) for a, rows in slots.items() for first, number, offset in rows)
    tokens = left * np.arange(window)
    stream = np.cumsum(tokens) - tokens
    total = int(tokens.sum())
    full = total // window * window
    borders, rest = [full], total - full
    for bit in reversed(range(window.bit_length())):
        if rest >> bit & 1:
            borders.append(borders[-1] + (1 << bit))
    columns = [np.array(c, np.int64) for c in zip(*flat, strict=True)] if flat else [np.zeros(0, np.int64)] * 3
    return Plan(window, *columns, used, stream, full, borders)


def encode_documents(
    documents: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], end: int, window: int, key: str
) -> DataFrame:
    """(key, part, number, rank, tokens, ids) as a table in the shared folder, so that every later step reads the same.

    number counts the whole windows of the part's rows before the row; rank is
    its place among those with the same remainder. ids are bytes of 2 or 4 each.
    """
    kind = documents.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(
            f"encoder:{ranks_path}:{pattern}", lambda: Encoder(ranks_path, pattern, special, 2)
        )
        last, width = encoder.pack([end]), 2
        seen, number = np.zeros(window, np.int64), 0
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        for block in blocks(batches, "text", BLOCK_BYTES):
            ids = [encoder.encode(t or "") + last for t in block.column("text").to_pylist()]
            tokens = [len(i) // width for i in ids]
            ranks, numbers = [], []
            for n in tokens:
                ranks.append(int(seen[n % window]))
                seen[n % window] += 1
                numbers.append(number)
                number += n // window
            count = len(ids)
            yield pa.record_batch(
                [
                    block.column(key),
                    pa.array([part] * count, pa.int64()),
                    pa.array(numbers, pa.int64()),
                    pa.array(ranks, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=[key, "part", "number", "rank", "tokens", "ids"],
            )

    if max([end, *special.values()]) >= 1 << 16:
        raise ValueError("ids are stored in two bytes")
    spark = documents.sparkSession
    path = scratch_path(spark, "token-ids")
    documents.select(key, "text").mapInArrow(
        encode, f"`{key}` {kind}, part long, number long, rank long, tokens long, ids binary"
    ).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def pack(
    documents: DataFrame,
    *,
    ranks_path: str,
    pattern: str,
    special: dict[str, int],
    end: int = 1,
    window: int = 2048,
    ids: bool = True,
    key: str = "doc_id",
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Every token of a document and its end id lies in exactly one piece, and a
    sequence holds at most ``window`` tokens without gaps. Sequences are
    complete but for the last few, which have powers of two as sizes, so there
    is no padding. A null or empty text is its end id alone; repeated rows are
    packed each; an empty table gives no sequence. Encoded documents are
    written once to the shared folder. Other columns of ``documents`` are not
    read and cannot clash. The driver sees a histogram of
    ``window`` counts; each length's rows are counted per part of the table.
    """
    table = encode_documents(documents, ranks_path, pattern, special, end, window, key)
    remainder = F.col("tokens") % window
    counts = table.groupBy("part", remainder.alias("size")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("part").alias("_part"), F.col("size").alias("_size"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    histogram = np.zeros(window, np.int64)
    for row in counts.groupBy("size").agg(F.sum("_n").alias("n")).collect():
        histogram[row["size"]] = row["n"]
    plan = documents.sparkSession.sparkContext.broadcast(vars(make_plan(histogram)))
    kind = documents.schema[key].dataType.simpleString()
    joined = table.join(offsets, (F.col("part") == F.col("_part")) & (remainder == F.col("_size"))).select(
        key, "part", "number", (F.col("_before") + F.col("rank")).alias("rank"), "tokens", "ids"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Plan(**plan.value).places
        for block in blocks(batches, "ids", BLOCK_BYTES):
            rows, data, home = [], [], []
            columns = [block.column(c).to_pylist() for c in ("part", "number", "rank", "tokens", "ids")]
            for n, (part, number, rank, tokens, raw) in enumerate(zip(*columns, strict=True)):
                values = np.frombuffer(raw, "<u2").astype("<u4")
                whole = tokens // window
                base = FULL + (part << PART_BITS) + number
                pieces = [(b * window, window, base + b, 0) for b in range(whole)]
                shift = whole * window
                pieces += [(s + shift, m, q, o) for s, m, q, o in places(tokens % window, rank)]
                for start, length, sequence, offset in pieces:
                    piece = values[start : start + length].tobytes()
                    rows.append((start, length, zlib.crc32(piece), tokens, sequence, offset))
                    home.append(n)
                    if ids:
                        data.append(piece)
            arrays = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if ids:
                arrays.append(pa.array(data, pa.binary()))
                names.append("ids")
            yield pa.record_batch([block.column(key).take(pa.array(home)), *arrays], names=[key, *names])

    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return joined.mapInArrow(cut, schema + (", ids binary" if ids else ""))


ship_by_value(__name__)
