"""Links between the tokens of two vocabularies over the same bytes, by products of sparse matrices.

Every token is a row of a token-byte incidence matrix in compressed sparse rows
(CSR). Gustavson's row products A·Bᵀ have an entry for each pair of tokens whose
bytes overlap, with the number of common bytes; products of the token-group
matrices have one for each pair of tokens between two common cuts.

Texts are encoded once, in chunks that go to a scratch table as packed arrays
next to the chunk's distinct pairs of ids. Corpus-wide counts are joined to
those pairs, not to links, and come back to a chunk as one array.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posigauge.functions.shipping import ship_by_value
from posigauge.llm.common import blocks, worker_cache
from posigauge.llm.token_counts import byte_letters
from posigauge.session import scratch_path

BLOCK_BYTES = 1 << 20  # encoded and linked at once
CHUNK_BYTES = 8 << 20  # one row of the scratch table
PIECE_BLANK = "▁"
CACHE_WORDS, LONG_WORD = 200_000, 64
BESIDE_BLANK = re.compile(r" \s|\s |^\s|\s$")


@dataclass
class Csr:
    """A 0/1 matrix: the columns of row r are columns[starts[r]:starts[r + 1]], ascending."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.starts) - 1


def spans_matrix(ends: np.ndarray, width: int) -> Csr:
    """Rows that cover the columns up to their end, each from the end of the one before."""
    return Csr(np.append(0, ends), np.arange(width), width)


def transposed(matrix: Csr) -> Csr:
    """Counting sort of the entries by column."""
    starts = np.zeros(matrix.width + 1, np.int64)
    np.cumsum(np.bincount(matrix.columns, minlength=matrix.width), out=starts[1:])
    row = np.repeat(np.arange(matrix.rows), np.diff(matrix.starts))
    return Csr(starts, row[np.argsort(matrix.columns, kind="stable")], matrix.rows)


def product(a: Csr, b: Csr) -> tuple[Csr, np.ndarray]:
    """(pattern, values) of A·B by rows: the rows of B that a row of A names, merged."""
    at = b.starts[a.columns]
    sizes = b.starts[a.columns + 1] - at
    ends = np.cumsum(sizes)
    row = np.repeat(np.repeat(np.arange(a.rows), np.diff(a.starts)), sizes)
    column = b.columns[np.repeat(at - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
    keys = row * b.width + column
    if len(keys) and (keys[1:] < keys[:-1]).any():
        keys = np.sort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    starts = np.searchsorted(keys[first], np.arange(a.rows + 1) * b.width)
    return Csr(starts, keys[first] % b.width, b.width), np.diff(np.append(first, len(keys)))


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Entries in each row of A·B where the rows of B do not overlap: the symbolic step alone."""
    sizes = np.append(0, np.cumsum(np.diff(b.starts)[a.columns]))
    return sizes[a.starts[1:]] - sizes[a.starts[:-1]]


def common_cuts(a_ends: np.ndarray, b_ends: np.ndarray, width: int) -> np.ndarray:
    """Ends of the groups: places where tokens of both end."""
    both = np.zeros(width + 1, bool)
    both[a_ends] = True
    b_only = np.zeros(width + 1, bool)
    b_only[b_ends] = True
    return np.flatnonzero(both & b_only)


class Vocabularies:
    """Both encoders and the bytes of their tokens.

    The byte-level vocabulary is read with its library's file of ranks, whose
    ids equal those of the vocabulary's JSON file; special tokens stay plain text.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, model_path: str):
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.a = tiktoken.Encoding("links", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        with open(json_path, encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        value = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            if all(letter in value for letter in entry):
                self.a_bytes[number] = bytes(value[letter] for letter in entry)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(n) else p.replace(PIECE_BLANK, " ").encode()
            for n, p in enumerate(pieces)
        ]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        # Every id with the mark that follows it inside a group and at its end.
        sizes = [len(self.a_bytes), len(self.b_bytes)]
        self.names = np.array([f"{n}{m}" for size, ms in zip(sizes, (",|", ",;"), strict=True) for m in ms for n in range(size)], object)

    def name(self, side: int, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Places in ``names``."""
        return ids + last * len(self.b_bytes if side else self.a_bytes) + side * 2 * len(self.a_bytes)

    def _both(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of blank + text in both as 4-byte numbers, None where the joined bytes differ from it."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            whole = " " + text
            a, data = self.a.encode_ordinary(whole), whole.encode()
            same = data == b"".join(map(self.a_bytes.__getitem__, a)) == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((array("i", a).tobytes(), array("i", b).tobytes()) if same else None)
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of both, none where a text is empty or the joined bytes of one differ from blank + text.

        A word between single blanks gets the same ids alone as in its text: the
        first vocabulary's pattern begins a part at such a blank, and no piece of
        the second has a blank after another letter. So words are remembered.
        Texts with other white space beside a blank or at an end are encoded whole.
        """
        cut = [t.split(" ") if t and not BESIDE_BLANK.search(t) else None for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        fresh = list(set().union(*filter(None, cut)) - self.known.keys())
        found = dict(zip(fresh, self._both(fresh), strict=True))
        whole = [t for t, words in zip(texts, cut, strict=True) if t and words is None]
        whole = iter(self._both(whole))
        known, out = self.known, []
        known.update(found)
        for text, words in zip(texts, cut, strict=True):
            parts = [known[w] for w in words] if words else [next(whole)] if text else [None]
            if None in parts:
                out.append((b"", b""))
            else:
                out.append((b"".join([a for a, _ in parts]), b"".join([b for _, b in parts])))
        for word in fresh:
            if len(word) > LONG_WORD:
                del known[word]
        return out


@dataclass
class Links:
    """All texts of a block: ids, common groups and overlap links."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray  # first token of each text, and the end
    b_at: np.ndarray
    overlap: Csr  # A tokens x B tokens
    a_groups: Csr  # groups x A tokens
    b_groups: Csr
    group_at: np.ndarray  # first group of each text, and the end
    shared: np.ndarray  # pairs of tokens in a common group, per A token

    @property
    def link_at(self) -> np.ndarray:
        return self.overlap.starts[self.a_at]


def flat(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int64)
    return np.frombuffer(b"".join(ids), np.int32).astype(np.int64), at


def link_texts(vocabularies: Vocabularies, texts: list[str | None]) -> Links:
    """Texts laid end to end: a text's last tokens end together, so no token or group crosses texts."""
    encoded = vocabularies.encode(texts)
    a, a_at = flat([x for x, _ in encoded])
    b, b_at = flat([x for _, x in encoded])
    a_ends, b_ends = np.cumsum(vocabularies.a_sizes[a]), np.cumsum(vocabularies.b_sizes[b])
    width = int(a_ends[-1]) if len(a) else 0
    overlap, _ = product(spans_matrix(a_ends, width), transposed(spans_matrix(b_ends, width)))
    cuts = common_cuts(a_ends, b_ends, width) if width else np.zeros(0, np.int64)
    # Cuts are token ends, so groups are spans of tokens too.
    a_groups = spans_matrix(np.searchsorted(a_ends, cuts, side="right"), len(a))
    b_groups = spans_matrix(np.searchsorted(b_ends, cuts, side="right"), len(b))
    text_ends = np.append(0, a_ends)[a_at]
    group_at = np.searchsorted(cuts, text_ends, side="right")
    return Links(a, b, a_at, b_at, overlap, a_groups, b_groups, group_at, product_sizes(transposed(a_groups), b_groups))


def shared_links(links: Links, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of the pairs in common groups, for a slice of the A tokens: the product's own rows."""
    groups = transposed(links.a_groups)
    part = groups.starts[rows.start : rows.stop + 1]
    pattern, _ = product(Csr(part - part[0], groups.columns[part[0] : part[-1]], groups.width), links.b_groups)
    return np.repeat(np.arange(rows.start, rows.stop), np.diff(pattern.starts)), pattern.columns


def group_texts(links: Links, vocabularies: Vocabularies) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of every text: a group's tokens of both sides one after the other, each with its mark."""
    a_at, b_at = links.a_groups.starts, links.b_groups.starts
    group_a = np.repeat(np.arange(links.a_groups.rows), np.diff(a_at))
    group_b = np.repeat(np.arange(links.b_groups.rows), np.diff(b_at))
    a, b = np.arange(len(links.a)), np.arange(len(links.b))
    marked = np.empty(len(a) + len(b), np.int64)
    marked[a + b_at[group_a]] = vocabularies.name(0, links.a, a + 1 == a_at[group_a + 1])
    marked[b + a_at[group_b + 1]] = vocabularies.name(1, links.b, b + 1 == b_at[group_b + 1])
    names = vocabularies.names[marked].tolist()
    borders = (links.a_at + links.b_at).tolist()
    return ["".join(names[i:j])[:-1] for i, j in zip(borders, borders[1:], strict=False)]


def id_pairs(links: Links) -> np.ndarray:
    """a << 32 | b of every link, in order."""
    return np.repeat(links.a, np.diff(links.overlap.starts)) << 32 | links.b[links.overlap.columns]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 4-byte numbers, each led by its length, compressed."""
    parts = [p for x in arrays for p in (np.array([len(x)], "<i8").tobytes(), x.astype("<i4").tobytes())]
    plain = b"".join(parts)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    plain = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(plain):
        n = int(np.frombuffer(plain, "<i8", 1, at)[0])
        out.append(np.frombuffer(plain, "<i4", n, at + 8))
        at += 8 + 4 * n
    return out


def token_links(
    documents: DataFrame, json_path: str, ranks_path: str, pattern: str, model_path: str, key: str = "doc_id"
) -> DataFrame:
    """Links between the tokens of every text under two vocabularies.

    Columns: key, n_a, n_b, n_groups, n_links, n_shared (pairs of tokens in a
    common group), groups_sha256, n_best and count_sum. A pair of ids counts
    the rows of ``documents`` that hold it linked; n_best are the links whose
    count is the highest of their A id, ties included; count_sum adds the
    counts of all links. Texts that are null or empty, or that a vocabulary
    does not give back byte by byte, have zeros and an empty groups_sha256.
    Repeated rows count and give a result each, null keys too; an empty table
    gives none; other columns of ``documents`` are not read and cannot clash.

    A chunk's distinct pairs are what is shuffled: a pair that every document
    holds has one row per chunk. No table is broadcast and no group is larger
    than a chunk.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    figures = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]
    row = f"struct<key: {kind}, {', '.join(f'{f}: long' for f in figures)}, groups_sha256: string>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = worker_cache(
            "links", lambda: Vocabularies(json_path, ranks_path, pattern, model_path), json_path + model_path
        )
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 32
        waiting, size = [], 0
        for block in blocks(batches, "text", BLOCK_BYTES):
            texts = block.column("text").to_pylist()
            links = link_texts(vocabularies, texts)
            pairs, where = id_pairs(links), links.link_at
            number, ids = pd.factorize(pairs)
            text = np.repeat(np.arange(len(texts)), np.diff(where))
            held, times = np.unique(text * max(len(ids), 1) + number, return_counts=True)
            text, number = np.divmod(held, max(len(ids), 1))
            sums = np.append(0, np.cumsum(links.shared))
            columns = [
                np.diff(links.a_at),
                np.diff(links.b_at),
                np.diff(links.group_at),
                np.diff(where),
                sums[links.a_at[1:]] - sums[links.a_at[:-1]],
            ]
            shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in group_texts(links, vocabularies)]
            fields = [block.column(key), *map(pa.array, columns), pa.array(shas)]
            rows = pa.StructArray.from_arrays(fields, names=["key", *figures, "groups_sha256"])
            waiting.append((rows, ids, np.bincount(text, minlength=len(texts)), number, times))
            size += sum(len(t) for t in texts if t)
            if size >= CHUNK_BYTES:
                yield chunk_row(chunk, waiting)
                waiting, size, chunk = [], 0, chunk + 1
        if waiting:
            yield chunk_row(chunk, waiting)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                a, b, n = unpack(data)
                for at in range(0, max(len(a), 1), 1 << 18):
                    part = slice(at, at + (1 << 18))
                    place = np.arange(at, at + len(a[part]), dtype=np.int32)
                    yield pa.record_batch(
                        [pa.array(np.full(len(place), chunk)), *map(pa.array, (place, a[part], b[part], n[part]))],
                        names=["chunk", "place", "a", "b", "n"],
                    )

    def finish(chunks: pa.Table, counted: pa.Table) -> pa.Table:
        rows = chunks["rows"].combine_chunks().flatten()
        per_text, number, times = unpack(chunks["links"][0].as_py())
        count = np.zeros(counted.num_rows, np.int64)
        best = np.zeros(counted.num_rows, np.int64)
        place = counted["place"].to_numpy()
        count[place], best[place] = counted["count"].to_numpy(), counted["best"].to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(per_text.astype(np.int64)))
        sums = [np.append(0, np.cumsum(times * v[number])) for v in (best, count)]
        n_best, count_sum = (s[ends[1:]] - s[ends[:-1]] for s in sums)
        return pa.table({"rows": rows, "n_best": pa.array(n_best), "count_sum": pa.array(count_sum)})

    path = scratch_path(spark, "token-links")
    documents.select(key, "text").mapInArrow(
        encode, f"chunk long, rows array<{row}>, pairs binary, links binary"
    ).write.parquet(path)
    chunks = spark.read.parquet(path)
    pairs = chunks.select("chunk", "pairs").mapInArrow(spread, "chunk long, place int, a int, b int, n int")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = counts.groupBy(F.col("a").alias("a_id")).agg(F.max("count").alias("highest"))
    judged = counts.join(highest, F.col("a") == F.col("a_id")).select(
        "a", "b", "count", (F.col("count") == F.col("highest")).alias("best")
    )
    counted = pairs.join(judged, ["a", "b"]).select("chunk", "place", "count", "best")
    done = chunks.select("chunk", "rows", "links").groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(
        finish, f"rows {row}, n_best long, count_sum long"
    )
    return done.select(F.col("rows.key").alias(key), *[f"rows.{f}" for f in figures], "rows.groups_sha256", "n_best", "count_sum")


def chunk_row(chunk: int, waiting: list[tuple]) -> pa.RecordBatch:
    """One row for some blocks: their texts' figures, distinct id pairs with text counts, and links by pair."""
    number, ids = pd.factorize(np.concatenate([w[1] for w in waiting]))
    borders = np.append(0, np.cumsum([len(w[1]) for w in waiting]))
    links = np.concatenate([number[b:][w[3]] for b, w in zip(borders, waiting, strict=False)])
    texts = np.bincount(links, minlength=len(ids))
    rows = pa.concat_arrays([w[0] for w in waiting])
    ids = ids.astype(np.int64)
    packed = [
        pack(ids >> 32, ids & 0xFFFFFFFF, texts),
        pack(np.concatenate([w[2] for w in waiting]), links, np.concatenate([w[4] for w in waiting])),
    ]
    return pa.record_batch(
        [
            pa.array([chunk]),
            pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
            *[pa.array([p], pa.binary()) for p in packed],
        ],
        names=["chunk", "rows", "pairs", "links"],
    )


ship_by_value(__name__)
