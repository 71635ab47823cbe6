"""Hidden Markov language model over words.

Words are told apart by 64-bit hashes and counted over all training texts. A
hidden state emits a symbol: one of the most frequent words, or a class of the
other words by their ending. A class word is then drawn by its smoothed
frequency in the class, so every word, seen or not, has a probability.
Baum-Welch counts of whole texts are computed per task and summed by Spark: the
texts of several chunks are worked on at once, token by token. Only very long
ones are cut into segments; products of their transition matrices carry the
state over the cuts. The scaled forward recursion gives the exact probability
of a whole text.

Texts are encoded once and written to the shared folder. Word counts come back
to each chunk through hash buckets, so no task needs the whole vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posigauge.functions.shipping import ship_by_value
from posigauge.llm.common import blocks, group_counts, lower_ascii, mix, raw_text, word_hashes, word_spans
from posigauge.session import scratch_path

CHUNK_BYTES = 4 << 20
BUCKET_WORDS = 400_000
SEGMENT = 512  # tokens of a segment of a text that is cut
WHOLE = 4  # segments up to which a text is not cut
BATCH_SEGMENTS = 1 << 9
BATCH_TOKENS = 1 << 18  # tokens whose state shares are held at once
POOL_TOKENS = 1 << 22  # tokens of chunks that are counted together
RESCALE = 8  # steps from one scaling to the next, at most
END = np.uint64(0x5DEECE66D1CE4E5B)  # the token after the last word
STARTS, TOTALS = -1000, -1001  # rows of the expected counts that are not symbols


def to_bytes(*arrays: np.ndarray) -> bytes:
    """Arrays one after another; from_bytes needs the same types and lengths."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def from_bytes(data: bytes, *parts: tuple[str, int]) -> list[np.ndarray]:
    out, at = [], 0
    for kind, n in parts:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """Three little-endian bytes per value, byte plane after byte plane."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T)


def wide(planes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    out[:, :3] = planes.reshape(3, n).T
    return out.reshape(-1).view("<u4").astype(np.int64)


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with first places and ranks, through a hash table: texts repeat their words."""
    table = pa.array(values).dictionary_encode()
    distinct, codes = table.dictionary.to_numpy(), table.indices.to_numpy()
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], first[order], rank[codes]


def encode_block(block: pa.RecordBatch, classes: int) -> dict:
    """One chunk: its documents, its distinct tokens with training counts and classes, and its token sequence."""
    data, offsets = raw_text(block.column("text"))
    data = lower_ascii(data)
    starts, ends, word_at = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    words = np.diff(word_at)
    lengths = words + 1
    last = np.cumsum(lengths) - 1
    tokens = np.empty(int(lengths.sum()), np.uint64)
    ends_here = np.zeros(len(tokens), bool)
    ends_here[last] = True
    tokens[ends_here], tokens[~ends_here] = END, hashes
    train = block.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
    distinct, first, place = ranked(tokens)
    counts = np.bincount(place, np.repeat(train, lengths), len(distinct)).astype("<i8")
    ending = np.zeros(len(distinct), np.uint64)
    is_word = ~ends_here[first]
    word = (first - np.searchsorted(last, first))[is_word]  # without the ends before it
    for back in (1, 2, 3):
        at = ends[word] - back
        reach = at >= starts[word]
        ending[np.flatnonzero(is_word)[reach]] += (data[at[reach]].astype(np.uint64) + np.uint64(1)) << np.uint64(9 * back)
    form = (mix(ending) % np.uint64(classes)).astype("<u2")
    key = block.column("key")
    return {
        "docs": len(lengths),
        "words": len(distinct),
        "tokens": len(tokens),
        "documents": to_bytes(
            key.fill_null(0).to_numpy().astype("<i8"),
            key.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8),
            train,
            lengths.astype("<i4"),
        ),
        "vocabulary": to_bytes(distinct.astype("<u8"), counts, form),
        "sequence": narrow(place).tobytes(),
    }


ENCODED = "chunk long, docs int, words int, tokens int, documents binary, vocabulary binary, sequence binary"
SEQUENCES = "chunk long, docs int, tokens int, documents binary, figures binary, symbols binary"


def _written(frame: DataFrame, label: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, label)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.parquet(path)


def encode(documents: DataFrame, train: Column, classes: int, key: str) -> DataFrame:
    rows = documents.select(F.col(key).cast("long").alias("key"), "text", F.coalesce(train, F.lit(False)).alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 32
        for block in blocks(batches, "text", CHUNK_BYTES):
            row = {"chunk": chunk, **encode_block(block, classes)}
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))
            chunk += 1

    return _written(rows.mapInArrow(run, ENCODED), "hmm-encoded")


def count_words(encoded: DataFrame, classes: int, frequent: int) -> DataFrame:
    """(kind, chunk, n, payload) from hash buckets: 0 counts for a chunk, 1 totals, 2 a bucket's most frequent words."""
    total = encoded.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    buckets = max(64, total // BUCKET_WORDS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["words"]
                words, counts, form = from_bytes(row["vocabulary"], ("<u8", n), ("<i8", n), ("<u2", n))
                bucket = (words % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                starts, sizes = group_counts(bucket[order])
                parts = [order[s : s + m] for s, m in zip(starts.tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch(
                    [
                        pa.array(bucket[order[starts]], pa.int64()),
                        pa.array([row["chunk"]] * len(parts), pa.int64()),
                        pa.array(sizes, pa.int32()),
                        pa.array([to_bytes(words[p], counts[p], form[p]) for p in parts], pa.binary()),
                    ],
                    names=["bucket", "chunk", "n", "payload"],
                )

    def count(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        parts = [
            from_bytes(p, ("<u8", n), ("<i8", n), ("<u2", n))
            for p, n in zip(table["payload"].to_pylist(), sizes, strict=True)
        ]
        words, counts, form = (np.concatenate(c) for c in zip(*parts, strict=True))
        distinct, first, place = np.unique(words, return_index=True, return_inverse=True)
        sums = np.bincount(place, counts, len(distinct)).astype("<i8")
        seen = np.flatnonzero(sums)
        mass = np.bincount(form[first[seen]], sums[seen] + 1, classes).astype("<i8")
        rows = [(1, -1, classes, to_bytes(np.array([sums.sum(), len(seen)], "<i8"), mass))]
        top = seen[np.lexsort((distinct[seen], -sums[seen]))[:frequent]]
        rows.append((2, -1, len(top), to_bytes(distinct[top], sums[top], form[first[top]])))
        at = 0
        for chunk, n in zip(table["chunk"].to_pylist(), sizes, strict=True):
            rows.append((0, chunk, n, to_bytes(words[at : at + n], sums[place[at : at + n]])))
            at += n
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        columns = zip(*rows, strict=True)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "chunk", "n", "payload"), columns, kinds, strict=True)})

    dealt = encoded.select("chunk", "words", "vocabulary").mapInArrow(deal, "bucket long, chunk long, n int, payload binary")
    return _written(dealt.groupBy("bucket").applyInArrow(count, "kind int, chunk long, n int, payload binary"), "hmm-counts")


@dataclass
class Vocabulary:
    """Bounded: the frequent words by hash, the mass of every symbol, and the totals."""

    tokens: int
    types: int
    top: np.ndarray  # sorted hashes
    mass: np.ndarray  # of symbols: frequent words, then classes (with one unseen word each)

    @property
    def share(self) -> np.ndarray:
        return self.mass / self.mass.sum()


def vocabulary(counted: DataFrame, classes: int, frequent: int) -> Vocabulary:
    def sum_masses(table: pa.Table) -> pa.Table:
        total = np.zeros(classes + 2, np.int64)
        for payload in table["payload"].to_pylist():
            total += np.frombuffer(payload, "<i8")
        return pa.table({"salt": table["salt"].slice(0, 1), "payload": pa.array([total.tobytes()], pa.binary())})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, payload in zip(batch["n"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                words, counts, form = from_bytes(payload, ("<u8", n), ("<i8", n), ("<u2", n))
                yield pa.record_batch(
                    [pa.array(words.view("<i8")), pa.array(counts), pa.array(form.astype(np.int32))],
                    names=["word", "count", "form"],
                )

    salted = counted.where("kind = 1").select((F.xxhash64("payload") % 32).alias("salt"), "payload")
    sums = salted.groupBy("salt").applyInArrow(sum_masses, "salt long, payload binary").collect()
    total = sum((np.frombuffer(r["payload"], "<i8") for r in sums), np.zeros(classes + 2, np.int64))
    words = counted.where("kind = 2").select("n", "payload").mapInArrow(unpack, "word long, count long, form int")
    top = words.orderBy(F.desc("count"), "word").limit(frequent).toArrow().sort_by("word")
    hashes = top["word"].to_numpy().astype(np.int64).view(np.uint64)
    counts, form = top["count"].to_numpy(), top["form"].to_numpy()
    order = np.argsort(hashes)
    rest = total[2:] - np.bincount(form, counts + 1, classes).astype(np.int64) + 1
    return Vocabulary(int(total[0]), int(total[1]), hashes[order], np.concatenate([counts[order] + 1, rest]).astype(float))


def symbol_sequences(encoded: DataFrame, counted: DataFrame, words: Vocabulary) -> DataFrame:
    """Chunks as symbols, with each document's known tokens, base score and score inside the classes."""
    shared = encoded.sparkSession.sparkContext.broadcast(vars(words))

    def join(table: pa.Table) -> pa.Table:
        known = Vocabulary(**shared.value)
        rows = table.to_pylist()
        row = next(r for r in rows if r["documents"] is not None)
        n, docs, tokens = row["words"], row["docs"], row["tokens"]
        hashes, _, form = from_bytes(row["vocabulary"], ("<u8", n), ("<i8", n), ("<u2", n))
        counts = np.zeros(n, np.int64)
        for reply in rows:
            if reply["documents"] is None:
                some, sums = from_bytes(reply["vocabulary"], ("<u8", reply["words"]), ("<i8", reply["words"]))
                counts[np.searchsorted(hashes, some)] = sums
        at = np.minimum(np.searchsorted(known.top, hashes), max(0, len(known.top) - 1))
        is_top = known.top[at] == hashes if len(known.top) else np.zeros(n, bool)
        symbol = np.where(is_top, at, len(known.top) + form.astype(np.int64))
        place = wide(np.frombuffer(row["sequence"], np.uint8), tokens)
        keys, valid, train, lengths = from_bytes(
            row["documents"], ("<i8", docs), ("u1", docs), ("u1", docs), ("<i4", docs)
        )
        begin = np.cumsum(lengths) - lengths
        in_class = np.where(is_top, 0.0, np.log10((counts + 1) / known.mass[symbol]))
        base = np.log10(counts + 1) - np.log10(known.tokens + known.types + 1)
        figures = [np.add.reduceat(v[place], begin) for v in ((counts > 0).astype(float), base, in_class)]
        return pa.table(
            {
                "chunk": pa.array([row["chunk"]], pa.int64()),
                "docs": pa.array([docs], pa.int32()),
                "tokens": pa.array([tokens], pa.int32()),
                "documents": pa.array([row["documents"]], pa.binary()),
                "figures": pa.array([to_bytes(*figures)], pa.binary()),
                "symbols": pa.array([to_bytes(symbol[place].astype("<u2"))], pa.binary()),
            }
        )

    replies = counted.where("kind = 0").select(
        "chunk", F.lit(0).alias("docs"), F.col("n").alias("words"), F.lit(0).alias("tokens"),
        F.lit(None).cast("binary").alias("documents"), F.col("payload").alias("vocabulary"),
        F.lit(None).cast("binary").alias("sequence"),
    )
    both = encoded.unionByName(replies)
    return _written(both.groupBy("chunk").applyInArrow(join, SEQUENCES), "hmm-symbols")


@dataclass
class Model:
    start: np.ndarray  # of the first token
    move: np.ndarray
    emit: np.ndarray  # states x symbols

    @property
    def rescale(self) -> int:
        """Steps from one scaling to the next: a step leaves at least the smallest emission of the weights' sum."""
        smallest = -np.log10(max(self.emit.min(), np.finfo(float).tiny))
        return int(np.clip(200 / max(smallest, 1e-9), 1, RESCALE))


def first_model(states: int, share: np.ndarray, seed: int) -> Model:
    """Symbol shares with seeded noise, and states that last."""
    noise = np.random.default_rng(seed).gamma(1.0, size=(states, len(share)))
    emit = noise * share
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    even = np.full(states, 1 / states)
    return Model(even, move, emit / emit.sum(axis=1, keepdims=True))


@dataclass
class Segments:
    """Sequences cut for work on many at once; short ones are a single segment."""

    owner: np.ndarray  # the sequence of each segment
    number: np.ndarray  # its place in the sequence
    at: np.ndarray
    length: np.ndarray
    last: np.ndarray


def cut(begin: np.ndarray, lengths: np.ndarray, segment: int) -> Segments:
    """Segments of ``segment`` tokens of the sequences longer than WHOLE of them, the others whole."""
    size = np.where(lengths > WHOLE * segment, segment, lengths)
    pieces = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = size[owner]
    length = np.minimum(size, lengths[owner] - number * size)
    return Segments(owner, number, begin[owner] + number * size, length, number == pieces[owner] - 1)


def batches_by_length(length: np.ndarray) -> Iterator[np.ndarray]:
    """Rows with the longest first, in runs of at most BATCH_TOKENS tokens (one row at least)."""
    order = np.argsort(-length, kind="stable")
    ends = np.cumsum(length[order])
    low = 0
    while low < len(order):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + BATCH_TOKENS, side="right")))
        yield order[low:high]
        low = high


def by_time(symbols: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All first symbols, all second ones and so on, without padding, and where each time begins; longest rows first."""
    running = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # rows longer than t
    offset = np.concatenate([[0], np.cumsum(running)])
    row = np.arange(offset[-1]) - np.repeat(offset[:-1], running)
    places = at[row] + np.repeat(np.arange(len(running)), running)
    return symbols[places].astype(np.int64), offset


def _symbol_grid(symbols: np.ndarray, at: np.ndarray, length: np.ndarray, padding: int) -> np.ndarray:
    """Symbols by time and segment; places after a segment's end hold ``padding``."""
    time = np.arange(int(length.max()))[:, None]
    return np.where(time < length, symbols[np.minimum(at + time, len(symbols) - 1)], padding)


def _emissions(emit: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """(time, state, segment): states in the middle, so that every step works on long rows."""
    out = np.empty((len(seen), len(emit), seen.shape[1]))
    for k, row in enumerate(emit):
        out[:, k] = row[seen]
    return out


def transfers(model: Model, emit: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """(segment, state, state): the product of emissions and moves over each segment, up to a factor.

    A row vector times it goes from the state before the first token to the
    state after the last one; it times a column vector goes back.
    """
    states, n = len(model.move), seen.shape[1]
    e = _emissions(emit, seen)
    product = np.repeat(np.eye(states)[:, :, None], n, axis=2)  # (state reached, state left, segment)
    step, every = model.move.T.copy(), model.rescale
    for t in range(len(e)):
        product *= e[t][:, None]
        product = (step @ product.reshape(states, -1)).reshape(states, states, n)
        if t % every == every - 1:
            product /= product.sum(axis=(0, 1))
    return (product / product.sum(axis=(0, 1))).transpose(2, 1, 0)


def segment_borders(model: Model, symbols: np.ndarray, segments: Segments) -> tuple[np.ndarray, np.ndarray]:
    """State shares before each segment, and the weight of what follows it by state.

    Both are exact: segments of a text that has several are multiplied out at
    the same time, then the products are applied one after the other.
    """
    at, length, number, last = segments.at, segments.length, segments.number, segments.last
    states, size = model.emit.shape
    emit = np.concatenate([model.emit, np.ones((states, 1))], axis=1)
    before, after = np.tile(model.start, (len(at), 1)), np.ones((len(at), states))
    parts = np.flatnonzero((number > 0) | ~last)
    if not len(parts):
        return before, after
    place = np.empty(len(at), np.int64)
    place[parts] = np.arange(len(parts))
    product = np.empty((len(parts), states, states))
    by_length = parts[np.argsort(length[parts], kind="stable")]
    for low in range(0, len(by_length), BATCH_SEGMENTS):
        rows = by_length[low : low + BATCH_SEGMENTS]
        product[place[rows]] = transfers(model, emit, _symbol_grid(symbols, at[rows], length[rows], size))
    by_number = parts[np.argsort(number[parts], kind="stable")]
    waves = np.split(by_number, np.cumsum(np.bincount(number[parts]))[:-1])
    for wave in waves:
        rows = wave[~last[wave]]
        state = (before[rows][:, None] @ product[place[rows]])[:, 0]
        before[rows + 1] = state / state.sum(axis=1, keepdims=True)
    for rows in reversed(waves[1:]):
        weight = (product[place[rows]] @ after[rows][:, :, None])[:, :, 0]
        after[rows - 1] = weight / weight.sum(axis=1, keepdims=True)
    return before, after


def forward_steps(model: Model, emit: np.ndarray, state: np.ndarray, offset: np.ndarray, out: np.ndarray) -> list[np.ndarray]:
    """The forward recursion over rows in the order of ``by_time``; steps ``model.rescale`` apart are scaled, by the sums returned.

    ``emit`` holds every token's emissions by state. ``out`` gets the weights
    of the states after each token; it may be ``emit`` itself.
    """
    scales, ones, every = [], np.ones(len(model.move)), model.rescale
    for t, (low, high) in enumerate(pairwise(offset.tolist())):
        now = np.multiply(emit[low:high], state[: high - low], out=out[low:high])
        if t % every == every - 1:
            scales.append(now.dot(ones))
            now /= scales[-1][:, None]
        state = now.dot(model.move)
    return scales


def expected_counts(
    model: Model, symbols: np.ndarray, begin: np.ndarray, lengths: np.ndarray, sums: dict, segment: int = SEGMENT
) -> None:
    """Adds the forward-backward counts of whole sequences to ``sums``.

    Long sequences are cut into segments only to work on many at once; the state
    is carried over the cuts in both directions, and the moves at them count.
    """
    states, size = model.emit.shape
    every = model.rescale
    segments = cut(begin, lengths, segment)
    before, after = segment_borders(model, symbols, segments)
    by_symbol, back_move = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    moves = np.zeros((states, states))
    room = np.empty((2, min(int(lengths.sum()), max(BATCH_TOKENS, int(segments.length.max()))), states))
    for rows in batches_by_length(segments.length):
        length = segments.length[rows]
        seen, offset = by_time(symbols, segments.at[rows], length)
        emit, alpha = room[:, : len(seen)]
        np.take(by_symbol, seen, axis=0, out=emit, mode="clip")
        scales = forward_steps(model, emit, before[rows], offset, alpha)
        final = alpha[offset[length - 1] + np.arange(len(rows))]
        sums["log"] += np.log10(final.sum(axis=1)).sum() + sum(np.log10(s).sum() for s in scales)
        further = after[rows]
        further = further / (final.dot(model.move) * further).sum(axis=1, keepdims=True)
        moves += final.T @ np.where(segments.last[rows][:, None], 0.0, further)  # to the next segment's first token
        back = further.dot(back_move)
        bounds = offset.tolist()
        for t in range(len(bounds) - 2, -1, -1):
            low, high = bounds[t], bounds[t + 1]
            follows = back[: high - low]
            what = emit[low:high]  # this token and all that follows, by state
            what *= follows
            shares = alpha[low:high]
            shares *= follows
            if t % every == every - 1:
                what /= scales[t // every][:, None]
            if t:
                earlier = bounds[t - 1]
                moves += alpha[earlier : earlier + high - low].T.dot(what)
                what.dot(back_move, out=follows)
        for k in range(states):
            sums["emit"][k] += np.bincount(seen, alpha[:, k], size)
        sums["start"] += alpha[: len(rows)][segments.number[rows] == 0].sum(axis=0)
    sums["move"] += model.move * moves
    sums["tokens"] += int(lengths.sum())


def no_counts(states: int, size: int) -> dict:
    return {"emit": np.zeros((states, size)), "move": np.zeros((states, states)), "start": np.zeros(states), "log": 0.0, "tokens": 0}


def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, begin, lengths) of the training texts of chunks in a row, POOL_TOKENS tokens or a little more at once."""
    symbols, begin, lengths, held = [], [], [], 0
    for batch in batches:
        for n, documents, sequence in zip(*(batch.column(c) for c in ("docs", "documents", "symbols")), strict=True):
            n = n.as_py()
            parts = ("<i8", n), ("u1", n), ("u1", n), ("<i4", n)
            _, _, train, sizes = from_bytes(documents.as_py(), *parts)
            chosen = np.flatnonzero(train)
            if len(chosen):
                sizes = sizes.astype(np.int64)
                begin.append(held + (np.cumsum(sizes) - sizes)[chosen])
                lengths.append(sizes[chosen])
                symbols.append(np.frombuffer(sequence.as_py(), "<u2"))
                held += len(symbols[-1])
            if held >= POOL_TOKENS:
                yield np.concatenate(symbols), np.concatenate(begin), np.concatenate(lengths)
                symbols, begin, lengths, held = [], [], [], 0
    if held:
        yield np.concatenate(symbols), np.concatenate(begin), np.concatenate(lengths)


def improve(sequences: DataFrame, model: Model, share: np.ndarray, strength: float) -> tuple[Model, float]:
    """One Baum-Welch round over all training texts: the new model and log10 probability per token of the old one.

    Each task adds up its chunks; Spark sums the tasks' rows by symbol, so what
    reaches the driver has the size of the model.
    """
    states, size = model.emit.shape
    shared = sequences.sparkSession.sparkContext.broadcast(vars(model))
    names = [f"g{k}" for k in range(states)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = Model(**shared.value), no_counts(states, size)
        for symbols, begin, lengths in pooled(batches):
            expected_counts(now, symbols, begin, lengths, sums)
        if sums["tokens"]:
            seen = np.flatnonzero(sums["emit"].any(axis=0))
            totals = np.zeros(states)
            totals[0], totals[-1] = sums["log"], sums["tokens"] if states > 1 else 0
            ids = np.concatenate([seen, -1 - np.arange(states), [STARTS, TOTALS]])
            values = np.concatenate([sums["emit"].T[seen], sums["move"], [sums["start"], totals]])
            yield pa.record_batch([pa.array(ids, pa.int64()), *map(pa.array, values.T.copy())], names=["symbol", *names])

    rows = sequences.select("docs", "documents", "symbols").mapInArrow(
        count, "symbol long, " + ", ".join(f"{n} double" for n in names)
    )
    table = rows.groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    values = {s: v for s, *v in zip(table["symbol"].to_pylist(), *(table[n].to_pylist() for n in names), strict=True)}
    if TOTALS not in values:
        return model, 0.0
    emit = np.zeros((size, states))
    for symbol, v in values.items():
        if symbol >= 0:
            emit[symbol] = v
    emit = emit.T + strength * share
    move = np.array([values[-1 - k] for k in range(states)]) + 0.1
    start = np.array(values[STARTS]) + 0.1
    occupied = emit.sum(axis=1)
    log, tokens = values[TOTALS][0], values[TOTALS][-1]
    return (
        Model(
            start / start.sum(),
            move / move.sum(axis=1, keepdims=True),
            emit / occupied[:, None],
        ),
        log / tokens if tokens else 0.0,
    )


def train_model(
    sequences: DataFrame, model: Model, share: np.ndarray, strength: float, rounds: int, settled: float
) -> Model:
    """Baum-Welch rounds over all training texts, ``rounds`` at least and until the log-likelihood settles."""
    seen, done = float("-inf"), 0
    while True:
        model, log = improve(sequences, model, share, strength)
        done += 1
        if log == 0.0 or (done >= rounds and log - seen < settled):  # 0 without training texts
            return model
        seen = log


def forward(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of every whole sequence, by the scaled forward recursion; all sequences step together."""
    segments = cut(np.cumsum(lengths) - lengths, lengths, SEGMENT)
    before, _ = segment_borders(model, symbols, segments)
    by_symbol = np.ascontiguousarray(model.emit.T)
    logs = np.empty(len(segments.at))
    for rows in batches_by_length(segments.length):
        length = segments.length[rows]
        seen, offset = by_time(symbols, segments.at[rows], length)
        alpha = np.take(by_symbol, seen, axis=0, mode="clip")
        scales = forward_steps(model, alpha, before[rows], offset, alpha)
        log = np.log10(alpha[offset[length - 1] + np.arange(len(rows))].sum(axis=1))
        for scale in scales:
            log[: len(scale)] += np.log10(scale)
        logs[rows] = log
    return np.bincount(segments.owner, logs, len(lengths))


def score_chunks(sequences: DataFrame, model: Model, words: Vocabulary) -> DataFrame:
    shared = sequences.sparkSession.sparkContext.broadcast(vars(model))
    total = words.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Model(**shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                n = row["docs"]
                keys, valid, train, lengths = from_bytes(
                    row["documents"], ("<i8", n), ("u1", n), ("u1", n), ("<i4", n)
                )
                known, base, inside = from_bytes(row["figures"], ("<f8", n), ("<f8", n), ("<f8", n))
                symbols = np.frombuffer(row["symbols"], "<u2")
                logs = forward(now, symbols, lengths.astype(np.int64)) + inside
                yield pa.record_batch(
                    [
                        pa.array(keys, mask=valid == 0),
                        pa.array(train == 1),
                        pa.array(lengths.astype(np.int64)),
                        pa.array(known.astype(np.int64)),
                        pa.array(np.full(n, total, np.int64)),
                        pa.array(base),
                        pa.array(logs),
                    ],
                    names=["key", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "key long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return sequences.select("docs", "documents", "figures", "symbols").mapInArrow(run, schema)


def language_scores(
    documents: DataFrame,
    train: Column,
    *,
    states: int = 6,
    frequent: int = 8192,
    classes: int = 1024,
    warm_rounds: int = 12,
    rounds: int = 2,
    settled: float = 1e-4,
    strength: float = 300.0,
    seed: int = 7,
    key: str = "doc_id",
) -> DataFrame:
    """Score of every text: key, trained, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``train`` marks the rows to learn from; null counts as false. A text's
    tokens are its words with A-Z lower-cased and one end. Null texts are
    empty. base_score is the add-one unigram score. Word counts, classes and
    every Baum-Welch round cover all training texts: ``warm_rounds`` and
    ``rounds`` together at least, then until a round gains less than
    ``settled`` (log10 a token).
    Without training texts the start itself scores. ``key`` is an integer; an
    empty table gives an empty result.
    """
    if frequent + classes > 1 << 16:
        raise ValueError("symbols are stored in two bytes")
    encoded = encode(documents, train, classes, key)
    counted = count_words(encoded, classes, frequent)
    words = vocabulary(counted, classes, frequent)
    sequences = symbol_sequences(encoded, counted, words)
    share, model = words.share, first_model(states, words.share, seed)
    model = train_model(sequences, model, share, strength, warm_rounds + rounds, settled)
    return score_chunks(sequences, model, words).withColumnRenamed("key", key)


ship_by_value(__name__)
