"""Periodic runs of words by recompression.

Candidates come from a harmonic grid: a run of period p and at least four
periods has 3p or more consecutive places whose word recurs p words later, so
one of them is a multiple of 3p. What passes three looks at single words there
is extended both ways by longest-common-extension queries on a run-length
grammar. The grammar alternates block compression (a symbol repeated k times
becomes one symbol) and pair compression (a left letter with a right letter
after it becomes one symbol) over the texts that have candidates. There is no
suffix array.

Equal stretches are cut alike by every level but for their ends, so a query
takes a bounded number of steps a level: it climbs while its two sides agree
and comes down from where they differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from posigauge.functions.shipping import ship_by_value
from posigauge.llm.common import blocks, mix, raw_text, word_spans

BLOCK_BYTES = 2 << 20
STEP = 1 << 19  # grid places looked at in one step
SHORTEST, PERIODS = 6, 4


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per word, equal just where the bytes are equal."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    letters = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), buffers)
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def closed_texts(words: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, place of each text's first word): texts end to end, parted by marks that occur once each."""
    texts = len(word_at) - 1
    symbols = np.empty(len(words) + texts + 1, np.int64)
    marks = np.append(word_at[:-1] + np.arange(texts), len(symbols) - 1)
    inner = np.ones(len(symbols), bool)
    inner[marks] = False
    symbols[marks] = np.arange(texts + 1)
    symbols[inner] = words + (texts + 1)
    return symbols, marks[:-1] + 1


@dataclass
class Level:
    """One string of the grammar and its cut into the next level's symbols."""

    symbols: np.ndarray
    left: np.ndarray | None  # pair levels: left letters; None at block levels
    parent: np.ndarray  # the next level's symbol that holds each symbol
    first: np.ndarray  # the first symbol of each of the next level's symbols, and the end


def _next(symbols: np.ndarray, left: np.ndarray | None, starts: np.ndarray) -> Level:
    small = np.int32 if len(symbols) < 1 << 31 else np.int64
    first = np.append(np.flatnonzero(starts), len(symbols)).astype(small)
    return Level(symbols, left, (np.cumsum(starts) - 1).astype(small), first)


def fold_blocks(symbols: np.ndarray, fresh: int) -> tuple[Level, np.ndarray, int]:
    """Maximal blocks of a symbol get a name by (symbol, length); blocks of one keep theirs."""
    starts = np.ones(len(symbols), bool)
    starts[1:] = symbols[1:] != symbols[:-1]
    level = _next(symbols, None, starts)
    lengths = np.diff(level.first).astype(np.int64)
    named = symbols[level.first[:-1]]
    long = np.flatnonzero(lengths > 1)
    if len(long):
        codes, seen = pd.factorize(named[long] * (len(symbols) + 1) + lengths[long])
        named[long] = fresh + codes
        fresh += len(seen)
    return level, named, fresh


def fold_pairs(symbols: np.ndarray, fresh: int, number: int, marks: int) -> tuple[Level, np.ndarray, int]:
    """A left letter and the right letter after it get a name by both.

    A hash of the symbol and the level's ``number`` deals the sides; of the two
    ways round the one with more pairs counts. Marks (below ``marks``) stay
    alone. Neighbours differ here, so a quarter of them or more pair on average.
    """
    side = (mix(symbols.astype(np.uint64) + np.uint64(number << 40)) & np.uint64(1)).astype(bool)
    free = symbols >= marks
    free = free[:-1] & free[1:]
    one, other = free & side[:-1] & ~side[1:], free & side[1:] & ~side[:-1]
    if np.count_nonzero(other) > np.count_nonzero(one):
        one, side = other, ~side
    pairs = np.flatnonzero(one)
    starts = np.ones(len(symbols), bool)
    starts[pairs + 1] = False
    level = _next(symbols, side, starts)
    named = symbols[level.first[:-1]]
    if len(pairs):
        codes, seen = pd.factorize(symbols[pairs] * fresh + symbols[pairs + 1])
        named[level.parent[pairs]] = fresh + codes
        fresh += len(seen)
    return level, named, fresh


class Grammar:
    """Levels over ``symbols`` of which those below ``marks`` occur once and part the texts.

    Levels are added until every text is one symbol. Their lengths fall by a
    constant factor, so all of them take a constant times the texts' words.
    """

    def __init__(self, symbols: np.ndarray, marks: int):
        self.levels: list[Level] = []
        fresh = int(symbols.max()) + 1
        while len(symbols) > 2 * marks - 1:
            level, symbols, fresh = fold_blocks(symbols, fresh)
            self.levels.append(level)
            level, symbols, fresh = fold_pairs(symbols, fresh, len(self.levels), marks)
            self.levels.append(level)
        self.top = symbols

    def common(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many symbols agree from places a and b on (way 1), or down from them (way -1).

        a < b lie in one text or are its marks, so a mark always ends the stretch.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        going, held = np.arange(len(a)), []
        for level in self.levels:
            differ = self._climb(level, x, y, going, way)
            held.append(going[differ])
            going = going[~differ]
            x[going], y[going] = level.parent[x[going]], level.parent[y[going]]
        # A text is one symbol now and y is beyond x, so what is left differs.
        for level, stopped in zip(reversed(self.levels), reversed(held), strict=True):
            self._descend(level, x, y, going, way)
            going = np.concatenate([going, stopped])
        return way * (y - b)

    def _climb(self, level: Level, x: np.ndarray, y: np.ndarray, at: np.ndarray, way: int) -> np.ndarray:
        """Move x and y to ends of the next level's symbols, or to where they differ; returns which do."""
        i, j = x[at], y[at]
        same = level.symbols[i] == level.symbols[j]
        if level.left is None:
            m, n = self._rest(level, i, way), self._rest(level, j, way)
            step = np.minimum(m, n)
            differ = ~same | (m != n)
        else:
            # A left letter begins its symbol, a right letter ends it; the others' neighbours do.
            step = (level.left[i] != (way > 0)).astype(np.int64)
            differ = ~same
        step = way * np.where(same, step, 0)
        x[at], y[at] = i + step, j + step
        return differ

    def _descend(self, level: Level, x: np.ndarray, y: np.ndarray, at: np.ndarray, way: int) -> None:
        """From differing symbols of the next level to the differing ones of this level."""
        i, j = (level.first[x[at]], level.first[y[at]]) if way > 0 else (level.first[x[at] + 1] - 1, level.first[y[at] + 1] - 1)
        i, j = i.astype(np.int64), j.astype(np.int64)
        same = level.symbols[i] == level.symbols[j]
        step = 1 if level.left is not None else np.minimum(self._rest(level, i, way), self._rest(level, j, way))
        step = way * np.where(same, step, 0)
        x[at], y[at] = i + step, j + step

    @staticmethod
    def _rest(level: Level, i: np.ndarray, way: int) -> np.ndarray:
        """Symbols of i's block from i on, in the direction ``way``."""
        block = level.parent[i]
        return level.first[block + 1] - i if way > 0 else i - level.first[block] + 1


def grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of all multiples of 3p in texts of four periods p or more.

    Periods ascend from one yield to the next or share one, and never double
    inside a yield; a yield has about ``STEP`` rows.
    """
    order = np.argsort(-sizes, kind="stable")
    falling = -sizes[order]
    longest = int(-falling[0]) if len(falling) else 0
    low = 1
    while PERIODS * low <= longest and longest >= SHORTEST:
        periods = np.arange(low, min(2 * low, longest // PERIODS + 1))
        low *= 2
        texts = np.searchsorted(falling, -np.maximum(PERIODS * periods, SHORTEST), side="right")
        period = np.repeat(periods, texts)
        text = order[np.arange(len(period)) - np.repeat(np.cumsum(texts) - texts, texts)]
        counts = (sizes[text] - period - 1) // (3 * period) + 1
        ends = np.cumsum(counts)
        start, done = 0, 0
        while start < len(period):
            stop = max(start + 1, int(np.searchsorted(ends, done + STEP, side="right")))
            n = counts[start:stop]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(period[start:stop], n)
            yield np.repeat(text[start:stop], n), 3 * p * k, p
            start, done = stop, int(ends[stop - 1])


def looks(
    symbols: np.ndarray, base: np.ndarray, sizes: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grid places (text, place in ``symbols``, period) whose own and two more words recur a period later.

    A stretch of 3p recurring words around a place reaches p places to one
    side of it at least, so the word beside it and the one p away recur too.
    """
    for text, place, p in grid(sizes):
        at = base[text] + place
        keep = np.flatnonzero(symbols[at] == symbols[at + p])
        text, place, p, at = text[keep], place[keep], p[keep], at[keep]
        after = place + 2 * p < sizes[text]
        a = at[after]
        after[after] = (symbols[a + 1] == symbols[a + 1 + p[after]]) & (symbols[a + p[after]] == symbols[a + 2 * p[after]])
        before = place >= p
        a = at[before]
        before[before] = (symbols[a - 1] == symbols[a - 1 + p[before]]) & (symbols[a - p[before]] == symbols[a])
        keep = np.flatnonzero(after | before)
        yield text[keep], at[keep], p[keep]


def text_runs(words: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    ``words`` are numbers of the words of texts laid end to end, text n from
    word_at[n] on. A run has its smallest period p, a length of max(6, 4p) or
    more, and no neighbour that keeps the period.
    """
    sizes = np.diff(word_at)
    symbols, base = closed_texts(words, word_at)
    hopeful = np.zeros(len(sizes), bool)
    for text, _, _ in looks(symbols, base, sizes):
        hopeful[text] = True
    chosen = np.flatnonzero(hopeful)
    if not len(chosen):
        return np.zeros((0, 4), np.int64)
    inner = np.repeat(hopeful, sizes)
    sizes = sizes[chosen]
    symbols, base = closed_texts(words[inner], np.append(0, np.cumsum(sizes)))
    grammar = Grammar(symbols, len(sizes) + 1)
    # The first run found over a place: a longer period that is a multiple of
    # its own gives the same run again wherever both compared places lie in it.
    run_end, run_period = np.zeros(len(symbols), np.int64), np.ones(len(symbols), np.int64)
    found = []
    for text, at, p in looks(symbols, base, sizes):
        fresh = np.flatnonzero((at + p >= run_end[at]) | (p % run_period[at] != 0))
        if not len(fresh):
            continue
        text, at, p = text[fresh], at[fresh], p[fresh]
        start = at - grammar.common(at - 1, at + p - 1, -1)
        end = at + p + grammar.common(at, at + p, 1)
        long = end - start >= np.maximum(PERIODS * p, SHORTEST)
        rows = np.unique(np.stack([p, start, end, text], axis=1)[long], axis=0)
        for period, s, e, _ in rows.tolist():
            if not run_end[s]:
                run_end[s:e], run_period[s:e] = e, period
        found.append(rows)
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[np.lexsort((rows[:, 0], rows[:, 2], rows[:, 1]))]
    again = np.zeros(len(rows), bool)  # the same stretch has a smaller period
    again[1:] = (rows[1:, 1:3] == rows[:-1, 1:3]).all(axis=1)
    period, start, end, text = rows[~again].T
    out = np.stack([chosen[text], start - base[text], end - start, period], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Which words of a text stay: all but those after some run's first period."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of every text: key, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are runs of characters other than blanks (0x20, 0x09-0x0D), numbered
    from 0. collapsed has the words left when each run keeps its first period
    only, joined by one space. A null or empty text has no words, no runs and
    an empty collapsed text. Repeated rows and null keys give a result each; an
    empty table gives none; other columns of ``documents`` are not read and
    cannot clash. Texts are whole: one narrow pass without a shuffle, in blocks
    of 2 MB. A longer text is a block of its own and takes about 150 bytes of
    memory a word if it has candidates.
    """
    kind = documents.schema[key].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            data, offsets = raw_text(block.column("text"))
            starts, ends, word_at = word_spans(data, offsets)
            runs = text_runs(word_numbers(data, starts, ends), word_at)
            borders = np.searchsorted(runs[:, 0], np.arange(block.num_rows + 1))
            sizes, collapsed = np.diff(word_at), []
            for n, text in enumerate(block.column("text").to_pylist()):
                words = text.encode().split() if text else []
                if borders[n] < borders[n + 1]:
                    words = compress(words, kept_words(len(words), runs[borders[n] : borders[n + 1]]).tolist())
                collapsed.append(b" ".join(words))
            fields = [pa.array(runs[:, c]) for c in (1, 2, 3)]
            yield pa.record_batch(
                [
                    block.column(key),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(run))),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                names=[key, "n_words", "runs", "collapsed"],
            )

    schema = f"`{key}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return documents.select(key, "text").mapInArrow(compute, schema)


ship_by_value(__name__)
