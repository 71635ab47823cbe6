"""Secrets in texts: an Aho-Corasick prefilter, anchored expressions near its hits, checksums inside tokens.

One automaton over all keywords reads every text once. Each kind's expression
is only tried where one of its keywords begins, so its matches are the leftmost
non-overlapping ones of a full search. Long hexadecimal words have no keyword of
their own: texts are mapped to one letter for hexadecimal digits, and a row of
that letter is the keyword. Kinds with a checksum keep a match only if the
checksum that the token carries fits the rest of it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posigauge.functions.shipping import ship_by_value
from posigauge.llm.common import blocks, worker_cache

BLOCK_BYTES = 4 << 20

# The letters of the token formats' number systems, in digit order.
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def crc_tail(token: bytes) -> bool:
    """The last six letters are the CRC-32 of those between the prefix and them, in base 62."""
    body, tail = token[token.index(b"_") + 1 : -6], token[-6:]
    value, digits = zlib.crc32(body), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return bytes(reversed(digits)) == tail


def base58_tail(token: bytes) -> bool:
    """The last four of the bytes in base 58 begin the doubled SHA-256 of the others."""
    value = 0
    for letter in token:
        value = value * 58 + BASE58.index(letter)
    if value >> (8 * 82):
        return False
    whole = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(whole[:-4]).digest()).digest()[:4] == whole[-4:]


def bech32_tail(token: bytes) -> bool:
    """The last six letters are the code's checksum over prefix and data."""
    token = token.lower()
    prefix, _, data = token.rpartition(b"1")
    values = [c >> 5 for c in prefix] + [0] + [c & 31 for c in prefix] + [BECH32.find(c) for c in data]
    state = 1
    for value in values:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ value
        for bit, step in enumerate(BECH32_STEPS):
            if top >> bit & 1:
                state ^= step
    return state == 1


@dataclass(frozen=True)
class Kind:
    """Matches of ``pattern`` that begin at a keyword and that ``check`` accepts."""

    name: str
    keywords: tuple[str, ...]  # lower case; every match begins with one of them
    pattern: re.Pattern[bytes]
    check: Callable[[re.Match[bytes]], bool]


# The base kinds, in the order in which spans at one place are listed.
BASE = (
    Kind(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(
            rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        ),
        lambda m: m.end(2) - m.start(2) >= 6,
    ),
    Kind("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20),
    Kind("hex", (), re.compile(rb"[0-9a-f]+"), lambda m: m.end() - m.start() >= 24),
)
# Public token formats with a checksum inside.
CHECKED = (
    Kind(
        "host_token",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        re.compile(rb"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
        lambda m: crc_tail(m.group()),
    ),
    Kind(
        "package_token",
        ("npm_",),
        re.compile(rb"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
        lambda m: crc_tail(m.group()),
    ),
    Kind(
        "wallet_key",
        ("xprv", "tprv"),
        re.compile(rb"[xt]prv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])"),
        lambda m: base58_tail(m.group()),
    ),
    Kind(
        "file_key",
        ("age-secret-key-1",),
        re.compile(rb"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![0-9A-Za-z])"),
        lambda m: bech32_tail(m.group()),
    ),
    Kind(
        "note_key",
        ("nsec1",),
        re.compile(rb"nsec1[02-9ac-hj-np-z]{58}(?![0-9A-Za-z])"),
        lambda m: bech32_tail(m.group()),
    ),
)
KINDS = BASE + CHECKED
HEX, HEX_LENGTH = 2, 24
HEX_MAP = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(".") for c in range(256))


def automaton(kinds: tuple[Kind, ...]) -> ahocorasick.Automaton:
    """All keywords; a hit gives (keyword length, number of its kind)."""
    machine = ahocorasick.Automaton()
    for number, kind in enumerate(kinds):
        for word in kind.keywords:
            machine.add_word(word, (len(word), number))
    machine.make_automaton()
    return machine


def text_spans(machine: ahocorasick.Automaton, data: bytes, kinds: tuple[Kind, ...] = KINDS) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in bytes, sorted; matches that fail their check still use up their place."""
    # One letter a byte, so that places are bytes; only ASCII letters meet keywords.
    hits = [(end + 1 - size, number) for end, (size, number) in machine.iter(data.decode("latin-1").lower())]
    found, free = [], [0] * len(kinds)
    if len(hits) > 1:
        hits.sort()  # a longer keyword ends after a shorter one that begins later
    for start, number in hits:
        if start >= free[number] and (m := kinds[number].pattern.match(data, start)):
            free[number] = m.end()
            if kinds[number].check(m):
                found.append((start, number, m.end()))
    classes, row, at = data.translate(HEX_MAP), b"h" * HEX_LENGTH, 0
    while (at := classes.find(row, at)) >= 0:
        m = kinds[HEX].pattern.match(data, at)
        found.append((at, HEX, m.end()))
        at = m.end()
    found.sort()
    return found


def find_secrets(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Secrets of every text: key, secrets (kind, start, end; in code points, end exclusive).

    Secrets are sorted by start, then by kind in the order of ``KINDS``. Kinds
    do not exclude each other; matches of one kind do not overlap. A null or
    empty text has none. Repeated rows and null keys give a result each; an
    empty table gives none; other columns of ``documents`` are not read and
    cannot clash. Whole texts in one narrow pass without a shuffle.
    """
    kind = documents.schema[key].dataType.simpleString()
    fields = [pa.field("kind", pa.string()), pa.field("start", pa.int64()), pa.field("end", pa.int64())]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = worker_cache("secret keywords", lambda: automaton(KINDS))
        for block in blocks(batches, "text", BLOCK_BYTES):
            offsets, kinds, starts, ends = [0], [], [], []
            for text in block.column("text").to_pylist():
                data = text.encode() if text else b""
                at = letters = 0
                for start, number, end in text_spans(machine, data):
                    if len(data) != len(text):  # code points before the place
                        letters, at = letters + len(data[at:start].decode()), start
                        size = len(data[start:end])  # every kind is ASCII
                        start, end = letters, letters + size
                    kinds.append(KINDS[number].name)
                    starts.append(start)
                    ends.append(end)
                offsets.append(len(kinds))
            values = [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            spans = pa.StructArray.from_arrays(values, fields=fields)
            yield pa.record_batch(
                [block.column(key), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)],
                names=[key, "secrets"],
            )

    return documents.select(key, "text").mapInArrow(
        compute, f"`{key}` {kind}, secrets array<struct<kind: string, start: long, end: long>>"
    )


def spans_text(secrets: Column) -> Column:
    """kind:start:end of every secret, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(secrets, one), ",")


def base_only(secrets: Column) -> Column:
    return F.filter(secrets, lambda s: s["kind"].isin([k.name for k in BASE]))


def masked(documents: DataFrame, column: str = "text") -> DataFrame:
    """``documents`` with every secret of ``column`` replaced by [kind]; overlapping ones go as one, named by the first.

    Null texts stay null; all other columns and repeated rows stay as they are.
    """
    schema = documents.schema
    place = documents.columns.index(column)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = worker_cache("secret keywords", lambda: automaton(KINDS))
        for block in blocks(batches, column, BLOCK_BYTES):
            texts = []
            for text in block.column(place).to_pylist():
                data = text.encode() if text else b""
                parts, at = [], 0
                for start, number, end in text_spans(machine, data):
                    if start >= at:
                        parts += [data[at:start], f"[{KINDS[number].name}]".encode()]
                    at = max(at, end)
                texts.append((b"".join(parts) + data[at:]).decode() if parts else text)
            columns = list(block.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=block.schema.names)

    return documents.mapInArrow(compute, schema)


ship_by_value(__name__)
