"""SimHash near-duplicates by multi-index hashing.

A fingerprint has one or more parts of 64 bits, cut into segments. Fingerprints
at a distance below twice the number of segments differ in at most one bit of
one of them, so each fingerprint probes, per segment, the segment's value and
its neighbours at one bit, fetches equal values from the segment's table, and
pairs are verified by their complete distance. Only distinct fingerprints take
part in this.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posigauge.functions.shipping import ship_by_value
from posigauge.llm.common import blocks, mix
from posigauge.llm.components import connected_components
from posigauge.session import materialize

SEED = 42
BLOCK_BYTES = 1 << 20


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 of every run of ``size`` words (the whole sequence where it is shorter), A-Z lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(run), SEED) for run in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprint(hashes: list[int], parts: int = 1) -> list[int]:
    """Bits set in over half of the hashes, zero without hashes; further parts take the hashes mixed again."""
    if not hashes:
        return [0] * parts
    values, out = np.array(hashes, "<u8"), []
    for _ in range(parts):
        counts = np.zeros(64, np.int64)
        for start in range(0, len(values), 1 << 16):
            part = values[start : start + (1 << 16)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0]))
        values = mix(values)
    return out


def part_names(parts: int) -> list[str]:
    return [f"fp{n}" for n in range(parts)]


def fingerprints(documents: DataFrame, size: int = 3, parts: int = 1, key: str = "doc_id") -> DataFrame:
    """(key, fp0, fp1, ...): the fingerprint of every row in signed longs. One narrow pass."""
    kind, names = documents.schema[key].dataType.simpleString(), part_names(parts)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            prints = [fingerprint(shingle_hashes(t, size), parts) for t in block.column("text").to_pylist()]
            values = np.array(prints, np.uint64).view(np.int64)
            yield pa.record_batch([block.column(key), *map(pa.array, values.T.copy())], names=[key, *names])

    return documents.select(key, "text").mapInArrow(
        compute, f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names)
    )


def links(nodes: DataFrame, distance: int = 2, segments: int = 2, parts: int = 1) -> DataFrame:
    """(a, b) with a < b: nodes whose fingerprints differ in ``distance`` bits or fewer.

    ``nodes`` has node and fp0, fp1, ...; each part is cut into ``segments``.
    Every pair at a distance below 2 * segments * parts is found; a larger
    ``distance`` adds pairs farther apart that come within one bit in some
    segment. The table has one row per node and segment; a probe is an
    equi-join on the segment's value, so a crowded value is a skewed key that
    adaptive execution splits. The complete distance is part of the join
    condition: no candidate that fails it is written.
    """
    if segments < 2:
        raise ValueError("a part has at least two segments")
    borders = [64 * i // segments for i in range(segments + 1)]
    radius = 1 if distance >= segments * parts else 0
    values, balls = [], []
    for part, name in enumerate(part_names(parts)):
        for number, (low, high) in enumerate(zip(borders, borders[1:], strict=False)):
            bits = F.shiftrightunsigned(name, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
            values.append(bits.bitwiseOR(F.lit(part * segments + number << 48)))
            flips = [0, *(1 << i for i in range(high - low))] if radius else [0]
            balls.append(F.array(*[values[-1].bitwiseXOR(F.lit(f)) for f in flips]))

    def side(keys: Column, end: str) -> DataFrame:
        own = [F.col(n).alias(f"{end}{n}") for n in part_names(parts)]
        return nodes.select(F.explode(keys).alias("segment"), F.col("node").alias(end), *own)

    pairs = side(F.flatten(F.array(*balls)), "a").join(side(F.array(*values), "b"), "segment")
    close = _bit_distance("a", "b", parts) <= distance
    return pairs.where((F.col("a") < F.col("b")) & close).select("a", "b")


def _bit_distance(left: str, right: str, parts: int) -> Column:
    return reduce(add, [F.bit_count(F.col(f"{left}{n}").bitwiseXOR(F.col(f"{right}{n}"))) for n in part_names(parts)])


def near_duplicates(
    documents: DataFrame,
    size: int = 3,
    distance: int = 2,
    segments: int = 2,
    parts: int = 1,
    key: str = "doc_id",
) -> DataFrame:
    """Component of every row: key, fingerprint (16 hex digits a part), component_id (smallest key reachable).

    Null and empty texts have fingerprint zero and link like any other. Rows
    with equal fingerprints are one node, so groups of copies are neither
    paired nor brought together. ``key`` is an integer below 2^62; a component
    without any key has a null id. Repeated rows give repeated results; an
    empty table gives none.
    """
    names = part_names(parts)
    rows = materialize(fingerprints(documents, size, parts, key))
    # A node goes by its smallest key, so that a component's root is its id. Nodes
    # without a key get one above all others from the fingerprint.
    unnamed = F.lit(1 << 62) + F.pmod(F.xxhash64(*names), F.lit(1 << 62))
    first = F.min(F.col(key).cast("long"))
    nodes = materialize(rows.groupBy(*names).agg(F.coalesce(first, F.first(unnamed)).alias("node")))
    roots = connected_components(links(nodes, distance, segments, parts))
    root = F.coalesce("root", "node")
    component = F.when(root < F.lit(1 << 62), root).cast(documents.schema[key].dataType)
    by_print = nodes.join(roots, nodes["node"] == roots["node"], "left").select(
        *names, nodes["node"].alias("node"), "root"
    )
    by_print = by_print.select(*names, component.alias("component_id"))
    digits = F.concat(*[F.lower(F.lpad(F.hex(n), 16, "0")) for n in names])
    return rows.join(by_print, names).select(key, digits.alias("fingerprint"), "component_id")


ship_by_value(__name__)
