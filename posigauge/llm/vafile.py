"""Exact top-k inner products with vector-approximation files.

Each vector has an approximation of one byte per component, its cell of a
uniform grid. All queries scan all approximations in blocks; the cells bound
every score from both sides, and what cannot be among the best is left out.
Exact vectors are then read in the order of their bounds until the k-th result
is certain: first the most promising of each query, then only those whose
bound still reaches the k-th exact score found.

Vectors with components too large for a score in a long have no cells. They
are few or none in embeddings; each is multiplied with every query, and every
vector with such a query, in unbounded integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posigauge.functions.shipping import ship_by_value
from posigauge.llm.common import partitions
from posigauge.session import materialize

CELL_BITS = 8
BLOCK = 8192  # approximations per block
QUERY_BLOCK = 512
LIMIT = 1 << 26  # vectors with components this large have no cells, so that every bound is an exact long
WIDE_BLOCK = 1024  # vectors without cells, or compared with one, per block
WIDE_QUERIES = 64
WHOLE = float(1 << 53)  # doubles from here on are whole
LONGEST = (1 << 63) - 1
SCORE_BYTES = 280  # of a shifted exact score: products of two scaled doubles stay below 2^2200


def integer_vectors(vectors: DataFrame, scale: int, key: str, column: str) -> DataFrame:
    """(key, v, z) of every usable vector: v is floor(scale * x), or null if a component is too large for cells.

    Then z is the vector that v would be of, as doubles: v / scale, or x where x is whole.
    """
    infinite = float("inf")
    unusable = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == infinite))
    rows = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull() & ~unusable)
    rows = rows.select(F.col(key).alias("key"), F.transform(column, lambda x: x.cast("double")).alias("x"))
    large = F.exists("x", lambda x: F.abs(x) * float(scale) >= float(LIMIT))
    cells = F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x))
    whole = F.transform("x", lambda x: F.when(F.abs(x) < WHOLE, F.floor(x * float(scale)) / float(scale)).otherwise(x))
    return rows.select("key", F.when(~large, cells).cast("array<int>").alias("v"), F.when(large, whole).alias("z"))


def _padded(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length; shorter vectors end in zeros, which add nothing to a product."""
    lengths = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), width), np.int32)
    out[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(frame: DataFrame, rows: int, groups: int, cell_shift: int | None) -> DataFrame:
    """(g, n, width, ids, data): packed rows of (id, v); ``cell_shift`` stores cells, one byte each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number = TaskContext.get(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                values = _padded(part.column("v"))
                data = values if cell_shift is None else (values >> cell_shift).astype(np.int8)
                group = ((context.partitionId() if context else 0) + number) % groups
                ids = part.column("id").to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.record_batch(
                    [
                        pa.array([group], pa.int32()),
                        pa.array([part.num_rows], pa.int32()),
                        pa.array([values.shape[1]], pa.int32()),
                        pa.array([ids.tobytes()], pa.binary()),
                        pa.array([data.tobytes()], pa.binary()),
                    ],
                    names=["g", "n", "width", "ids", "data"],
                )
                number += 1

    return frame.mapInArrow(pack, "g int, n int, width int, ids binary, data binary")


def block_survivors(queries: np.ndarray, cells: np.ndarray, shift: int, keep: int) -> tuple[np.ndarray, ...]:
    """(query row, cell row, lower, upper) of pairs whose upper bound reaches the block's keep-th lower bound.

    Cells are ``2**shift`` wide, so a score lies within ``slack`` of the one
    with the cells' middles. Everything is doubled to stay in integers; sums
    are below 2^53 and exact in floating point.
    """
    spread = (1 << shift) - 1
    middle = (cells.astype(np.float64) * (2 << shift)) + spread
    doubled = queries.astype(np.float64) @ middle.T
    slack = spread * np.abs(queries.astype(np.float64)).sum(axis=1)
    if doubled.shape[1] > keep:
        least = np.partition(doubled, -keep, axis=1)[:, -keep] - 2 * slack
        q, c = np.nonzero(doubled >= least[:, None])
    else:
        q, c = (a.reshape(-1) for a in np.indices(doubled.shape))
    found = doubled[q, c]
    return q, c, np.ceil((found - slack[q]) / 2).astype(np.int64), np.floor((found + slack[q]) / 2).astype(np.int64)


def _scan(cell_blocks: DataFrame, query_blocks: DataFrame, groups: int, shift: int, keep: int) -> DataFrame:
    """(query_id, node, lower, upper): every query block against every cell block.

    Query blocks are copied to each group of cell blocks; the join is on the group.
    """
    copies = query_blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"),
        F.col("n").alias("qn"), F.col("width").alias("qwidth"), F.col("ids").alias("qids"), F.col("data").alias("qdata"),
    )
    pairs = cell_blocks.join(copies, "g")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n, width, qn, qwidth = (batch.column(c)[row].as_py() for c in ("n", "width", "qn", "qwidth"))
                cells = np.frombuffer(batch.column("data")[row].as_buffer(), np.int8).reshape(n, width)
                queries = np.frombuffer(batch.column("qdata")[row].as_buffer(), "<i4").reshape(qn, qwidth)
                ids = np.frombuffer(batch.column("ids")[row].as_buffer(), "<i8")
                qids = np.frombuffer(batch.column("qids")[row].as_buffer(), "<i8")
                if width > qwidth:
                    cells = cells[:, :qwidth]
                q, c, lower, upper = block_survivors(queries[:, : cells.shape[1]], cells, shift, keep)
                yield pa.record_batch(
                    [pa.array(qids[q]), pa.array(ids[c]), pa.array(lower), pa.array(upper)],
                    names=["query_id", "node", "lower", "upper"],
                )

    return pairs.mapInArrow(bound, "query_id long, node long, lower long, upper long")


def whole_numbers(vectors: list[list[float]], scale: int) -> np.ndarray:
    """Unbounded integers floor(scale * x); shorter vectors end in zeros."""
    out = np.zeros((len(vectors), max(1, *map(len, vectors))), object)
    for row, vector in enumerate(vectors):
        out[row, : len(vector)] = [int(x) * scale if abs(x) >= WHOLE else math.floor(x * scale) for x in vector]
    return out


def _listed(frame: DataFrame, key: str, rows: int, groups: int) -> DataFrame:
    """(g, ids, vectors): blocks of (key, z)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number = TaskContext.get(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield pa.record_batch(
                    [
                        pa.array([((context.partitionId() if context else 0) + number) % groups], pa.int32()),
                        *(pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns),
                    ],
                    names=["g", "ids", "vectors"],
                )
                number += 1

    ids = "array<struct<query: long, query_id: long>>" if key == "query" else "array<long>"
    named = F.struct("query", "query_id") if key == "query" else F.col(key)
    return frame.select(named, "z").mapInArrow(pack, f"g int, ids {ids}, vectors array<array<double>>")


def _exact_scan(rows: DataFrame, queries: DataFrame, scale: int, groups: int, k: int) -> DataFrame:
    """(query, query_id, key, score, beyond): the k best rows of every block for every query, without bounds.

    ``beyond`` orders scores that a long cannot hold; others have none.
    """
    copies = _listed(queries, "query", WIDE_QUERIES, groups).select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"),
        F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"),
    )
    pairs = _listed(rows, "key", WIDE_BLOCK, groups).join(copies, "g")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in range(batch.num_rows):
                keys, vectors, qids, qvectors = (
                    batch.column(c)[pair].as_py() for c in ("ids", "vectors", "qids", "qvectors")
                )
                here, there = whole_numbers(vectors, scale), whole_numbers(qvectors, scale)
                width = min(here.shape[1], there.shape[1])
                found = there[:, :width] @ here[:, :width].T
                out = []
                for query, scores in zip(qids, found.tolist(), strict=True):
                    others = ((-s, i) for s, i in zip(scores, keys, strict=True) if i != query["query_id"])
                    for s, i in heapq.nsmallest(k, others):
                        bound = max(-LONGEST, min(LONGEST, -s))
                        beyond = b"" if bound == -s else (-s + (1 << (8 * SCORE_BYTES - 1))).to_bytes(SCORE_BYTES, "big")
                        out.append((query["query"], query["query_id"], i, bound, beyond))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                columns = zip(*out, strict=True) if out else [[]] * 5
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["query", "query_id", "key", "score", "beyond"],
                )

    return pairs.mapInArrow(score, "query long, query_id long, key long, score long, beyond binary")


def _product(a: str, b: str) -> Column:
    terms = F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long"))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda total, x: total + F.coalesce(x, F.lit(0)))


def top_k(
    vectors: DataFrame,
    *,
    k: int = 10,
    query_step: int = 100,
    scale: int = 1024,
    key: str = "vec_id",
    column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, key, score): the k highest inner products of every query, exact.

    Queries are the rows whose key is divisible by ``query_step``; candidates
    are all rows with another key. Ties go to the smaller key. Fewer than k
    candidates give fewer rows. Vectors that are null or hold a null or
    non-finite component take no part, nor do null keys; an empty vector has
    the score 0 with every other. Any finite component takes part exactly
    (beyond 2^26 / scale for a whole scale that is a power of two); a score
    that a long cannot hold is ranked by its exact value and given as the
    largest long, or minus that. Repeated rows count once; a key with several
    vectors is a candidate with each. A shorter vector counts as ending in
    zeros. Equal vectors are one node that keeps its k + 1 smallest keys,
    which are all that can be among the best. Columns of other names are not
    read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    both = materialize(integer_vectors(vectors, scale, key, column).distinct())
    found = both.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.count("z")).first()
    largest, n_wide = found[0] or 0, found[1]
    rows = both.where("v is not null").select("key", "v")
    shift = max(0, int(largest).bit_length() + 1 - CELL_BITS)
    order = Window.partitionBy("v").orderBy("key")
    smallest = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    nodes = materialize(
        smallest.groupBy("v").agg(F.sort_array(F.collect_list("key")).alias("keys"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    queries = rows.where(F.col("key") % query_step == 0).select(
        F.monotonically_increasing_id().alias("query"), F.col("key").alias("query_id"), F.col("v").alias("qv")
    )
    queries = materialize(queries)
    groups = partitions(spark)
    cell_blocks = _blocks(nodes.select(F.col("node").alias("id"), "v"), BLOCK, groups, shift)
    query_blocks = _blocks(queries.select(F.col("query").alias("id"), F.col("qv").alias("v")), QUERY_BLOCK, groups, None)
    # One node may be the query's own, so bounds look one place further than k.
    bounds = _scan(cell_blocks, query_blocks, groups, shift, k + 1).withColumnRenamed("query_id", "query")
    bounds = materialize(bounds)
    by_lower = Window.partitionBy("query").orderBy(F.desc("lower"), "node")
    floor = (
        bounds.withColumn("_n", F.row_number().over(by_lower))
        .where(F.col("_n") <= k + 1)
        .groupBy("query")
        .agg(F.max(F.when(F.col("_n") == k + 1, F.col("lower"))).alias("_floor"))
    )
    hopeful = bounds.join(floor, "query").where(F.col("_floor").isNull() | (F.col("upper") >= F.col("_floor")))
    by_upper = Window.partitionBy("query").orderBy(F.desc("upper"), "node")
    hopeful = materialize(hopeful.select("query", "node", "upper", F.row_number().over(by_upper).alias("_n")))

    def exact(pairs: DataFrame) -> DataFrame:
        return pairs.join(nodes, "node").join(queries, "query").select(
            "query", "query_id", "keys", _product("v", "qv").alias("score")
        )

    first = materialize(exact(hopeful.where(F.col("_n") <= k + 1)))
    certain = first.groupBy("query").agg(F.min("score").alias("_least"))
    rest = hopeful.where(F.col("_n") > k + 1).join(certain, "query").where(F.col("upper") >= F.col("_least"))
    scored = first.unionByName(exact(rest.select("query", "node")))
    scored = scored.select("query", "query_id", F.explode("keys").alias("key"), "score", F.lit(b"").alias("beyond"))
    scored = scored.where(F.col("key") != F.col("query_id"))
    if n_wide:
        wide = both.where("z is not null").select("key", "z")
        wide_queries = materialize(
            wide.where(F.col("key") % query_step == 0).select(
                (-1 - F.monotonically_increasing_id()).alias("query"), F.col("key").alias("query_id"), "z"
            )
        )
        narrow = rows.select("key", F.transform("v", lambda x: x / F.lit(float(scale))).alias("z"))
        narrow_queries = queries.select(
            "query", "query_id", F.transform("qv", lambda x: x / F.lit(float(scale))).alias("z")
        )
        every_query = narrow_queries.unionByName(wide_queries)
        scored = scored.unionByName(_exact_scan(wide, every_query, scale, groups, k)).unionByName(
            _exact_scan(narrow, wide_queries, scale, groups, k)
        )
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("beyond"), "key")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").cast("long"), "rank", F.col("key").alias(key), "score")


ship_by_value(__name__)
