"""Row order as data: indexes, first rows and top-k entities.

Spark rows have no order, so every function names its order columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posigauge.constants import SAMPLE_ENTITIES
from posigauge.operators.selection import order_statistics
from posigauge.session import materialize


def _nulls_last(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


_PLACE_BITS = 33  # of monotonically_increasing_id: the place inside its partition


def _number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """1-based position in a global order, without sorting in one task.

    Rows are range-partitioned and sorted once, and written down with their
    range and place (checkpoint), so sizes and positions cannot disagree, even
    when executors are lost. Offsets come from one row per range, which is
    broadcast: no second shuffle of the rows.
    """
    by = _nulls_last(order)
    ranged = materialize(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    )
    span = F.shiftright("_at", _PLACE_BITS).alias("_range")
    sizes = ranged.groupBy(span).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_range").alias("_of"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    found = ranged.join(F.broadcast(offsets), F.shiftright("_at", _PLACE_BITS) == F.col("_of"))
    return found.select(*df.columns, (F.col("_offset") + place + 1).alias(name))


def row_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Number all rows by ``order``; rows alike in it are told apart by an id.

    The id lets a long run of equal rows be split over many ranges. It follows
    the input's partitions and must come out the same when a task is run again,
    as it does for files.
    """
    tagged = df.withColumn("_uid", F.monotonically_increasing_id())
    return _number_rows(tagged, [*order, "_uid"], name).drop("_uid")


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, 1-based rank) for the distinct keys: an index for a categorical id."""
    return _number_rows(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], name)


def first_entities(
    df: DataFrame, key: str, count: int = SAMPLE_ENTITIES, name: str = "entity_index"
) -> DataFrame:
    """The first ``count`` keys with their index: a top-k, never a full sort."""
    top = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(count)
    return top.withColumn(name, F.row_number().over(Window.orderBy(key)).cast("long"))


def keep_first_entities(df: DataFrame, key: str, count: int = SAMPLE_ENTITIES) -> DataFrame:
    """Rows of the first ``count`` keys. The broadcast holds ``count`` ids at most."""
    return df.join(F.broadcast(first_entities(df, key, count).select(key)), key, "left_semi")


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per group, first by ``order``; remaining columns break ties.

    Spark cuts each task's rows to one per group before the shuffle
    (WindowGroupLimit), so a hot group stays small.
    """
    rest = [c for c in df.columns if c not in (*by, *order)]
    w = Window.partitionBy(*by).orderBy(*_nulls_last([*order, *rest]))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def hash_halves(df: DataFrame, key: str, seed: str, name: str = "is_train") -> DataFrame:
    """Exact random halves: the first floor(n/2) rows by a seeded hash are True.

    ``key`` must be unique. The middle hash is selected by its first 60 bits;
    the few rows that share them are told apart by the whole hash. Rows are not
    sorted or shuffled, but ``df`` is read again for each round of the selection.
    """
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    hashed = df.withColumn("_digest", digest).withColumn("_head", F.conv(F.substring("_digest", 1, 15), 16, 10).cast("long"))
    heads = materialize(hashed.select("_head"))
    middle = order_statistics(heads, [], "_head", {"_at": F.floor(F.col("n") / 2)}).first()
    if middle is None or middle["_at"] is None:
        return df.withColumn(name, F.lit(False))
    missing = middle["n"] // 2 - heads.where(F.col("_head") < middle["_at"]).count()
    alike = hashed.where(F.col("_head") == middle["_at"]).select("_digest").orderBy("_digest").limit(missing)
    last = alike.agg(F.max("_digest")).first()[0]
    return hashed.withColumn(name, F.col("_digest") <= last).drop("_digest", "_head")
