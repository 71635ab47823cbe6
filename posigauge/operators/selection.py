"""Exact order statistics without sorting: histograms narrow to the bucket that holds a rank.

A round counts every open range's rows in ``BUCKETS`` even buckets, for all
groups and ranks in one partial aggregate, and goes on with the smallest and
largest value of the bucket that holds the rank. A range of one value is the
answer, and ranges of a few rows are ranked in a last step. So a task holds at
most a histogram or ``FEW`` rows per range, whatever the size of a group, and
about log(rows) / log(BUCKETS) rounds read the values again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posigauge.session import materialize

BUCKETS = 1024
FEW = 4096  # rows of a range that are ranked one by one
SMALL_STATE = 10_000  # ranges up to this many are broadcast, more are joined by their group


def _same_group(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    return reduce(and_, [left[c].eqNullSafe(right[f"_of_{c}"]) for c in by], F.lit(True))


def _bucket(x: Column, low: Column, high: Column, kind: str) -> Column:
    """0 .. BUCKETS - 1, never falling as x rises; the ends get the first and the last."""
    if kind in ("double", "float"):  # halves, so that no difference overflows
        share = (x / 2 - low / 2) / (high / 2 - low / 2)
    else:
        share = (x - low).cast("double") / (high - low).cast("double")
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def order_statistics(df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """One row per group: ``by``, n and the values at 1-based ``ranks``, expressions on n.

    NULL and NaN take no part; a rank outside 1..n is NULL; infinite values are
    refused. Values are integers below 2^62 or doubles. ``df`` is read once per
    round, so hand over a frame that is cheap to read again.
    """
    x = F.col(value)
    kind = dict(df.dtypes)[value]
    kept = df.where(x.isNotNull())
    if kind in ("double", "float"):
        kept = kept.where(~F.isnan(x))
        refuse = F.when(F.abs(x) == float("inf"), F.raise_error(F.lit(f"{value} holds an infinite value")).cast(kind))
        kept = kept.withColumn(value, refuse.otherwise(x))
    groups = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("_low"), F.max(x).alias("_high"))
    groups = materialize(groups)
    names = list(ranks)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), ranks[name].cast("long").alias("rank")) for name in names])
    state = groups.select(
        *by, "_low", "_high", F.lit(0).cast("long").alias("_below"), F.col("n").alias("_rows"), F.explode(wanted).alias("_want")
    )
    state = state.select(*by, "_low", "_high", "_below", "_rows", F.col("_want.name").alias("_name"), F.col("_want.rank").alias("_rank"))
    state = materialize(state.where(F.col("_rank").between(1, F.col("_rows"))))
    of = [f"_of_{c}" for c in by]
    span = [*of, "_l", "_h"]
    place = F.col("_rank") - F.col("_below")

    def rows_in(ranges: DataFrame) -> DataFrame:
        """Values next to the open ranges that they lie in."""
        names = [F.col(c).alias(o) for c, o in zip(by, of, strict=True)]
        ranges = materialize(ranges.select(*names, F.col("_low").alias("_l"), F.col("_high").alias("_h")).distinct())
        near = F.broadcast(ranges) if ranges.count() <= SMALL_STATE else ranges
        return kept.join(near, _same_group(kept, ranges, by) & x.between(F.col("_l"), F.col("_h"))).select(*span, x.alias("_x"))

    def narrowed(found: DataFrame, to: Column, rows: Column) -> DataFrame:
        """States whose rank is among the ``rows`` values that end at place ``to`` of their range."""
        same = _same_group(state, found, by) & (F.col("_low") == F.col("_l")) & (F.col("_high") == F.col("_h"))
        hit = state.join(found, same & (place <= to) & (place > to - rows))
        return hit.select(
            *[state[c] for c in by],
            F.col("_first").alias("_low"),
            F.col("_last").alias("_high"),
            (F.col("_below") + to - rows).alias("_below"),
            rows.alias("_rows"),
            "_name",
            "_rank",
        )

    wide = F.col("_low") < F.col("_high")
    many = wide & (F.col("_rows") > FEW)
    while state.where(many).count():
        span_rows = rows_in(state.where(many))
        counted = span_rows.groupBy(*span, _bucket(F.col("_x"), F.col("_l"), F.col("_h"), kind).alias("_bucket")).agg(
            F.count(F.lit(1)).alias("_size"), F.min("_x").alias("_first"), F.max("_x").alias("_last")
        )
        counted = counted.withColumn("_to", F.sum("_size").over(Window.partitionBy(*span).orderBy("_bucket")))
        state = materialize(state.where(~many).unionByName(narrowed(counted, F.col("_to"), F.col("_size"))))
    if state.where(wide).count():
        placed = rows_in(state.where(wide)).withColumn("_to", F.row_number().over(Window.partitionBy(*span).orderBy("_x")).cast("long"))
        placed = placed.select(*span, "_to", F.col("_x").alias("_first"), F.col("_x").alias("_last"), F.lit(1).cast("long").alias("_size"))
        state = materialize(state.where(~wide).unionByName(narrowed(placed, F.col("_to"), F.col("_size"))))
    at = [F.max(F.when(F.col("_name") == name, F.col("_low"))).alias(name) for name in names]
    values = state.groupBy(*[F.col(c).alias(o) for c, o in zip(by, of, strict=True)]).agg(*at)
    return groups.join(values, _same_group(groups, values, by), "left").select(*by, "n", *names)


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``by``, n and linearly interpolated quantiles under the names of ``shares``."""
    ranks = {}
    for name, share in shares.items():
        place = F.floor((F.col("n") - 1) * F.lit(share))
        ranks |= {f"_{name}_a": place + 1, f"_{name}_b": F.least(place + 2, F.col("n"))}
    found = order_statistics(df, by, value, ranks)
    out = []
    for name, share in shares.items():
        place = (F.col("n") - 1) * F.lit(share)
        low, high = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return found.select(*by, "n", *out)
