"""Grouped counts. All are partial + final hash aggregates, so a hot key
is already folded to one row per task before anything is shuffled."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posigauge.constants import CHANNELS
from posigauge.functions.rates import is_known, is_positive, ratio
from posigauge.functions.times import in_period, round_week


def select_tests(
    df: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    known_only: bool = False,
    date: str = "date",
) -> DataFrame:
    """Period filter, and on demand only positive and negative results."""
    if start is not None or end is not None:
        df = df.where(in_period(F.col(date), start, end))
    return df.where(is_known(F.col("result"))) if known_only else df


def positive_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``k`` positives of ``n`` rows per group."""
    return df.groupBy(*by).agg(
        F.count_if(is_positive(F.col("result"))).alias("k"), F.count(F.lit(1)).alias("n")
    )


def conditional_counts(
    df: DataFrame, by: Sequence[str], conditions: Mapping[str, Column], total: str | None = None
) -> DataFrame:
    """Several ``count_if`` columns in one pass, plus the row count if named."""
    aggs = [F.count_if(condition).alias(name) for name, condition in conditions.items()]
    if total:
        aggs.append(F.count(F.lit(1)).alias(total))
    return df.groupBy(*by).agg(*aggs)


def row_counts(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def weekly_counts(df: DataFrame, by: Sequence[str] = ("testType",), date: str = "date") -> DataFrame:
    """``k`` and ``n`` per nearest-Sunday week."""
    return positive_counts(df.withColumn("week", round_week(F.col(date))), [*by, "week"])


def channel_counts(
    df: DataFrame, by: Sequence[str], channels: Sequence[str] = CHANNELS, column: str = "testType"
) -> DataFrame:
    """Wide ``n_T`` and ``k_T`` straight from the log.

    Same rows as counting per channel and then pivoting, with one shuffle
    instead of two. A channel without tests is NULL, not 0.
    """
    aggs = []
    for stem, condition in (("n", F.lit(True)), ("k", is_positive(F.col("result")))):
        for channel in channels:
            mine = F.col(column) == channel
            seen = F.count_if(mine)
            aggs.append(F.when(seen > 0, F.count_if(mine & condition)).alias(f"{stem}_{channel}"))
    return df.where(F.col(column).isin(list(channels))).groupBy(*by).agg(*aggs)


def rate_per_thousand(
    counts: DataFrame, population: DataFrame, key: str = "region", by: Mapping[str, Sequence[str]] = MappingProxyType({})
) -> DataFrame:
    """Counts FULL JOIN population: a key on one side only keeps its row.

    ``by`` names strata and their values; each of them is joined with the
    whole population on its own, so none loses the keys it has no tests of.
    """
    for column, values in by.items():
        population = population.withColumn(column, F.explode(F.array(*map(F.lit, values))))
    return counts.join(population, [*by, key], "full").withColumn(
        "rate", ratio(F.col("n"), F.col("population")) * 1000
    )


def sum_by_prefix(
    df: DataFrame, by: Sequence[str], prefixes: Sequence[str] = ("n", "k")
) -> DataFrame:
    """Sum every column that starts with a prefix, NULL counted as 0."""
    chosen = [c for c in df.columns if c not in by and c.startswith(tuple(prefixes))]
    return df.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in chosen])
