"""Joins of series and dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def full_join_series(*frames: DataFrame, on: Sequence[str] = ("date",)) -> DataFrame:
    """Full outer join on shared keys; each key appears once."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, list(on), "full")
    return out


def coalesce_columns(df: DataFrame, pairs: Mapping[str, Sequence[str]]) -> DataFrame:
    """``target: (new, old)``: first non-NULL source wins."""
    return df.withColumns({t: F.coalesce(*[F.col(c) for c in s]) for t, s in pairs.items()})


def left_join_fill(
    base: DataFrame, counts: DataFrame, on: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Attach counts to every base row; a missing count is 0."""
    return base.join(counts, list(on), "left").fillna(0, subset=list(columns))


def left_join_all(base: DataFrame, *others: DataFrame, on: Sequence[str]) -> DataFrame:
    """Chain of left joins on one key; Spark shuffles each input once."""
    out = base
    for other in others:
        out = out.join(other, list(on), "left")
    return out


def add_group_total(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Total of the group next to each row of an aggregate: a window, no join."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by)))

