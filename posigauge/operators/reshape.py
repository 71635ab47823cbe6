"""Wide and long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posigauge.constants import CHANNELS, WEEKDAYS
from posigauge.functions.times import weekday_name


def pivot_channels(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str] = ("n", "k"),
    column: str = "testType",
    channels: Sequence[str] = CHANNELS,
) -> DataFrame:
    """One row per key; ``value_channel`` columns, NULL where a channel is absent.

    The channel list is explicit, which saves the job that would look for it.
    """
    wide = (
        df.groupBy(*keys)
        .pivot(column, list(channels))
        .agg(*[F.first(v).alias(v) for v in values])
    )
    if len(values) == 1:
        renames = {c: f"{values[0]}_{c}" for c in channels}
    else:
        renames = {f"{c}_{v}": f"{v}_{c}" for c in channels for v in values}
    return wide.withColumnsRenamed(renames)


def weekday_one_hot(df: DataFrame, date: str = "date") -> DataFrame:
    """Seven 0/1 columns. A day has one weekday, so no grouping is needed."""
    name = weekday_name(F.col(date))
    return df.withColumns({day: (name == day).cast("long") for day in WEEKDAYS})


def unpivot_long(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str] | None = None,
    key: str = "predictors",
    value: str = "predictor_value",
) -> DataFrame:
    chosen = list(values) if values else [c for c in df.columns if c not in ids]
    as_double = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in chosen])
    return as_double.unpivot(list(ids), chosen, key, value)
