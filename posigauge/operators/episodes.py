"""Repeat episodes of one person."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posigauge.constants import EPISODE_GAP_DAYS


def _episode(gap: Column, w: WindowSpec, gap_days: int, mode: str) -> Column:
    if mode == "gap":
        return F.floor(gap / gap_days).cast("long")
    if mode == "cumulative":
        return F.sum(F.when(gap >= gap_days, 1).otherwise(0)).over(w).cast("long")
    raise ValueError(f"unknown mode {mode!r}")


def episode_days(
    df: DataFrame,
    by: Sequence[str] = ("testType",),
    person: str = "patientId",
    date: str = "date",
    gap_days: int = EPISODE_GAP_DAYS,
    mode: str = "gap",
) -> DataFrame:
    """One row per (group, person, day) with ``rows`` and ``episode``.

    ``gap``: the gap to the previous test day in whole ``gap_days``, 0 on the
    first day (two separate long gaps of equal length share a number).
    ``cumulative``: how many gaps of at least ``gap_days`` came before.

    Rows are folded to days before the window, so its partitions are bounded
    by the calendar however often one id occurs.
    """
    days = df.groupBy(*by, person, date).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(*by, person).orderBy(date)
    gap = F.datediff(F.col(date), F.lag(date).over(w))
    days = days.withColumn("_gap", F.coalesce(gap, F.lit(0)))
    return days.withColumn("episode", _episode(F.col("_gap"), w, gap_days, mode)).drop("_gap")


def episode_ids(
    df: DataFrame,
    by: Sequence[str] = ("testType",),
    person: str = "patientId",
    date: str = "date",
    gap_days: int = EPISODE_GAP_DAYS,
    mode: str = "gap",
) -> DataFrame:
    """``newId`` of every test, as (group, person, date, newId, rows, n).

    ``rows`` tests share the id on that day and ``n`` is the person's total.
    In ``gap`` mode only the first test of a day carries the gap; the others
    follow it at distance 0.
    """
    days = episode_days(df, by, person, date, gap_days, mode).withColumn(
        "n", F.sum("rows").over(Window.partitionBy(*by, person))
    )
    if mode == "gap":
        zero = F.lit(0).cast("long")
        repeats = F.col("rows") - 1
        split = F.array(
            F.struct(F.col("episode").alias("episode"), F.lit(1).cast("long").alias("rows")),
            F.struct(zero.alias("episode"), repeats.alias("rows")),
        )
        whole = F.array(F.struct("episode", "rows"))
        apart = (F.col("episode") != 0) & (repeats > 0)
        days = days.select(
            *by, person, date, "n", F.explode(F.when(apart, split).otherwise(whole)).alias("part")
        ).select(*by, person, date, "n", "part.episode", "part.rows")
    return days.withColumn(
        "newId", F.concat_ws("-", F.col(person).cast("string"), F.col("episode").cast("string"))
    ).drop("episode")


def first_per_episode(
    df: DataFrame,
    by: Sequence[str] = ("testType",),
    person: str = "patientId",
    date: str = "date",
    gap_days: int = EPISODE_GAP_DAYS,
    mode: str = "gap",
) -> DataFrame:
    """First day of each (group, person, episode)."""
    return (
        episode_days(df, by, person, date, gap_days, mode)
        .groupBy(*by, person, "episode")
        .agg(F.min(date).alias(date))
    )


def first_event_flags(
    person_days: DataFrame,
    keys: Sequence[str],
    date: str = "date",
    gap_days: int = EPISODE_GAP_DAYS,
    mode: str = "gap",
) -> tuple[DataFrame, dict[str, Column]]:
    """On person-days of known results: does a new case or the first negative fall on the day?

    Gives the same days as :func:`first_per_episode` over the positives and
    :func:`first_day_per_person` over the negatives. All windows share the
    partitioning by person, so nothing is shuffled again.
    """
    positive = F.col("positives") > 0
    negative = F.col("tests") > F.col("positives")
    w = Window.partitionBy(*keys).orderBy(date)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last_positive = F.max(F.when(positive, F.col(date))).over(before)
    gap = F.coalesce(F.datediff(F.col(date), last_positive), F.lit(0))
    frame = person_days.withColumns(
        {
            "_gap": gap,
            "_had_negative": F.max(F.when(negative, F.col(date))).over(before).isNotNull(),
        }
    )
    episode = _episode(F.when(positive, F.col("_gap")), w, gap_days, mode)
    frame = frame.withColumn("_episode", F.when(positive, episode))
    rank = F.row_number().over(Window.partitionBy(*keys, "_episode").orderBy(date))
    frame = frame.withColumn("_rank", rank)
    return frame, {
        "cases": (positive & (F.col("_rank") == 1)).cast("long"),
        "negative_cases": (negative & ~F.col("_had_negative")).cast("long"),
    }


def first_day_per_person(
    df: DataFrame, by: Sequence[str] = ("testType",), person: str = "patientId", date: str = "date"
) -> DataFrame:
    return df.groupBy(*by, person).agg(F.min(date).alias(date))
