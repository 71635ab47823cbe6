"""Tests of one person on different channels a few days apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posigauge.constants import PAIR_WINDOW_DAYS
from posigauge.functions.rates import is_positive
from posigauge.operators.counts import positive_counts


def attach_group_counts(df: DataFrame, by: Sequence[str] = ("testType", "date")) -> DataFrame:
    """``k`` and ``n`` of its group next to every row.

    Counted as an aggregate and joined, so a hot group is never gathered in
    one window partition. The join is left to Spark, which broadcasts counts
    below its byte threshold and splits a hot key otherwise.
    """
    return df.join(positive_counts(df, by), list(by), "left")


def multi_type_people(
    df: DataFrame, person: str = "patientId", test_type: str = "testType"
) -> DataFrame:
    """Ids seen with more than one test type.

    Distinct (id, type) rows first: a busy id leaves each task as one row per
    type, and no set is built.
    """
    types = df.where(F.col(person).isNotNull()).select(person, test_type).distinct()
    return types.groupBy(person).count().where("count > 1").select(person)


def keep_multi_type(
    df: DataFrame, person: str = "patientId", test_type: str = "testType", date: str = "date"
) -> DataFrame:
    """Rows of people seen with more than one test type.

    Joined by (person, type, day) cells, not by person alone: the rows of a
    busy id then spread over its days.
    """
    everything = Window.partitionBy(person)
    cells = _cells(df, person, test_type, date)
    several = (
        cells.withColumns(
            {"_lo": F.min(test_type).over(everything), "_hi": F.max(test_type).over(everything)}
        )
        .where("_lo <> _hi")
        .select(person, test_type, date)
    )
    return df.join(several, [person, test_type, date], "left_semi")


def _cells(df: DataFrame, person: str, test_type: str, date: str) -> DataFrame:
    """Distinct (person, type, day): at most one row per day and type of a person."""
    return df.where(F.col(person).isNotNull()).select(person, test_type, date).distinct()


def paired_days(
    df: DataFrame,
    days: int = PAIR_WINDOW_DAYS,
    person: str = "patientId",
    test_type: str = "testType",
    date: str = "date",
) -> DataFrame:
    """(person, type, day) cells with a cell of another type within ``days``.

    The log is folded to distinct cells first, so a window partition holds at
    most one row per day and type of a person. Around a day the types differ
    exactly when the smallest and the largest do.
    """
    cells = _cells(df, person, test_type, date)
    around = (
        Window.partitionBy(person).orderBy(F.unix_date(date)).rangeBetween(-days, days)
    )
    return (
        cells.withColumns({"_lo": F.min(test_type).over(around), "_hi": F.max(test_type).over(around)})
        .where("_lo <> _hi")
        .select(person, test_type, date)
    )


def interval_semi(
    df: DataFrame,
    days: int = PAIR_WINDOW_DAYS,
    person: str = "patientId",
    test_type: str = "testType",
    date: str = "date",
) -> DataFrame:
    """Rows that have a row of another type of the same person within ``days``.

    Joining by person, type and day spreads the rows of a busy person.
    """
    hits = paired_days(df, days, person, test_type, date)
    return df.join(hits, [person, test_type, date], "left_semi")


def interval_pairs(
    df: DataFrame,
    days: int = PAIR_WINDOW_DAYS,
    person: str = "patientId",
    test_type: str = "testType",
    date: str = "date",
) -> DataFrame:
    """The pairs, as person-days against person-days with multiplicities.

    A person-day meets the other types of at most ``2 * days + 1`` days, so
    the output is linear in the person-days; ``pairs`` gives how many row
    pairs a line stands for and ``agree`` how many of them have both results
    alike. Blocks of ``days + 1`` days turn the range condition into an
    equi-join that also spreads a busy id over its days.
    """
    width = days + 1
    cells = (
        df.where(F.col(person).isNotNull())
        .groupBy(person, date, test_type)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(is_positive(F.col("result"))).alias("k"))
        .withColumn("_block", F.floor(F.unix_date(date) / width))
    )

    def side(tag: str):
        return [F.col(c).alias(f"{c}_{tag}") for c in (test_type, date, "n", "k")]

    left = cells.select(person, "_block", *side("a"))
    near = F.array(*[F.col("_block") + step for step in (-1, 0, 1)])
    right = cells.withColumn("_block", F.explode(near)).select(person, "_block", *side("b"))
    gap = F.datediff(F.col(f"{date}_b"), F.col(f"{date}_a"))
    alike = F.col("k_a") * F.col("k_b") + (F.col("n_a") - F.col("k_a")) * (
        F.col("n_b") - F.col("k_b")
    )
    return (
        left.join(right, [person, "_block"])
        .where((F.col(f"{test_type}_a") < F.col(f"{test_type}_b")) & (F.abs(gap) <= days))
        .select(
            person,
            f"{test_type}_a",
            f"{date}_a",
            f"{test_type}_b",
            f"{date}_b",
            gap.alias("gap_days"),
            (F.col("n_a") * F.col("n_b")).alias("pairs"),
            alike.alias("agree"),
        )
    )


def split_summary(df: DataFrame, key: str, date: str = "date") -> DataFrame:
    """What a split by key yields: size and span of each piece."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first"), F.max(date).alias("last")
    )
