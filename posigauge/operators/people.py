"""Distinct people per day and per trailing week."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posigauge.constants import WEEK_DAYS
from posigauge.functions.binomial import binomial_bounds
from posigauge.functions.rates import is_positive, ratio
from posigauge.operators.rolling import cumulative, series

DAILY = ("people_positives", "people_total", "tests_positives", "tests_total")
WEEKLY = ("people_positives_week", "people_total_week")
AS_KNOWN = ("obs_people_positives_week", "obs_people_total_week")


def person_days(
    df: DataFrame,
    by: Sequence[str] = ("testType",),
    person: str = "patientId",
    date: str = "date",
    entry: str | None = None,
) -> DataFrame:
    """One row per (group, person, day), folded before the shuffle.

    The rows of a person are bounded by the calendar from here on, however
    many tests a single id has in the log.
    """
    positive = is_positive(F.col("result"))
    aggs = [F.count(F.lit(1)).alias("tests"), F.count_if(positive).alias("positives")]
    if entry:
        aggs += [
            F.min(entry).alias("entry"),
            F.min(F.when(positive, F.col(entry))).alias("positive_entry"),
        ]
    return df.groupBy(*by, person, date).agg(*aggs)


def _daily_values(person: str, count_missing: bool) -> dict[str, Column]:
    """What one person-day adds to its day. A missing id is nobody, or one more person."""
    somebody = F.lit(True) if count_missing else F.col(person).isNotNull()
    return {
        "people_positives": (somebody & (F.col("positives") > 0)).cast("long"),
        "people_total": somebody.cast("long"),
        "tests_positives": F.col("positives"),
        "tests_total": F.col("tests"),
    }


def daily_people(
    df: DataFrame,
    by: Sequence[str] = ("testType",),
    person: str = "patientId",
    date: str = "date",
    count_missing: bool = False,
) -> DataFrame:
    """People and tests per day, without a distinct aggregate over the log."""
    values = _daily_values(person, count_missing)
    return (
        person_days(df, by, person, date)
        .groupBy(*by, date)
        .agg(*[F.sum(c).alias(name) for name, c in values.items()])
        .withColumn("rate", ratio(F.col("people_positives"), F.col("people_total")))
    )


def _first_uncovered(start: str, end: str, keys: Sequence[str], order: str) -> Column:
    """First day of ``[start, end)`` that no earlier interval of the person covers.

    With intervals in order of their start, what the earlier ones cover from
    this start on reaches exactly to their largest end. Rows without an
    interval have no end and do not count.
    """
    before = (
        Window.partitionBy(*keys)
        .orderBy(F.col(order).asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.greatest(F.col(start), F.max(end).over(before))


def _week_starts(date: str, entry: bool, somebody: Column) -> dict[str, Column]:
    """From which day on a person-day counts, per metric; NULL where it never does."""
    day, positive = F.col(date), F.col("positives") > 0
    starts = {
        "people_total_week": F.when(somebody, day),
        "people_positives_week": F.when(somebody & positive, day),
    }
    if entry:
        # greatest() skips NULL, but a test without an entry day is never known
        known, known_positive = F.col("entry"), F.col("positive_entry")
        starts["obs_people_total_week"] = F.when(
            somebody & known.isNotNull(), F.greatest(day, known)
        )
        starts["obs_people_positives_week"] = F.when(
            somebody & known_positive.isNotNull(), F.greatest(day, known_positive)
        )
    return starts


def trailing_week_counts(
    df: DataFrame,
    first_day: dt.date,
    by: Sequence[str] = ("testType",),
    person: str = "patientId",
    date: str = "date",
    entry: str | None = "entry_date",
    days: int = WEEK_DAYS,
    count_missing: bool = False,
    more: Callable[[DataFrame, list[str]], tuple[DataFrame, dict[str, Column]]] | None = None,
) -> DataFrame:
    """Daily counts and distinct people over the last ``days`` calendar days.

    One row per group and day from ``first_day`` to the group's last test.
    Weekly metrics start ``days`` after ``first_day``; daily ones are NULL on
    days without tests.

    A test makes its person count on ``days`` days. Instead of copying it to
    each of them, the days it adds beyond the person's earlier tests become
    +1 and -1 marks, and running sums of the marks per group are the counts.
    The log is read once and shuffled as person-days; there is no fan-out to
    days and no distinct aggregate.

    ``more`` gets the person-days and their keys and returns them with further
    daily counts, so that these cost no pass of their own.
    """
    keys = [*by, person]
    somebody = F.lit(True) if count_missing else F.col(person).isNotNull()
    starts = _week_starts(date, bool(entry), somebody)
    metrics = list(starts)
    end = F.date_add(date, days)
    frame = person_days(df, by, person, date, entry)
    for m, start in starts.items():
        counts = start < end
        frame = frame.withColumns({f"s_{m}": F.when(counts, start), f"e_{m}": F.when(counts, end)})
    # without entry days a start is the day itself: one sort serves both metrics
    order = {m: f"s_{m}" if m in AS_KNOWN else date for m in metrics}
    frame = frame.withColumns(
        {f"o_{m}": _first_uncovered(f"s_{m}", f"e_{m}", keys, order[m]) for m in metrics}
    )
    daily = _daily_values(person, count_missing)
    if more:
        frame, counted = more(frame, keys)
        daily |= counted

    # a mark is (day, which count, how much)
    names = [*metrics, *daily]
    kind = {name: F.lit(i) for i, name in enumerate(names)}

    def mark(name: str, day: Column, step: Column) -> Column:
        return F.struct(day.alias("day"), kind[name].alias("kind"), step.alias("step"))

    one = F.lit(1).cast("long")
    marks = [F.when(c != 0, mark(name, F.col(date), c)) for name, c in daily.items()]
    for m in metrics:
        opens, ends = F.col(f"o_{m}"), F.col(f"e_{m}")
        adds = F.col(f"s_{m}").isNotNull() & (opens < ends)
        marks += [F.when(adds, mark(m, opens, one)), F.when(adds, mark(m, ends, -one))]
    steps = {name: F.when(F.col("kind") == i, F.col("step")) for name, i in kind.items()}
    per_day = (
        frame.select(*by, F.explode(F.array(*marks)).alias("mark"))
        .where("mark is not null")
        .select(*by, "mark.*")
        .groupBy(*by, "day")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in steps.items()])
    )
    return _spread(per_day, metrics, list(daily), by, date, first_day, days)


def _spread(
    per_day: DataFrame,
    metrics: Sequence[str],
    daily: Sequence[str],
    by: Sequence[str],
    date: str,
    first_day: dt.date,
    days: int,
) -> DataFrame:
    """From marks to one row per day.

    A running sum holds from its mark to the day before the next mark, so each
    mark row is spread over those days. Days before the first mark get zeros.
    """
    w = series(by, ("day",))
    has_tests = F.col("tests_total") > 0
    runs = per_day.withColumns(
        {
            **{m: cumulative(F.col(m), w) for m in metrics},
            "_next": F.lead("day").over(w),
            "_is_first": F.lag("day").over(w).isNull(),
            "_last": F.max(F.when(has_tests, F.col("day"))).over(Window.partitionBy(*by)),
        }
    )
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    own = F.struct(
        F.col("day").alias("lo"),
        F.coalesce(F.date_sub("_next", 1), F.col("day")).alias("hi"),
        *[F.col(m).alias(m) for m in metrics],
        *[F.when(has_tests, F.col(d)).alias(d) for d in daily],
    )
    before = F.struct(
        F.lit(first_day).alias("lo"),
        F.date_sub("day", 1).alias("hi"),
        *[zero.alias(m) for m in metrics],
        *[nothing.alias(d) for d in daily],
    )
    pieces = F.array(own, F.when(F.col("_is_first"), before))
    lo = F.greatest(F.col("run.lo"), F.lit(first_day))
    hi = F.least(F.col("run.hi"), F.col("_last"))
    spread = (
        runs.select(*by, "_last", F.explode(pieces).alias("run"))
        .where(F.col("run").isNotNull() & (lo <= hi))
        .select(*by, "run", F.explode(F.sequence(lo, hi, F.expr("interval 1 day"))).alias(date))
    )
    on_mark = F.col(date) == F.col("run.lo")
    full_week = F.col(date) >= F.lit(first_day + dt.timedelta(days=days))
    return spread.select(
        *by,
        date,
        *[F.when(on_mark, F.col(f"run.{d}")).alias(d) for d in daily],
        *[F.when(full_week, F.col(f"run.{m}")).alias(m) for m in metrics],
    )


def add_week_rates(df: DataFrame, as_known: bool = True, bounds: bool = True) -> DataFrame:
    """Share of positive people and its binomial bounds, also as known on the day."""
    for prefix, name in (("", "fit"), ("obs_", "obs_fit")) if as_known else (("", "fit"),):
        k, n = F.col(f"{prefix}people_positives_week"), F.col(f"{prefix}people_total_week")
        df = df.withColumn(name, ratio(k, n))
        if bounds:
            low, high = binomial_bounds(n, F.col(name))
            df = df.withColumns({f"{prefix}lower": low, f"{prefix}upper": high})
    return df


def trailing_week_people(
    df: DataFrame,
    first_day: dt.date,
    by: Sequence[str] = ("testType",),
    person: str = "patientId",
    date: str = "date",
    entry: str | None = "entry_date",
    days: int = WEEK_DAYS,
    count_missing: bool = False,
    bounds: bool = True,
) -> DataFrame:
    """Weekly distinct people with rates and bounds, from the first full week on."""
    counts = trailing_week_counts(df, first_day, by, person, date, entry, days, count_missing)
    full = counts.where(F.col(date) >= F.lit(first_day + dt.timedelta(days=days)))
    return add_week_rates(full.drop(*DAILY), bool(entry), bounds)
