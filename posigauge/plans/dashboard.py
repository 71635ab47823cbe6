"""The daily panel: people, tests, new cases and new negatives by test type."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posigauge.constants import (
    COMBINED_MEMBERS,
    DASHBOARD_FIRST_DAY,
    EPISODE_GAP_DAYS,
    NEGATIVE,
    POSITIVE,
)
from posigauge.functions.rates import cases_plus_negatives, ratio
from posigauge.operators.cleaning import add_combined_type
from posigauge.operators.counts import row_counts, select_tests
from posigauge.operators.episodes import (
    first_day_per_person,
    first_event_flags,
    first_per_episode,
)
from posigauge.operators.joins import left_join_fill
from posigauge.operators.people import add_week_rates, trailing_week_counts
from posigauge.operators.rolling import rolling_mean, rolling_sum, series

KEYS = ("testType", "date")


def dashboard_log(
    log: DataFrame,
    first_day: dt.date = DASHBOARD_FIRST_DAY,
    members: Sequence[str] = COMBINED_MEMBERS,
) -> DataFrame:
    """Known results since ``first_day``, members also under the combined type."""
    return add_combined_type(select_tests(log, first_day, known_only=True), members)


def _tests(counts: DataFrame, as_known: bool) -> DataFrame:
    """Keep days with tests; add rates, 7-row sums and weekly shares."""
    tests = counts.where("tests_total is not null").withColumn(
        "rate", ratio(F.col("people_positives"), F.col("people_total"))
    )
    w = series(("testType",))
    tests = tests.withColumns(
        {
            "tests_positives_week": rolling_sum(F.col("tests_positives"), w),
            "tests_total_week": rolling_sum(F.col("tests_total"), w),
        }
    )
    return add_week_rates(tests, as_known=as_known)


def dashboard_tests(
    log: DataFrame, first_day: dt.date = DASHBOARD_FIRST_DAY, entry: str | None = "entry_date"
) -> DataFrame:
    """One row per test type and day with tests; ``log`` comes from :func:`dashboard_log`."""
    return _tests(trailing_week_counts(log, first_day, entry=entry), bool(entry))


def _with_all_days(tests: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """Counts for every row of the panel, 0 where none, and their 7-row mean."""
    filled = left_join_fill(tests.select(*KEYS), counts, KEYS, [name])
    return filled.withColumn(
        f"{name}_week_avg", rolling_mean(F.col(name), series(("testType",)))
    )


def unique_cases(
    log: DataFrame,
    tests: DataFrame,
    gap_days: int = EPISODE_GAP_DAYS,
    mode: str = "gap",
) -> DataFrame:
    """First positive of each episode, counted for every day of ``tests``."""
    positive = log.where(F.col("result") == POSITIVE)
    first = first_per_episode(positive, gap_days=gap_days, mode=mode)
    return _with_all_days(tests, row_counts(first, KEYS, "cases"), "cases")


def unique_negatives(log: DataFrame, tests: DataFrame) -> DataFrame:
    """First negative of each person, counted for every day of ``tests``."""
    first = first_day_per_person(log.where(F.col("result") == NEGATIVE))
    return _with_all_days(tests, row_counts(first, KEYS, "negative_cases"), "negative_cases")


def add_case_rates(panel: DataFrame) -> DataFrame:
    weekly_cases = F.col("cases_week_avg") * 7
    return panel.withColumns(
        {
            "cases_plus_negatives": cases_plus_negatives(
                F.col("people_total_week"), F.col("people_positives_week"), weekly_cases
            ),
            "cases_plus_negatives_daily": cases_plus_negatives(
                F.col("people_total"), F.col("people_positives"), F.col("cases")
            ),
        }
    ).withColumns(
        {
            "cases_rate": ratio(weekly_cases, F.col("cases_plus_negatives")),
            "cases_rate_daily": ratio(F.col("cases"), F.col("cases_plus_negatives_daily")),
        }
    )


def dashboard(
    log: DataFrame,
    first_day: dt.date = DASHBOARD_FIRST_DAY,
    members: Sequence[str] = COMBINED_MEMBERS,
    entry: str | None = "entry_date",
    gap_days: int = EPISODE_GAP_DAYS,
    mode: str = "gap",
) -> DataFrame:
    """Tests, cases and negatives on one row per test type and day, in one pass.

    New cases and first negatives are flags on the person-days the weekly
    counts need anyway, so the log is read and shuffled once for all of them.
    """

    def first_events(frame: DataFrame, keys: list[str]):
        return first_event_flags(frame, keys, gap_days=gap_days, mode=mode)

    known = dashboard_log(log, first_day, members)
    counts = trailing_week_counts(known, first_day, entry=entry, more=first_events)
    w = series(("testType",))
    panel = _tests(counts, bool(entry)).withColumns(
        {
            f"{name}_week_avg": rolling_mean(F.col(name), w) for name in ("cases", "negative_cases")
        }
    )
    return add_case_rates(panel)
