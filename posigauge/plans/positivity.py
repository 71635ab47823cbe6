"""Daily and 7-day positivity of two channels, overall and by stratum."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posigauge.constants import CHANNELS, FIRST_DAY, HOME, LAB, PERIODS, UNREPORTED
from posigauge.functions.binomial import binomial_bounds
from posigauge.functions.times import period_label
from posigauge.operators.cleaning import add_age_bins
from posigauge.operators.correlation import linear_fit, pearson_test
from posigauge.operators.counts import channel_counts, select_tests, sum_by_prefix
from posigauge.operators.ordering import first_per_group
from posigauge.operators.rolling import add_rates, add_rolling_rates


def add_bounds(df: DataFrame, channel: str = HOME) -> DataFrame:
    """Binomial bounds of one channel: ``lower, upper`` daily, ``lower7, upper7`` weekly."""
    for s in ("", "7"):
        if f"p{s}_{channel}" not in df.columns:
            continue
        low, high = binomial_bounds(F.col(f"n{s}_{channel}"), F.col(f"p{s}_{channel}"))
        df = df.withColumns({f"lower{s}": low, f"upper{s}": high})
    return df


def positivity(
    log: DataFrame,
    by: Sequence[str] = (),
    start: dt.date | None = FIRST_DAY,
    end: dt.date | None = None,
    known_only: bool = False,
    channels: Sequence[str] = CHANNELS,
    across_strata: bool = False,
) -> DataFrame:
    """Wide daily series per stratum with strict 7-row sums and rates.

    By default results other than positive and negative stay in ``n``.
    ``across_strata`` runs the 7-row window through all strata in date order,
    as the published regional figures did; else each stratum has its own.
    """
    wide = channel_counts(select_tests(log, start, end, known_only), [*by, "date"], channels)
    if across_strata:
        return add_rolling_rates(wide, (), channels, ("date", *by))
    return add_rolling_rates(wide, by, channels)


def positivity_overall(log: DataFrame, **options) -> DataFrame:
    return add_bounds(positivity(log, **options))


def positivity_by_region(log: DataFrame, **options) -> DataFrame:
    return add_bounds(positivity(log, ("region",), **options))


def positivity_by_age(
    log: DataFrame,
    order: Sequence[str] = ("date", "reportedDate", "collectedDate"),
    bin_ages: bool = False,
    **options,
) -> DataFrame:
    """Only the first test of a person on each channel counts.

    With ``bin_ages`` the age text is binned here, on the few rows left.
    """
    first = first_per_group(log, ("testType", "patientId"), order)
    if bin_ages:
        first = add_age_bins(first)
    return add_bounds(positivity(first, ("ageRange",), **options))


def positivity_excluding(
    strata: DataFrame,
    stratum: str,
    labels: Sequence[str] = (UNREPORTED,),
    channels: Sequence[str] = CHANNELS,
) -> DataFrame:
    """Add the strata up again, without the given labels."""
    kept = strata.where(~F.col(stratum).isin(list(labels)))
    return add_bounds(add_rates(sum_by_prefix(kept, ["date"]), channels))


def period_correlation(
    daily: DataFrame,
    periods: Sequence[tuple[str, dt.date, dt.date]] = PERIODS,
    x: str = f"p7_{LAB}",
    y: str = f"p7_{HOME}",
) -> DataFrame:
    """Correlation test and line of home on lab positivity per period."""
    labelled = daily.withColumn("period", period_label(F.col("date"), periods))
    labelled = labelled.where(F.col("period").isNotNull())
    test = pearson_test(labelled, ["period"], x, y)
    line = linear_fit(labelled, ["period"], x, y).drop("pairs")
    return test.join(line, "period")
