"""Raw records of all channels to the clean log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posigauge.constants import FIRST_YEAR
from posigauge.functions import text, times
from posigauge.operators import cleaning


def clean_tests(
    *raw: DataFrame,
    as_of: dt.date,
    first_year: int = FIRST_YEAR,
    bin_ages: bool = False,
    domain: list[str] | None = None,
    normalize_types: bool = False,
    mode: str = "impute",
    clamp_future: bool = False,
) -> DataFrame:
    """Union, parse, classify, drop copies, repair dates, keep valid days.

    Copies are dropped before the columns that follow from others are added,
    which keeps the shuffled rows narrow; Spark still moves the day filter in
    front of the shuffle. Rows come back unordered; sort at output with
    :func:`posigauge.operators.cleaning.sort_log`.
    """
    log = cleaning.union_by_name(*raw)
    if normalize_types:
        log = log.withColumn("testType", text.normalize_test_type(F.col("testType")))
    log = cleaning.clean_labels(cleaning.parse_times(log))
    if domain is not None:
        log = log.withColumn("ageRange", text.in_domain(F.col("ageRange"), domain))
    log = cleaning.distinct_rows(log)
    log = cleaning.resolve_dates(log, as_of, mode, first_year, clamp_future=clamp_future)
    return cleaning.add_age_bins(log) if bin_ages else log


def clean_deaths(deaths: DataFrame, separator: str = " to ") -> DataFrame:
    """Death records with local date and age bins."""
    named = deaths.withColumnsRenamed({"TX_GRUPO_EDAD": "ageRange", "FE_MUERTE": "date"})
    named = named.withColumn("date", times.local_date(F.col("date")))
    return cleaning.add_age_bins(named, separator, unreported=None)


def clean_death_summary(
    summary: DataFrame, first_day: dt.date, as_of: dt.date, separator: str = " a "
) -> DataFrame:
    """Death summary: out-of-range death days fall back to the report day."""
    dated = summary.withColumns(
        {
            "date": times.death_date(F.col("deathDate"), F.col("reportDate"), first_day, as_of),
            "bulletin_date": times.local_date(F.col("reportDate")),
        }
    )
    return cleaning.add_age_bins(dated, separator, unreported=None)


def entry_dates(log: DataFrame) -> DataFrame:
    """Day on which a record entered the system."""
    return log.withColumn("entry_date", F.col("orderCreatedAt").cast("date"))


def _as_numbers(df: DataFrame, skip: set[str], kind: str) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast(kind) for c in df.columns if c not in skip})


def clean_hospital(beds: DataFrame) -> DataFrame:
    """Daily bed counters as numbers, keyed by ``date``."""
    dated = beds.withColumn("date", F.col("FE_REPORTE").try_cast("date")).drop("FE_REPORTE")
    return _as_numbers(dated, {"date"}, "bigint")


def clean_legacy_hospital(beds: DataFrame) -> DataFrame:
    """The older bed table, whose dates are month/day/year text."""
    dated = beds.withColumn("date", times.parse_mdy(F.col("Fecha"))).drop("Fecha")
    return _as_numbers(dated, {"date"}, "bigint")


def clean_vaccines(vaccines: DataFrame) -> DataFrame:
    dated = vaccines.withColumn("date", F.col("date").try_cast("date"))
    return _as_numbers(dated, {"date", "location"}, "double")
