"""Hospital, death and all-test panels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posigauge.functions.rates import ratio
from posigauge.functions.times import in_period, report_lag
from posigauge.operators.counts import positive_counts, row_counts
from posigauge.operators.joins import add_group_total, coalesce_columns, full_join_series
from posigauge.operators.rolling import forward_max, mean_of_present, rolling_mean, series

VACCINE_COLUMNS = (
    "total_distributed",
    "total_vaccinations",
    "people_vaccinated",
    "people_fully_vaccinated",
)


def fill_vaccines(
    vaccines: DataFrame, location: str | None = None, columns: Sequence[str] = VACCINE_COLUMNS
) -> DataFrame:
    """One location's cumulative series with gaps filled by the largest earlier value."""
    if location is not None:
        vaccines = vaccines.where(F.col("location") == location)
    w = series()
    return vaccines.select("date", *[forward_max(F.col(c), w).alias(c) for c in columns])


def deaths_daily(deaths: DataFrame, start: dt.date | None = None, name: str = "deaths") -> DataFrame:
    return row_counts(deaths.where(in_period(F.col("date"), start)), ["date"], name)


def hospital_panel(
    hospital: DataFrame,
    legacy: DataFrame,
    vaccines: DataFrame,
    deaths: DataFrame,
    first_day: dt.date,
) -> DataFrame:
    """One row per day: beds, vaccinations and deaths with their 7-row means.

    Current counters win over the legacy ones. Inputs are daily tables, except
    ``deaths``, which has one row per death.
    """
    current = hospital.where(in_period(F.col("date"), first_day))
    beds = full_join_series(current, legacy.where(in_period(F.col("date"), first_day)))
    beds = coalesce_columns(
        beds,
        {
            "HospitCOV19": ("CAMAS_ADULTOS_COVID", "HospitCOV19"),
            "CamasICU": ("CAMAS_ICU_COVID", "CamasICU"),
            "CamasICU_disp": ("CAMAS_ICU_DISP", "CamasICU_disp"),
        },
    )
    w = series()
    beds = beds.withColumns(
        {
            "hosp_week_avg": rolling_mean(F.col("HospitCOV19"), w),
            "icu_week_avg": rolling_mean(F.col("CamasICU"), w),
        }
    )
    beds = mean_of_present(beds, "CAMAS_PED_COVID", "ped_hosp_week_avg")
    beds = mean_of_present(beds, "CAMAS_PICU_COVID", "picu_week_avg")
    panel = full_join_series(deaths_daily(deaths), full_join_series(beds, vaccines))
    panel = panel.fillna(0, subset=["deaths"]).withColumnRenamed("deaths", "IncMueSalud")
    return panel.withColumn("mort_week_avg", rolling_mean(F.col("IncMueSalud"), w))


def report_delay(deaths: DataFrame) -> DataFrame:
    """Days from death to bulletin, one row per death with a date."""
    return deaths.where(F.col("date").isNotNull()).select(
        "date", report_lag(F.col("date"), F.col("bulletin_date")).alias("diff")
    )


def all_tests_panel(log: DataFrame) -> DataFrame:
    """Counts per type and day next to the day's total over all types."""
    per_type = positive_counts(log, ["testType", "date"]).withColumnsRenamed(
        {"k": "pos", "n": "totalType"}
    )
    panel = add_group_total(per_type, ["date"], "totalType", "n")
    return panel.withColumns(
        {
            "rate_of_all": ratio(F.col("pos"), F.col("n")),
            "rate_of_type": ratio(F.col("pos"), F.col("totalType")),
        }
    )
