"""Local timestamps, event dates and calendar columns.

Timestamps are kept as wall-clock values of one zone (TIMESTAMP_NTZ), so no
result depends on the session time zone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from posigauge.constants import (
    FIRST_YEAR,
    IMPUTATION_DELAY_DAYS,
    LOCAL_ZONE,
    PERIODS,
)

def _offset(text: Column) -> Column:
    """Trailing ``Z``, ``UTC``, ``GMT``, ``+hh:mm``, ``+hhmm`` or ``+hh`` after a clock; NULL without one."""
    long_tail, short_tail, hours = (F.substring(text, -n, n) for n in (6, 5, 3))
    return (
        F.when(text.endswith("Z") | text.endswith("UTC") | text.endswith("GMT"), "Z")
        .when(F.substring(text, -6, 1).isin("+", "-"), long_tail)
        .when(F.substring(text, -5, 1).isin("+", "-"), short_tail)
        .when(F.substring(text, -3, 1).isin("+", "-"), F.concat(hours, F.lit(":00")))
    )


_TAIL = r"\s*(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?$"
# Year-first forms besides the standard one, tried in this order, and the standard text of each.
_FORMS = (
    (r"^(\d{4})([-/._])(\d{1,2})\2(\d{1,2})[T ]+(\d{1,2})([:.])(\d{2})\6(\d{2}(?:\.\d+)?)" + _TAIL, "$1-$3-$4 $5:$7:$8$9"),
    (r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2}):?(\d{2}):?(\d{2}(?:\.\d+)?)" + _TAIL, "$1-$2-$3 $4:$5:$6$7"),
)


def _standard_form(text: Column) -> Column:
    """Other separators and compact texts in the standard form; NULL for texts of none of the forms."""
    forms = [F.when(text.rlike(p), F.regexp_replace(text, p, to)) for p, to in _FORMS]
    return F.coalesce(*forms)


def local_timestamp(text: Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall clock in ``zone``; NULL where the text has no date and clock.

    Text that ends in an offset is converted, other text already is local.
    The cast reads the wall clock and leaves the offset aside.
    """
    wall = text.try_cast("timestamp_ntz")
    offset = _offset(text)
    local = F.when(offset.isNull(), wall).otherwise(
        F.convert_timezone(offset, F.lit(zone), wall)
    )
    return F.when(text.contains(":"), local)


def local_timestamp_any_form(text: Column, zone: str = LOCAL_ZONE) -> Column:
    """:func:`local_timestamp`, and for texts that it does not read other year-first forms.

    They are tried in a fixed order: one other separator between the parts of
    the date and of the clock, then digits without separators; texts that mix
    separators or leave out digits stay NULL. Larger expressions than the
    standard form's: use it on columns known to hold such texts.
    """
    return F.coalesce(local_timestamp(text, zone), local_timestamp(_standard_form(F.trim(text)), zone))


def local_date(text: Column, zone: str = LOCAL_ZONE) -> Column:
    return local_timestamp(text, zone).cast("date")


def parse_mdy(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("M/d/yyyy")))


def within_years(day: Column, as_of: dt.date, first_year: int = FIRST_YEAR) -> Column:
    return F.year(day).between(first_year, as_of.year)


def event_date(
    collected: Column,
    reported: Column,
    as_of: dt.date,
    first_year: int = FIRST_YEAR,
    delay_days: int = IMPUTATION_DELAY_DAYS,
    clamp_future: bool = False,
) -> Column:
    """Day a test counts for.

    Collection day if present and in range, else the report day less the
    usual delay. ``clamp_future`` also moves a collection after the report
    back to the report; published results were made without it.
    """
    fallback = F.date_sub(reported.cast("date"), delay_days)
    taken = collected
    if clamp_future:
        taken = F.when(collected > reported, reported).otherwise(collected)
    day = taken.cast("date")
    return F.when(within_years(day, as_of, first_year), day).otherwise(fallback)


def valid_day(day: Column, as_of: dt.date, first_year: int = FIRST_YEAR) -> Column:
    """Year in range and not after ``as_of``, as plain bounds that prune files."""
    return day.between(F.lit(dt.date(first_year, 1, 1)), F.lit(as_of))


def since_year(day: Column, year: int) -> Column:
    return day >= F.lit(dt.date(year, 1, 1))


def in_period(day: Column, start: dt.date | None = None, end: dt.date | None = None) -> Column:
    """Half-open: ``start <= day < end``; either side may be open."""
    out = F.lit(True)
    if start is not None:
        out = day >= F.lit(start)
    if end is not None:
        out = out & (day < F.lit(end))
    return out


def period_label(
    day: Column, periods: Sequence[tuple[str, dt.date, dt.date]] = PERIODS
) -> Column:
    """Name of the period holding ``day``: one pass instead of one filter each."""
    name, start, end = periods[0]
    out = F.when(in_period(day, start, end), name)
    for name, start, end in periods[1:]:
        out = out.when(in_period(day, start, end), name)
    return out


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def weekday_number(day: Column) -> Column:
    """1 is Sunday."""
    return F.dayofweek(day)


def round_week(day: Column) -> Column:
    """Nearest Sunday: Sunday to Wednesday go back, Thursday to Saturday ahead."""
    since_sunday = F.dayofweek(day) - 1
    return F.date_sub(day, F.when(since_sunday <= 3, since_sunday).otherwise(since_sunday - 7))


def death_date(text: Column, report_text: Column, first: dt.date, as_of: dt.date) -> Column:
    """Death day, or the report day where the death day is out of range."""
    day = local_date(text)
    in_range = day.between(F.lit(first), F.lit(as_of))
    return F.when(in_range | day.isNull(), day).otherwise(local_date(report_text))


def report_lag(day: Column, bulletin: Column) -> Column:
    return F.datediff(bulletin, day)
