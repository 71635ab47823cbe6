"""Row windows over daily series.

These run on daily aggregates: a partition holds one row per calendar day of
one stratum, so its size is bounded by the calendar and not by the log. Never
call them on the log itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posigauge.constants import CHANNELS, WINDOW_ROWS
from posigauge.functions.rates import ratio


def series(by: Sequence[str] = (), order: Sequence[str] = ("date",)) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def _strict(agg, x: Column, w: WindowSpec, k: int) -> Column:
    """Aggregate only where the frame holds ``k`` values; else NULL."""
    return F.when(F.count(x).over(w) == k, agg(x).over(w))


def rolling_sum(x: Column, w: WindowSpec, k: int = WINDOW_ROWS) -> Column:
    """Trailing k-row sum; NULL in a short or NULL-holding frame."""
    return _strict(F.sum, x, w.rowsBetween(1 - k, 0), k)


def rolling_mean(x: Column, w: WindowSpec, k: int = WINDOW_ROWS) -> Column:
    return _strict(F.avg, x, w.rowsBetween(1 - k, 0), k)


def ma7(
    df: DataFrame, y: str, by: Sequence[str] = (), date: str = "date", k: int = WINDOW_ROWS
) -> DataFrame:
    """(group, date, ``moving_avg``) of a daily series."""
    return df.select(*by, date, rolling_mean(F.col(y), series(by, (date,)), k).alias("moving_avg"))


def sum7(
    df: DataFrame, y: str, by: Sequence[str] = (), date: str = "date", k: int = WINDOW_ROWS
) -> DataFrame:
    """(group, date, ``moving_sum``) of a daily series."""
    return df.select(*by, date, rolling_sum(F.col(y), series(by, (date,)), k).alias("moving_sum"))


def rolling_mean_fill0(x: Column, w: WindowSpec, k: int = WINDOW_ROWS) -> Column:
    """Trailing mean, 0 while fewer than k rows exist."""
    short = F.count(F.lit(1)).over(w.rowsBetween(1 - k, 0)) < k
    return F.when(short, F.lit(0.0)).otherwise(rolling_mean(x, w, k))


def centered_mean(x: Column, w: WindowSpec, k: int = WINDOW_ROWS) -> Column:
    if k % 2 == 0:
        raise ValueError("a centred window needs an odd number of rows")
    return _strict(F.avg, x, w.rowsBetween(-(k // 2), k // 2), k)


def cumulative(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def forward_max(x: Column, w: WindowSpec) -> Column:
    """NULL becomes the largest earlier value, or stays NULL without one."""
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(x, F.max(x).over(before))


def mean_of_present(
    df: DataFrame, x: str, name: str, by: Sequence[str] = (), order: Sequence[str] = ("date",), k: int = WINDOW_ROWS
) -> DataFrame:
    """Trailing mean over the rows that have ``x``; NULL on the others."""
    flag = F.col(x).isNotNull()
    w = Window.partitionBy(*by, flag).orderBy(*order)
    return df.withColumn(name, F.when(flag, rolling_mean(F.col(x), w, k)))


def add_rolling_rates(
    df: DataFrame,
    by: Sequence[str] = (),
    channels: Sequence[str] = CHANNELS,
    order: Sequence[str] = ("date",),
    k: int = WINDOW_ROWS,
) -> DataFrame:
    """Add ``k7_T, n7_T, p_T, p7_T`` to a wide frame of ``k_T, n_T``."""
    w = series(by, order)
    sums = {
        f"{stem}7_{c}": rolling_sum(F.col(f"{stem}_{c}"), w, k) for c in channels for stem in "kn"
    }
    return add_rates(df.withColumns(sums), channels)


def add_rates(df: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    return df.withColumns(
        {
            f"p{s}_{c}": ratio(F.col(f"k{s}_{c}"), F.col(f"n{s}_{c}"))
            for c in channels
            for s in ("", "7")
        }
    )
