"""Ratios and small formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from posigauge.constants import NEGATIVE, POSITIVE


def is_positive(result: Column) -> Column:
    return result == POSITIVE


def is_known(result: Column) -> Column:
    return result.isin(POSITIVE, NEGATIVE)


def ratio(k: Column, n: Column) -> Column:
    """k/n as double, NULL where n is 0 or missing."""
    return F.try_divide(k.cast("double"), n.cast("double"))


def logit(p: Column) -> Column:
    odds = ratio(p, F.lit(1.0) - p)
    return F.ln(F.nullif(odds, F.lit(0.0)))


def log2_or_null(x: Column) -> Column:
    """log2, NULL at 0 (a log scale has no place for it)."""
    return F.log2(F.nullif(x.cast("double"), F.lit(0.0)))


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    z = ratio(x - mean, sd)
    return F.try_divide(F.exp(-(z * z) / 2), sd * math.sqrt(2 * math.pi))


def standard_error(x: Column) -> Column:
    """Aggregate: sd over the root of the row count."""
    return F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x).cast("double")))


def cases_plus_negatives(people: Column, positives: Column, cases: Column) -> Column:
    return people - positives + cases


def per_thousand(n: Column, population: Column) -> Column:
    return ratio(n, population) * 1000


def type_offset(test_type: Column, base: str, low: float = 1.0, high: float = 1.25) -> Column:
    """Lane of a mark: ``low`` for the base channel, ``high`` for any other."""
    return F.when(test_type == base, low).otherwise(high)
