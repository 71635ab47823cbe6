"""Age-range text and age bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from posigauge.constants import AGE_STARTS


def _number_at(c: Column, pattern: str) -> Column:
    # regexp_extract gives '' when nothing matches
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("double")


def age_start(c: Column) -> Column:
    return _number_at(c, r"^(\d+)")


def age_end(c: Column) -> Column:
    return _number_at(c, r"(\d+)$")


def age_labels(starts: Sequence[int] = AGE_STARTS, separator: str = " to ") -> list[str]:
    closed = [f"{lo}{separator}{hi - 1}" for lo, hi in zip(starts, starts[1:])]
    return [*closed, f"{starts[-1]}+"]


def age_bin(
    age: Column, starts: Sequence[int] = AGE_STARTS, separator: str = " to "
) -> Column:
    """Label of the half-open bin holding ``age``; NULL below the first start."""
    labels = age_labels(starts, separator)
    out = F.when(age >= starts[-1], labels[-1])
    for start, label in reversed(list(zip(starts, labels))[:-1]):
        out = out.when(age >= start, label)
    return out
