"""Text and label columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from posigauge.constants import (
    MISSING_TEXT,
    NEGATIVE,
    OTHER,
    POSITIVE,
    REGION_SPELLING,
    TEST_TYPE_ALIASES,
    UNREPORTED,
)

# --- fixed values: markers looked for in the lower-cased result text ---------
TARGET_MARKERS = ("covid", "sars-cov-2")
OFF_TARGET_MARKER = "influenza"
POSITIVE_MARKER = "positive"
NEGATIVE_MARKER = "negative"
NOT_DETECTED = "not detected"
# ----------------------------------------------------------------------------


def missing_to_null(c: Column, marker: str = MISSING_TEXT) -> Column:
    return F.nullif(c, F.lit(marker))


def respell(c: Column, spelling: Mapping[str, str]) -> Column:
    """Replace whole values found in ``spelling``; leave the rest."""
    out = c
    for wrong, right in spelling.items():
        out = F.when(c == wrong, F.lit(right)).otherwise(out)
    return out


def clean_region(c: Column) -> Column:
    return F.coalesce(respell(missing_to_null(c), REGION_SPELLING), F.lit(UNREPORTED))


def classify_result(raw: Column) -> Column:
    """positive / negative / other; the first rule that holds decides.

    NULL makes every test NULL, so a missing result ends as "other".
    """
    text = F.lower(raw)
    says_positive = text.contains(POSITIVE_MARKER)
    on_target = text.contains(TARGET_MARKERS[0]) | text.contains(TARGET_MARKERS[1])
    return (
        F.when(on_target & says_positive, POSITIVE)
        .when(text.contains(OFF_TARGET_MARKER), OTHER)
        .when(says_positive, POSITIVE)
        .when(text.contains(NEGATIVE_MARKER) | (text == NOT_DETECTED), NEGATIVE)
        .otherwise(OTHER)
    )


def normalize_test_type(c: Column) -> Column:
    return respell(F.initcap(c), TEST_TYPE_ALIASES)


def short_label(c: Column, length: int = 1) -> Column:
    return F.substring(c, 1, length)


def in_domain(c: Column, levels: Iterable[str]) -> Column:
    """Closed domain: a value outside ``levels`` becomes NULL."""
    return F.when(c.isin(list(levels)), c)


def domain_index(c: Column, levels: Iterable[str]) -> Column:
    """1-based position in the domain, NULL outside it; use it to sort."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), c)
    return F.nullif(position, F.lit(0).cast("long"))
