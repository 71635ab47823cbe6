"""From raw test records to the clean log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posigauge.constants import (
    COMBINED_MEMBERS,
    COMBINED_TYPE,
    FIRST_YEAR,
    IMPUTATION_DELAY_DAYS,
    LOCAL_ZONE,
    UNREPORTED,
)
from posigauge.functions import ages, text, times
from posigauge.session import materialize

TIME_COLUMNS = ("collectedDate", "reportedDate", "orderCreatedAt", "resultCreatedAt")


def compute_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns that are evaluated once per row.

    A plain projection is copied into every later filter and expression that
    uses it. The result of a generator is not, which matters for text parsing.
    """
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    kept = [c for c in df.columns if c not in columns]
    order = [*df.columns, *[c for c in columns if c not in df.columns]]
    return df.select(*kept, F.inline(packed)).select(*order)


def parse_times(
    df: DataFrame, columns: Sequence[str] = TIME_COLUMNS, zone: str = LOCAL_ZONE
) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return compute_once(df, {c: times.local_timestamp(F.col(c), zone) for c in present})


def clean_labels(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "ageRange": text.missing_to_null(F.col("ageRange")),
            "region": text.clean_region(F.col("region")),
            "result": text.classify_result(F.col("result")),
        }
    )


def resolve_dates(
    df: DataFrame,
    as_of: dt.date,
    mode: str = "impute",
    first_year: int = FIRST_YEAR,
    delay_days: int = IMPUTATION_DELAY_DAYS,
    clamp_future: bool = False,
) -> DataFrame:
    """Add ``date`` and keep valid days only.

    ``impute`` repairs missing or impossible collection days from the report
    day; ``drop`` removes those rows instead.
    """
    collected, reported = F.col("collectedDate"), F.col("reportedDate")
    if mode == "drop":
        day = collected.cast("date")
    elif mode == "impute":
        day = times.event_date(collected, reported, as_of, first_year, delay_days, clamp_future)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.withColumn("date", day).where(times.valid_day(F.col("date"), as_of, first_year))


def add_age_bins(
    df: DataFrame, separator: str = " to ", unreported: str | None = UNREPORTED
) -> DataFrame:
    """Add ``age_start`` and ``age_end`` and replace ``ageRange`` by its bin."""
    df = df.withColumns(
        {"age_start": ages.age_start(F.col("ageRange")), "age_end": ages.age_end(F.col("ageRange"))}
    )
    label = ages.age_bin(F.col("age_start"), separator=separator)
    return df.withColumn("ageRange", F.coalesce(label, F.lit(unreported)) if unreported else label)


def add_combined_type(
    df: DataFrame,
    members: Sequence[str] = COMBINED_MEMBERS,
    combined: str = COMBINED_TYPE,
    column: str = "testType",
) -> DataFrame:
    """Count rows of ``members`` once more under ``combined``, in one scan."""
    own = F.col(column)
    targets = F.when(own.isin(list(members)), F.array(own, F.lit(combined))).otherwise(F.array(own))
    return df.withColumn(column, F.explode(targets))


def union_by_name(*frames: DataFrame, strict: bool = False) -> DataFrame:
    """Stack by column name; unless ``strict``, absent columns become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        if strict and set(out.columns) != set(frame.columns):
            raise ValueError("strict union needs the same columns")
        out = out.unionByName(frame, allowMissingColumns=not strict)
    return out


def distinct_rows(df: DataFrame) -> DataFrame:
    """Drop exact duplicates; partial aggregation removes copies before the shuffle."""
    return df.dropDuplicates()


BITMAP_BITS = 26  # bits that row fingerprints fall on: a table of 2^20 words of 16 bytes at most


def distinct_by_fingerprint(df: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """Drop exact duplicates, shuffling whole rows only where a fingerprint recurs.

    16-byte fingerprints are counted; those that occur more than once set a bit
    each in a bitmap of fixed size, which is broadcast. A row whose bit is not
    set has no equal and goes on without a shuffle; all others are compared
    whole, so results are exact. ``df`` is read three times: worth it where
    rows are wide and few of them repeat. With many repeats most bits are set
    and it does what :func:`distinct_rows` does.
    """
    marks = [F.xxhash64(*df.columns), F.xxhash64(F.lit("second"), *df.columns)]
    bit = F.pmod(F.col("_a"), F.lit(1 << bits))
    word, place = F.floor(bit / 64).cast("long"), (bit % 64).cast("int")
    counted = df.select(*[m.alias(n) for m, n in zip(marks, ("_a", "_b"), strict=True)]).groupBy("_a", "_b").agg(
        F.count(F.lit(1)).alias("_n")
    )
    repeats = counted.where("_n > 1").groupBy(word.alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(_a, {1 << bits}) % 64 as int))")).alias("_bits"))
    repeats = F.broadcast(materialize(repeats))
    marked = df.withColumn("_a", marks[0]).withColumn("_word", word).withColumn("_place", place)
    found = marked.join(repeats, "_word", "left")
    recurs = F.coalesce(F.expr("shiftrightunsigned(_bits, _place) & 1"), F.lit(0)) == 1
    alone = found.where(~recurs).select(*df.columns)
    return alone.unionByName(found.where(recurs).select(*df.columns).dropDuplicates())


def sort_log(df: DataFrame, *columns: str) -> DataFrame:
    """Ascending with NULL last; for output only."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def exclude_days(df: DataFrame, days: Sequence[dt.date], date: str = "date") -> DataFrame:
    return df.where(~F.col(date).isin(list(days)))


def select_numeric(df: DataFrame) -> DataFrame:
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return df.select(
        *[name for name, kind in df.dtypes if kind in numeric or kind.startswith("decimal")]
    )


def drop_containing(df: DataFrame, *parts: str) -> DataFrame:
    """Drop columns whose name holds one of ``parts`` (leftovers of a join)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not any(p in c for p in parts)])


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(0, subset=list(columns) if columns else None)
