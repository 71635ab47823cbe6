"""Landed files in, snapshots out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from posigauge.functions.times import in_period

CORRUPT, FILE = "_corrupt_record", "_file"
MONTH = "month"
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the directory name that reads back as NULL


def read_json_log(
    spark: SparkSession, path: str | list[str], schema: StructType, lines: bool = False
) -> DataFrame:
    """JSON records, each file one array (``lines=False``) or one record a line.

    An array file is read by a single task, so land the log as many slices;
    use ``lines=True`` for files that should be split.
    """
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_json_records(
    spark: SparkSession, path: str | list[str], schema: StructType, rest: str = "rest", lines: bool = False
) -> DataFrame:
    """The schema's columns of JSON records, and every other field of a record in one text column.

    Each record is parsed once, to a VARIANT; columns are taken out by path and
    cast (a value that does not fit is NULL). ``rest`` is a JSON object of the
    undeclared fields by name, NULL without any, so that records which differ
    in such a field only stay different rows. A file is one array of records or
    one record (``lines=False``), or holds a record a line.
    """
    record = F.col("record")
    landed = spark.read.option("singleVariantColumn", "record").json(path, multiLine=not lines)
    if not lines:
        parts = F.coalesce(F.try_variant_get(record, "$", "array<variant>"), F.array(record))
        landed = landed.select(F.explode(parts).alias("record"))
    fields = [F.try_variant_get(record, f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in schema]
    other = F.map_filter(
        F.try_variant_get(record, "$", "map<string, variant>"), lambda name, _: ~name.isin([f.name for f in schema])
    )
    value = lambda e: F.coalesce(F.to_json(e["value"]), F.lit("null"))
    name = lambda e: F.regexp_extract(F.to_json(F.array(e["key"])), r"(?s)^\[(.*)\]$", 1)
    members = F.array_sort(F.transform(F.map_entries(other), lambda e: F.concat(name(e), F.lit(":"), value(e))))
    text = F.when(F.size(other) > 0, F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")))
    return landed.select(*fields, text.alias(rest))


def read_accounted(spark: SparkSession, path: str | list[str], schema: StructType, kind: str = "json", **options) -> DataFrame:
    """The schema's columns, the text of records that do not parse, and the file of every record.

    Nothing fails on a bad record: it has its text in ``CORRUPT`` and its file
    in ``FILE``, so :func:`corrupt_files` can account for it and
    :func:`read_first_available` can turn to another source.
    """
    whole = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    reader = spark.read.schema(whole).options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options)
    return reader.format(kind).load(path).select("*", F.col("_metadata.file_path").alias(FILE))


def _judged(df: DataFrame) -> DataFrame:
    """Per file, or for all rows of a frame without files: rows and bad rows; every column of every row is read."""
    bad = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    read = F.bit_xor(F.xxhash64(*[F.col(c) for c in df.columns if c not in (CORRUPT, FILE)]))
    return df.groupBy(*[c for c in (FILE,) if c in df.columns]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), read.alias("digest")
    )


def corrupt_files(df: DataFrame) -> DataFrame:
    """(FILE, n, bad) of a frame of :func:`read_accounted`: files with records that do not parse."""
    return _judged(df).where("bad > 0 and digest is not null").drop("digest")


def write_json_slices(
    df: DataFrame, path: str, slice_id: str, rows_per_slice: int = 20_000
) -> None:
    """Land a log as array files, each holding a bounded run of ``slice_id``.

    ``slice_id`` must be a unique integer column: it bounds the rows of a file.
    """
    record = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    (
        df.select(
            F.floor(F.col(slice_id) / rows_per_slice).alias("slice"), record.alias("record")
        )
        .groupBy("slice")
        .agg(F.concat(F.lit("["), F.array_join(F.collect_list("record"), ","), F.lit("]")).alias("value"))
        .write.partitionBy("slice")
        .text(path)
    )


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """The schema's columns by header name, whatever their order and whatever else the file holds.

    The header is read as text columns; an absent column is NULL in every row.
    All files of one call share a header: read files with other columns apart
    and union them by name.
    """
    landed = spark.read.csv(path, header=True)
    present = set(landed.columns)
    return landed.select(
        *[
            (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_snapshot(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), rebalance: bool = False
) -> None:
    """Parquet snapshot; partitioning by test type lets later reads prune.

    With many partition values every task would write a small file for each;
    ``rebalance`` shuffles once so that files are of even size, splitting
    large values and joining small ones.
    """
    if rebalance:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stamp_snapshot(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Keep the processing day and the last complete day with the data."""
    return df.withColumn("the_stamp", F.lit(as_of)).withColumn(
        "last_complete_day", F.lit(as_of - dt.timedelta(days=1))
    )


def read_slice(
    df: DataFrame, test_type: str, created: str, start: dt.date, end: dt.date
) -> DataFrame:
    """One channel and a half-open creation period, as filters the scan takes."""
    return df.where((F.col("testType") == test_type) & in_period(F.col(created), start, end))


def read_first_available(
    candidates: Sequence[Callable[[], DataFrame]], columns: Sequence[str] | None = None
) -> DataFrame:
    """First candidate that gives a row and can be read to its end, on the common columns.

    Missing files and columns show when the plan is analysed, unreadable files
    when they are read. So every row of a candidate is read once before it is
    taken, in one aggregate: a file that fails after its first row, or a single
    record that does not parse (:func:`read_accounted`), makes the next one count.
    """
    failure: Exception | None = None
    for candidate in candidates:
        try:
            df = candidate()
            judged = _judged(df).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.bit_xor("digest")).first()
            if judged["n"] and not judged["bad"]:
                return df.select(*columns) if columns else df.drop(CORRUPT, FILE)
        except (PySparkException, Py4JJavaError) as error:
            failure = error
    raise FileNotFoundError("no candidate source is available") from failure


def write_log(df: DataFrame, path: str, created: str) -> None:
    """The log by test type and month, rows of a file in the order of ``created``.

    Months prune directories; order inside files gives row groups narrow
    bounds, so a slice of some days skips most of its month's pages too. One
    shuffle makes files of even size, splitting large months.
    """
    # Spark keeps the order of rows in a file only if partition columns cannot be NULL (nor be one literal for all rows).
    named = {"testType": F.col("testType"), MONTH: F.date_format(created, "yyyy-MM")}
    dated = df.withColumns({c: F.coalesce(v, F.lit(NULL_PARTITION)) for c, v in named.items()})
    even = dated.hint("rebalance", "testType", MONTH).sortWithinPartitions("testType", MONTH, created)
    even.write.partitionBy("testType", MONTH).option("compression", "zstd").parquet(path)


def read_log_slice(spark: SparkSession, path: str, test_type: str, created: str, start: dt.date, end: dt.date) -> DataFrame:
    """One channel and a half-open period of a log of :func:`write_log`: directories, then row groups, then rows."""
    log = spark.read.schema(spark.read.parquet(path).schema).parquet(path)
    last = end - dt.timedelta(days=1)
    months = F.col(MONTH).cast("string").between(f"{start:%Y-%m}", f"{last:%Y-%m}")
    return read_slice(log.where(months), test_type, created, start, end).drop(MONTH)
