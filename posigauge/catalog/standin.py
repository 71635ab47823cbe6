"""The benchmark tables seen as test logs, and the same views as SQL text.

lineitem is a dense log of two channels, orders a sparse log of five, events a
small log with entry days. Each view joins only the tables its columns need.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posigauge.constants import HOME, LAB
from posigauge.operators.counts import channel_counts
from posigauge.operators.rolling import add_rolling_rates

START = dt.date(1996, 1, 1)
AS_OF = dt.date(2001, 6, 30)
FIRST_YEAR = 1996
EVENTS_START = dt.date(2024, 1, 1)
MEMBERS = ["click", "purchase"]
PERIODS = [
    ("early", dt.date(1996, 1, 1), dt.date(1998, 1, 1)),
    ("middle", dt.date(1998, 1, 1), dt.date(2000, 1, 1)),
    ("late", dt.date(2000, 1, 1), dt.date(2002, 1, 1)),
]
POPULATION = {"AFRICA": 700000, "AMERICA": 500000, "ASIA": 400000, "EUROPE": 450000, "ATLANTIS": 100000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_region(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    places = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("region"))
    )
    return df.join(places, "l_suppkey")


def _with_age(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    low = 5 * (F.col("p_size") % 20)
    ages = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.when(F.col("p_size") == 50, "N/A")
        .otherwise(F.concat(low.cast("string"), F.lit(" to "), (low + 4).cast("string")))
        .alias("ageRange"),
    )
    return df.join(ages, "l_partkey")


def dense_log(spark: SparkSession, sf_dir: str, region: bool = False, age: bool = False) -> DataFrame:
    """Clean log: testType, patientId, result, date [, region] [, ageRange]."""
    df = table(spark, sf_dir, "lineitem")
    extra = []
    if region:
        df, extra = _with_region(df, spark, sf_dir), [*extra, "region"]
    if age:
        df, extra = _with_age(df, spark, sf_dir), [*extra, "ageRange"]
    flag = F.col("l_returnflag")
    return df.select(
        F.when(F.col("l_linestatus") == "O", HOME).otherwise(LAB).alias("testType"),
        F.col("l_partkey").alias("patientId"),
        F.when(flag == "R", "positive").when(flag == "A", "negative").otherwise("other").alias("result"),
        F.col("l_shipdate").cast("date").alias("date"),
        *extra,
    )


_TYPE = f"case l_linestatus when 'O' then '{HOME}' else '{LAB}' end as testType"
_RESULT = (
    "case l_returnflag when 'R' then 'positive' when 'A' then 'negative' else 'other' end as result"
)
_AGE = (
    "case when p_size = 50 then 'N/A' else concat(5 * (p_size % 20), ' to ', 5 * (p_size % 20) + 4) end"
)


def log_sql(region: bool = False, age: bool = False) -> str:
    """The same view as a CTE named ``log``."""
    extra = (", r_name as region" if region else "") + (f", {_AGE} as ageRange" if age else "")
    joins = ""
    if region:
        joins += (
            " join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey"
            " join region on n_regionkey = r_regionkey"
        )
    if age:
        joins += " join part on l_partkey = p_partkey"
    return (
        f"log as (select {_TYPE}, l_partkey as patientId, {_RESULT}, "
        f"cast(l_shipdate as date) as date{extra} from lineitem{joins})"
    )


def raw_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned text records: spelling variants, offsets, gaps and garbage."""
    df = _with_age(_with_region(table(spark, sf_dir, "lineitem"), spark, sf_dir), spark, sf_dir)
    df = df.join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    line, even = F.col("l_linenumber"), F.col("l_linenumber") % 2 == 0
    flag, ship = F.col("l_returnflag"), F.col("l_shipdate").cast("date").cast("string")
    return df.select(
        F.when(F.col("l_linestatus") == "O", HOME).otherwise(LAB).alias("testType"),
        F.col("l_partkey").cast("string").alias("patientId"),
        F.when((flag == "R") & even, "SARS-CoV-2 Positive")
        .when(flag == "R", "POSITIVE")
        .when((flag == "A") & even, "Not Detected")
        .when(flag == "A", "Negative")
        .when(even, "Influenza A positive")
        .otherwise("Invalid")
        .alias("result"),
        F.when(line == 7, None)
        .when(line == 6, F.lit("not a date"))
        .when(line % 3 == 0, F.concat(ship, F.lit("T02:00:00Z")))
        .when(line % 3 == 1, F.concat(ship, F.lit(" 10:30:00")))
        .otherwise(F.concat(ship, F.lit("T23:30:00-04:00")))
        .alias("collectedDate"),
        F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit(" 08:00:00")).alias("reportedDate"),
        F.col("ageRange"),
        F.when(F.col("region") == "AMERICA", "Bayamon")
        .when(F.col("region") == "ASIA", "Mayaguez")
        .when(F.col("region") == "EUROPE", "N/A")
        .when(F.col("region") == "AFRICA", "Metro")
        .alias("region"),
    )


RAW_SQL = f"""raw as (select {_TYPE}, cast(l_partkey as varchar) as patientId,
  {_RESULT}, l_linenumber, l_returnflag,
  case when l_linenumber in (6, 7) then null
       when l_linenumber % 3 = 0 then cast(l_shipdate as date) - 1
       else cast(l_shipdate as date) end as collected,
  cast(o_orderdate as date) as reported,
  case r_name when 'AMERICA' then 'Bayamón' when 'ASIA' then 'Mayagüez' when 'AFRICA' then 'Metro'
       else 'No reportada' end as region,
  {_AGE} as ageRange
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey
  join orders on l_orderkey = o_orderkey)"""


def sparse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("testType"),
        F.col("o_custkey").alias("patientId"),
        F.when(status == "F", "positive").when(status == "O", "negative").otherwise("other").alias("result"),
        F.col("o_orderdate").cast("date").alias("date"),
    )


SPARSE_SQL = (
    "log as (select o_orderpriority as testType, o_custkey as patientId, "
    "case o_orderstatus when 'F' then 'positive' when 'O' then 'negative' else 'other' end as result, "
    "cast(o_orderdate as date) as date from orders)"
)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small log with an entry day and one missing person id."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("testType"),
        F.nullif(F.col("user_id"), F.lit(3).cast("long")).alias("patientId"),
        F.when(value >= 50, "positive").when(value < 5, "other").otherwise("negative").alias("result"),
        F.col("ts").cast("date").alias("date"),
        F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 4).cast("int")).alias("entry_date"),
    )


EVENTS_SQL = (
    "log as (select event_type as testType, nullif(user_id, 3) as patientId, "
    "case when value >= 50 then 'positive' when value < 5 then 'other' else 'negative' end as result, "
    "cast(ts as date) as date, cast(ts as date) + cast(event_id % 4 as integer) as entry_date from events)"
)


def daily_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of both channels per day of the dense log."""
    return add_rolling_rates(channel_counts(dense_log(spark, sf_dir), ["date"]))


def wide_sql(by: str = "date", where: str = "true") -> str:
    """CTE ``wide`` with n_T and k_T per ``by`` from ``log``."""
    columns = []
    for channel in (LAB, HOME):
        seen = f"count(*) filter (testType = '{channel}')"
        hits = f"count(*) filter (testType = '{channel}' and result = 'positive')"
        columns += [
            f"nullif({seen}, 0) as n_{channel}",
            f"case when {seen} > 0 then {hits} end as k_{channel}",
        ]
    return f"wide as (select {by}, {', '.join(columns)} from log where {where} group by {by})"


def rolling_sql(partition: str = "", order: str = "date") -> str:
    """CTE ``rolled`` with strict 7-row sums and rates from ``wide``."""
    part = f"partition by {partition} " if partition else ""
    sums = ", ".join(
        f"cast(case when count({c}) over w = 7 then sum({c}) over w end as bigint) as {c[0]}7{c[1:]}"
        for c in (f"{s}_{t}" for t in (LAB, HOME) for s in "nk")
    )
    rates = ", ".join(
        f"cast(k{s}_{t} as double) / nullif(n{s}_{t}, 0) as p{s}_{t}"
        for t in (LAB, HOME)
        for s in ("", "7")
    )
    return (
        f"summed as (select *, {sums} from wide window w as "
        f"({part}order by {order} rows between 6 preceding and current row)), "
        f"rolled as (select *, {rates} from summed)"
    )


RATE_COLUMNS = " ".join(f"p{s}_{t}" for t in (LAB, HOME) for s in ("", "7"))

