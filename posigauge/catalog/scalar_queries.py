"""Projections, filters and scalar functions over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from posigauge.catalog.base import register
from posigauge.catalog.standin import (
    AS_OF,
    EVENTS_SQL,
    FIRST_YEAR,
    MEMBERS,
    PERIODS,
    RATE_COLUMNS,
    RAW_SQL,
    SPARSE_SQL,
    daily_pair,
    dense_log,
    event_log,
    log_sql,
    raw_tests,
    rolling_sql,
    sparse_log,
    table,
    wide_sql,
)
from posigauge.constants import FIVE_YEAR_LABELS, HOME, LAB
from posigauge.functions import ages, rates, text, times
from posigauge.operators import cleaning
from posigauge.operators.counts import positive_counts, row_counts
from posigauge.sources.files import stamp_snapshot



def n_rows():
    return F.count(F.lit(1)).alias("n")

WIDE = f"with {log_sql()}, {wide_sql()}, {rolling_sql()}"


@register(
    "parse_local_ts",
    """
    with t as (select ts, event_id % 4 as form from events),
    p as (select case form
        when 0 then ts - interval 4 hour
        when 1 then ts
        when 2 then ts - interval 9 hour - interval 30 minute
        end as local from t)
    select cast(local as date) as date, extract(hour from local) as hour, count(*) as n from p group by 1, 2
    """,
)
def parse_local_ts(spark, sf_dir):
    form = F.col("event_id") % 4
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = (
        F.when(form == 0, F.concat(stamp, F.lit("Z")))
        .when(form == 1, stamp)
        .when(form == 2, F.concat(stamp, F.lit("+05:30")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    local = times.local_timestamp(written)
    events = table(spark, sf_dir, "events").select(local.alias("local"))
    return events.groupBy(
        F.col("local").cast("date").alias("date"), F.hour("local").cast("long").alias("hour")
    ).agg(n_rows())


@register(
    "clean_labels",
    f"with {RAW_SQL} select region, nullif(ageRange, 'N/A') as ageRange, result, count(*) as n from raw group by 1, 2, 3",
)
def clean_labels(spark, sf_dir):
    cleaned = cleaning.clean_labels(raw_tests(spark, sf_dir))
    return cleaned.groupBy("region", "ageRange", "result").agg(n_rows())


@register(
    "classify_result",
    f"with {RAW_SQL} select result, count(*) as n from raw group by 1",
)
def classify_result(spark, sf_dir):
    return raw_tests(spark, sf_dir).groupBy(text.classify_result(F.col("result")).alias("result")).agg(n_rows())


_EVENT_DATE = f"""case when extract(year from collected) between {FIRST_YEAR} and {AS_OF.year}
  then collected else reported - 2 end"""


@register(
    "resolve_event_date",
    f"""with {RAW_SQL},
    c as (select *, case when collected > reported then reported else collected end as clamped from raw)
    select {_EVENT_DATE} as date,
      {_EVENT_DATE.replace('collected', 'clamped')} as clamped_date, count(*) as n
    from c group by 1, 2""",
)
def resolve_event_date(spark, sf_dir):
    raw = cleaning.parse_times(raw_tests(spark, sf_dir))
    args = (F.col("collectedDate"), F.col("reportedDate"), AS_OF, FIRST_YEAR)
    return raw.groupBy(
        times.event_date(*args).alias("date"),
        times.event_date(*args, clamp_future=True).alias("clamped_date"),
    ).agg(n_rows())


@register(
    "valid_date_filter",
    f"""with {RAW_SQL}, d as (select testType, {_EVENT_DATE} as date from raw)
    select testType, date, count(*) as n from d
    where date between date '{FIRST_YEAR}-01-01' and date '{AS_OF}' group by 1, 2""",
)
def valid_date_filter(spark, sf_dir):
    raw = cleaning.parse_times(raw_tests(spark, sf_dir))
    dated = cleaning.resolve_dates(raw, AS_OF, first_year=FIRST_YEAR)
    return row_counts(dated, ["testType", "date"])


@register(
    "drop_bad_dates",
    f"""with {RAW_SQL} select testType, collected as date, count(*) as n from raw
    where collected between date '{FIRST_YEAR}-01-01' and date '{AS_OF}' group by 1, 2""",
)
def drop_bad_dates(spark, sf_dir):
    raw = cleaning.parse_times(raw_tests(spark, sf_dir))
    dated = cleaning.resolve_dates(raw, AS_OF, mode="drop", first_year=FIRST_YEAR)
    return row_counts(dated, ["testType", "date"])


@register(
    "age_parse",
    f"""with {log_sql(age=True)} select ageRange, cast(nullif(regexp_extract(ageRange, '^([0-9]+)', 1), '') as double) as age_start,
      cast(nullif(regexp_extract(ageRange, '([0-9]+)$', 1), '') as double) as age_end, count(*) as n
    from log group by 1, 2, 3""",
    "age_start age_end",
)
def age_parse(spark, sf_dir):
    log = dense_log(spark, sf_dir, age=True)
    return log.groupBy(
        "ageRange",
        ages.age_start(F.col("ageRange")).alias("age_start"),
        ages.age_end(F.col("ageRange")).alias("age_end"),
    ).agg(n_rows())


AGE_BIN_SQL = """case when a >= 75 then '75+' when a >= 65 then '65 to 74' when a >= 40 then '40 to 64'
  when a >= 30 then '30 to 39' when a >= 20 then '20 to 29' when a >= 15 then '15 to 19'
  when a >= 10 then '10 to 14' when a >= 0 then '0 to 9' else 'No reportada' end"""
AGED_SQL = f"""{log_sql(age=True)},
  parsed as (select *, cast(nullif(regexp_extract(ageRange, '^([0-9]+)', 1), '') as integer) as a from log),
  aged as (select testType, patientId, result, date, {AGE_BIN_SQL} as ageRange from parsed)"""


@register("age_bin", f"with {AGED_SQL} select ageRange, count(*) as n from aged group by 1")
def age_bin(spark, sf_dir):
    return row_counts(cleaning.add_age_bins(dense_log(spark, sf_dir, age=True)), ["ageRange"])


_LEVELS = ", ".join(f"'{level}'" for level in FIVE_YEAR_LABELS)


@register(
    "domain_check",
    f"""with {log_sql(age=True)} select case when ageRange in ({_LEVELS}) then ageRange end as level,
      cast(nullif(list_position([{_LEVELS}], ageRange), 0) as integer) as position,
      ageRange <> 'N/A' as five_year, count(*) as n from log group by 1, 2, 3""",
)
def domain_check(spark, sf_dir):
    age = F.col("ageRange")
    return (
        dense_log(spark, sf_dir, age=True)
        .groupBy(
            text.in_domain(age, FIVE_YEAR_LABELS).alias("level"),
            text.domain_index(age, FIVE_YEAR_LABELS).cast("int").alias("position"),
            text.in_domain(age, FIVE_YEAR_LABELS).isNotNull().alias("five_year"),
        )
        .agg(n_rows())
    )


@register(
    "project_rename",
    f"with {SPARSE_SQL} select testType as channel, date, result = 'positive' as hit, count(*) as n from log group by 1, 2, 3",
)
def project_rename(spark, sf_dir):
    log = sparse_log(spark, sf_dir).drop("patientId").withColumnRenamed("testType", "channel")
    return log.withColumn("hit", rates.is_positive(F.col("result"))).groupBy("channel", "date", "hit").agg(n_rows())


@register(
    "filter_in",
    f"""with {log_sql(region=True)} select region, testType, count(*) as n from log
    where region in ('ASIA', 'EUROPE', 'AFRICA') and region not in ('AFRICA') and testType <> '{LAB}' group by 1, 2""",
)
def filter_in(spark, sf_dir):
    log = dense_log(spark, sf_dir, region=True)
    region = F.col("region")
    kept = log.where(region.isin("ASIA", "EUROPE", "AFRICA") & ~region.isin("AFRICA"))
    return row_counts(kept.where(F.col("testType") != LAB), ["region", "testType"])


@register(
    "filter_period",
    f"""with {log_sql()} select case when date < date '1998-01-01' then 'early' when date < date '2000-01-01' then 'middle'
      else 'late' end as period, min(date) as first, max(date) as last, count(*) as n
    from log where date >= date '1996-01-01' and date < date '2002-01-01' group by 1""",
)
def filter_period(spark, sf_dir):
    log = dense_log(spark, sf_dir).where(
        times.in_period(F.col("date"), dt.date(1996, 1, 1), dt.date(2002, 1, 1))
    )
    return log.groupBy(times.period_label(F.col("date"), PERIODS).alias("period")).agg(
        F.min("date").alias("first"), F.max("date").alias("last"), n_rows()
    )


@register(
    "filter_known",
    f"with {log_sql()} select testType, result, count(*) as n from log where result <> 'other' group by 1, 2",
)
def filter_known(spark, sf_dir):
    log = dense_log(spark, sf_dir).where(rates.is_known(F.col("result")))
    return row_counts(log, ["testType", "result"])


@register(
    "weekday_label",
    f"""with {log_sql()} select dayname(date) as weekday, cast(dayofweek(date) + 1 as integer) as wday, count(*) as n
    from log group by 1, 2""",
)
def weekday_label(spark, sf_dir):
    day = F.col("date")
    return dense_log(spark, sf_dir).groupBy(
        times.weekday_name(day).alias("weekday"), times.weekday_number(day).alias("wday")
    ).agg(n_rows())


ROUND_WEEK_SQL = """cast(case when dayofweek(date) <= 3 then date - cast(dayofweek(date) as integer)
  else date + cast(7 - dayofweek(date) as integer) end as date)"""


@register("round_week", f"with {log_sql()} select date, {ROUND_WEEK_SQL} as week, count(*) as n from log group by 1, 2")
def round_week(spark, sf_dir):
    return dense_log(spark, sf_dir).groupBy("date", times.round_week(F.col("date")).alias("week")).agg(n_rows())


@register(
    "normalize_test_type",
    """
    select case event_type when 'error' then 'Antigens' else concat(upper(event_type[1]), event_type[2:]) end as testType,
      count(*) as n from events group by 1
    """,
)
def normalize_test_type(spark, sf_dir):
    raw = F.when(F.col("event_type") == "error", "ANTIGENO").otherwise(F.upper("event_type"))
    return row_counts(
        table(spark, sf_dir, "events").select(text.normalize_test_type(raw).alias("testType")), ["testType"]
    )


@register("short_label", f"with {SPARSE_SQL} select left(testType, 1) as label, count(*) as n from log group by 1")
def short_label(spark, sf_dir):
    return sparse_log(spark, sf_dir).groupBy(text.short_label(F.col("testType")).alias("label")).agg(n_rows())


@register(
    "log2_positives",
    f"""with {SPARSE_SQL}, c as (select testType, date, count(*) filter (result = 'positive') as k from log group by 1, 2)
    select testType, date, k, case when k > 0 then log2(k) end as log2_k from c""",
    "log2_k",
)
def log2_positives(spark, sf_dir):
    counts = positive_counts(sparse_log(spark, sf_dir), ["testType", "date"]).drop("n")
    return counts.withColumn("log2_k", rates.log2_or_null(F.col("k")))


@register(
    "logit",
    f"{WIDE} select date, case when p7_{LAB} > 0 and p7_{LAB} < 1 then ln(p7_{LAB} / (1 - p7_{LAB})) end as logit from rolled",
    "logit",
)
def logit(spark, sf_dir):
    return daily_pair(spark, sf_dir).select("date", rates.logit(F.col(f"p7_{LAB}")).alias("logit"))


@register(
    "normal_density",
    """
    with v as (select cast(o_orderdate as date) as date, count(*) as n from orders group by 1),
    s as (select avg(n) as m, stddev_samp(n) as sd from v)
    select date, n, exp(-(n - m) * (n - m) / (2 * sd * sd)) / (sd * sqrt(2 * pi())) as density from v, s
    """,
    "density",
)
def normal_density(spark, sf_dir):
    daily = row_counts(sparse_log(spark, sf_dir), ["date"])
    x = F.col("n").cast("double")
    mean = daily.select(F.avg("n")).scalar()
    sd = daily.select(F.stddev_samp("n")).scalar()
    return daily.withColumn("density", rates.normal_density(x, mean, sd))


@register(
    "report_lag",
    """
    select date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as lag, count(*) as n
    from lineitem join orders on l_orderkey = o_orderkey group by 1
    """,
)
def report_lag(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lag = times.report_lag(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date"))
    return lines.join(orders, "l_orderkey").groupBy(lag.cast("long").alias("lag")).agg(n_rows())


@register(
    "coalesce_sources",
    """
    with n as (select cast(o_orderdate as date) as date, nullif(count(*) % 5, 0) as fresh, count(*) as stale from orders group by 1)
    select date, coalesce(fresh, stale) as beds from n
    """,
)
def coalesce_sources(spark, sf_dir):
    daily = row_counts(sparse_log(spark, sf_dir), ["date"], "stale")
    fresh = F.nullif(F.col("stale") % 5, F.lit(0).cast("long"))
    return daily.select("date", F.coalesce(fresh, F.col("stale")).alias("beds"))


@register(
    "fill_zero",
    f"""with {log_sql()}, {wide_sql()} select date, coalesce(n_{LAB}, 0) as n_{LAB}, coalesce(n_{HOME}, 0) as n_{HOME},
      coalesce(k_{LAB}, 0) as k_{LAB}, coalesce(k_{HOME}, 0) as k_{HOME} from wide""",
)
def fill_zero(spark, sf_dir):
    columns = ["date", *[f"{s}_{t}" for t in (LAB, HOME) for s in "nk"]]
    return cleaning.fill_zero(daily_pair(spark, sf_dir).select(*columns))


@register(
    "select_numeric",
    """
    select s_nationkey, sum(s_acctbal) as s_acctbal, cast(sum(s_suppkey) as bigint) as s_suppkey from supplier group by 1
    """,
    "s_acctbal",
    digits=4,
)
def select_numeric(spark, sf_dir):
    numeric = cleaning.select_numeric(table(spark, sf_dir, "supplier"))
    sums = [F.sum(c).alias(c) for c in numeric.columns if c != "s_nationkey"]
    return numeric.groupBy("s_nationkey").agg(*sums)


@register(
    "filter_year",
    f"with {log_sql()} select date, count(*) as n from log where extract(year from date) >= 1999 group by 1",
)
def filter_year(spark, sf_dir):
    return row_counts(dense_log(spark, sf_dir).where(times.since_year(F.col("date"), 1999)), ["date"])


@register(
    "exclude_dates",
    f"with {log_sql()} select date, count(*) as n from log where date not in (date '1996-03-09', date '1996-03-10') group by 1",
)
def exclude_dates(spark, sf_dir):
    days = [dt.date(1996, 3, 9), dt.date(1996, 3, 10)]
    return row_counts(cleaning.exclude_days(dense_log(spark, sf_dir), days), ["date"])


@register("rates", f"{WIDE} select date, {RATE_COLUMNS.replace(' ', ', ')} from rolled", RATE_COLUMNS)
def rates_query(spark, sf_dir):
    return daily_pair(spark, sf_dir).select("date", *RATE_COLUMNS.split())


@register(
    "parse_mdy",
    """
    with d as (select cast(o_orderdate as date) as death, cast(o_orderdate as date) + cast(o_orderkey % 9 as integer) as report from orders)
    select death as legacy_date, case when death < date '1996-01-01' or death > date '2001-06-30' then report else death end as date,
      count(*) as n from d group by 1, 2
    """,
)
def parse_mdy(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    later = F.date_add(day, (F.col("o_orderkey") % 9).cast("int"))

    def written(d):
        return F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 12:00:00"))

    death = times.death_date(written(day), written(later), dt.date(1996, 1, 1), AS_OF)
    legacy = times.parse_mdy(F.date_format(day, "M/d/yyyy"))
    return table(spark, sf_dir, "orders").groupBy(legacy.alias("legacy_date"), death.alias("date")).agg(n_rows())


@register(
    "conditional_offset",
    f"""with {log_sql()}, y as (select *, case when testType = '{LAB}' then 1.0 else 1.25 end as y from log)
    select patientId, testType, cast(y as double) as y, cast(y + patientId as double) as y_val,
      cast(y + patientId - 1 as double) as bottom, cast(y + patientId + 1 as double) as top, count(*) as n
    from y group by 1, 2, 3, 4, 5, 6""",
    "y y_val bottom top",
)
def conditional_offset(spark, sf_dir):
    y = rates.type_offset(F.col("testType"), LAB)
    y_val = y + F.col("patientId")
    return dense_log(spark, sf_dir).groupBy(
        "patientId",
        "testType",
        y.alias("y"),
        y_val.alias("y_val"),
        (y_val - 1).alias("bottom"),
        (y_val + 1).alias("top"),
    ).agg(n_rows())


@register(
    "combined_test_type",
    f"""with {EVENTS_SQL}, both_types as (select testType, date from log union all
      select 'Molecular+Antigens', date from log where testType in ('click', 'purchase'))
    select testType, date, count(*) as n from both_types group by 1, 2""",
)
def combined_test_type(spark, sf_dir):
    return row_counts(cleaning.add_combined_type(event_log(spark, sf_dir), MEMBERS), ["testType", "date"])


@register(
    "snapshot_stamp",
    f"""with {SPARSE_SQL} select testType, date '2001-06-30' as the_stamp, date '2001-06-29' as last_complete_day, count(*) as n
    from log group by 1""",
)
def snapshot_stamp(spark, sf_dir):
    stamped = stamp_snapshot(sparse_log(spark, sf_dir), AS_OF)
    return row_counts(stamped, ["testType", "the_stamp", "last_complete_day"])


@register(
    "daily_rate_per_7",
    f"{WIDE} select date, n7_{HOME} / 7.0 as per_day from rolled",
    "per_day",
)
def daily_rate_per_7(spark, sf_dir):
    return daily_pair(spark, sf_dir).select("date", (F.col(f"n7_{HOME}") / 7.0).alias("per_day"))
