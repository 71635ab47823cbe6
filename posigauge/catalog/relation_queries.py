"""Joins, aggregates, windows, order and reshaping over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from posigauge.catalog.base import register
from posigauge.catalog.scalar_queries import AGED_SQL, ROUND_WEEK_SQL, WIDE
from posigauge.catalog.standin import (
    EVENTS_SQL,
    EVENTS_START,
    POPULATION,
    SPARSE_SQL,
    daily_pair,
    dense_log,
    event_log,
    log_sql,
    rolling_sql,
    sparse_log,
    table,
    wide_sql,
)
from posigauge.constants import HOME, LAB, WEEKDAYS
from posigauge.functions import rates
from posigauge.operators import (
    cleaning,
    counts,
    episodes,
    joins,
    ordering,
    pairs,
    people,
    reshape,
    rolling,
)
from posigauge.plans import panels
from posigauge.sources import dims



def n_rows():
    return F.count(F.lit(1)).alias("n")

LOG, LOG_REGION = f"with {log_sql()}", f"with {log_sql(region=True)}"


# --- joins -------------------------------------------------------------------
@register(
    "full_join_series",
    """
    with a as (select cast(o_orderdate as date) as date, count(*) as orders from orders group by 1),
    b as (select cast(l_shipdate as date) as date, count(*) as lines from lineitem group by 1)
    select date, orders, lines from a full join b using (date)
    """,
)
def full_join_series(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    b = counts.row_counts(dense_log(spark, sf_dir), ["date"], "lines")
    return joins.full_join_series(a, b)


_DIM = "dim(region, population) as (values ('AFRICA', 700000), ('AMERICA', 500000), ('ASIA', 400000), ('EUROPE', 450000), ('ATLANTIS', 100000))"


@register(
    "full_join_dim",
    f"""{LOG_REGION}, {_DIM}, c as (select region, count(*) as n from log where testType = '{LAB}' group by 1)
    select region, n, cast(population as bigint) as population, n * 1000.0 / population as rate from c full join dim using (region)""",
    "rate",
)
def full_join_dim(spark, sf_dir):
    log = dense_log(spark, sf_dir, region=True).where(F.col("testType") == LAB)
    return counts.rate_per_thousand(
        counts.row_counts(log, ["region"]), dims.region_population(spark, POPULATION)
    )


@register(
    "full_join_dim_channels",
    f"""{LOG_REGION}, {_DIM}, t as (select unnest(['{LAB}', '{HOME}']) as testType),
    d as (select * from dim cross join t), c as (select testType, region, count(*) as n from log group by 1, 2)
    select testType, region, n, cast(population as bigint) as population, n * 1000.0 / population as rate
    from c full join d using (testType, region)""",
    "rate",
)
def full_join_dim_channels(spark, sf_dir):
    """Each channel meets the whole population on its own."""
    log = dense_log(spark, sf_dir, region=True)
    return counts.rate_per_thousand(
        counts.row_counts(log, ["testType", "region"]),
        dims.region_population(spark, POPULATION),
        by={"testType": [LAB, HOME]},
    )


@register(
    "left_join_fill",
    f"""with {SPARSE_SQL}, base as (select distinct testType, date from log),
    c as (select testType, date, count(*) as cases from log where result = 'positive' group by 1, 2)
    select testType, date, coalesce(cases, 0) as cases from base left join c using (testType, date)""",
)
def left_join_fill(spark, sf_dir):
    log, keys = sparse_log(spark, sf_dir), ["testType", "date"]
    base = counts.row_counts(log, keys).drop("n")
    cases = counts.row_counts(log.where(rates.is_positive(F.col("result"))), keys, "cases")
    return joins.left_join_fill(base, cases, keys, ["cases"])


@register(
    "left_join_metrics",
    f"""with {SPARSE_SQL}, base as (select testType, date, count(*) as n from log group by 1, 2),
    p as (select testType, date, count(*) as positives from log where result = 'positive' group by 1, 2),
    q as (select testType, date, count(*) as negatives from log where result = 'negative' group by 1, 2)
    select * from base left join p using (testType, date) left join q using (testType, date)""",
)
def left_join_metrics(spark, sf_dir):
    """Every metric is an aggregate on the join's keys, so the chain of joins shuffles nothing again."""
    log, keys = sparse_log(spark, sf_dir), ["testType", "date"]
    metrics = [
        counts.row_counts(log.where(F.col("result") == r), keys, f"{r}s") for r in ("positive", "negative")
    ]
    return joins.left_join_all(counts.row_counts(log, keys), *metrics, on=keys)


@register(
    "full_join_coalesce",
    """
    with a as (select cast(o_orderdate as date) as date, nullif(count(*) % 5, 0) as beds, nullif(count(*) % 3, 0) as icu from orders group by 1),
    b as (select cast(l_shipdate as date) as date, count(*) as old_beds, nullif(count(*) % 4, 0) as old_icu from lineitem group by 1),
    d as (select cast(o_orderdate as date) as date, count(*) as deaths from orders group by 1)
    select date, coalesce(beds, old_beds) as beds, coalesce(icu, old_icu) as icu, coalesce(deaths, 0) as deaths
    from a full join b using (date) full join d using (date)
    """,
)
def full_join_coalesce(spark, sf_dir):
    zero = F.lit(0).cast("long")
    a = counts.row_counts(sparse_log(spark, sf_dir), ["date"]).select(
        "date", F.nullif(F.col("n") % 5, zero).alias("beds"), F.nullif(F.col("n") % 3, zero).alias("icu")
    )
    b = counts.row_counts(dense_log(spark, sf_dir), ["date"]).select(
        "date", F.col("n").alias("old_beds"), F.nullif(F.col("n") % 4, zero).alias("old_icu")
    )
    d = panels.deaths_daily(sparse_log(spark, sf_dir))
    joined = joins.coalesce_columns(
        joins.full_join_series(a, b, d), {"beds": ("beds", "old_beds"), "icu": ("icu", "old_icu")}
    )
    return cleaning.fill_zero(joined.drop("old_beds", "old_icu"), ["deaths"])


@register(
    "one_to_many_total",
    f"""with {SPARSE_SQL}, a as (select testType, date, count(*) as totalType from log group by 1, 2),
    b as (select date, count(*) as n from log group by 1) select * from a full join b using (date)""",
)
def one_to_many_total(spark, sf_dir):
    per_type = counts.row_counts(sparse_log(spark, sf_dir), ["testType", "date"], "totalType")
    return joins.add_group_total(per_type, ["date"], "totalType", "n")


@register(
    "interval_self_join_semi",
    f"""{LOG}, known as (select * from log where result <> 'other')
    select testType, patientId, date, result, count(*) as n from known a
    where exists (select 1 from known b where b.patientId = a.patientId and b.testType <> a.testType
      and b.date between a.date - 7 and a.date + 7)
    group by 1, 2, 3, 4""",
)
def interval_self_join_semi(spark, sf_dir):
    known = dense_log(spark, sf_dir).where(rates.is_known(F.col("result")))
    return counts.row_counts(pairs.interval_semi(known), ["testType", "patientId", "date", "result"])


@register(
    "interval_pairs",
    f"""{LOG}, known as (select * from log where result <> 'other')
    select a.patientId, a.testType as testType_a, a.date as date_a, b.testType as testType_b, b.date as date_b,
      date_diff('day', a.date, b.date) as gap_days, count(*) as pairs, count(*) filter (a.result = b.result) as agree
    from known a join known b on a.patientId = b.patientId and a.testType < b.testType
      and b.date between a.date - 7 and a.date + 7 group by 1, 2, 3, 4, 5, 6""",
)
def interval_pairs(spark, sf_dir):
    known = dense_log(spark, sf_dir).where(rates.is_known(F.col("result")))
    return pairs.interval_pairs(known).withColumn("gap_days", F.col("gap_days").cast("long"))


# --- aggregates ----------------------------------------------------------------
_KN = "count(*) filter (result = 'positive') as k, count(*) as n"


@register("totals_by_type", f"{LOG} select testType, {_KN} from log group by 1")
def totals_by_type(spark, sf_dir):
    return counts.positive_counts(dense_log(spark, sf_dir), ["testType"])


@register(
    "daily_counts",
    f"{LOG} select testType, date, {_KN} from log where date >= date '1996-01-01' group by 1, 2",
)
def daily_counts(spark, sf_dir):
    log = counts.select_tests(dense_log(spark, sf_dir), dt.date(1996, 1, 1))
    return counts.positive_counts(log, ["testType", "date"])


@register("daily_counts_region", f"{LOG_REGION} select testType, date, region, {_KN} from log group by 1, 2, 3")
def daily_counts_region(spark, sf_dir):
    return counts.positive_counts(dense_log(spark, sf_dir, region=True), ["testType", "date", "region"])


FIRST_SQL = """firsts as (select * from (select *, row_number() over (partition by testType, patientId
  order by date, result, ageRange) as rn from aged) where rn = 1)"""


@register(
    "daily_counts_age",
    f"with {AGED_SQL}, {FIRST_SQL} select testType, date, ageRange, {_KN} from firsts group by 1, 2, 3",
)
def daily_counts_age(spark, sf_dir):
    log = cleaning.add_age_bins(dense_log(spark, sf_dir, age=True)).drop("age_start", "age_end")
    first = ordering.first_per_group(log, ["testType", "patientId"], ["date"])
    return counts.positive_counts(first, ["testType", "date", "ageRange"])


@register(
    "cond_counts",
    f"""with {SPARSE_SQL} select date, count(*) filter (result = 'positive') as pos, count(*) filter (result = 'negative') as neg,
      count(*) filter (testType = '1-URGENT' and result = 'positive') as urgent_pos, count(*) as total from log group by 1""",
)
def cond_counts(spark, sf_dir):
    result = F.col("result")
    return counts.conditional_counts(
        sparse_log(spark, sf_dir),
        ["date"],
        {
            "pos": result == "positive",
            "neg": result == "negative",
            "urgent_pos": (F.col("testType") == "1-URGENT") & (result == "positive"),
        },
        total="total",
    )


@register(
    "region_counts",
    f"""{LOG_REGION}, {_DIM}, c as (select testType, region, {_KN} from log group by 1, 2)
    select testType, region, k, n, cast(population as bigint) as population, n * 1000.0 / population as rate
    from c full join (select * from (values ('{LAB}'), ('{HOME}')) t(testType), dim) using (testType, region)""",
    "rate",
)
def region_counts(spark, sf_dir):
    by_type = counts.positive_counts(dense_log(spark, sf_dir, region=True), ["testType", "region"])
    return counts.rate_per_thousand(by_type, dims.region_population(spark, POPULATION), by={"testType": [LAB, HOME]})


@register("age_counts", f"with {AGED_SQL} select ageRange, testType, {_KN} from aged group by 1, 2")
def age_counts(spark, sf_dir):
    log = cleaning.add_age_bins(dense_log(spark, sf_dir, age=True))
    return counts.positive_counts(log, ["ageRange", "testType"])


@register(
    "weekly_counts",
    f"{LOG} select testType, {ROUND_WEEK_SQL} as week, {_KN} from log group by 1, 2",
)
def weekly_counts(spark, sf_dir):
    return counts.weekly_counts(dense_log(spark, sf_dir))


@register(
    "daily_distinct_people",
    f"""with {EVENTS_SQL} select testType, date, count(distinct case when result = 'positive' then patientId end) as people_positives,
      count(distinct patientId) as people_total, count(*) filter (result = 'positive') as tests_positives, count(*) as tests_total,
      count(distinct case when result = 'positive' then patientId end) / nullif(cast(count(distinct patientId) as double), 0) as rate
    from log where result <> 'other' group by 1, 2""",
    "rate",
)
def daily_distinct_people(spark, sf_dir):
    return people.daily_people(counts.select_tests(event_log(spark, sf_dir), known_only=True))


_SUMS = ", ".join(
    f"cast(coalesce(sum({s}{w}_{t}), 0) as bigint) as {s}{w}_{t}" for t in (LAB, HOME) for s in "nk" for w in ("", "7")
)


@register(
    "sum_across_prefix",
    f"""{LOG_REGION}, {wide_sql('date, region')}, {rolling_sql('region')}
    select date, {_SUMS} from rolled where region <> 'EUROPE' group by 1""",
)
def sum_across_prefix(spark, sf_dir):
    wide = counts.channel_counts(dense_log(spark, sf_dir, region=True), ["date", "region"])
    strata = rolling.add_rolling_rates(wide, ["region"])
    return counts.sum_by_prefix(strata.where("region <> 'EUROPE'"), ["date"])


@register(
    "deaths_daily",
    f"with {SPARSE_SQL} select date, count(*) as deaths from log where date >= date '1996-01-01' group by 1",
)
def deaths_daily(spark, sf_dir):
    return panels.deaths_daily(sparse_log(spark, sf_dir), dt.date(1996, 1, 1))


# --- windows -------------------------------------------------------------------
@register(
    "rolling_sum_strict",
    f"{WIDE} select date, k7_{LAB}, n7_{LAB}, k7_{HOME}, n7_{HOME} from rolled",
)
def rolling_sum_strict(spark, sf_dir):
    return daily_pair(spark, sf_dir).select("date", *[f"{s}7_{t}" for t in (LAB, HOME) for s in "kn"])


_REGION_COLUMNS = ", ".join(["date", "region", *(f"{s}7_{t}" for t in (LAB, HOME) for s in "kn")])


@register(
    "rolling_sum_region",
    f"""{LOG_REGION}, {wide_sql('date, region')}, {rolling_sql('region')},
    {rolling_sql('', 'date, region').replace('summed', 'summed2').replace('rolled', 'rolled2')}
    select 'own' as form, {_REGION_COLUMNS} from rolled union all select 'across', {_REGION_COLUMNS} from rolled2""",
)
def rolling_sum_region(spark, sf_dir):
    wide = counts.channel_counts(dense_log(spark, sf_dir, region=True), ["date", "region"])
    columns = _REGION_COLUMNS.split(", ")
    own = rolling.add_rolling_rates(wide, ["region"]).select(F.lit("own").alias("form"), *columns)
    across = rolling.add_rolling_rates(wide, (), order=("date", "region"))
    return own.unionByName(across.select(F.lit("across").alias("form"), *columns))


_DAILY_SPARSE = f"with {SPARSE_SQL}, d as (select testType, date, count(*) as n, count(*) filter (result = 'positive') as k from log group by 1, 2)"
_W7 = "(partition by testType order by date rows between 6 preceding and current row)"


@register(
    "ma7_sum7",
    f"""{_DAILY_SPARSE} select testType, date, case when count(n) over w = 7 then avg(n) over w end as moving_avg,
      cast(case when count(n) over w = 7 then sum(n) over w end as bigint) as moving_sum from d window w as {_W7}""",
    "moving_avg",
)
def ma7_sum7(spark, sf_dir):
    daily = counts.row_counts(sparse_log(spark, sf_dir), ["testType", "date"])
    w = rolling.series(["testType"])
    return daily.select(
        "testType",
        "date",
        rolling.rolling_mean(F.col("n"), w).alias("moving_avg"),
        rolling.rolling_sum(F.col("n"), w).alias("moving_sum"),
    )


@register(
    "ma7",
    f"""{_DAILY_SPARSE} select testType, date, case when count(k) over w = 7 then avg(k) over w end as moving_avg
    from d window w as {_W7}""",
    "moving_avg",
)
def ma7(spark, sf_dir):
    daily = counts.positive_counts(sparse_log(spark, sf_dir), ["testType", "date"])
    return rolling.ma7(daily, "k", ["testType"])


@register(
    "sum7",
    f"""{_DAILY_SPARSE} select testType, date, cast(case when count(k) over w = 7 then sum(k) over w end as bigint) as moving_sum
    from d window w as {_W7}""",
)
def sum7(spark, sf_dir):
    daily = counts.positive_counts(sparse_log(spark, sf_dir), ["testType", "date"])
    return rolling.sum7(daily, "k", ["testType"])


@register(
    "rolling_mean_fill0",
    f"""{_DAILY_SPARSE} select testType, date, case when count(*) over w < 7 then 0 else avg(cast(k as double) / n) over w end as seven_day_avg
    from d window w as {_W7}""",
    "seven_day_avg",
)
def rolling_mean_fill0(spark, sf_dir):
    daily = counts.positive_counts(sparse_log(spark, sf_dir), ["testType", "date"])
    rate = rates.ratio(F.col("k"), F.col("n"))
    mean = rolling.rolling_mean_fill0(rate, rolling.series(["testType"]))
    return daily.select("testType", "date", mean.alias("seven_day_avg"))


@register(
    "centered_ma",
    f"""{_DAILY_SPARSE} select testType, date, case when count(n) over w = 7 then avg(n) over w end as centered
    from d window w as (partition by testType order by date rows between 3 preceding and 3 following)""",
    "centered",
)
def centered_ma(spark, sf_dir):
    daily = counts.row_counts(sparse_log(spark, sf_dir), ["testType", "date"])
    mean = rolling.centered_mean(F.col("n"), rolling.series(["testType"]))
    return daily.select("testType", "date", mean.alias("centered"))


@register(
    "ma_nonnull_rows",
    f"""{_DAILY_SPARSE}, x as (select testType, date, nullif(n % 5, 0) as beds from d),
    y as (select testType, date, case when count(*) over w = 7 then avg(beds) over w end as m from x where beds is not null window w as {_W7})
    select testType, date, beds, m as beds_week_avg from x left join y using (testType, date)""",
    "beds_week_avg",
)
def ma_nonnull_rows(spark, sf_dir):
    daily = counts.row_counts(sparse_log(spark, sf_dir), ["testType", "date"])
    beds = daily.select("testType", "date", F.nullif(F.col("n") % 5, F.lit(0).cast("long")).alias("beds"))
    return rolling.mean_of_present(beds, "beds", "beds_week_avg", ["testType"])


@register(
    "cumulative_count",
    f"""{LOG}, d as (select date, count(*) as n from log where testType <> '{LAB}' group by 1)
    select date, cast(sum(n) over (order by date) as bigint) as n from d""",
)
def cumulative_count(spark, sf_dir):
    daily = counts.row_counts(dense_log(spark, sf_dir).where(F.col("testType") != LAB), ["date"])
    return daily.withColumn("n", rolling.cumulative(F.col("n"), rolling.series()))


_GAPS = f"""{LOG}, pos as (select * from log where result = 'positive'),
  g as (select *, coalesce(date_diff('day', lag(date) over w, date), 0) as gap, count(*) over (partition by testType, patientId) as total
    from pos window w as (partition by testType, patientId order by date))"""


@register(
    "episode_ids",
    f"""{_GAPS} select testType, patientId, date, concat(patientId, '-', gap // 90) as newId, count(*) as rows, total as n
    from g group by 1, 2, 3, 4, 6""",
)
def episode_ids(spark, sf_dir):
    return episodes.episode_ids(dense_log(spark, sf_dir).where("result = 'positive'"))


@register(
    "window_counts",
    f"""{LOG}, known as (select * from log where result <> 'other'),
    c as (select *, count(*) over (partition by testType, date) as n,
      count(*) filter (result = 'positive') over (partition by testType, date) as k from known)
    select testType, date, result, k, n, count(*) as rows, cast(sum(patientId) as bigint) as ids from c group by 1, 2, 3, 4, 5""",
)
def window_counts(spark, sf_dir):
    known = dense_log(spark, sf_dir).where(rates.is_known(F.col("result")))
    return (
        pairs.attach_group_counts(known)
        .groupBy("testType", "date", "result", "k", "n")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("patientId").alias("ids"))
    )


@register(
    "keep_multi_type",
    f"""with {SPARSE_SQL} select patientId, count(*) as n, min(date) as first from log
    where patientId in (select patientId from log group by 1 having count(distinct testType) > 1) group by 1""",
)
def keep_multi_type(spark, sf_dir):
    kept = pairs.keep_multi_type(sparse_log(spark, sf_dir))
    return kept.groupBy("patientId").agg(n_rows(), F.min("date").alias("first"))


@register(
    "forward_max_fill",
    f"""{_DAILY_SPARSE}, x as (select testType, date, nullif(n * (n % 3), 0) as people from d)
    select testType, date, coalesce(people, max(people) over (partition by testType order by date
      rows between unbounded preceding and 1 preceding)) as people from x""",
)
def forward_max_fill(spark, sf_dir):
    daily = counts.row_counts(sparse_log(spark, sf_dir), ["testType", "date"])
    people_ = F.nullif(F.col("n") * (F.col("n") % 3), F.lit(0).cast("long"))
    gaps = daily.select("testType", "date", people_.alias("people"))
    return gaps.withColumn("people", rolling.forward_max(F.col("people"), rolling.series(["testType"])))


_WEEK = f"""with {EVENTS_SQL}, known as (select * from log where result <> 'other'),
  spine as (select testType, cast(unnest(generate_series(date '2024-01-08', max(date), interval 1 day)) as date) as day
    from known group by testType),
  week as (select s.testType, s.day as date,
    count(distinct case when result = 'positive' then patientId end) as people_positives_week,
    count(distinct patientId) as people_total_week,
    count(distinct case when result = 'positive' and entry_date <= day then patientId end) as obs_people_positives_week,
    count(distinct case when entry_date <= day then patientId end) as obs_people_total_week
  from spine s left join known k on k.testType = s.testType and k.date > s.day - 7 and k.date <= s.day group by 1, 2),
  fitted as (select *, cast(people_positives_week as double) / nullif(people_total_week, 0) as fit,
    cast(obs_people_positives_week as double) / nullif(obs_people_total_week, 0) as obs_fit from week)"""


@register(
    "trailing_week_distinct",
    f"{_WEEK} select testType, date, people_positives_week, people_total_week, fit from fitted",
    "fit",
)
def trailing_week_distinct(spark, sf_dir):
    known = counts.select_tests(event_log(spark, sf_dir), known_only=True)
    return people.trailing_week_people(known, EVENTS_START, entry=None, bounds=False)


@register(
    "trailing_week_as_known",
    f"{_WEEK} select testType, date, obs_people_positives_week, obs_people_total_week, obs_fit from fitted",
    "obs_fit",
)
def trailing_week_as_known(spark, sf_dir):
    known = counts.select_tests(event_log(spark, sf_dir), known_only=True)
    week = people.trailing_week_people(known, EVENTS_START, bounds=False)
    return week.select("testType", "date", *people.AS_KNOWN, "obs_fit")


@register(
    "row_index",
    f"""{LOG} select row_number() over (order by date, patientId, testType, result) as index, date, patientId, testType, result from log""",
)
def row_index(spark, sf_dir):
    return ordering.row_index(dense_log(spark, sf_dir), ["date", "patientId", "testType", "result"])


@register(
    "patient_index",
    f"with {SPARSE_SQL} select distinct patientId, dense_rank() over (order by patientId) as patientIndex from log",
)
def patient_index(spark, sf_dir):
    return ordering.dense_index(sparse_log(spark, sf_dir), "patientId", "patientIndex")


# --- order ---------------------------------------------------------------------
@register(
    "sort_multi",
    f"with {SPARSE_SQL} select * from log order by date, testType, patientId, result",
)
def sort_multi(spark, sf_dir):
    return cleaning.sort_log(sparse_log(spark, sf_dir), "date", "testType", "patientId", "result")


@register(
    "first_n_entities",
    f"""{LOG} select testType, patientId, date, result, count(*) as n from log where date >= date '1996-01-01'
    and patientId in (select distinct patientId from log order by 1 limit 50) group by 1, 2, 3, 4""",
)
def first_n_entities(spark, sf_dir):
    kept = ordering.keep_first_entities(dense_log(spark, sf_dir), "patientId")
    kept = kept.where(F.col("date") >= F.lit(dt.date(1996, 1, 1)))
    return counts.row_counts(kept, ["testType", "patientId", "date", "result"])


@register(
    "first_per_group",
    f"""{LOG} select testType, patientId, date, result from (select *, row_number() over (partition by testType, patientId
      order by date, result) as rn from log) where rn = 1""",
)
def first_per_group(spark, sf_dir):
    return ordering.first_per_group(dense_log(spark, sf_dir), ["testType", "patientId"], ["date"])


@register(
    "first_per_episode",
    f"{_GAPS} select testType, patientId, gap // 90 as episode, min(date) as date from g group by 1, 2, 3",
)
def first_per_episode(spark, sf_dir):
    return episodes.first_per_episode(dense_log(spark, sf_dir).where("result = 'positive'"))


@register(
    "first_negative",
    f"{LOG} select testType, patientId, min(date) as date from log where result = 'negative' group by 1, 2",
)
def first_negative(spark, sf_dir):
    return episodes.first_day_per_person(dense_log(spark, sf_dir).where("result = 'negative'"))


# --- sets and shape --------------------------------------------------------------
@register(
    "union_by_name",
    """
    with u as (select event_type as testType, cast(ts as date) as date, user_id as patientId from events
      union all select o_orderpriority, cast(o_orderdate as date), null from orders)
    select testType, date, count(patientId) as with_id, count(*) as n from u group by 1, 2
    """,
)
def union_by_name(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("testType"), F.col("ts").cast("date").alias("date"), F.col("user_id").alias("patientId")
    )
    both = cleaning.union_by_name(events, sparse_log(spark, sf_dir).select("date", "testType"))
    return both.groupBy("testType", "date").agg(F.count("patientId").alias("with_id"), n_rows())


@register(
    "union_strict",
    f"""with {SPARSE_SQL}, {log_sql().replace('log as', 'dense as')}, u as (select * from log union all select * from dense)
    select testType, result, count(*) as n, min(date) as first from u group by 1, 2""",
)
def union_strict(spark, sf_dir):
    both = cleaning.union_by_name(sparse_log(spark, sf_dir), dense_log(spark, sf_dir), strict=True)
    return both.groupBy("testType", "result").agg(n_rows(), F.min("date").alias("first"))


@register("distinct_rows", f"{LOG} select distinct * from log")
def distinct_rows(spark, sf_dir):
    return cleaning.distinct_rows(dense_log(spark, sf_dir))


@register("distinct_rows_fingerprint", f"{LOG} select distinct * from log")
def distinct_rows_fingerprint(spark, sf_dir):
    return cleaning.distinct_by_fingerprint(dense_log(spark, sf_dir))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PIVOT = ", ".join(
    f"max({v}) filter (testType = '{c}') as \"{v}_{c}\"" for c in PRIORITIES for v in "nk"
)


@register("pivot_wide", f"{_DAILY_SPARSE} select date, {_PIVOT} from d group by 1")
def pivot_wide(spark, sf_dir):
    daily = counts.positive_counts(sparse_log(spark, sf_dir), ["testType", "date"])
    return reshape.pivot_channels(daily, ["date"], channels=PRIORITIES)


_DAYS = ", ".join(f"case when dayname(date) = '{d}' then 1 else 0 end as {d}" for d in WEEKDAYS)


@register("weekday_one_hot", f"{WIDE} select date, n_{LAB}, {_DAYS} from rolled")
def weekday_one_hot(spark, sf_dir):
    return reshape.weekday_one_hot(daily_pair(spark, sf_dir)).select("date", f"n_{LAB}", *WEEKDAYS)


@register(
    "unpivot_long",
    f"""{WIDE} select date, 'n_{LAB}' as predictors, cast(n_{LAB} as double) as predictor_value from rolled
    union all select date, 'p_{LAB}', p_{LAB} from rolled union all select date, 'p7_{HOME}', p7_{HOME} from rolled""",
    "predictor_value",
)
def unpivot_long(spark, sf_dir):
    return reshape.unpivot_long(daily_pair(spark, sf_dir), ["date"], [f"n_{LAB}", f"p_{LAB}", f"p7_{HOME}"])


@register(
    "split_by_key",
    f"{LOG} select patientId, count(*) as n, min(date) as first, max(date) as last from log group by 1",
)
def split_by_key(spark, sf_dir):
    return pairs.split_summary(dense_log(spark, sf_dir), "patientId")
