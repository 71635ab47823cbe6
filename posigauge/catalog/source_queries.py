"""Readers and writers: each query lands data derived from the tables first."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posigauge import schemas
from posigauge.catalog.base import register
from posigauge.catalog.standin import POPULATION, event_log, sparse_log, table
from posigauge.operators.joins import coalesce_columns, full_join_series
from posigauge.session import scratch_path
from posigauge.sources import dims, files
from posigauge.functions.times import local_date, parse_mdy
from posigauge.plans import panels


@register(
    "scan_json_log",
    """
    select event_type as testType, case when value >= 50 then 'Positive' else 'Negative' end as result,
      cast(ts as date) as date, count(*) as n, count(distinct user_id) as people
    from events group by 1, 2, 3
    """,
)
def scan_json_log(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    landed = events.select(
        "event_id",
        F.col("event_type").alias("testType"),
        F.col("user_id").cast("string").alias("patientId"),
        F.when(F.col("value") >= 50, "Positive").otherwise("Negative").alias("result"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("collectedDate"),
    )
    path = scratch_path(spark, "json-log")
    files.write_json_slices(landed, path, "event_id")
    log = files.read_json_log(spark, path, schemas.TESTS)
    return log.groupBy("testType", "result", local_date(F.col("collectedDate")).alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("patientId").alias("people")
    )


@register(
    "scan_slice_pushdown",
    """
    select cast(ts as date) as date, count(*) as n from events
    where event_type = 'click' and ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'
    group by 1
    """,
)
def scan_slice_pushdown(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("created", F.col("date"))
    path = scratch_path(spark, "log")
    files.write_snapshot(log, path, ["testType"])
    kept = files.read_slice(
        files.read_snapshot(spark, path), "click", "created", dt.date(2024, 1, 10), dt.date(2024, 1, 20)
    )
    return kept.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@register(
    "scan_month_slice",
    """
    select cast(ts as date) as date, count(*) as n from events
    where event_type = 'click' and ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'
    group by 1
    """,
)
def scan_month_slice(spark, sf_dir):
    """The log by type and month with ordered files; the slice reaches directories and row groups."""
    path = scratch_path(spark, "log-months")
    files.write_log(event_log(spark, sf_dir).withColumn("created", F.col("date")), path, "created")
    kept = files.read_log_slice(spark, path, "click", "created", dt.date(2024, 1, 10), dt.date(2024, 1, 20))
    return kept.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@register(
    "scan_json_records",
    """
    with d as (select distinct event_type, user_id, value >= 50 as hit, cast(ts as date) as date,
      event_id % 7 as lot, case when event_id % 2 = 0 then event_id % 3 end as site from events)
    select event_type as testType, date, count(*) as rows, count(distinct user_id) as people from d group by 1, 2
    """,
)
def scan_json_records(spark, sf_dir):
    """Undeclared fields of a record (a number, an object that half of them have) take part in distinct."""
    site = F.when(F.col("event_id") % 2 == 0, F.struct((F.col("event_id") % 3).alias("id"), F.lit("x").alias("name")))
    landed = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("testType"),
        F.col("user_id").cast("string").alias("patientId"),
        F.when(F.col("value") >= 50, "Positive").otherwise("Negative").alias("result"),
        F.date_format("ts", "yyyy-MM-dd").alias("collectedDate"),
        (F.col("event_id") % 7).alias("lot"),
        site.alias("site"),
    )
    path = scratch_path(spark, "json-records")
    landed.drop("event_id").write.json(path)
    log = files.read_json_records(spark, path, schemas.TESTS, lines=True)
    day = F.to_date("collectedDate").alias("date")
    return log.distinct().groupBy("testType", day).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("patientId").alias("people")
    )


_BEDS = "select cast(o_orderdate as date) as date, count(*) as n from orders group by 1"


@register(
    "scan_legacy_beds",
    f"select date, n as HospitCOV19, nullif(n % 3, 0) as CamasICU_disp, nullif(n % 5, 0) as CamasICU from ({_BEDS})",
)
def scan_legacy_beds(spark, sf_dir):
    """Old bed counts from CSV with dates as month/day/year and empty cells."""
    zero, n = F.lit(0).cast("long"), F.col("n")
    daily = sparse_log(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "beds-csv")
    files.write_csv(
        daily.select(
            F.nullif(n % 5, zero).alias("CamasICU"),
            F.date_format("date", "M/d/yyyy").alias("Fecha"),
            n.alias("HospitCOV19"),
            F.nullif(n % 3, zero).alias("CamasICU_disp"),
        ),
        path,
    )
    beds = files.read_csv(spark, path, schemas.LEGACY_HOSPITAL)
    counters = ["HospitCOV19", "CamasICU_disp", "CamasICU"]
    return beds.select(parse_mdy(F.col("Fecha")).alias("date"), *[F.col(c).try_cast("long").alias(c) for c in counters])


@register(
    "scan_vaccines",
    f"""
    with c as (select date, n, sum(n) over (order by date) as total from ({_BEDS})),
    g as (select date, cast(case when n % 4 > 0 then total end as double) as total_distributed,
      cast(case when n % 3 > 0 then total - 1 end as double) as total_vaccinations,
      cast(case when n % 5 > 0 then total // 2 end as double) as people_vaccinated, cast(total // 3 as double) as people_fully_vaccinated from c)
    select date, max(total_distributed) over w as total_distributed, max(total_vaccinations) over w as total_vaccinations,
      max(people_vaccinated) over w as people_vaccinated, max(people_fully_vaccinated) over w as people_fully_vaccinated
    from g window w as (order by date rows unbounded preceding)
    """,
    "total_distributed total_vaccinations people_vaccinated people_fully_vaccinated",
)
def scan_vaccines(spark, sf_dir):
    """One location of a CSV of cumulative vaccinations, its gaps filled."""
    daily = sparse_log(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    total, n = F.sum("n").over(Window.orderBy("date")), F.col("n")
    cumulative = daily.withColumn("total", total)
    t = F.col("total")
    values = {
        "total_distributed": F.when(n % 4 > 0, t),
        "total_vaccinations": F.when(n % 3 > 0, t - 1),
        "people_vaccinated": F.when(n % 5 > 0, F.floor(t / 2)),
        "people_fully_vaccinated": F.floor(t / 3),
    }
    here = cumulative.select(F.lit("here").alias("location"), "date", *[v.alias(c) for c, v in values.items()])
    there = here.withColumn("location", F.lit("there")).withColumn("total_distributed", F.lit(10**9))
    path = scratch_path(spark, "vaccines-csv")
    files.write_csv(here.unionByName(there), path)
    landed = files.read_csv(spark, path, schemas.VACCINES)
    typed = landed.select(
        "location", F.to_date("date").alias("date"), *[F.col(c).try_cast("double").alias(c) for c in values]
    )
    return panels.fill_vaccines(typed, "here")


@register(
    "scan_death_summary",
    """
    select cast(o_orderdate as date) as date, o_orderpriority as ageRange, count(*) as n,
      sum(o_orderkey % 9) as lag_days from orders group by 1, 2
    """,
)
def scan_death_summary(spark, sf_dir):
    """Deaths of a JSON bulletin by day and age, with the days until they were reported."""
    stamp = lambda day: F.date_format(day, "yyyy-MM-dd'T'12:00:00")
    orders = table(spark, sf_dir, "orders").select(
        stamp("o_orderdate").alias("deathDate"),
        stamp(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 9).cast("int"))).alias("reportDate"),
        F.col("o_orderpriority").alias("ageRange"),
        F.lit("x").alias("sex"),
    )
    path = scratch_path(spark, "deaths-json")
    orders.write.json(path)
    deaths = files.read_json_log(spark, path, schemas.DEATHS_SUMMARY, lines=True)
    date, reported = local_date(F.col("deathDate")), local_date(F.col("reportDate"))
    return deaths.groupBy(date.alias("date"), "ageRange").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.date_diff(reported, date)).alias("lag_days")
    )


@register(
    "scan_csv",
    """
    select cast(o_orderdate as date) as date, o_orderstatus as CO_SEXO, count(*) as n
    from orders group by 1, 2
    """,
)
def scan_csv(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("TX_GRUPO_EDAD"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("FE_MUERTE"),
        F.lit("CONFIRMADO").alias("CO_CLASIFICACION"),
        F.col("o_orderstatus").alias("CO_SEXO"),
    )
    path = scratch_path(spark, "deaths-csv")
    files.write_csv(orders, path)
    deaths = files.read_csv(spark, path, schemas.DEATHS)
    return deaths.groupBy(local_date(F.col("FE_MUERTE")).alias("date"), "CO_SEXO").agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "snapshot_roundtrip",
    """
    select o_orderpriority as testType, count(*) as rows_parquet, count(*) as rows_csv,
      min(cast(o_orderdate as date)) as first, max(cast(o_orderdate as date)) as last
    from orders group by 1
    """,
)
def snapshot_roundtrip(spark, sf_dir):
    log = sparse_log(spark, sf_dir)
    parquet, csv = scratch_path(spark, "snapshot"), scratch_path(spark, "snapshot-csv")
    files.write_snapshot(log, parquet, ["testType"])
    files.write_csv(log, csv)
    back = files.read_snapshot(spark, parquet).groupBy("testType").agg(
        F.count(F.lit(1)).alias("rows_parquet"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    text = files.read_csv(spark, csv, log.schema).groupBy("testType").agg(
        F.count(F.lit(1)).alias("rows_csv")
    )
    return back.join(text, "testType")


@register(
    "read_with_fallback",
    """
    with new as (select cast(o_orderdate as date) as date, nullif(count(*) % 5, 0) as beds from orders group by 1),
    old as (select cast(l_shipdate as date) as date, count(*) as old_beds from lineitem group by 1)
    select date, coalesce(beds, old_beds) as beds from new full join old using (date)
    """,
)
def read_with_fallback(spark, sf_dir):
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"))
    new = new.agg(F.count(F.lit(1)).alias("n")).select(
        "date", F.nullif(F.col("n") % 5, F.lit(0).cast("long")).alias("beds"), F.lit(1).alias("unused")
    )
    backup = scratch_path(spark, "backup")
    files.write_snapshot(new, backup)
    missing = scratch_path(spark, "never-written")
    current = files.read_first_available(
        [lambda: files.read_snapshot(spark, missing), lambda: files.read_snapshot(spark, backup)],
        ["date", "beds"],
    )
    old = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
    joined = full_join_series(current, old.agg(F.count(F.lit(1)).alias("old_beds")))
    return coalesce_columns(joined, {"beds": ("beds", "old_beds")}).drop("old_beds")


@register(
    "dim_literal",
    """
    with dim(region, population) as (values ('AFRICA', 700000), ('AMERICA', 500000), ('ASIA', 400000),
      ('EUROPE', 450000), ('ATLANTIS', 100000))
    select r_name as region, cast(population as bigint) as population, count(*) as suppliers
    from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
      left join dim on r_name = dim.region
    group by 1, 2
    """,
)
def dim_literal(spark, sf_dir):
    places = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("region"))
        .agg(F.count(F.lit(1)).alias("suppliers"))
    )
    return places.join(dims.region_population(spark, POPULATION), "region", "left")


@register(
    "date_spine",
    """
    with b as (select o_orderpriority as testType, min(cast(o_orderdate as date)) + 7 as lo,
      max(cast(o_orderdate as date)) as hi from orders group by 1)
    select testType, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from b
    """,
)
def date_spine(spark, sf_dir):
    return dims.date_spine(sparse_log(spark, sf_dir), ["testType"], F.date_add(F.min("date"), 7))
