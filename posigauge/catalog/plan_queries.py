"""The pipelines over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from posigauge.catalog import sqlparts as sp
from posigauge.catalog.base import SQL, register
from posigauge.catalog.relation_queries import FIRST_SQL
from posigauge.catalog.scalar_queries import AGE_BIN_SQL, AGED_SQL, ROUND_WEEK_SQL
from posigauge.catalog.standin import (
    AS_OF,
    EVENTS_SQL,
    EVENTS_START,
    FIRST_YEAR,
    MEMBERS,
    PERIODS,
    RATE_COLUMNS,
    RAW_SQL,
    SPARSE_SQL,
    START,
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
from posigauge.catalog.stats_queries import (
    FIT_NAMES,
    FIT_SQL,
    HALF_SQL,
    LINE_COLUMNS,
    LINE_SQL,
    PERIOD_SQL,
    WEEK_ROWS,
    X,
    Y,
    fitted_forms,
    model_rows_sql,
)
from posigauge.constants import HOME, LAB, WEEKDAYS
from posigauge.operators import cleaning, glm
from posigauge.operators.counts import row_counts
from posigauge.plans import agreement as agreement_plan
from posigauge.plans import cleaning as clean
from posigauge.plans import dashboard, modelling, panels, positivity
from posigauge.session import materialize

SINCE = f"date >= date '{START}'"
COUNTS = [f"{s}{w}_{t}" for t in (LAB, HOME) for s in "nk" for w in ("", "7")]
BOUNDS = "lower upper lower7 upper7"


# --- cleaning --------------------------------------------------------------------
@register(
    "clean_tests",
    f"""with {RAW_SQL}, u as (select distinct testType, patientId, result, region, ageRange, collected,
      case when collected is not null then l_linenumber % 3 end as form, reported from raw),
    d as (select *, cast(nullif(regexp_extract(ageRange, '^([0-9]+)', 1), '') as integer) as a,
      case when extract(year from collected) between {FIRST_YEAR} and {AS_OF.year} then collected else reported - 2 end as date from u)
    select testType, date, result, region, {AGE_BIN_SQL} as ageRange, count(*) as n
    from d where date between date '{FIRST_YEAR}-01-01' and date '{AS_OF}' group by 1, 2, 3, 4, 5""",
)
def clean_tests(spark, sf_dir):
    log = clean.clean_tests(
        raw_tests(spark, sf_dir), as_of=AS_OF, first_year=FIRST_YEAR, bin_ages=True
    )
    return row_counts(log, ["testType", "date", "result", "region", "ageRange"])


# --- positivity --------------------------------------------------------------------
def _bounded(stratum: str = "") -> str:
    """Select over ``rolled`` with the binomial bounds of the home channel."""
    columns = ", ".join([*([stratum] if stratum else []), "date", *COUNTS, *RATE_COLUMNS.split()])
    return f"""{sp.binomial_ctes('rolled', f'n_{HOME}', f'k_{HOME}', '1')}, {sp.binomial_ctes('rolled', f'n7_{HOME}', f'k7_{HOME}', '7')}
    select {columns}, q1.lower, q1.upper, q7.lower as lower7, q7.upper as upper7 from rolled
      left join q1 on q1.n = n_{HOME} and q1.k = k_{HOME} left join q7 on q7.n = n7_{HOME} and q7.k = k7_{HOME}"""


@register(
    "positivity_overall",
    f"with {log_sql()}, {wide_sql('date', SINCE)}, {rolling_sql()}, {_bounded()}",
    f"{RATE_COLUMNS} {BOUNDS}",
)
def positivity_overall(spark, sf_dir):
    return positivity.positivity_overall(dense_log(spark, sf_dir), start=START)


@register(
    "positivity_by_age",
    f"with {AGED_SQL}, {FIRST_SQL}, {wide_sql('date, ageRange', SINCE).replace('from log', 'from firsts')}, {rolling_sql('ageRange')}, {_bounded('ageRange')}",
    f"{RATE_COLUMNS} {BOUNDS}",
)
def positivity_by_age(spark, sf_dir):
    log = dense_log(spark, sf_dir, age=True)
    return positivity.positivity_by_age(log, order=["date"], bin_ages=True, start=START)


@register(
    "positivity_by_region",
    f"with {log_sql(region=True)}, {wide_sql('date, region', SINCE)}, {rolling_sql('region')}, {_bounded('region')}",
    f"{RATE_COLUMNS} {BOUNDS}",
)
def positivity_by_region(spark, sf_dir):
    return positivity.positivity_by_region(dense_log(spark, sf_dir, region=True), start=START)


_SUMMED = ", ".join(f"cast(coalesce(sum({c}), 0) as bigint) as {c}" for c in COUNTS)
_RATED = ", ".join(
    f"cast(k{s}_{t} as double) / nullif(n{s}_{t}, 0) as p{s}_{t}" for t in (LAB, HOME) for s in ("", "7")
)


@register(
    "positivity_excluding_unreported",
    f"""with {log_sql(region=True)}, {wide_sql('date, region', SINCE)}, {rolling_sql('region').replace('rolled', 'strata')},
    total as (select date, {_SUMMED} from strata where region not in ('EUROPE') group by 1), rolled as (select *, {_RATED} from total), {_bounded()}""",
    f"{RATE_COLUMNS} {BOUNDS}",
)
def positivity_excluding_unreported(spark, sf_dir):
    strata = positivity.positivity(dense_log(spark, sf_dir, region=True), ["region"], start=START)
    return positivity.positivity_excluding(strata, "region", ["EUROPE"])


@register(
    "period_correlation",
    f"""with {log_sql()}, {wide_sql('date', SINCE)}, {rolling_sql()},
    pairs as (select {PERIOD_SQL} as period, {X} as x, {Y} as y from rolled where {X} is not null and {Y} is not null),
    {LINE_SQL}, c as (select period, count(*) as pairs, case when count(*) >= 3 then corr(y, x) end as r from pairs where period is not null group by 1),
    t as (select *, r * sqrt(greatest(pairs - 2, 0)) / nullif(sqrt(1 - r * r), 0) as t, pairs - 2 as dof from c),
    {sp.t_tail_ctes('t', 'period', 't', 'dof', 'a')}
    select period, t.pairs, r, t, p as p_value, tanh(atanh(r) - {sp.Z} / sqrt(nullif(greatest(t.pairs - 3, 0), 0))) as lower,
      tanh(atanh(r) + {sp.Z} / sqrt(nullif(greatest(t.pairs - 3, 0), 0))) as upper, {LINE_COLUMNS.replace(' ', ', ')}
    from t left join taila using (period) join lines using (period) left join critl using (period)""",
    f"r t p_value lower upper {LINE_COLUMNS}",
)
def period_correlation(spark, sf_dir):
    daily = positivity.positivity(dense_log(spark, sf_dir), start=START)
    return positivity.period_correlation(daily, PERIODS)


# --- agreement -----------------------------------------------------------------------
@register(
    "agreement",
    f"""with {log_sql()}, known as (select * from log where result <> 'other'),
    c as (select testType, date, count(*) filter (result = 'positive') as k, count(*) as n from known group by 1, 2),
    hits as (select * from known a where exists (select 1 from known b where b.patientId = a.patientId and b.testType <> a.testType
      and b.date between a.date - 7 and a.date + 7)),
    ids as (select patientId, dense_rank() over (order by patientId) as patientIndex from (select distinct patientId from hits)),
    y as (select testType, date, k, n, patientId, result, patientIndex, case testType when '{LAB}' then 1.0 else 1.25 end as y
      from hits join ids using (patientId) join c using (testType, date) where patientIndex <= 50 and {SINCE})
    select testType, date, k, n, patientId, result, patientIndex, left(testType, 1) as label, cast(y as double) as y,
      cast(y + patientIndex as double) as y_val, cast(y + patientIndex - 1 as double) as bottom, cast(y + patientIndex + 1 as double) as top
    from y""",
    "y y_val bottom top",
)
def agreement(spark, sf_dir):
    return agreement_plan.agreement(dense_log(spark, sf_dir), start=START)


@register(
    "agreement_all", SQL["agreement"].replace("patientIndex <= 50 and ", ""), digits=6
)
def agreement_all(spark, sf_dir):
    """The whole result, without the sample of ids."""
    return agreement_plan.agreement(dense_log(spark, sf_dir), start=START, sample_n=None)


# --- dashboard -------------------------------------------------------------------------
_WEEK_COLUMNS = "people_positives_week people_total_week obs_people_positives_week obs_people_total_week"
_DASH = f"""with {EVENTS_SQL}, dash as (select * from log where result <> 'other'
    union all select 'Molecular+Antigens', patientId, result, date, entry_date from log
      where result <> 'other' and testType in ('click', 'purchase')),
  daily as (select testType, date, count(distinct case when result = 'positive' then patientId end) as people_positives,
    count(distinct patientId) as people_total, count(*) filter (result = 'positive') as tests_positives, count(*) as tests_total
    from dash group by 1, 2),
  spine as (select testType, cast(unnest(generate_series(date '2024-01-08', max(date), interval 1 day)) as date) as day from dash group by 1),
  week as (select s.testType, s.day as date, count(distinct case when result = 'positive' then patientId end) as people_positives_week,
    count(distinct patientId) as people_total_week,
    count(distinct case when result = 'positive' and entry_date <= day then patientId end) as obs_people_positives_week,
    count(distinct case when entry_date <= day then patientId end) as obs_people_total_week
    from spine s left join dash k on k.testType = s.testType and k.date > s.day - 7 and k.date <= s.day group by 1, 2),
  tests as (select d.*, {', '.join('week.' + c for c in _WEEK_COLUMNS.split())},
    cast(case when count(*) over w = 7 then sum(tests_positives) over w end as bigint) as tests_positives_week,
    cast(case when count(*) over w = 7 then sum(tests_total) over w end as bigint) as tests_total_week
    from daily d left join week using (testType, date)
    window w as (partition by d.testType order by d.date rows between 6 preceding and current row))"""


@register(
    "dashboard_tests",
    f"""{_DASH}, {sp.binomial_ctes('tests', 'people_total_week', 'people_positives_week', 'a')},
    {sp.binomial_ctes('tests', 'obs_people_total_week', 'obs_people_positives_week', 'b')}
    select tests.*, cast(people_positives as double) / nullif(people_total, 0) as rate,
      cast(people_positives_week as double) / nullif(people_total_week, 0) as fit,
      cast(obs_people_positives_week as double) / nullif(obs_people_total_week, 0) as obs_fit,
      qa.lower, qa.upper, qb.lower as obs_lower, qb.upper as obs_upper
    from tests left join qa on qa.n = people_total_week and qa.k = people_positives_week
      left join qb on qb.n = obs_people_total_week and qb.k = obs_people_positives_week""",
    "rate fit obs_fit lower upper obs_lower obs_upper",
)
def dashboard_tests(spark, sf_dir):
    known = dashboard.dashboard_log(event_log(spark, sf_dir), EVENTS_START, MEMBERS)
    return dashboard.dashboard_tests(known, EVENTS_START)


_FILLED = """case when count(*) over w = 7 then avg({0}) over w end as {0}_week_avg
  from (select tests.*, coalesce({0}, 0) as {0} from tests left join counted using (testType, date))
  window w as (partition by testType order by date rows between 6 preceding and current row)"""


_CASES = (
    "testType date cases cases_week_avg cases_plus_negatives cases_rate "
    "cases_plus_negatives_daily cases_rate_daily"
)


@register(
    "unique_cases",
    f"""{_DASH}, g as (select testType, patientId, date, coalesce(date_diff('day', lag(date) over w, date), 0) // 7 as episode
      from dash where result = 'positive' window w as (partition by testType, patientId order by date)),
    e as (select testType, patientId, episode, min(date) as date from g group by 1, 2, 3),
    counted as (select testType, date, count(*) as cases from e group by 1, 2),
    f as (select *, {_FILLED.format('cases')})
    select testType, date, cases, cases_week_avg,
      people_total_week - people_positives_week + cases_week_avg * 7 as cases_plus_negatives,
      cases_week_avg * 7 / nullif(people_total_week - people_positives_week + cases_week_avg * 7, 0) as cases_rate,
      people_total - people_positives + cases as cases_plus_negatives_daily,
      cast(cases as double) / nullif(people_total - people_positives + cases, 0) as cases_rate_daily from f""",
    "cases_week_avg cases_plus_negatives cases_rate cases_rate_daily",
)
def unique_cases(spark, sf_dir):
    """From the plan that reads and shuffles the log once for tests, cases and negatives."""
    panel = dashboard.dashboard(event_log(spark, sf_dir), EVENTS_START, MEMBERS, gap_days=7)
    return panel.select(*_CASES.split())


@register(
    "unique_negatives",
    f"""{_DASH}, e as (select testType, patientId, min(date) as date from dash where result = 'negative' group by 1, 2),
    counted as (select testType, date, count(*) as negative_cases from e group by 1, 2)
    select testType, date, negative_cases, {_FILLED.format('negative_cases')}""",
    "negative_cases_week_avg",
)
def unique_negatives(spark, sf_dir):
    panel = dashboard.dashboard(event_log(spark, sf_dir), EVENTS_START, MEMBERS, gap_days=7)
    return panel.select("testType", "date", "negative_cases", "negative_cases_week_avg")


_PANEL = """g as (select testType, patientId, date, coalesce(date_diff('day', lag(date) over w, date), 0) as gap
      from dash where result = 'positive' window w as (partition by testType, patientId order by date)),
    g2 as (select *, {episode} as episode from g),
    e as (select testType, patientId, episode, min(date) as date from g2 group by 1, 2, 3),
    c as (select testType, date, count(*) as cases from e group by 1, 2),
    ne as (select testType, patientId, min(date) as date from dash where result = 'negative' group by 1, 2),
    nc as (select testType, date, count(*) as negative_cases from ne group by 1, 2),
    p as (select testType, date, tests_total, people_total_week, coalesce(cases, 0) as cases, coalesce(negative_cases, 0) as negative_cases
      from tests left join c using (testType, date) left join nc using (testType, date))"""
_RUNNING = """sum(case when gap >= 7 then 1 else 0 end) over (partition by testType, patientId order by date
      rows unbounded preceding)"""


def _panel_sql(episode: str) -> str:
    return f"""{_DASH}, {_PANEL.format(episode=episode)}
    select *, case when count(*) over w = 7 then avg(cases) over w end as cases_week_avg,
      case when count(*) over w = 7 then avg(negative_cases) over w end as negative_cases_week_avg
    from p window w as (partition by testType order by date rows between 6 preceding and current row)"""


def _panel(spark, sf_dir, mode):
    panel = dashboard.dashboard(event_log(spark, sf_dir), EVENTS_START, MEMBERS, gap_days=7, mode=mode)
    return panel.select(
        *["testType", "date", "tests_total", "people_total_week", "cases", "negative_cases"],
        *["cases_week_avg", "negative_cases_week_avg"],
    )


@register("dashboard_one_pass", _panel_sql("gap // 7"), "cases_week_avg negative_cases_week_avg")
def dashboard_one_pass(spark, sf_dir):
    return _panel(spark, sf_dir, "gap")


@register("dashboard_all_episodes", _panel_sql(_RUNNING), "cases_week_avg negative_cases_week_avg")
def dashboard_all_episodes(spark, sf_dir):
    return _panel(spark, sf_dir, "cumulative")


# --- panels ------------------------------------------------------------------------------
_TRAIL = "case when count({0}) over w = 7 then avg({0}) over w end as {1}"


def _present_mean(column: str, name: str) -> str:
    return (
        f"{name} as (select date, case when count(*) over w = 7 then avg({column}) over w end as {name} from beds "
        f"where {column} is not null window w as (order by date rows between 6 preceding and current row))"
    )


@register(
    "hospital_panel",
    f"""with o as (select cast(o_orderdate as date) as date, count(*) as n from orders group by 1),
    l as (select cast(l_shipdate as date) as date, count(*) as m from lineitem group by 1),
    new as (select date, nullif(n % 5, 0) as CAMAS_ADULTOS_COVID, nullif(n % 3, 0) as CAMAS_ICU_COVID, nullif(n % 4, 0) as CAMAS_ICU_DISP,
      nullif(n % 2, 0) as CAMAS_PED_COVID, nullif(n % 7, 0) as CAMAS_PICU_COVID from o where {SINCE}),
    old as (select date, m as h, m % 6 as d, m % 8 as i from l where {SINCE}),
    beds as (select date, CAMAS_ADULTOS_COVID, CAMAS_ICU_COVID, CAMAS_ICU_DISP, CAMAS_PED_COVID, CAMAS_PICU_COVID,
      coalesce(CAMAS_ADULTOS_COVID, h) as HospitCOV19, coalesce(CAMAS_ICU_COVID, i) as CamasICU, coalesce(CAMAS_ICU_DISP, d) as CamasICU_disp
      from new full join old using (date)),
    avgs as (select *, {_TRAIL.format('HospitCOV19', 'hosp_week_avg')}, {_TRAIL.format('CamasICU', 'icu_week_avg')}
      from beds window w as (order by date rows between 6 preceding and current row)),
    {_present_mean('CAMAS_PED_COVID', 'ped_hosp_week_avg')}, {_present_mean('CAMAS_PICU_COVID', 'picu_week_avg')},
    v as (select date, cast(nullif(m * (m % 3), 0) as double) as v from l),
    vaccines as (select date, coalesce(v, max(v) over (order by date rows between unbounded preceding and 1 preceding)) as people_vaccinated from v),
    deaths as (select cast(o_orderdate as date) as date, count(*) as deaths from orders group by 1),
    p as (select *, coalesce(deaths, 0) as IncMueSalud from deaths full join (avgs left join ped_hosp_week_avg using (date)
      left join picu_week_avg using (date)) using (date) full join vaccines using (date))
    select date, HospitCOV19, CamasICU, CamasICU_disp, hosp_week_avg, icu_week_avg, ped_hosp_week_avg, picu_week_avg, people_vaccinated,
      IncMueSalud, {_TRAIL.format('IncMueSalud', 'mort_week_avg')} from p window w as (order by date rows between 6 preceding and current row)""",
    "hosp_week_avg icu_week_avg ped_hosp_week_avg picu_week_avg people_vaccinated mort_week_avg",
)
def hospital_panel(spark, sf_dir):
    orders = row_counts(sparse_log(spark, sf_dir), ["date"])
    lines = row_counts(dense_log(spark, sf_dir), ["date"])
    zero = F.lit(0).cast("long")

    def text(column, gap=True):
        return (F.nullif(column, zero) if gap else column).cast("string")

    n, m = F.col("n"), F.col("n")
    beds = orders.select(
        F.col("date").cast("string").alias("FE_REPORTE"),
        text(n % 5).alias("CAMAS_ADULTOS_COVID"),
        text(n % 3).alias("CAMAS_ICU_COVID"),
        text(n % 4).alias("CAMAS_ICU_DISP"),
        text(n % 2).alias("CAMAS_PED_COVID"),
        text(n % 7).alias("CAMAS_PICU_COVID"),
    )
    legacy = lines.select(
        F.date_format("date", "M/d/yyyy").alias("Fecha"),
        text(m, gap=False).alias("HospitCOV19"),
        text(m % 6, gap=False).alias("CamasICU_disp"),
        text(m % 8, gap=False).alias("CamasICU"),
    )
    doses = text(m * (m % 3))
    vaccines = lines.select(
        F.lit("here").alias("location"),
        F.col("date").cast("string").alias("date"),
        *[doses.alias(c) for c in panels.VACCINE_COLUMNS],
    )
    panel = panels.hospital_panel(
        clean.clean_hospital(beds),
        clean.clean_legacy_hospital(legacy),
        panels.fill_vaccines(clean.clean_vaccines(vaccines), "here"),
        sparse_log(spark, sf_dir),
        START,
    )
    return panel.select(
        "date",
        "HospitCOV19",
        "CamasICU",
        "CamasICU_disp",
        "hosp_week_avg",
        "icu_week_avg",
        "ped_hosp_week_avg",
        "picu_week_avg",
        "people_vaccinated",
        "IncMueSalud",
        "mort_week_avg",
    )


@register(
    "report_delay",
    f"""with d as (select cast(o_orderdate as date) as death, cast(o_orderdate as date) + cast(o_orderkey % 9 as integer) as bulletin from orders),
    f as (select case when death < date '{START}' or death > date '{AS_OF}' then bulletin else death end as date, bulletin from d)
    select date, date_diff('day', date, bulletin) as diff, count(*) as n from f group by 1, 2""",
)
def report_delay(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    later = F.date_add(day, (F.col("o_orderkey") % 9).cast("int"))
    noon = F.lit("T12:00:00")
    summary = table(spark, sf_dir, "orders").select(
        F.concat(day.cast("string"), noon).alias("deathDate"),
        F.concat(later.cast("string"), noon).alias("reportDate"),
        F.lit("40 to 44").alias("ageRange"),
    )
    delays = panels.report_delay(clean.clean_death_summary(summary, START, AS_OF))
    return row_counts(delays.withColumn("diff", F.col("diff").cast("long")), ["date", "diff"])


@register(
    "all_tests_panel",
    f"""with {SPARSE_SQL}, {log_sql().replace('log as', 'dense as')}, u as (select * from log union all select * from dense),
    a as (select testType, date, count(*) filter (result = 'positive') as pos, count(*) as totalType from u group by 1, 2),
    b as (select date, count(*) as n from u group by 1)
    select *, cast(pos as double) / n as rate_of_all, cast(pos as double) / totalType as rate_of_type from a join b using (date)""",
    "rate_of_all rate_of_type",
)
def all_tests_panel(spark, sf_dir):
    both = cleaning.union_by_name(sparse_log(spark, sf_dir), dense_log(spark, sf_dir), strict=True)
    return panels.all_tests_panel(both)


# --- models ----------------------------------------------------------------------------------
_NAMED = f"""n_{HOME} as HTTotal, k_{HOME} as HTPos, n_{LAB} as MolecularTotal, k_{LAB} as MolecularPos,
  cast(k_{HOME} as double) / n_{HOME} as HTAvgDaily, cast(k_{LAB} as double) / n_{LAB} as MolecularAvgDaily"""
_OUTLIERS = [dt.date(1996, 3, 9), dt.date(1996, 3, 10)]
_TRAIN = "(select * from halves where is_train)"


def _predicted_sql(key: str, x: str, link: str, weight: str = "1", extra: str = "") -> str:
    rows = model_rows_sql(x, "MolecularPos", "MolecularTotal", _TRAIN, weight)
    return f"""halves as materialized (select *, {HALF_SQL.format(key=key)} as is_train from tab),
    {rows}, {sp.irls_ctes('rows', link, 'm')},
    scored as (select *, {sp.fitted(link, x)} as fit, {sp.fitted_se(link, x)} as se from halves, fitm where not is_train)
    select {key}, {x}, MolecularAvgDaily{extra}, fit, se, fit - 1.96 * se as ribbon_low, fit + 1.96 * se as ribbon_high from scored"""


_RIBBON = "fit se ribbon_low ribbon_high MolecularAvgDaily"
_HOT = ", ".join(f"case when dayname(date) = '{d}' then 1 else 0 end as {d}" for d in WEEKDAYS)


@register(
    "model_table",
    f"""with {log_sql()}, {wide_sql('date', SINCE)},
    tab as (select date, {_NAMED}, {_HOT} from wide where date not in (date '1996-03-09', date '1996-03-10')),
    {_predicted_sql('date', 'HTAvgDaily', 'logit', 'HTTotal', ', Sunday')}""",
    f"{_RIBBON} HTAvgDaily",
)
def model_table(spark, sf_dir):
    run = modelling.daily_model(dense_log(spark, sf_dir), start=START, outliers=_OUTLIERS)
    return run.predicted.select("date", "HTAvgDaily", "Sunday", *_RIBBON.split())


_WEEKS = f"""weeks as (select *, {ROUND_WEEK_SQL} as week from log where {SINCE}),
    {wide_sql('week').replace('from log', 'from weeks').replace('wide as', 'wide2 as')},
    tab2 as (select week, {_NAMED} from wide2 where week < date '2001-10-01'),
    halves2 as materialized (select *, {HALF_SQL.format(key='week')} as is_train from tab2),
    {model_rows_sql('HTAvgDaily', 'MolecularPos', 'MolecularTotal', '(select * from halves2 where is_train)').replace('rows as', 'rows2 as')},
    {sp.irls_ctes('rows2', 'log', 'w')}"""
_DAYS_FIT = f"""{wide_sql('date', SINCE)},
    tab as (select date, {_NAMED} from wide where date not in (date '1996-03-09', date '1996-03-10')),
    halves as materialized (select *, {HALF_SQL.format(key='date')} as is_train from tab),
    {model_rows_sql('HTAvgDaily', 'MolecularPos', 'MolecularTotal', _TRAIN, 'HTTotal')}, {sp.irls_ctes('rows', 'logit', 'd')}"""


@register(
    "model_quality",
    f"""with {log_sql()}, {_DAYS_FIT},
    ll as (select sum(prior * (lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
        + case when k > 0 then k * ln(mu) else 0 end + case when n > k then (n - k) * ln(1 - mu) else 0 end)) as ll
      from (select r.k, r.n, r.prior, {sp.fitted('logit', 'r.x')} as mu from rows r, fitd)),
    q as (select 'daily' as model, null_deviance - deviance as lr_chi2, sqrt(null_deviance - deviance) as z, * from fitd),
    {sp.normal_tail_ctes('q', 'model', 'z', 'z')}
    select 'logit' as link, n as observations, null_deviance, deviance, n - 1 as df_null, n - 2 as df_residual, -2 * ll + 4 as aic,
      (null_deviance - deviance) / null_deviance as mcfadden_r2, lr_chi2, p as lr_p, pearson as pearson_chi2,
      pearson / (n - 2) as dispersion, deviance / (n - 2) as deviance_per_df from q join tailz using (model), ll""",
    "null_deviance deviance aic mcfadden_r2 lr_chi2 lr_p pearson_chi2 dispersion deviance_per_df",
    digits=5,
)
def model_quality(spark, sf_dir):
    run = modelling.daily_model(dense_log(spark, sf_dir), start=START, outliers=_OUTLIERS)
    return glm.quality_table(run.train_rows, run.fit)


@register(
    "model_comparison",
    f"""with {log_sql()}, {_DAYS_FIT}, {_WEEKS}
    select 'logit' as link, 'HTAvgDaily' as predictor, n as observations, n - 2 as df_residual, deviance, cast(null as double) as p_value from fitd
    union all select 'log', 'HTAvgDaily', n, n - 2, deviance, null from fitw""",
    "deviance p_value",
    digits=5,
)
def model_comparison(spark, sf_dir):
    log = dense_log(spark, sf_dir)
    daily = modelling.daily_model(log, start=START, outliers=_OUTLIERS)
    weekly = modelling.weekly_model(log, start=START, end=dt.date(2001, 10, 1))
    return glm.compare_deviance(daily.train_rows, daily.fit, weekly.fit)


@register(
    "weekly_model",
    f"""with {log_sql()}, weeks as (select *, {ROUND_WEEK_SQL} as week from log where {SINCE}),
    {wide_sql('week').replace('from log', 'from weeks')}, tab as (select week, {_NAMED} from wide where week < date '2001-10-01'),
    {_predicted_sql('week', 'HTAvgDaily', 'log')}""",
    f"{_RIBBON} HTAvgDaily",
)
def weekly_model(spark, sf_dir):
    run = modelling.weekly_model(dense_log(spark, sf_dir), start=START, end=dt.date(2001, 10, 1))
    return run.predicted.select("week", "HTAvgDaily", *_RIBBON.split())


def _own_mean_sql(share: str, name: str) -> str:
    return f"""{name} as (select date, case when count(*) over w < 7 then 0 else avg({share}) over w end as {name} from t0
      where {share} is not null window w as (order by date rows between 6 preceding and current row))"""


@register(
    "rolling_model",
    f"""with {log_sql()}, {wide_sql('date', SINCE)}, t0 as (select date, {_NAMED} from wide),
    {_own_mean_sql('MolecularAvgDaily', 'TRMean')}, {_own_mean_sql('HTAvgDaily', 'HT0')},
    j as (select * from t0 left join TRMean using (date) left join HT0 using (date)),
    tab as (select *, case when count(HT0) over w = 7 then avg(HT0) over w end as HTRMean from j
      window w as (order by date rows between 3 preceding and 3 following)),
    {_predicted_sql('date', 'HTRMean', 'log', '1', ', TRMean')}""",
    f"{_RIBBON} HTRMean TRMean",
)
def rolling_model(spark, sf_dir):
    run = modelling.rolling_model(dense_log(spark, sf_dir), start=START)
    return run.predicted.select("date", "HTRMean", "TRMean", *_RIBBON.split())


@register(
    "prediction_long",
    f"""with {log_sql()}, {wide_sql()}, {rolling_sql()}, {WEEK_ROWS}, {sp.irls_ctes('rows', 'logit', 'a')},
    s as (select *, {sp.fitted('logit', Y)} as p from rolled, fita), t as (select *, ln(p / (1 - p)) as logit from s)
    select logit, 'k7_{HOME}' as predictors, cast(k7_{HOME} as double) as predictor_value from t
    union all select logit, '{Y}', {Y} from t union all select logit, 'p_hat', coalesce(p, 0) from t""",
    "logit predictor_value",
)
def prediction_long(spark, sf_dir):
    daily = materialize(daily_pair(spark, sf_dir))
    fit = glm.fit_binomial(glm.model_rows(daily, Y, f"k7_{LAB}", f"n7_{LAB}"), Y)
    return modelling.prediction_long(daily, fit, [f"k7_{HOME}", Y])


def _stratum_fits_sql(stratum: str) -> str:
    return f"""base as (select unnest([{stratum}, 'pooled']) as {stratum}, {Y} as x, k7_{LAB} as k, n7_{LAB} as n from rolled
      where {Y} is not null and n7_{LAB} > 0 and k7_{LAB} is not null),
    rows as materialized (select 'trials' as form, {stratum}, x, cast(k as double) / n as y, cast(n as double) as w from base
      union all select 'failures', {stratum}, x, cast(k as double) / (n + k), cast(n + k as double) from base),
    {sp.irls_group_ctes('rows', f'form, {stratum}')} select form, {stratum}, {FIT_SQL} from fits"""


@register(
    "glm_by_region",
    f"with {log_sql(region=True)}, {wide_sql('date, region', SINCE)}, {rolling_sql('region')}, {_stratum_fits_sql('region')}",
    FIT_NAMES,
)
def glm_by_region(spark, sf_dir):
    """The fit on the regional frame, over all regions' rows and per region."""
    frame = positivity.positivity(dense_log(spark, sf_dir, region=True), ["region"], start=START)
    return fitted_forms(frame, ["region"])


@register(
    "glm_by_age",
    f"""with {AGED_SQL}, {wide_sql('date, ageRange', SINCE).replace('from log', 'from aged')}, {rolling_sql('ageRange')},
    {_stratum_fits_sql('ageRange')}""",
    FIT_NAMES,
)
def glm_by_age(spark, sf_dir):
    """The fit on the frame of ages; all tests count, as first tests alone leave no full week on both channels here."""
    aged = cleaning.add_age_bins(dense_log(spark, sf_dir, age=True))
    return fitted_forms(positivity.positivity(aged, ["ageRange"], start=START), ["ageRange"])
