"""Bounds, correlation, regression and smoothing over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from posigauge.catalog import sqlparts as sp
from posigauge.catalog.base import register
from posigauge.catalog.scalar_queries import WIDE
from posigauge.catalog.standin import (
    EVENTS_SQL,
    PERIODS,
    daily_pair,
    dense_log,
    event_log,
    log_sql,
    rolling_sql,
    table,
    wide_sql,
)
from posigauge.constants import HOME, LAB
from posigauge.functions.binomial import binomial_bounds
from posigauge.functions.rates import ratio
from posigauge.functions.times import period_label
from posigauge.operators import correlation, glm, glm_batch, ordering, rolling, smooth, summaries
from posigauge.operators.counts import channel_counts, positive_counts
from posigauge.session import materialize

X, Y = f"p7_{LAB}", f"p7_{HOME}"
SEED = "posigauge"

# --- fixed sources shared by several queries ---------------------------------
_DAILY = f"with {log_sql()}, {wide_sql()}"


def model_rows_sql(x: str, k: str, n: str, source: str = "rolled", weight: str = "1", total: str = "") -> str:
    total = total or n
    return (
        f"rows as materialized (select {x} as x, cast({k} as double) / ({total}) as y, cast(({total}) * {weight} as double) as w, "
        f"cast({k} as double) as k, cast({total} as double) as n, cast({weight} as double) as prior from {source} "
        f"where {x} is not null and ({total}) > 0 and {k} is not null and ({weight}) > 0)"
    )


WEEK_ROWS = model_rows_sql(Y, f"k7_{LAB}", f"n7_{LAB}")
DAY_ROWS = model_rows_sql(f"p_{HOME}", f"k_{LAB}", f"n_{LAB}", weight=f"n_{HOME}")
DAY_LOG_ROWS = model_rows_sql(f"p_{HOME}", f"k_{LAB}", f"n_{LAB}")


def week_rows(spark, sf_dir):
    return glm.model_rows(daily_pair(spark, sf_dir), Y, f"k7_{LAB}", f"n7_{LAB}")


def day_rows(spark, sf_dir, weight=None):
    return glm.model_rows(daily_pair(spark, sf_dir), f"p_{HOME}", f"k_{LAB}", f"n_{LAB}", weight)


# --- bounds and spread ---------------------------------------------------------
@register(
    "binomial_bounds",
    f"""{WIDE}, {sp.binomial_ctes('rolled', f'n_{HOME}', f'k_{HOME}', '1')}, {sp.binomial_ctes('rolled', f'n7_{HOME}', f'k7_{HOME}', '7')}
    select date, q1.lower, q1.upper, q7.lower as lower7, q7.upper as upper7 from rolled
      left join q1 on q1.n = n_{HOME} and q1.k = k_{HOME} left join q7 on q7.n = n7_{HOME} and q7.k = k7_{HOME}""",
    "lower upper lower7 upper7",
)
def binomial_bounds_query(spark, sf_dir):
    daily = daily_pair(spark, sf_dir)
    for s in ("", "7"):
        low, high = binomial_bounds(F.col(f"n{s}_{HOME}"), F.col(f"p{s}_{HOME}"))
        daily = daily.withColumns({f"lower{s}": low, f"upper{s}": high})
    return daily.select("date", "lower", "upper", "lower7", "upper7")


@register(
    "dispersion",
    f"""{_DAILY}, h as (select testType, 'test' as grain, cast(result = 'positive' as integer) as v from log
      union all select testType, 'day', count(*) filter (result = 'positive') from log group by testType, date)
    select testType, grain, count(*) as n, stddev_samp(v) as sd, var_samp(v) as variance, stddev_samp(v) / sqrt(count(*)) as se
    from h group by 1, 2""",
    "sd variance se",
)
def dispersion(spark, sf_dir):
    log = dense_log(spark, sf_dir)
    hits = log.select(
        "testType", F.lit("test").alias("grain"), (F.col("result") == "positive").cast("long").alias("v")
    )
    days = positive_counts(log, ["testType", "date"]).select("testType", F.lit("day").alias("grain"), F.col("k").alias("v"))
    return summaries.dispersion(hits.unionByName(days), ["testType", "grain"], "v")


_RATES = f"{_DAILY}, r as (select testType, date, cast(count(*) filter (result = 'positive') as double) / count(*) as rate from log group by 1, 2)"


@register(
    "box_stats",
    f"""{_RATES}, q as (select testType, quantile_cont(rate, 0.25) as q1, quantile_cont(rate, 0.5) as median, quantile_cont(rate, 0.75) as q3
      from r group by 1),
    f as (select *, rate between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from r join q using (testType))
    select testType, q1, median, q3, min(rate) filter (inside) as whisker_low, max(rate) filter (inside) as whisker_high,
      count(*) filter (not inside) as outliers from f group by 1, 2, 3, 4""",
    "q1 median q3 whisker_low whisker_high",
)
def box_stats(spark, sf_dir):
    return summaries.box_stats(_daily_rates(spark, sf_dir), ["testType"], "rate")


def _daily_rates(spark, sf_dir):
    daily = positive_counts(dense_log(spark, sf_dir), ["testType", "date"])
    return materialize(daily.select("testType", "date", ratio(F.col("k"), F.col("n")).alias("rate")))


@register(
    "box_stats_log",
    """
    with q as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
      quantile_cont(value, 0.75) as q3 from events group by 1),
    f as (select *, value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from events join q using (event_type))
    select event_type, q1, median, q3, min(value) filter (inside) as whisker_low, max(value) filter (inside) as whisker_high,
      count(*) filter (not inside) as outliers from f group by 1, 2, 3, 4
    """,
    "q1 median q3 whisker_low whisker_high",
)
def box_stats_log(spark, sf_dir):
    """Spread of single rows, not of daily rates: every row of the log takes part."""
    return summaries.box_stats(table(spark, sf_dir, "events"), ["event_type"], "value")


@register(
    "histogram",
    """
    select event_type, cast(least(floor(value / 25.0), 20) as bigint) + 1 as bin, count(*) as n,
      least(floor(value / 25.0), 20) * 25.0 as bin_start from events group by 1, 2, 4
    """,
    "bin_start",
)
def histogram(spark, sf_dir):
    return summaries.histogram(table(spark, sf_dir, "events"), "value", 0.0, 500.0, 20, ["event_type"])


@register(
    "violin_density",
    f"""{_RATES}, s as (select testType, count(*) as n, stddev_samp(rate) as sd,
      (quantile_cont(rate, 0.75) - quantile_cont(rate, 0.25)) / 1.34 as iqr, min(rate) as lo, max(rate) as hi from r group by 1),
    h as (select *, 0.9 * (case when iqr > 0 then least(sd, iqr) else sd end) * pow(n, -0.2) as h from s),
    g as (select *, unnest(range(0, 64)) as point from h)
    select testType, point, lo + point * (hi - lo) / 63 as x,
      sum(exp(-pow((lo + point * (hi - lo) / 63 - rate) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) as density
    from g join r using (testType) group by 1, 2, 3""",
    "x density",
)
def violin_density(spark, sf_dir):
    return summaries.kernel_density(_daily_rates(spark, sf_dir), ["testType"], "rate", 64)


# --- correlation and lines -------------------------------------------------------
PERIOD_SQL = """case when date >= date '1996-01-01' and date < date '1998-01-01' then 'early'
  when date >= date '1998-01-01' and date < date '2000-01-01' then 'middle'
  when date >= date '2000-01-01' and date < date '2002-01-01' then 'late' end"""
_PAIRS = f"{WIDE}, pairs as (select {PERIOD_SQL} as period, {X} as x, {Y} as y from rolled where {X} is not null and {Y} is not null)"


@register(
    "pearson_by_period",
    f"""{_PAIRS} select coalesce(period, 'none') as period, count(*) as pairs, case when count(*) >= 3 then corr(y, x) end as r from pairs group by 1
    union all select 'all', count(*), corr(y, x) from pairs""",
    "r",
)
def pearson_by_period(spark, sf_dir):
    daily = daily_pair(spark, sf_dir).withColumn(
        "period", F.coalesce(period_label(F.col("date"), PERIODS), F.lit("none"))
    )
    whole = correlation.pearson(daily, [], X, Y).select(F.lit("all").alias("period"), "pairs", "r")
    return correlation.pearson(daily, ["period"], X, Y).unionByName(whole)


_REGION = f"""with {log_sql(region=True)}, {wide_sql('date, region')}, {rolling_sql('region')},
  pairs as (select region, {X} as x, {Y} as y from rolled where {X} is not null and {Y} is not null)"""


def _region_daily(spark, sf_dir):
    wide = channel_counts(dense_log(spark, sf_dir, region=True), ["date", "region"])
    return rolling.add_rolling_rates(wide, ["region"])


@register(
    "pearson_by_stratum",
    f"{_REGION} select region, count(*) as pairs, case when count(*) >= 3 then corr(y, x) end as r from pairs group by 1",
    "r",
)
def pearson_by_stratum(spark, sf_dir):
    return correlation.pearson(_region_daily(spark, sf_dir), ["region"], X, Y)


@register(
    "pearson_test",
    f"""{_REGION}, c as (select region, count(*) as pairs, case when count(*) >= 3 then corr(y, x) end as r from pairs group by 1),
    t as (select *, r * sqrt(greatest(pairs - 2, 0)) / nullif(sqrt(1 - r * r), 0) as t, pairs - 2 as dof from c),
    {sp.t_tail_ctes('t', 'region', 't', 'dof', 'a')}
    select region, pairs, r, t, p as p_value, tanh(atanh(r) - {sp.Z} / sqrt(nullif(greatest(pairs - 3, 0), 0))) as lower,
      tanh(atanh(r) + {sp.Z} / sqrt(nullif(greatest(pairs - 3, 0), 0))) as upper from t left join taila using (region)""",
    "r t p_value lower upper",
)
def pearson_test(spark, sf_dir):
    return correlation.pearson_test(_region_daily(spark, sf_dir), ["region"], X, Y)


LINE_SQL = f"""lines as (select period, count(*) as pairs, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, regr_r2(y, x) as r2,
      avg(x) as x_mean, regr_sxx(y, x) as sxx,
      sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / nullif(count(*) - 2, 0)) as sigma, count(*) - 2 as dof from pairs
      where period is not null group by 1),
    {sp.t_quantile_ctes('lines', 'period', 'dof', 'l')}"""
LINE_COLUMNS = "slope intercept r2 x_mean sxx sigma t_crit"


@register(
    "linear_fit",
    f"{_PAIRS}, {LINE_SQL} select period, pairs, {LINE_COLUMNS.replace(' ', ', ')} from lines left join critl using (period)",
    LINE_COLUMNS,
)
def linear_fit(spark, sf_dir):
    daily = daily_pair(spark, sf_dir).withColumn("period", period_label(F.col("date"), PERIODS))
    return correlation.linear_fit(daily.where("period is not null"), ["period"], X, Y)


@register(
    "linear_band",
    f"""{WIDE}, pairs as (select date, {PERIOD_SQL} as period, {X} as x, {Y} as y from rolled where {X} is not null and {Y} is not null),
    {LINE_SQL},
    b as (select date, intercept + slope * x as centre, t_crit * sigma * sqrt(1.0 / pairs + (x - x_mean) * (x - x_mean) / sxx) as half
      from pairs join lines using (period) left join critl using (period))
    select date, centre, centre - half as low, centre + half as high from b""",
    "centre low high",
)
def linear_band(spark, sf_dir):
    daily = daily_pair(spark, sf_dir).withColumn("period", period_label(F.col("date"), PERIODS))
    daily = daily.where(f"period is not null and {X} is not null and {Y} is not null")
    lines = correlation.linear_fit(daily, ["period"], X, Y)
    centre, low, high = correlation.line_band(F.col(X))
    joined = daily.select("date", "period", X).join(lines, "period")
    return joined.select("date", centre.alias("centre"), low.alias("low"), high.alias("high"))


@register(
    "gaussian_fit",
    f"""{WIDE} select count(*) as pairs, regr_slope(p_{LAB}, p_{HOME}) as slope, regr_intercept(p_{LAB}, p_{HOME}) as intercept,
      regr_r2(p_{LAB}, p_{HOME}) as r2 from rolled where p_{LAB} is not null and p_{HOME} is not null""",
    "slope intercept r2",
)
def gaussian_fit(spark, sf_dir):
    fit = correlation.linear_fit(daily_pair(spark, sf_dir), [], f"p_{HOME}", f"p_{LAB}")
    return fit.select("pairs", "slope", "intercept", "r2")


# --- binomial models ---------------------------------------------------------------
FIT_SQL = "n as observations, a as intercept, b as slope, sqrt(v00) as intercept_se, sqrt(v11) as slope_se, deviance, null_deviance"
FIT_NAMES = "intercept slope intercept_se slope_se deviance null_deviance"


def _fit_row(df, fit, **labels):
    se0, se1 = fit.standard_errors()
    values = {
        **labels,
        "observations": fit.observations,
        "intercept": fit.intercept,
        "slope": fit.slope,
        "intercept_se": se0,
        "slope_se": se1,
        "deviance": fit.deviance,
        "null_deviance": fit.null_deviance,
    }
    schema = ", ".join(
        f"{n} {'string' if n in labels else 'long' if n == 'observations' else 'double'}" for n in values
    )
    return df.sparkSession.createDataFrame([tuple(values.values())], schema)


_COMPAT_ROWS = model_rows_sql(Y, f"k7_{LAB}", f"n7_{LAB}", total=f"n7_{LAB} + k7_{LAB}").replace("rows as", "rows2 as")


@register(
    "glm_logit",
    f"""{WIDE}, {WEEK_ROWS}, {_COMPAT_ROWS}, {sp.irls_ctes('rows', 'logit', 'a')}, {sp.irls_ctes('rows2', 'logit', 'c')}
    select 'trials' as form, {FIT_SQL} from fita union all select 'failures', {FIT_SQL} from fitc""",
    FIT_NAMES,
)
def glm_logit(spark, sf_dir):
    daily = daily_pair(spark, sf_dir).select(Y, f"k7_{LAB}", f"n7_{LAB}")
    return fitted_forms(daily)


def fitted_forms(daily, by=()):
    """Fits of lab on home positivity in both forms, one per group, all in one loop."""
    columns = [*by, Y, f"k7_{LAB}", f"n7_{LAB}"]
    form = F.explode(F.array(F.lit("trials"), F.lit("failures"))).alias("form")
    trials = F.col(f"n7_{LAB}") + F.when(F.col("form") == "failures", F.col(f"k7_{LAB}")).otherwise(0)
    both = daily.select(*columns, form).withColumn(f"n7_{LAB}", trials)
    rows = glm.model_rows(both, Y, f"k7_{LAB}", f"n7_{LAB}", by=["form", *by])
    if by:
        rows = glm_batch.pooled(rows, *by)
    fits = glm_batch.fit_many(rows, ["form", *by])
    return fits.select(
        "form",
        *by,
        "observations",
        "intercept",
        "slope",
        F.sqrt("v00").alias("intercept_se"),
        F.sqrt("v11").alias("slope_se"),
        "deviance",
        "null_deviance",
    )


@register(
    "glm_logit_weighted",
    f"{WIDE}, {DAY_ROWS}, {sp.irls_ctes('rows', 'logit', 'a')} select {FIT_SQL} from fita",
    FIT_NAMES,
)
def glm_logit_weighted(spark, sf_dir):
    rows = day_rows(spark, sf_dir, f"n_{HOME}")
    return _fit_row(rows, glm.fit_binomial(rows, f"p_{HOME}"))


@register(
    "glm_log_link",
    f"{WIDE}, {DAY_LOG_ROWS}, {sp.irls_ctes('rows', 'log', 'a')} select {FIT_SQL} from fita",
    FIT_NAMES,
)
def glm_log_link(spark, sf_dir):
    rows = day_rows(spark, sf_dir)
    return _fit_row(rows, glm.fit_binomial(rows, f"p_{HOME}", "log"))


@register(
    "glm_predict",
    f"{WIDE}, {WEEK_ROWS}, {sp.irls_ctes('rows', 'logit', 'a')} select date, {sp.fitted('logit', Y)} as p_hat from rolled, fita",
    "p_hat",
)
def glm_predict(spark, sf_dir):
    daily = materialize(daily_pair(spark, sf_dir).select("date", Y, f"k7_{LAB}", f"n7_{LAB}"))
    fit = glm.fit_binomial(glm.model_rows(daily, Y, f"k7_{LAB}", f"n7_{LAB}"), Y)
    return daily.select("date", glm.predict_response(fit).alias("p_hat"))


@register(
    "glm_predict_se",
    f"""{WIDE}, {DAY_LOG_ROWS}, {sp.irls_ctes('rows', 'log', 'a')},
    s as (select date, {sp.fitted('log', f'p_{HOME}')} as fit, {sp.fitted_se('log', f'p_{HOME}')} as se from rolled, fita)
    select date, fit, se, fit - 1.96 * se as ribbon_low, fit + 1.96 * se as ribbon_high from s""",
    "fit se ribbon_low ribbon_high",
)
def glm_predict_se(spark, sf_dir):
    daily = materialize(daily_pair(spark, sf_dir).select("date", f"p_{HOME}", f"k_{LAB}", f"n_{LAB}"))
    fit = glm.fit_binomial(glm.model_rows(daily, f"p_{HOME}", f"k_{LAB}", f"n_{LAB}"), f"p_{HOME}", "log")
    return glm.add_prediction(daily, fit).select("date", "fit", "se", "ribbon_low", "ribbon_high")


_LL = """ll as (select -2 * sum(prior * (lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    + case when k > 0 then k * ln(mu) else 0 end + case when n > k then (n - k) * ln(1 - mu) else 0 end)) + 4 as aic
  from (select r.k, r.n, r.prior, 1 / (1 + exp(-(a + b * x))) as mu from rows r, fita))"""


@register(
    "glm_summary",
    f"""{WIDE}, {WEEK_ROWS}, {sp.irls_ctes('rows', 'logit', 'a')}, {_LL},
    c as (select '(Intercept)' as term, a as estimate, sqrt(v00) as std_error, a / sqrt(v00) as z from fita
      union all select '{Y}', b, sqrt(v11), b / sqrt(v11) from fita),
    {sp.normal_tail_ctes('c', 'term', 'z', 'z')}
    select term, estimate, std_error, z, p as p_value, null_deviance, deviance, n - 1 as df_null, n - 2 as df_residual, aic
    from c join tailz using (term), fita, ll""",
    "estimate std_error z p_value null_deviance deviance aic",
)
def glm_summary(spark, sf_dir):
    rows = week_rows(spark, sf_dir)
    fit = glm.fit_binomial(rows, Y)
    return glm.coefficient_table(rows, fit).withColumns(
        {
            "null_deviance": F.lit(fit.null_deviance),
            "deviance": F.lit(fit.deviance),
            "df_null": F.lit(fit.observations - 1).cast("long"),
            "df_residual": F.lit(fit.df_residual).cast("long"),
            "aic": F.lit(fit.aic),
        }
    )


@register(
    "glm_confint",
    f"""{WIDE}, {WEEK_ROWS}, {DAY_LOG_ROWS.replace('rows as', 'rows2 as')},
    {sp.irls_ctes('rows', 'logit', 'a')}, {sp.profile_ctes('rows', 'fita', 'logit', 'a')},
    {sp.irls_ctes('rows2', 'log', 'c')}, {sp.profile_ctes('rows2', 'fitc', 'log', 'c')}
    select 'logit' as link, case j when 0 then '(Intercept)' else '{Y}' end as term, min(b) as lower, max(b) as upper from boundsa group by j
    union all select 'log', case j when 0 then '(Intercept)' else 'p_{HOME}' end, min(b), max(b) from boundsc group by j""",
    "lower upper",
)
def glm_confint(spark, sf_dir):
    week, day = week_rows(spark, sf_dir), day_rows(spark, sf_dir)
    a = glm.profile_interval(week, glm.fit_binomial(week, Y))
    b = glm.profile_interval(day, glm.fit_binomial(day, f"p_{HOME}", "log"))
    return a.select(F.lit("logit").alias("link"), "*").unionByName(b.select(F.lit("log").alias("link"), "*"))


@register(
    "mcfadden_r2",
    f"{WIDE}, {WEEK_ROWS}, {sp.irls_ctes('rows', 'logit', 'a')} select (null_deviance - deviance) / null_deviance as mcfadden_r2 from fita",
    "mcfadden_r2",
)
def mcfadden_r2(spark, sf_dir):
    rows = week_rows(spark, sf_dir)
    return glm.quality_table(rows, glm.fit_binomial(rows, Y)).select("mcfadden_r2")


@register(
    "lr_test",
    f"""{WIDE}, {WEEK_ROWS}, {DAY_LOG_ROWS.replace('rows as', 'rows2 as')}, {sp.irls_ctes('rows', 'logit', 'a')}, {sp.irls_ctes('rows2', 'log', 'c')},
    l as (select 'logit' as link, n as observations, null_deviance - deviance as lr_chi2, deviance from fita
      union all select 'log', n, null_deviance - deviance, deviance from fitc),
    r as (select link, sqrt(lr_chi2) as z from l), {sp.normal_tail_ctes('r', 'link', 'z', 'z')}
    select link, observations, lr_chi2, deviance, p as lr_p from l join tailz using (link)""",
    "lr_chi2 lr_p deviance",
)
def lr_test(spark, sf_dir):
    week, day = week_rows(spark, sf_dir), day_rows(spark, sf_dir)
    tables = [
        glm.quality_table(week, glm.fit_binomial(week, Y)),
        glm.quality_table(day, glm.fit_binomial(day, f"p_{HOME}", "log")),
    ]
    return tables[0].unionByName(tables[1]).select("link", "observations", "lr_chi2", "deviance", "lr_p")


@register(
    "pearson_residuals",
    f"""{WIDE}, {WEEK_ROWS}, {sp.irls_ctes('rows', 'logit', 'a')},
    r as (select x, y, w, {sp.fitted('logit')} as mu, n as obs, deviance from (select rows.x, rows.y, rows.w from rows), fita)
    select round(mu, 2) as fitted_bin, count(*) as n, sum((y - mu) / sqrt(mu * (1 - mu) / w)) as residual_sum,
      sum(w * (y - mu) * (y - mu) / (mu * (1 - mu))) as pearson_chi2, any_value(deviance / (obs - 2)) as deviance_per_df
    from r group by 1""",
    "residual_sum pearson_chi2 deviance_per_df fitted_bin",
    digits=4,
)
def pearson_residuals(spark, sf_dir):
    rows = week_rows(spark, sf_dir)
    fit = glm.fit_binomial(rows, Y)
    r = F.col("pearson_residual")
    return (
        glm.add_residuals(rows, fit)
        .groupBy(F.round("fitted", 2).alias("fitted_bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("residual_sum"), F.sum(r * r).alias("pearson_chi2"))
        .withColumn("deviance_per_df", F.lit(fit.deviance / fit.df_residual))
    )


HALF_SQL = "row_number() over (order by md5(concat(cast({key} as varchar), ':posigauge'))) <= count(*) over () // 2"


@register("half_split", f"{WIDE} select date, {HALF_SQL.format(key='date')} as is_train from rolled")
def half_split(spark, sf_dir):
    return ordering.hash_halves(daily_pair(spark, sf_dir).select("date"), "date", SEED)


# --- smoothers -----------------------------------------------------------------------
_LOESS = f"""with {EVENTS_SQL}, s as (select testType, date, cast(count(*) filter (result = 'positive') as double) / count(*) as y,
    cast(date_diff('day', date '1970-01-01', date) as double) as x from log group by 1, 2),
  size as (select testType, least(count(*), cast(floor(count(*) * 0.75 + 1e-5) as bigint)) as near from s group by 1),
  d as (select a.testType, a.date, b.x - a.x as u, b.y, abs(b.x - a.x) as dist,
    row_number() over (partition by a.testType, a.date order by abs(b.x - a.x)) as rn from s a join s b using (testType)),
  reach as (select testType, date, dist as h from d join size using (testType) where rn = near),
  w as (select testType, date, u, y, pow(1 - pow(dist / h, 3), 3) as w from d join reach using (testType, date) where dist < h),
  m as (select testType, date, sum(w) as s0, sum(w * u) as s1, sum(w * u * u) as s2, sum(w * u * u * u) as s3, sum(w * u * u * u * u) as s4,
    sum(w * y) as t0, sum(w * u * y) as t1, sum(w * u * u * y) as t2 from w group by 1, 2)
  select testType, date, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2))
    / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)) as trend from m"""


@register("loess_smooth", _LOESS, "trend")
def loess_smooth(spark, sf_dir):
    daily = positive_counts(event_log(spark, sf_dir), ["testType", "date"])
    daily = daily.withColumn("rate", ratio(F.col("k"), F.col("n")))
    return smooth.loess_smooth(daily, ["testType"], "date", "rate")


@register(
    "spline_smooth",
    f"""{_RATES}, daily as (select testType as s, date, rate as y from r), {sp.spline_ctes('daily', 1e-4)}
    select s as testType, date, smooth from curve""",
    "smooth",
)
def spline_smooth(spark, sf_dir):
    return smooth.spline_smooth(_daily_rates(spark, sf_dir), ["testType"], "date", "rate")
