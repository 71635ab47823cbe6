"""Correlation and straight-line fits, from sums over complete pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posigauge.constants import CONFIDENCE
from posigauge.functions.rates import ratio
from posigauge.functions.tails import t_quantile_col, t_two_sided_col

Z_975 = 1.959963984540054  # standard normal quantile at 0.975


def _complete(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """r per group; NULL below three pairs."""
    pairs = F.count(F.lit(1))
    return (
        _complete(df, x, y)
        .groupBy(*by)
        .agg(pairs.alias("pairs"), F.when(pairs >= 3, F.corr(x, y)).alias("r"))
    )


def pearson_test(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """r with t, two-sided p and the 95 % interval of Fisher's transform."""
    dof = F.col("pairs") - 2
    r = F.col("r")
    out = pearson(df, by, x, y).withColumn(
        "t", ratio(r * F.sqrt(dof.cast("double")), F.sqrt(1 - r * r))
    )
    half = F.when(F.col("pairs") > 3, F.lit(Z_975) / F.sqrt((F.col("pairs") - 3).cast("double")))
    return out.withColumns(
        {
            "p_value": t_two_sided_col(F.col("t"), dof),
            "lower": F.tanh(F.atanh(r) - half),
            "upper": F.tanh(F.atanh(r) + half),
        }
    )


def linear_fit(
    df: DataFrame, by: Sequence[str], x: str, y: str, confidence: float = CONFIDENCE
) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` per group, with what its band needs."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    fit = (
        _complete(df, x, y)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.regr_slope(ys, xs).alias("slope"),
            F.regr_intercept(ys, xs).alias("intercept"),
            F.regr_r2(ys, xs).alias("r2"),
            F.avg(xs).alias("x_mean"),
            F.regr_sxx(ys, xs).alias("sxx"),
            F.regr_syy(ys, xs).alias("_syy"),
            F.regr_sxy(ys, xs).alias("_sxy"),
        )
    )
    rss = F.col("_syy") - F.col("slope") * F.col("_sxy")
    dof = F.col("pairs") - 2
    return fit.withColumns(
        {"sigma": F.sqrt(ratio(rss, dof)), "t_crit": t_quantile_col(confidence, dof)}
    ).drop("_syy", "_sxy")


def line_band(fit_x: Column) -> tuple[Column, Column, Column]:
    """Fitted value and band at ``fit_x`` from the columns of :func:`linear_fit`."""
    centre = F.col("intercept") + F.col("slope") * fit_x
    off = fit_x - F.col("x_mean")
    half = (
        F.col("t_crit")
        * F.col("sigma")
        * F.sqrt(ratio(F.lit(1.0), F.col("pairs")) + ratio(off * off, F.col("sxx")))
    )
    return centre, centre - half, centre + half
