"""Binomial regression of a share on one predictor, logit or log link.

A fit is iterative, so it runs jobs when called. It first writes down the few
columns it needs: no iteration scans the log again. Each step is one
aggregate of a handful of sums and a 2x2 solve on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from posigauge.functions.shipping import ship_by_value
from posigauge.functions.tails import chi2_tail, normal_two_sided
from posigauge.operators.correlation import Z_975
from posigauge.session import materialize

ship_by_value(__name__)

SUMMARY_SCHEMA = (
    "term string, estimate double, std_error double, z double, p_value double"
)
QUALITY_SCHEMA = (
    "link string, observations long, null_deviance double, deviance double, "
    "df_null long, df_residual long, aic double, mcfadden_r2 double, lr_chi2 double, "
    "lr_p double, pearson_chi2 double, dispersion double, deviance_per_df double"
)


class NotConverged(ArithmeticError):
    """An iteration ended before its result was settled."""


def _log_gamma(x: pd.Series) -> pd.Series:
    """log gamma for x >= 1: Stirling's series at x + 8, stepped back by the recurrence."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    far = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    return far - sum(np.log(x + i) for i in range(8))


@F.pandas_udf(DoubleType())
def _log_choose(n: pd.Series, k: pd.Series) -> pd.Series:
    return _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)


@dataclass(frozen=True)
class Evaluation:
    """Sums over the rows at one pair of coefficients."""

    score: tuple[float, float]
    info: tuple[tuple[float, float], tuple[float, float]]
    curvature: tuple[tuple[float, float], tuple[float, float]]
    deviance: float
    pearson: float


@dataclass(frozen=True)
class BinomialFit:
    link: str
    x: str
    intercept: float
    slope: float
    v00: float
    v01: float
    v11: float
    observations: int
    null_deviance: float
    deviance: float
    pearson_chi2: float
    aic: float

    @property
    def df_residual(self) -> int:
        return self.observations - 2

    def standard_errors(self) -> tuple[float, float]:
        return math.sqrt(self.v00), math.sqrt(self.v11)


def mean_of(link: str, eta: Column) -> Column:
    return F.exp(eta) if link == "log" else F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def _slope_of_mean(link: str, mu: Column) -> Column:
    return mu if link == "log" else mu * (F.lit(1.0) - mu)


def binomial_deviance(y: Column, mu: Column, w: Column) -> Column:
    hit = F.when(y > 0, y * F.ln(y / mu)).otherwise(0.0)
    miss = F.when(y < 1, (1 - y) * F.ln((1 - y) / (1 - mu))).otherwise(0.0)
    return 2 * w * (hit + miss)


def model_rows(
    df: DataFrame,
    x: str,
    successes: str,
    trials: str,
    weight: str | None = None,
    compat: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by, x, y, w, k, n, prior): complete rows with trials, written down once.

    ``compat`` treats ``trials`` as the number of failures, so the share is
    k / (k + n).
    """
    k, n = F.col(successes).cast("double"), F.col(trials).cast("double")
    total = k + n if compat else n
    prior = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(
        *by,
        F.col(x).cast("double").alias("x"),
        (k / F.nullif(total, F.lit(0.0))).alias("y"),
        (total * prior).alias("w"),
        k.alias("k"),
        total.alias("n"),
        prior.alias("prior"),
    )
    return materialize(rows.where("x is not null and y is not null and w > 0"))


def evaluate(
    rows: DataFrame, link: str, candidates: Sequence[tuple[float, float]]
) -> list[Evaluation | None]:
    """Score, expected and observed information, deviance per (intercept, slope).

    All of them come from one job.

    The candidates are a literal array that is exploded next to the rows, so
    the generated code is the same for every call and is compiled once. A
    candidate that leaves a mean outside (0, 1) gives None.
    """
    points = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(float(b0)).alias("b0"), F.lit(float(b1)).alias("b1"))
            for i, (b0, b1) in enumerate(candidates)
        ]
    )
    x, y, w, eta, mu = (F.col(c) for c in ("x", "y", "w", "eta", "mu"))
    placed = (
        rows.select("x", "y", "w", F.explode(points).alias("at"))
        .select("x", "y", "w", "at.i", (F.col("at.b0") + F.col("at.b1") * x).alias("eta"))
        .select("*", mean_of(link, eta).alias("mu"))
        .withColumn("mu", F.when((mu > 0) & (mu < 1), mu))
        .withColumn("d", _slope_of_mean(link, mu))
        .withColumn("g", w * (y - mu) * F.col("d") / (mu * (1 - mu)))
        .withColumn("h", w * F.col("d") * F.col("d") / (mu * (1 - mu)))
        .withColumn("c", w * mu * (1 - y) / (1 - mu) ** 2 if link == "log" else F.col("h"))
    )
    found = {
        r["i"]: r
        for r in placed.groupBy("i")
        .agg(
            F.count_if(mu.isNull()).alias("outside"),
            F.sum("g").alias("g0"),
            F.sum(F.col("g") * x).alias("g1"),
            F.sum("h").alias("s"),
            F.sum(F.col("h") * x).alias("sx"),
            F.sum(F.col("h") * x * x).alias("sxx"),
            F.sum("c").alias("c"),
            F.sum(F.col("c") * x).alias("cx"),
            F.sum(F.col("c") * x * x).alias("cxx"),
            F.sum(binomial_deviance(y, mu, w)).alias("deviance"),
            F.sum(w * (y - mu) ** 2 / (mu * (1 - mu))).alias("pearson"),
        )
        .collect()  # one row per candidate
    }
    out: list[Evaluation | None] = []
    for i in range(len(candidates)):
        r = found[i]
        out.append(
            None
            if r["outside"]
            else Evaluation(
                score=(r["g0"], r["g1"]),
                info=((r["s"], r["sx"]), (r["sx"], r["sxx"])),
                curvature=((r["c"], r["cx"]), (r["cx"], r["cxx"])),
                deviance=r["deviance"],
                pearson=r["pearson"],
            )
        )
    return out


def _newton(
    rows: DataFrame, link: str, share: float, max_steps: int = 50, halvings: int = 4
) -> tuple[float, float]:
    """Newton steps on the log likelihood, which is concave for both links.

    Each job looks at the full step and its halves at once and takes the
    longest that keeps means below 1 and lowers the deviance. Raises
    :class:`NotConverged` if ``max_steps`` steps do not settle it.
    """
    here = np.array([math.log(share if link == "log" else share / (1 - share)), 0.0])
    now = evaluate(rows, link, [tuple(here)])[0]
    for _ in range(max_steps):
        step = np.linalg.solve(now.curvature, now.score)
        error = np.sqrt(np.diag(np.linalg.inv(now.info)))
        if np.all(np.abs(step) <= 1e-10 * error):
            break
        scale = 1.0
        while True:
            tries = [here + step * scale / 2**i for i in range(halvings)]
            results = evaluate(rows, link, [tuple(t) for t in tries])
            limit = now.deviance * (1 + 1e-12)
            good = [(t, r) for t, r in zip(tries, results) if r and r.deviance <= limit]
            if good:
                here, now = good[0]
                break
            scale /= 2**halvings
            if scale < 1e-8:
                if np.all(np.abs(step) <= 1e-6 * error):  # nothing left but rounding
                    return float(here[0]), float(here[1])
                raise NotConverged(f"no step lowers the deviance of the {link}-link fit")
    else:
        raise NotConverged(f"the {link}-link fit is not settled after {max_steps} steps")
    return float(here[0]), float(here[1])


def _fit_log(rows: DataFrame, share: float, **limits: int) -> tuple[float, float]:
    return _newton(rows, "log", share, **limits)


def check_settled(at: Evaluation | None, tolerance: float = 1e-4) -> None:
    """Raise unless the next Newton step is below ``tolerance`` standard errors."""
    if at is None:
        raise NotConverged("a fitted mean is 1 or more")
    step = np.linalg.solve(at.info, at.score)
    if np.any(np.abs(step) > tolerance * np.sqrt(np.diag(np.linalg.inv(at.info)))):
        raise NotConverged("the binomial fit is not settled")


def fit_binomial(rows: DataFrame, x: str, link: str = "logit") -> BinomialFit:
    """Fit rows made by :func:`model_rows`; ``x`` names the predictor later on."""
    y, w, k, n = (F.col(c) for c in ("y", "w", "k", "n"))
    share = rows.agg((F.sum(w * y) / F.sum(w)).alias("share")).first()["share"]
    if share is None or not 0 < share < 1:
        raise ValueError("a binomial fit needs both successes and failures")
    if link not in ("logit", "log"):
        raise ValueError(f"unknown link {link!r}")
    b0, b1 = _newton(rows, link, share)
    null = (math.log(share) if link == "log" else math.log(share / (1 - share)), 0.0)
    at_fit, at_null = evaluate(rows, link, [(b0, b1), null])
    check_settled(at_fit)
    mu = mean_of(link, F.lit(b0) + F.lit(b1) * F.col("x"))
    log_density = (
        _log_choose(F.round(n), F.round(k))
        + F.when(k > 0, k * F.ln(mu)).otherwise(0.0)
        + F.when(n > k, (n - k) * F.ln(1 - mu)).otherwise(0.0)
    )
    sums = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("prior") * log_density).alias("ld")
    ).first()
    cov = np.linalg.inv(at_fit.info)
    return BinomialFit(
        link=link,
        x=x,
        intercept=b0,
        slope=b1,
        v00=float(cov[0, 0]),
        v01=float(cov[0, 1]),
        v11=float(cov[1, 1]),
        observations=sums["rows"],
        null_deviance=at_null.deviance,
        deviance=at_fit.deviance,
        pearson_chi2=at_fit.pearson,
        aic=-2 * sums["ld"] + 4,
    )


def predict_response(fit: BinomialFit, x: Column | None = None) -> Column:
    """Fitted share; NULL where the predictor is."""
    x = F.col(fit.x) if x is None else x
    return mean_of(fit.link, F.lit(fit.intercept) + F.lit(fit.slope) * x.cast("double"))


def predict_se(fit: BinomialFit, x: Column | None = None) -> Column:
    """Standard error of the fitted share by the delta method."""
    x = (F.col(fit.x) if x is None else x).cast("double")
    mu = predict_response(fit, x)
    variance = F.lit(fit.v00) + 2 * F.lit(fit.v01) * x + F.lit(fit.v11) * x * x
    return _slope_of_mean(fit.link, mu) * F.sqrt(variance)


def add_prediction(df: DataFrame, fit: BinomialFit, name: str = "fit") -> DataFrame:
    """Add the fit, its error and the +-1.96 ribbon."""
    mu, se = predict_response(fit), predict_se(fit)
    return df.withColumns({name: mu, "se": se}).withColumns(
        {"ribbon_low": F.col(name) - 1.96 * F.col("se"), "ribbon_high": F.col(name) + 1.96 * F.col("se")}
    )


def add_residuals(rows: DataFrame, fit: BinomialFit) -> DataFrame:
    """Fitted value and Pearson residual next to the model rows."""
    mu = predict_response(fit, F.col("x"))
    return rows.withColumn("fitted", mu).withColumn(
        "pearson_residual",
        (F.col("y") - F.col("fitted"))
        / F.sqrt(F.col("fitted") * (1 - F.col("fitted")) / F.col("w")),
    )


def coefficient_table(df: DataFrame, fit: BinomialFit) -> DataFrame:
    out = []
    for term, b, se in zip(
        ("(Intercept)", fit.x), (fit.intercept, fit.slope), fit.standard_errors()
    ):
        out.append((term, b, se, b / se, normal_two_sided(b / se)))
    return df.sparkSession.createDataFrame(out, SUMMARY_SCHEMA)


def quality_table(df: DataFrame, fit: BinomialFit) -> DataFrame:
    """Deviances, McFadden share, likelihood-ratio test and dispersion."""
    gain = fit.null_deviance - fit.deviance
    row = (
        fit.link,
        fit.observations,
        fit.null_deviance,
        fit.deviance,
        fit.observations - 1,
        fit.df_residual,
        fit.aic,
        gain / fit.null_deviance,
        gain,
        chi2_tail(gain, 1),
        fit.pearson_chi2,
        fit.pearson_chi2 / fit.df_residual,
        fit.deviance / fit.df_residual,
    )
    return df.sparkSession.createDataFrame([row], QUALITY_SCHEMA)


def compare_deviance(df: DataFrame, *fits: BinomialFit) -> DataFrame:
    """Residual deviances side by side.

    The tail probability of a difference is given only where the later fit
    spends residual degrees of freedom on the same number of observations.
    """
    out = []
    for before, fit in zip((None, *fits), fits):
        spent = before.df_residual - fit.df_residual if before else 0
        p = None
        if before and spent > 0 and before.observations == fit.observations:
            p = chi2_tail(before.deviance - fit.deviance, spent)
        out.append((fit.link, fit.x, fit.observations, fit.df_residual, fit.deviance, p))
    return df.sparkSession.createDataFrame(
        out,
        "link string, predictor string, observations long, df_residual long, "
        "deviance double, p_value double",
    )


def wald_interval(fit: BinomialFit) -> list[tuple[str, float, float]]:
    return [
        (term, b - Z_975 * se, b + Z_975 * se)
        for term, b, se in zip(
            ("(Intercept)", fit.x), (fit.intercept, fit.slope), fit.standard_errors()
        )
    ]


def profile_interval(
    rows: DataFrame, fit: BinomialFit, rounds: int = 40, tol: float = 1e-9
) -> DataFrame:
    """95 % profile-likelihood interval of both coefficients.

    A bound is where the deviance, minimised over the other coefficient, has
    risen by 1.96 squared. The four bounds are searched together: each round
    is one aggregate that moves the other coefficient to its best value and,
    once there, the bound itself along the signed root of the deviance.
    Raises :class:`NotConverged` if a bound is open after ``rounds``.
    """
    best = np.array([fit.intercept, fit.slope])
    cov = np.array([[fit.v00, fit.v01], [fit.v01, fit.v11]])
    se = np.sqrt(np.diag(cov))
    probes = []
    for j in (0, 1):
        for side in (-1.0, 1.0):
            probe = {"j": j, "side": side, "prev": (best[j], 0.0), "done": False}
            _move(probe, best[j] + side * Z_975 * se[j], best, cov)
            probes.append(probe)
    for _ in range(rounds):
        live = [p for p in probes if not p["done"]]
        if not live:
            break
        results = evaluate(rows, fit.link, [tuple(p["beta"]) for p in live])
        for p, now in zip(live, results):
            j, o = p["j"], 1 - p["j"]
            if now is None:  # a mean reached 1: come back halfway to the fit
                _move(p, (p["beta"][j] + best[j]) / 2, best, cov)
                continue
            step = now.score[o] / now.curvature[o][o]
            # the deviance still falls by about step * score before the best point
            low = now.deviance - step * now.score[o]
            p["beta"][o] += step
            if abs(step) > 1e-3 * se[o]:
                continue
            b = p["beta"][j]
            root = p["side"] * math.sqrt(max(low - fit.deviance, 0.0))
            b_old, root_old = p["prev"]
            target = b + (p["side"] * Z_975 - root) * (b - b_old) / (root - root_old)
            p["prev"] = (b, root)
            p["done"] = abs(target - b) <= tol * se[j]
            _move(p, target, best, cov, from_beta=p["beta"])
    if not all(p["done"] for p in probes):
        raise NotConverged(f"a profile bound is not settled after {rounds} rounds")
    bounds = {(p["j"], p["side"]): float(p["beta"][p["j"]]) for p in probes}
    out = [
        (term, bounds[(j, -1.0)], bounds[(j, 1.0)])
        for j, term in enumerate(("(Intercept)", fit.x))
    ]
    return rows.sparkSession.createDataFrame(out, "term string, lower double, upper double")


def _move(probe: dict, b: float, best, cov, from_beta=None) -> None:
    """Set the probed coefficient and follow with the other along the ridge."""
    j, o = probe["j"], 1 - probe["j"]
    origin = best if from_beta is None else from_beta
    beta = np.array(origin, dtype=float)
    beta[o] = origin[o] + cov[o, j] / cov[j, j] * (b - origin[j])
    beta[j] = b
    probe["beta"] = beta
