"""Distribution tails and quantiles Spark has no function for.

Each public name is a vectorised pandas UDF meant for result rows (days or
strata), never for the log. The numeric parts are a few lines of numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from posigauge.functions.shipping import ship_by_value

ship_by_value(__name__)

_REACH = 12.0  # standard deviations kept around the mode; the rest is < 1e-30


def binomial_quantile(q: float, n: float, p: float) -> float:
    """Smallest x with P(X <= x) >= q for X ~ Binomial(n, p).

    Weights follow the ratio of neighbouring terms outward from the mode, so
    nothing underflows however large n is; the work grows with sqrt(n).
    """
    if not (math.isfinite(n) and math.isfinite(p)) or n < 0 or not 0 <= p <= 1:
        return math.nan
    n = int(n)
    if n == 0 or p == 0.0:
        return 0.0
    if p == 1.0:
        return float(n)
    mode = min(n, int((n + 1) * p))
    reach = int(_REACH * math.sqrt(n * p * (1 - p))) + 40
    lo, hi = max(0, mode - reach), min(n, mode + reach)
    odds = math.log(p) - math.log1p(-p)
    x = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(n - x) - np.log(x + 1) + odds  # log weight(x+1) - log weight(x)
    log_w = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.exp(log_w - log_w[mode - lo])
    cumulative = np.cumsum(weights)
    return float(lo + np.searchsorted(cumulative, q * cumulative[-1] * (1 - 1e-13)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 20000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    raise ArithmeticError("the continued fraction of the incomplete beta function did not converge")


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b)
        - math.lgamma(a)
        - math.lgamma(b)
        + a * math.log(x)
        + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) with ``df`` degrees of freedom."""
    if math.isnan(t) or not df > 0:
        return math.nan
    return regularized_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(level: float, df: float) -> float:
    """Two-sided critical value: P(|T| <= value) = level."""
    if not df > 0:
        return math.nan
    lo, hi = 0.0, 2.0
    while t_two_sided(hi, df) > 1 - level:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        if t_two_sided(mid, df) > 1 - level:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def chi2_tail(x: float, df: float) -> float:
    """P(X >= x) for a chi-squared variable."""
    if math.isnan(x) or not df > 0:
        return math.nan
    if x <= 0:
        return 1.0
    if df == 1:
        return math.erfc(math.sqrt(x / 2))
    a, z = df / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= z / k
            total += term
        return 1.0 - front * total
    b, c = z + 1 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return front * h
    raise ArithmeticError("the continued fraction of the chi-square tail did not converge")


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2)) if not math.isnan(z) else math.nan


def _per_pair(fn, a: pd.Series, b: pd.Series) -> pd.Series:
    """Evaluate once per distinct pair of arguments; NaN goes out as NULL."""
    a, b = a.astype("float64"), b.astype("float64")
    seen: dict[tuple[float, float], float] = {}
    out = []
    for pair in zip(a.to_numpy(), b.to_numpy()):
        if pair not in seen:
            seen[pair] = math.nan if math.isnan(pair[0]) or math.isnan(pair[1]) else fn(*pair)
        value = seen[pair]
        out.append(None if math.isnan(value) else value)
    return pd.Series(out, dtype=object)


def _pair_udf(fn):
    def body(a: pd.Series, b: pd.Series) -> pd.Series:
        return _per_pair(fn, a, b)

    return F.pandas_udf(body, DoubleType())


def binomial_quantile_col(q: float, n, p):
    """Column form of :func:`binomial_quantile` for a fixed level."""
    return _pair_udf(lambda n_, p_: binomial_quantile(q, n_, p_))(
        n.cast("double"), p.cast("double")
    )


def binomial_quantiles_col(levels: tuple[float, float], n, p):
    """Struct of both quantiles, from one pass over the distinct pairs."""

    def body(n_: pd.Series, p_: pd.Series) -> pd.DataFrame:
        columns = {f"q{i}": _per_pair(lambda a, b, q=q: binomial_quantile(q, a, b), n_, p_) for i, q in enumerate(levels)}
        return pd.DataFrame(columns)

    return F.pandas_udf(body, "q0 double, q1 double")(n.cast("double"), p.cast("double"))


def t_two_sided_col(t, df):
    return _pair_udf(t_two_sided)(t.cast("double"), df.cast("double"))


def t_quantile_col(level: float, df):
    return _pair_udf(lambda df_, _: t_quantile(level, df_))(df.cast("double"), F.lit(0.0))


def chi2_tail_col(x, df):
    return _pair_udf(chi2_tail)(x.cast("double"), df.cast("double"))
