"""Smoothers of daily series.

A group is one series of daily values, so its size is bounded by the calendar.
The window or basis of a series is solved with numpy inside a task; Spark
distributes the series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posigauge.functions.shipping import ship_by_value

ship_by_value(__name__)


def _loess(x: np.ndarray, y: np.ndarray, span: float, degree: int) -> np.ndarray:
    """Local polynomial at every x, tricube weights over the nearest share."""
    near = min(len(x), int(np.floor(len(x) * span + 1e-5)))
    out = np.full(len(x), np.nan)
    if near <= degree:
        return out
    for i, at in enumerate(x):
        distance = np.abs(x - at)
        reach = np.partition(distance, near - 1)[near - 1] * max(1.0, span)
        inside = distance < reach
        u = x[inside] - at
        if len(np.unique(u)) <= degree:
            continue
        root = (1 - (distance[inside] / reach) ** 3) ** 1.5
        basis = np.vander(u, degree + 1, increasing=True)
        scale = np.abs(basis).max(axis=0)
        beta, *_ = np.linalg.lstsq(basis / scale * root[:, None], y[inside] * root, rcond=None)
        out[i] = beta[0] / scale[0]
    return out


def _knots(x: np.ndarray, count: int) -> np.ndarray:
    distinct = np.unique(x)
    at = np.linspace(0, len(distinct) - 1, min(count, len(distinct)))
    return distinct[np.round(at).astype(int)]


def _spline(x: np.ndarray, y: np.ndarray, count: int, penalty: float) -> np.ndarray:
    """Natural cubic spline through values at the knots, second derivative penalised."""
    knots = _knots(x, count)
    if len(knots) < 3:
        return np.full(len(x), y.mean()) if len(knots) < 2 else np.polyval(np.polyfit(x, y, 1), x)
    span = knots[-1] - knots[0]
    x, knots = (x - knots[0]) / span, (knots - knots[0]) / span
    h, m = np.diff(knots), len(knots)
    d, b = np.zeros((m - 2, m)), np.zeros((m - 2, m - 2))
    for i in range(m - 2):
        d[i, i], d[i, i + 2] = 1 / h[i], 1 / h[i + 1]
        d[i, i + 1] = -d[i, i] - d[i, i + 2]
        b[i, i] = (h[i] + h[i + 1]) / 3
        if i + 1 < m - 2:
            b[i, i + 1] = b[i + 1, i] = h[i + 1] / 6
    curvature = np.vstack([np.zeros(m), np.linalg.solve(b, d), np.zeros(m)])
    j = np.clip(np.searchsorted(knots, x, side="right") - 1, 0, m - 2)
    left, right, hj = knots[j + 1] - x, x - knots[j], h[j]
    basis = np.zeros((len(x), m))
    rows = np.arange(len(x))
    basis[rows, j] += left / hj
    basis[rows, j + 1] += right / hj
    basis += ((left**3 / hj - hj * left) / 6)[:, None] * curvature[j]
    basis += ((right**3 / hj - hj * right) / 6)[:, None] * curvature[j + 1]
    gram = basis.T @ basis + penalty * (d.T @ np.linalg.solve(b, d))
    return basis @ np.linalg.solve(gram, basis.T @ y)


def _smooth_groups(df: DataFrame, by: Sequence[str], x: str, y: str, name: str, solve) -> DataFrame:
    kinds = dict(df.dtypes)
    keys = list(by)
    position = F.unix_date(x) if kinds[x] == "date" else F.col(x)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, x, position.cast("double").alias("_at"), F.col(y).cast("double").alias("_y")
    )
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{x}` {kinds[x]}", f"`{name}` double"])

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", kind="stable")
        pdf[name] = solve(pdf["_at"].to_numpy(), pdf["_y"].to_numpy())
        return pdf[[*keys, x, name]]

    return rows.groupBy(*keys).applyInPandas(per_series, schema)


def loess_smooth(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    name: str = "trend",
    span: float = 0.75,
    degree: int = 2,
) -> DataFrame:
    """Local regression computed directly at every point."""
    return _smooth_groups(df, by, x, y, name, lambda a, b: _loess(a, b, span, degree))


def spline_smooth(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    name: str = "smooth",
    knots: int = 10,
    penalty: float = 1e-4,
) -> DataFrame:
    """Penalised cubic spline with a given penalty (it is not selected from the data)."""
    return _smooth_groups(df, by, x, y, name, lambda a, b: _spline(a, b, knots, penalty))
