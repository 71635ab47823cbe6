"""Lab share explained by home-test positivity: daily, weekly and rolling models."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posigauge.constants import FIRST_DAY, HOME, LAB, OUTLIER_DAYS
from posigauge.functions.rates import logit, ratio
from posigauge.functions.times import round_week
from posigauge.operators.cleaning import exclude_days, fill_zero
from posigauge.operators.counts import channel_counts, select_tests
from posigauge.operators.glm import (
    BinomialFit,
    add_prediction,
    fit_binomial,
    model_rows,
    predict_response,
)
from posigauge.operators.ordering import hash_halves
from posigauge.operators.reshape import unpivot_long, weekday_one_hot
from posigauge.operators.rolling import centered_mean, rolling_mean_fill0, series
from posigauge.operators.smooth import spline_smooth
from posigauge.session import materialize

MODEL_NAMES = {
    f"k_{HOME}": "HTPos",
    f"n_{HOME}": "HTTotal",
    f"k_{LAB}": "MolecularPos",
    f"n_{LAB}": "MolecularTotal",
}


@dataclass(frozen=True)
class ModelRun:
    """A fit on the training half, its rows, and the other half with predictions."""

    fit: BinomialFit
    train_rows: DataFrame
    predicted: DataFrame


def daily_table(
    log: DataFrame,
    start: dt.date = FIRST_DAY,
    end: dt.date | None = None,
    outliers: Sequence[dt.date] = OUTLIER_DAYS,
) -> DataFrame:
    """Counts and shares of both channels per day, weekday columns, outliers out."""
    wide = channel_counts(select_tests(log, start, end), ["date"]).withColumnsRenamed(MODEL_NAMES)
    return exclude_days(weekday_one_hot(_shares(wide)), outliers)


def weekly_table(
    log: DataFrame, start: dt.date = FIRST_DAY, end: dt.date | None = None
) -> DataFrame:
    """The same per nearest-Sunday week; ``end`` cuts weeks, not days."""
    weeks = select_tests(log, start).withColumn("week", round_week(F.col("date")))
    if end is not None:
        weeks = weeks.where(F.col("week") < F.lit(end))
    return _shares(channel_counts(weeks, ["week"]).withColumnsRenamed(MODEL_NAMES))


def rolling_table(
    log: DataFrame, start: dt.date = FIRST_DAY, end: dt.date | None = None
) -> DataFrame:
    """Trailing means of the daily shares; the home mean is centred once more."""
    wide = _shares(
        channel_counts(select_tests(log, start, end), ["date"]).withColumnsRenamed(MODEL_NAMES)
    )
    means = wide.withColumns(
        {"TRMean": _own_days_mean("MolecularAvgDaily"), "HTRMean": _own_days_mean("HTAvgDaily")}
    )
    return means.withColumn("HTRMean", centered_mean(F.col("HTRMean"), series()))


def _own_days_mean(share: str) -> Column:
    """Trailing mean of a channel over the days it has tests on."""
    present = F.col(share).isNotNull()
    w = Window.partitionBy(present).orderBy("date")
    return F.when(present, rolling_mean_fill0(F.col(share), w))


def _shares(wide: DataFrame) -> DataFrame:
    return wide.withColumns(
        {
            "HTAvgDaily": ratio(F.col("HTPos"), F.col("HTTotal")),
            "MolecularAvgDaily": ratio(F.col("MolecularPos"), F.col("MolecularTotal")),
        }
    )


def run_model(
    table: DataFrame,
    key: str,
    x: str = "HTAvgDaily",
    link: str = "logit",
    weight: str | None = None,
    seed: str = "posigauge",
) -> ModelRun:
    """Fit on one random half, predict the other.

    ``table`` has one row per day or week. It is written down before the fit.
    """
    halves = materialize(hash_halves(table, key, seed))
    rows = model_rows(halves.where("is_train"), x, "MolecularPos", "MolecularTotal", weight)
    fit = fit_binomial(rows, x, link)
    predicted = add_prediction(halves.where("not is_train").drop("is_train"), fit)
    return ModelRun(fit, rows, predicted)


def smooth_share(
    table: DataFrame, column: str = "HTAvgDaily", knots: int = 10, penalty: float = 1e-4
) -> DataFrame:
    """Replace a daily share by its spline; days without a share keep none."""
    curve = spline_smooth(table, [], "date", column, "_curve", knots, penalty)
    return table.join(curve, "date", "left").withColumn(column, F.col("_curve")).drop("_curve")


def daily_model(
    log: DataFrame, seed: str = "posigauge", penalty: float | None = None, **period
) -> ModelRun:
    """Daily logit model, trials weighted once more by the home tests of the day.

    With a ``penalty`` the home share is smoothed first.
    """
    table = daily_table(log, **period)
    if penalty is not None:
        table = smooth_share(materialize(table), penalty=penalty)
    return run_model(table, "date", weight="HTTotal", seed=seed)


def weekly_model(log: DataFrame, seed: str = "posigauge", **period) -> ModelRun:
    return run_model(weekly_table(log, **period), "week", link="log", seed=seed)


def rolling_model(log: DataFrame, seed: str = "posigauge", **period) -> ModelRun:
    return run_model(rolling_table(log, **period), "date", "HTRMean", "log", seed=seed)


def prediction_long(
    table: DataFrame, fit: BinomialFit, columns: Sequence[str], filled: bool = True
) -> DataFrame:
    """Logit of the fitted share against each column, one row per value."""
    p = predict_response(fit)
    scored = table.withColumns({"p_hat": p, "logit": logit(p)})
    if filled:
        scored = fill_zero(scored, ["p_hat"])
    return unpivot_long(scored, ["logit"], [*columns, "p_hat"])
