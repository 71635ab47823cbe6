"""Binomial regressions of many groups at once.

The coefficients of all models are a table. A round is one aggregate of the
rows next to their model's trial point, then a 2x2 solve in columns. Settled
models leave the table, so later rounds read the rows of the open ones only.
The driver reads nothing but whether a model is open.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posigauge.operators.glm import binomial_deviance, mean_of
from posigauge.session import materialize

FIT_COLUMNS = (
    "observations", "intercept", "slope", "v00", "v01", "v11", "deviance", "null_deviance", "pearson_chi2", "settled",
)
SETTLED, ROUNDING, SHORTEST = 1e-10, 1e-6, 1e-8


def _solve(a: Column, b: Column, c: Column, r0: Column, r1: Column) -> tuple[Column, Column]:
    """Solution of [[a, b], [b, c]] z = (r0, r1); null if the matrix is singular."""
    det = a * c - b * b
    return F.try_divide(c * r0 - b * r1, det), F.try_divide(a * r1 - b * r0, det)


def _starts(rows: DataFrame, link: str) -> DataFrame:
    """One row per model: the constant share as first trial, and whether it can be fitted at all."""
    share = F.col("share")
    start = F.ln(share) if link == "log" else F.ln(share / (1 - share))
    models = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("observations"),
        (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("share"),
        (F.max("x") > F.min("x")).alias("varies"),
    )
    fits = F.col("varies") & (share > 0) & (share < 1)
    zero = F.lit(0.0)
    return models.select(
        "model",
        "observations",
        F.when(fits, start).alias("b0"),
        zero.alias("b1"),
        zero.alias("s0"),
        zero.alias("s1"),
        F.lit(1.0).alias("scale"),
        F.lit(False).alias("near"),
        F.lit(None).cast("double").alias("null_deviance"),
        *[F.lit(None).cast("double").alias(c) for c in ("deviance", "pearson", "s", "sx", "sxx")],
        (~fits).alias("done"),
        F.lit(False).alias("settled"),
    )


def _sums(rows: DataFrame, live: DataFrame, link: str) -> DataFrame:
    """Score, information, curvature, deviance at every model's trial point, from one aggregate."""
    trials = live.select(
        "model",
        (F.col("b0") + F.col("scale") * F.col("s0")).alias("t0"),
        (F.col("b1") + F.col("scale") * F.col("s1")).alias("t1"),
    )
    x, y, w, mu = (F.col(c) for c in ("x", "y", "w", "mu"))
    placed = (
        rows.join(trials, "model")
        .select("model", "x", "y", "w", mean_of(link, F.col("t0") + F.col("t1") * x).alias("m"))
        .select("model", "x", "y", "w", F.when((F.col("m") > 0) & (F.col("m") < 1), F.col("m")).alias("mu"))
    )
    if link == "log":
        placed = placed.select(
            "*",
            (w * (y - mu) / (1 - mu)).alias("g"),
            (w * mu / (1 - mu)).alias("h"),
            (w * mu * (1 - y) / ((1 - mu) * (1 - mu))).alias("c"),
        )
    else:
        h = w * mu * (1 - mu)
        placed = placed.select("*", (w * (y - mu)).alias("g"), h.alias("h"), h.alias("c"))
    moments = [F.sum(F.col(c) * p).alias(f"{c}{i}") for c in "ghc" for i, p in enumerate((F.lit(1.0), x, x * x))]
    return placed.groupBy("model").agg(
        F.count_if(mu.isNull()).alias("outside"),
        *moments,
        F.sum(binomial_deviance(y, mu, w)).alias("new_deviance"),
        F.sum(w * (y - mu) * (y - mu) / (mu * (1 - mu))).alias("new_pearson"),
    )


def _advance(live: DataFrame, sums: DataFrame) -> DataFrame:
    """Accept the trial or halve the step.

    A trial is accepted if no mean leaves (0, 1) and the deviance does not
    rise; a step of less than 1e-6 standard errors may raise it by rounding.
    """
    both = live.join(sums, "model")
    lower = F.col("deviance").isNull() | (F.col("new_deviance") <= F.col("deviance") * (1 + 1e-12))
    both = both.withColumn("good", (F.col("outside") == 0) & (lower | F.col("near")))
    good = F.col("good")
    step0, step1 = _solve(*[F.col(c) for c in ("c0", "c1", "c2", "g0", "g1")])
    v00, _ = _solve(F.col("h0"), F.col("h1"), F.col("h2"), F.lit(1.0), F.lit(0.0))
    _, v11 = _solve(F.col("h0"), F.col("h1"), F.col("h2"), F.lit(0.0), F.lit(1.0))
    both = both.withColumns({"n0": step0, "n1": step1, "e0": F.sqrt(v00), "e1": F.sqrt(v11)})

    def within(limit: float) -> Column:
        return F.coalesce(
            (F.abs("n0") <= limit * F.col("e0")) & (F.abs("n1") <= limit * F.col("e1")), F.lit(False)
        )

    settled = good & within(SETTLED)
    stuck = F.when(good, F.col("n0").isNull() | F.col("n1").isNull()).otherwise(F.col("scale") < SHORTEST)
    chosen = {
        "b0": F.col("b0") + F.col("scale") * F.col("s0"),
        "b1": F.col("b1") + F.col("scale") * F.col("s1"),
        "s0": F.col("n0"),
        "s1": F.col("n1"),
        "near": within(ROUNDING),
        "null_deviance": F.coalesce("null_deviance", "new_deviance"),
        "deviance": F.col("new_deviance"),
        "pearson": F.col("new_pearson"),
        "s": F.col("h0"),
        "sx": F.col("h1"),
        "sxx": F.col("h2"),
    }
    return both.select(
        "model",
        "observations",
        *[F.when(good, new).otherwise(F.col(c)).alias(c) for c, new in chosen.items()],
        F.when(good, F.lit(1.0)).otherwise(F.col("scale") / 2).alias("scale"),
        (settled | stuck).alias("done"),
        settled.alias("settled"),
    )


def fit_many(rows: DataFrame, by: Sequence[str] = (), link: str = "logit", max_rounds: int = 60) -> DataFrame:
    """One binomial fit of y on x per group of ``by``; rows as :func:`glm.model_rows` writes them.

    Gives ``by``, observations, intercept, slope, their covariances v00, v01
    and v11, the deviances, pearson_chi2 and settled. A model that cannot be
    fitted (only successes or only failures, a constant predictor) or is open
    after ``max_rounds`` has settled = false and NULL for its figures; the
    others are not held up. A NULL group is a group. Nothing to fit gives an
    empty table.
    """
    if link not in ("logit", "log"):
        raise ValueError(f"unknown link {link!r}")
    model = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    placed = rows.select(model.alias("model"), "x", "y", "w")
    state = materialize(_starts(placed, link))
    parts = []
    for _ in range(max_rounds):
        parts.append(state.where("done"))
        live = state.where("not done")
        if live.isEmpty():
            break
        state = materialize(_advance(live, _sums(placed, live, link)))
    else:
        parts.append(state.withColumn("settled", F.col("done") & F.col("settled")))
    found = reduce(DataFrame.unionByName, parts)
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    figures = {
        "intercept": F.col("b0"),
        "slope": F.col("b1"),
        "v00": F.try_divide("sxx", det),
        "v01": F.try_divide(-F.col("sx"), det),
        "v11": F.try_divide("s", det),
        "deviance": F.col("deviance"),
        "null_deviance": F.col("null_deviance"),
        "pearson_chi2": F.col("pearson"),
    }
    return found.select(
        *[F.col("model").getField(c).alias(c) for c in by],
        "observations",
        *[F.when(F.col("settled"), value).alias(name) for name, value in figures.items()],
        "settled",
    )


def pooled(rows: DataFrame, stratum: str, label: str = "pooled") -> DataFrame:
    """Every row once under its stratum and once under ``label``, for a fit over all strata next to theirs."""
    both = F.explode(F.array(F.col(stratum), F.lit(label))).alias(stratum)
    return rows.select(both, *[c for c in rows.columns if c != stratum])
