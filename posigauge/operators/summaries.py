"""Spread and shape of values per group.

Quantiles are exact order statistics by histogram refinement, so groups may be
as large as a log; each refinement reads the frame again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posigauge.functions.rates import ratio, standard_error
from posigauge.operators.selection import quantiles
from posigauge.session import materialize


def dispersion(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    x = F.col(value)
    return df.groupBy(*by).agg(
        F.count(x).alias("n"),
        F.stddev_samp(x).alias("sd"),
        F.var_samp(x).alias("variance"),
        standard_error(x).alias("se"),
    )


def box_stats(df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Hinges (linear interpolation), whiskers within ``reach`` IQR, outlier count."""
    x = F.col(value)
    hinges = quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    spread = (F.col("q3") - F.col("q1")) * reach
    inside = x.between(F.col("q1") - spread, F.col("q3") + spread)
    return (
        df.join(hinges, list(by))
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def histogram(
    df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Row counts of equal-width bins; bin 0 and bins+1 hold what lies outside."""
    width = (high - low) / bins
    bucket = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, bucket.cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_start", F.lit(low) + (F.col("bin") - 1) * width)
    )


def kernel_density(
    df: DataFrame, by: Sequence[str], value: str, points: int = 512, bins: int = 8192
) -> DataFrame:
    """Gaussian density of each group on an even grid from its minimum to its maximum.

    Values are split between the four nearest of ``bins`` + 1 even nodes with
    cubic weights, in one aggregate; then nodes meet grid points, so what
    follows the aggregate does not grow with the rows. Against the exact sum
    over all values the error is at most ``(3/128) * 3 * (d/h)**4`` of the
    kernel's height, d being the distance of nodes and h the bandwidth,
    ``0.9 * min(sd, IQR / 1.34) * n ** -0.2``.
    """
    x = F.col(value)
    kept = df.where(x.isNotNull())
    spread = kept.groupBy(*by).agg(F.stddev_samp(x).alias("_sd"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    hinges = quantiles(df, by, value, {"_q1": 0.25, "_q3": 0.75}).withColumnRenamed("n", "_n")
    iqr = (F.col("_q3") - F.col("_q1")) / 1.34
    narrow = F.when(iqr > 0, F.least("_sd", iqr)).otherwise(F.col("_sd"))
    bandwidth = 0.9 * narrow * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    stats = materialize(spread.join(hinges, list(by)).select(*by, "_n", "_lo", "_hi", bandwidth.alias("_h")))
    step = ratio(F.col("_hi") - F.col("_lo"), F.lit(bins))
    at = F.coalesce(ratio(x - F.col("_lo"), step), F.lit(0.0))
    cell = F.least(F.floor(at), F.lit(bins - 1))
    u = F.col("_u")
    weights = [
        -u * (u - 1) * (u - 2) / 6,
        (u + 1) * (u - 1) * (u - 2) / 2,
        -(u + 1) * u * (u - 2) / 2,
        (u + 1) * u * (u - 1) / 6,
    ]
    binned = (
        kept.join(stats, list(by))
        .select(*by, "_n", "_lo", "_hi", "_h", cell.alias("_cell"), (at - cell).alias("_u"))
        .groupBy(*by, "_n", "_lo", "_hi", "_h", "_cell")
        .agg(F.array(*map(F.sum, weights)).alias("_w"))
    )
    nodes = binned.select(*by, "_n", "_lo", "_hi", "_h", "_cell", F.posexplode("_w").alias("_k", "_part"))
    nodes = nodes.groupBy(*by, "_n", "_lo", "_hi", "_h", (F.col("_cell") + F.col("_k") - 1).alias("_node")).agg(
        F.sum("_part").alias("_mass")
    )
    place = F.col("_lo") + F.col("point") * ratio(F.col("_hi") - F.col("_lo"), F.lit(points - 1))
    node = F.col("_lo") + F.col("_node") * step
    far = ratio(place - node, F.col("_h"))
    kernel = F.sum(F.col("_mass") * F.exp(-(far * far) / 2))
    return (
        nodes.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(*by, "point", place.alias("x"), "_n", "_h")
        .agg((kernel / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))
        .select(*by, F.col("point").cast("long").alias("point"), "x", "density")
    )
