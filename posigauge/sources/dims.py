"""Literal dimensions and date spines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posigauge.constants import REGION_POPULATION


def region_population(
    spark: SparkSession, population: Mapping[str, int] = REGION_POPULATION
) -> DataFrame:
    return spark.createDataFrame(list(population.items()), "region string, population long")


def date_spine(
    df: DataFrame, by: Sequence[str], start: Column, date: str = "date", name: str = "date"
) -> DataFrame:
    """Every day from ``start`` (a literal or an aggregate) to the last day of each group."""
    bounds = df.groupBy(*by).agg(start.alias("_lo"), F.max(date).alias("_hi"))
    return bounds.where(F.col("_lo") <= F.col("_hi")).select(
        *by, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(name)
    )
