"""Registry and the rounding both sides of a comparison share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame, digits: int) -> DataFrame:
    """Round doubles; adding 0.0 turns -0.0 into 0.0."""
    doubles = {name for name, kind in df.dtypes if kind == "double"}
    return df.select(
        *[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


def register(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Name a query and its SQL; ``doubles`` lists the columns to round there."""

    def wrap(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(build(spark, sf_dir), digits)

        run.__name__ = name
        run.__doc__ = build.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f'round("{c}", {digits}) + 0.0 as "{c}"' for c in doubles.split())
            SQL[name] = f"select * replace ({rounded}) from (\n{sql}\n)" if rounded else sql
        return build

    return wrap
