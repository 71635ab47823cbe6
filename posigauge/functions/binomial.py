"""Binomial bounds of a rate."""

from __future__ import annotations

from pyspark.sql import Column

from posigauge.constants import CONFIDENCE
from posigauge.functions.rates import ratio
from posigauge.functions.tails import binomial_quantiles_col


def binomial_bounds(
    n: Column, p: Column, confidence: float = CONFIDENCE
) -> tuple[Column, Column]:
    """Lower and upper binomial quantile of ``n`` trials at rate ``p``, over ``n``."""
    tail = (1 - confidence) / 2
    both = binomial_quantiles_col((tail, 1 - tail), n, p)
    return ratio(both["q0"], n), ratio(both["q1"], n)
