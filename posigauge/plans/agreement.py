"""Do two channels agree for the same person a few days apart?"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posigauge.constants import FIRST_DAY, LAB, PAIR_WINDOW_DAYS, SAMPLE_ENTITIES
from posigauge.functions.rates import is_known, type_offset
from posigauge.functions.text import short_label
from posigauge.operators.counts import positive_counts
from posigauge.operators.ordering import dense_index, first_entities
from posigauge.operators.pairs import paired_days
from posigauge.session import materialize


def agreement(
    log: DataFrame,
    start: dt.date = FIRST_DAY,
    days: int = PAIR_WINDOW_DAYS,
    sample_n: int | None = SAMPLE_ENTITIES,
    base: str = LAB,
) -> DataFrame:
    """Tests with a test on another channel within ``days``, laid out per person.

    Persons are numbered in id order among those with such tests; the first
    ``sample_n`` are kept, or all of them when it is None. Having more than
    one test type needs no filter of its own: a paired day implies it.
    """
    known = log.where(is_known(F.col("result")))
    daily = positive_counts(known, ["testType", "date"])
    hits = paired_days(known, days)
    if sample_n is None:
        hits = materialize(hits)  # needed twice: for the index, whose jobs run now, and for the rows
        people = dense_index(hits, "patientId", "patientIndex")
        hits = hits.join(people, "patientId")
    else:
        # sample_n rows at most
        people = first_entities(hits, "patientId", sample_n, "patientIndex")
        hits = hits.join(F.broadcast(people), "patientId")
    rows = (
        known.where(F.col("date") >= F.lit(start))
        .select("patientId", "testType", "date", "result")
        .join(hits, ["patientId", "testType", "date"])
    )
    lane = type_offset(F.col("testType"), base)
    # daily counts, one row per type and day, are small enough for Spark to broadcast
    return (
        rows.join(daily, ["testType", "date"])
        .withColumns({"y": lane, "label": short_label(F.col("testType"))})
        .withColumn("y_val", F.col("y") + F.col("patientIndex"))
        .withColumns({"bottom": F.col("y_val") - 1, "top": F.col("y_val") + 1})
    )
