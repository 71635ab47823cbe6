"""What the physical plans must and must not hold."""

import re

import pytest

import __spark_entry__ as entry_module
from posigauge.catalog.standin import START, dense_log
from posigauge.operators import ordering, pairs
from posigauge.plans import positivity


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_no_query_multiplies_rows_blindly(name, spark, sf_dir):
    text = plan(entry_module.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_period_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(positivity.positivity(dense_log(spark, sf_dir), start=START))
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line)
    assert re.search(r"FileScan parquet \[l_returnflag#\d+,l_linestatus#\d+,l_shipdate#\d+\]", scan)
    assert "GreaterThanOrEqual(l_shipdate" in scan
    # one shuffle of the partial aggregates, one of the daily rows
    assert text.count("Exchange ") == 2


def test_first_per_group_is_limited_before_the_shuffle(spark, sf_dir):
    text = plan(ordering.first_per_group(dense_log(spark, sf_dir), ["testType", "patientId"], ["date"]))
    below = text[text.index("Exchange ") :]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_pair_cells_are_hashed_not_sorted(spark, sf_dir):
    text = plan(pairs.paired_days(dense_log(spark, sf_dir)))
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_person_joins_spread_over_days(spark, sf_dir):
    """Log rows are shuffled by person, type and day, with a sort right above.

    That also lets adaptive execution split a partition that is still too big.
    """
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (pairs.interval_semi, pairs.keep_multi_type):
            text = plan(rows(dense_log(spark, sf_dir)))
            keys = r"hashpartitioning\(patientId#\d+L, testType#\d+, date#\d+"
            join = text[text.index("SortMergeJoin") :]
            assert len(re.findall(r"Sort \[[^\n]*\n[^\n]*Exchange " + keys, join)) >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hints_are_bounded(spark, sf_dir):
    """With automatic broadcasts off, only sampled ids may be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(entry_module.queries()["agreement"](spark, sf_dir))
        assert text.count("BroadcastExchange") == 1 and "TakeOrderedAndProject(limit=50" in text
        for name in ("clean_tests", "dashboard_one_pass", "interval_pairs", "positivity_by_region"):
            assert "BroadcastExchange" not in plan(entry_module.queries()[name](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
