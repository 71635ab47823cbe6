"""Regression values over the published daily counts (190 days).

The file is not part of this repository: name it in POSIGAUGE_DAILY_CSV.
"""

import os

import pytest
from pyspark.sql import functions as F

from posigauge.constants import HOME, LAB
from posigauge.operators import glm, rolling
from posigauge.operators.correlation import pearson
from posigauge.plans.positivity import add_bounds, period_correlation
from posigauge.schemas import DAILY_GOLDEN
from posigauge.sources.files import read_csv

pytestmark = pytest.mark.skipif(
    "POSIGAUGE_DAILY_CSV" not in os.environ, reason="POSIGAUGE_DAILY_CSV is not set"
)


@pytest.fixture(scope="module")
def golden(spark):
    return read_csv(spark, os.environ["POSIGAUGE_DAILY_CSV"], DAILY_GOLDEN)


@pytest.fixture(scope="module")
def daily(golden):
    wide = golden.select(
        "date",
        F.col("HTPos").alias(f"k_{HOME}"),
        F.col("HTTotal").alias(f"n_{HOME}"),
        F.col("MolecularPos").alias(f"k_{LAB}"),
        F.col("MolecularTotal").alias(f"n_{LAB}"),
    )
    return rolling.add_rolling_rates(wide)


def test_shares_match_the_file(golden, daily):
    joined = golden.join(daily, "date")
    off = F.abs(F.col("HTAvgDaily") - F.col(f"p_{HOME}")) + F.abs(
        F.col("MolecularAvgDaily") - F.col(f"p_{LAB}")
    )
    assert joined.agg(F.count(F.lit(1)), F.max(off)).first()[1] < 1e-9
    assert golden.count() == 190


def test_correlation_per_period(daily):
    rows = {r["period"]: r for r in period_correlation(daily).collect()}
    expected = {
        "December-February": (70, 0.9707376189, 1.2313257588, -0.0326688710),
        "March-April": (61, 0.7783458777, 0.9055184868, 0.1230572123),
        "May-June": (53, 0.6282710020, 2.8251847450, -0.3938835701),
    }
    for period, (pairs, r, slope, intercept) in expected.items():
        row = rows[period]
        assert row["pairs"] == pairs
        assert row["r"] == pytest.approx(r, abs=1e-9)
        assert row["slope"] == pytest.approx(slope, abs=1e-9)
        assert row["intercept"] == pytest.approx(intercept, abs=1e-9)
        assert row["lower"] < r < row["upper"]
    # published values come from another extract
    for period, r in (("December-February", 0.96), ("March-April", 0.78), ("May-June", 0.62)):
        assert rows[period]["r"] == pytest.approx(r, abs=0.02)


def test_correlation_overall(daily):
    row = pearson(daily, [], f"p7_{LAB}", f"p7_{HOME}").first()
    assert (row["pairs"], row["r"]) == (184, pytest.approx(0.8135068572, abs=1e-9))


def test_models_converge_to_known_values(golden):
    rows = glm.model_rows(golden, "HTAvgDaily", "MolecularPos", "MolecularTotal")
    logit = glm.fit_binomial(rows, "HTAvgDaily")
    assert (logit.intercept, logit.slope) == (
        pytest.approx(-1.887010, abs=1e-6),
        pytest.approx(2.142143, abs=1e-6),
    )
    assert logit.deviance == pytest.approx(46110.933, abs=1e-3)
    log = glm.fit_binomial(rows, "HTAvgDaily", "log")
    assert (log.intercept, log.slope) == (
        pytest.approx(-1.9512654, abs=1e-6),
        pytest.approx(1.4841536, abs=1e-6),
    )
    assert log.deviance == pytest.approx(47712.533, abs=1e-3)


def test_bounds_hold_the_rate(daily):
    bad = add_bounds(daily).where(
        f"lower7 > p7_{HOME} or upper7 < p7_{HOME} or lower > p_{HOME} or upper < p_{HOME}"
    )
    assert bad.count() == 0
    two = daily.where(f"n_{HOME} = 2 and k_{HOME} = 2")
    assert [str(r["date"]) for r in two.collect()] == ["2022-03-12"]
