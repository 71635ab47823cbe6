"""Column helpers on literal frames, one case per rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from posigauge.functions import ages, rates, tails, text, times


def values(spark, data, column, schema="x string"):
    frame = spark.createDataFrame([(v,) for v in data], schema)
    return [r[0] for r in frame.select(column).collect()]


def test_classify_result(spark):
    cases = {
        "COVID-19 Positive": "positive",
        "SARS-CoV-2 positive": "positive",
        "Influenza A positive": "other",
        "covid influenza POSITIVE": "positive",
        "Positive": "positive",
        "NEGATIVE": "negative",
        "Not Detected": "negative",
        "not detected (x)": "other",
        "": "other",
        None: "other",
    }
    assert values(spark, cases, text.classify_result(F.col("x"))) == list(cases.values())


def test_labels(spark):
    cases = {"N/A": "No reportada", None: "No reportada", "Bayamon": "Bayamón", "Mayaguez": "Mayagüez", "Metro": "Metro"}
    assert values(spark, cases, text.clean_region(F.col("x"))) == list(cases.values())
    assert values(spark, ["MOLECULAR", "antigeno", None], text.normalize_test_type(F.col("x"))) == [
        "Molecular",
        "Antigens",
        None,
    ]
    levels = ["b", "a"]
    assert values(spark, ["a", "b", "c", None], text.in_domain(F.col("x"), levels)) == ["a", "b", None, None]
    assert values(spark, ["a", "b", "c", None], text.domain_index(F.col("x"), levels)) == [2, 1, None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/Puerto_Rico", "America/New_York"])
def test_local_timestamp_ignores_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        cases = {
            "2022-01-02T02:00:00Z": dt.datetime(2022, 1, 1, 22),
            "2022-01-02T02:00:00": dt.datetime(2022, 1, 2, 2),
            "2022-01-02 02:00:00": dt.datetime(2022, 1, 2, 2),
            "2022-01-02T02:00:00.250Z": dt.datetime(2022, 1, 1, 22, 0, 0, 250000),
            "2022-01-02T02:00:00+05:30": dt.datetime(2022, 1, 1, 16, 30),
            "2022-01-02T02:00:00-0400": dt.datetime(2022, 1, 2, 2),
            "2022-11-06T05:30:00Z": dt.datetime(2022, 11, 6, 1, 30),
            "2022-11-06T06:30:00Z": dt.datetime(2022, 11, 6, 2, 30),
            "2022-01-02": None,
            "garbage": None,
            "10:30:00 garbage": None,
            None: None,
        }
        assert values(spark, cases, times.local_timestamp(F.col("x"))) == list(cases.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_event_date(spark):
    as_of = dt.date(2022, 7, 1)
    day = dt.date
    rows = [
        (day(2022, 1, 5), day(2022, 1, 3), day(2022, 1, 5), day(2022, 1, 3)),  # after the report
        (None, day(2022, 1, 3), day(2022, 1, 1), day(2022, 1, 1)),
        (None, None, None, None),
        (day(1922, 1, 5), day(2022, 1, 3), day(2022, 1, 1), day(2022, 1, 1)),
        (day(2023, 1, 5), day(2022, 1, 3), day(2022, 1, 1), day(2022, 1, 3)),
        (day(2022, 1, 2), None, day(2022, 1, 2), day(2022, 1, 2)),
    ]
    frame = spark.createDataFrame(rows, "c date, r date, plain date, clamped date")
    args = (F.col("c"), F.col("r"), as_of)
    out = frame.select(
        times.event_date(*args).alias("a"),
        "plain",
        times.event_date(*args, clamp_future=True).alias("b"),
        "clamped",
    ).collect()
    assert [(r["a"], r["b"]) for r in out] == [(r["plain"], r["clamped"]) for r in out]


def test_round_week(spark):
    # 2022-01-02 is a Sunday
    days = [dt.date(2022, 1, 2) + dt.timedelta(days=i) for i in range(8)]
    back, ahead, later = dt.date(2022, 1, 2), dt.date(2022, 1, 9), dt.date(2022, 1, 9)
    expected = [back] * 4 + [ahead] * 3 + [later]
    assert values(spark, days, times.round_week(F.col("x")), "x date") == expected


def test_ages(spark):
    data = ["N/A", "0 to 4", "10 to 14", "75 to 79", "85+", None]
    assert values(spark, data, ages.age_start(F.col("x"))) == [None, 0, 10, 75, 85, None]
    assert values(spark, data, ages.age_end(F.col("x"))) == [None, 4, 14, 79, None, None]
    edges = [-1.0, 0.0, 9.0, 10.0, 14.0, 15.0, 19.0, 20.0, 29.0, 30.0, 39.0, 40.0, 64.0, 65.0, 74.0, 75.0, 120.0, None]
    labels = [None, "0 to 9", "0 to 9", "10 to 14", "10 to 14", "15 to 19", "15 to 19", "20 to 29", "20 to 29"]
    labels += ["30 to 39", "30 to 39", "40 to 64", "40 to 64", "65 to 74", "65 to 74", "75+", "75+", None]
    assert values(spark, edges, ages.age_bin(F.col("x")), "x double") == labels
    assert ages.age_labels(separator=" a ")[:2] == ["0 a 9", "10 a 14"]


def test_rates_are_null_not_nan(spark):
    frame = spark.createDataFrame([(0, 0), (1, 2), (None, 2)], "k long, n long")
    assert [r[0] for r in frame.select(rates.ratio(F.col("k"), F.col("n"))).collect()] == [None, 0.5, None]
    logits = values(spark, [0.0, 0.5, 1.0, None], rates.logit(F.col("x")), "x double")
    assert logits == [None, 0.0, None, None]
    assert values(spark, [0, 8], rates.log2_or_null(F.col("x")), "x long") == [None, 3.0]


def test_parse_mdy(spark):
    assert values(spark, ["3/9/2022", "12/31/2020", "x"], times.parse_mdy(F.col("x"))) == [
        dt.date(2022, 3, 9),
        dt.date(2020, 12, 31),
        None,
    ]


def _exact_quantile(q, n, k):
    from fractions import Fraction
    from math import comb

    p, total = Fraction(k, n), Fraction(0)
    for i in range(n + 1):
        total += comb(n, i) * p**i * (1 - p) ** (n - i)
        if total >= Fraction(q):
            return i
    return n


@pytest.mark.parametrize("n", [1, 2, 5, 17, 60, 95])
def test_binomial_quantile_is_exact(n):
    for k in range(0, n + 1, max(1, n // 7)):
        for q in ("0.025", "0.975"):
            assert tails.binomial_quantile(float(q), n, k / n) == _exact_quantile(q, n, k)


def test_binomial_quantile_limits():
    assert tails.binomial_quantile(0.025, 0, 0.3) == 0
    assert tails.binomial_quantile(0.975, 2, 1.0) == 2
    assert tails.binomial_quantile(0.025, 9, 0.0) == 0
    # normal limit: 126000 * 0.2 -+ 1.96 sd
    assert abs(tails.binomial_quantile(0.025, 126_000, 0.2) - (25_200 - 278.3)) < 2
    assert abs(tails.binomial_quantile(0.975, 10**10, 0.5) - (5e9 + 97_998.2)) < 2


def test_tails():
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_quantile(0.95, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert tails.t_quantile(0.95, 1) == pytest.approx(12.70620474, abs=1e-7)
    assert tails.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(18.30703805, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_other_clock_formats(spark):
    ten = dt.datetime(2022, 1, 2, 10, 0, 5)
    cases = {
        "2022-01-02 10:00:05": ten,
        "2022/01/02 10:00:05": ten,
        "2022.1.2 10.00.05": ten,
        "2022_01_02T10:00:05": ten,
        "20220102 100005": ten,
        "20220102100005": ten,
        "20220102T100005": ten,
        "20220102T140005Z": ten,
        "2022/01/02 14:00:05Z": ten,
        "2022/01/02 10:00:05-0400": ten,
        "2022/01-02 10:00:05": None,
        "2022/01/02 10:00.05": None,
        "2022/13/02 10:00:05": None,
        "2022/01/02": None,
        "20220102": None,
        "2022110 100005": None,
        "01/02/2022 10:00:05": None,
        "soon": None,
        None: None,
    }
    assert values(spark, cases, times.local_timestamp_any_form(F.col("x"))) == list(cases.values())
