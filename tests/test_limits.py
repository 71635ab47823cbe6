"""Readers that follow the header, offsets, and iterations that say when they are not settled."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from posigauge import schemas
from posigauge.functions import tails, times
from posigauge.operators import counts, glm
from posigauge.sources import files


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_follows_the_header(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        "date,location,extra,people_vaccinated,total_vaccinations,total_distributed\n2022-01-01,here,x,3,2,1\n",
    )
    row = files.read_csv(spark, path, schemas.VACCINES).first()
    assert row.asDict() == {
        "location": "here",
        "date": "2022-01-01",
        "total_distributed": "1",
        "total_vaccinations": "2",
        "people_vaccinated": "3",
        "people_fully_vaccinated": None,
    }


@pytest.mark.parametrize("schema", [schemas.VACCINES, schemas.LEGACY_HOSPITAL, schemas.HOSPITAL, schemas.DEATHS])
def test_csv_with_one_absent_column(spark, tmp_path, schema):
    names = schema.fieldNames()
    for n, gone in enumerate(names):
        kept = [c for c in reversed(names) if c != gone]
        path = write(tmp_path / f"{n}.csv", ",".join(kept) + "\n" + ",".join(f"v{c}" for c in kept) + "\n")
        row = files.read_csv(spark, path, schema).first().asDict()
        assert row == {c: None if c == gone else f"v{c}" for c in names}
        if n == 3:
            break


def test_fallback_tries_a_row(spark, tmp_path):
    good = write(tmp_path / "good.csv", "a\n1\n")
    empty = write(tmp_path / "empty.csv", "a\n")
    schema = schemas.text_schema("a")
    got = files.read_first_available(
        [
            lambda: spark.read.parquet(str(tmp_path / "absent")),
            lambda: spark.read.schema(schema).parquet(good),
            lambda: files.read_csv(spark, empty, schema),
            lambda: files.read_csv(spark, good, schema),
        ]
    )
    assert [r["a"] for r in got.collect()] == ["1"]


def test_offsets(spark):
    texts = ["2022-03-01 12:00:00" + z for z in ("", "Z", "+00", " UTC", "+0000", "+00:00", "-04", " GMT")]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in frame.select(times.local_timestamp(F.col("t"))).collect()]
    local, from_utc = dt.datetime(2022, 3, 1, 12), dt.datetime(2022, 3, 1, 8)
    assert got == [local, *[from_utc] * 5, local, from_utc]


def test_every_stratum_keeps_every_region(spark):
    tests = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "testType string, region string, n long")
    people = spark.createDataFrame([("x", 10), ("y", 20), ("z", 30)], "region string, population long")
    got = counts.rate_per_thousand(tests, people, by={"testType": ["a", "b"]}).collect()
    assert {(r["testType"], r["region"]): r["n"] for r in got} == {
        ("a", "x"): 1, ("a", "y"): 2, ("a", "z"): None, ("b", "x"): 3, ("b", "y"): None, ("b", "z"): None,
    }


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i / 10, 2 + i % 5, 40 + i) for i in range(30)]
    frame = spark.createDataFrame(data, "x double, k long, n long")
    return glm.model_rows(frame, "x", "k", "n")


def test_fits_say_when_they_are_not_settled(rows):
    share = rows.agg(F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()[0]
    with pytest.raises(glm.NotConverged):
        glm._fit_log(rows, share, max_steps=1)
    fit = glm.fit_binomial(rows, "x", "log")
    with pytest.raises(glm.NotConverged):
        glm.profile_interval(rows, fit, rounds=2)
    assert glm.profile_interval(rows, fit).count() == 2
    with pytest.raises(glm.NotConverged):
        glm.check_settled(glm.evaluate(rows, "logit", [(0.0, 0.0)])[0])


def test_log_gamma():
    import math

    import pandas as pd

    x = np.array([1, 1.5, 2, 3, 10, 1e3, 1e7])
    assert glm._log_gamma(pd.Series(x)).to_numpy() == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-11)


def test_both_bounds_in_one_pass(spark):
    frame = spark.createDataFrame([(10.0, 0.3), (None, 0.5), (1000.0, 0.01)], "n double, p double")
    both = tails.binomial_quantiles_col((0.025, 0.975), F.col("n"), F.col("p"))
    got = frame.select(both["q0"].alias("a"), both["q1"].alias("b"))
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = [(tails.binomial_quantile(0.025, n, p), tails.binomial_quantile(0.975, n, p)) if n else (None, None) for n, p in frame.collect()]
    assert [tuple(r) for r in got.collect()] == want
