"""Order statistics, quantiles, binned densities and fingerprints against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from posigauge.operators import cleaning, ordering, selection, summaries


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


GROUPED = "g string, v double"


def grouped_rows():
    rng = random.Random(4)
    rows = [("even", float(i)) for i in range(3000)]
    rows += [("steep", 10.0**-k) for k in range(300)] + [("steep", -(10.0**k)) for k in range(300)]
    rows += [("ties", 1.5)] * 2000 + [("ties", 2.5)] * 3
    rows += [("hot", rng.gauss(0, 1)) for _ in range(9000)]
    rows += [(None, 7.0), (None, 9.0), ("one", 4.0), ("none", None), ("nan", float("nan")), ("nan", 3.0)]
    rows += [("wide", 1.7e308), ("wide", -1.7e308), ("wide", 0.0)]
    return rows


def test_ranks_are_exact(spark):
    rows = grouped_rows()
    frame = spark.createDataFrame(rows, GROUPED).repartition(5)
    n = F.col("n")
    ranks = {"first": F.lit(1), "middle": (n + 1) / 2, "last": n, "third": F.lit(3), "none": n + 1}
    got = {r["g"]: r for r in selection.order_statistics(frame, ["g"], "v", ranks).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        values.sort()
        want = (len(values), values[0], values[(len(values) + 1) // 2 - 1], values[-1], values[2] if len(values) > 2 else None, None)
        assert tuple(got[g][c] for c in ("n", *ranks)) == want


def test_ranks_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(selection, "SMALL_STATE", 0)
    frame = spark.createDataFrame([(str(i % 50), float(i * 37 % 1009)) for i in range(2000)], GROUPED)
    got = {r["g"]: r["m"] for r in selection.order_statistics(frame, ["g"], "v", {"m": F.lit(7)}).collect()}
    want = {str(g): sorted(float(i * 37 % 1009) for i in range(2000) if i % 50 == g)[6] for g in range(50)}
    assert got == want


def test_ranks_of_long_integers(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 2)
    rng = random.Random(8)
    values = [rng.randrange(-(2**61), 2**61) for _ in range(300)] + [2**60 + i for i in range(300)]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    got = selection.order_statistics(frame, [], "v", {f"x{r}": F.lit(r) for r in (1, 200, 450, 600)}).first()
    assert [got[f"x{r}"] for r in (1, 200, 450, 600)] == [sorted(values)[r - 1] for r in (1, 200, 450, 600)]


def test_infinite_values_are_refused(spark):
    frame = spark.createDataFrame([("a", float("inf"))], GROUPED)
    with pytest.raises(Exception, match="infinite"):
        selection.order_statistics(frame, ["g"], "v", {"x": F.lit(1)}).collect()


def test_quantiles_interpolate(spark):
    values = np.random.default_rng(2).normal(size=501)
    frame = spark.createDataFrame([("a", float(v)) for v in values], GROUPED)
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}
    got = selection.quantiles(frame, ["g"], "v", shares).first()
    assert [got[c] for c in shares] == pytest.approx(np.quantile(values, list(shares.values())), abs=1e-12)
    assert selection.quantiles(frame.limit(0), ["g"], "v", shares).count() == 0


def test_box_and_halves_neither_buffer_nor_sort(spark):
    frame = spark.createDataFrame([(i, float(i % 97)) for i in range(1000)], "k long, v double")
    box = plan(summaries.box_stats(frame.withColumn("g", F.col("k") % 2), ["g"], "v"))
    assert "percentile" not in box and "ObjectHashAggregate" not in box
    halves = ordering.hash_halves(frame, "k", "s")
    assert "Exchange" not in plan(halves) and "Sort" not in plan(halves)
    assert halves.where("is_train").count() == 500
    assert ordering.hash_halves(frame.limit(0), "k", "s").count() == 0
    assert [r["is_train"] for r in ordering.hash_halves(frame.limit(1), "k", "s").collect()] == [False]


def plain_density(values, points):
    values = np.sort(values)
    q1, q3 = np.quantile(values, [0.25, 0.75])
    sd, iqr = values.std(ddof=1), (q3 - q1) / 1.34
    h = 0.9 * (min(sd, iqr) if iqr > 0 else sd) * len(values) ** -0.2
    x = np.linspace(values[0], values[-1], points)
    return x, np.exp(-(((x[:, None] - values) / h) ** 2) / 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi)), h


@pytest.mark.parametrize("bins", [64, 512, 8192])
def test_density_error_is_within_its_bound(spark, bins):
    values = np.concatenate([np.random.default_rng(5).gamma(2.0, size=3000), np.full(500, 1.25)])
    frame = spark.createDataFrame([("a", float(v)) for v in values], GROUPED).repartition(4)
    got = sorted(summaries.kernel_density(frame, ["g"], "v", 64, bins).collect(), key=lambda r: r["point"])
    x, want, h = plain_density(values, 64)
    assert [r["x"] for r in got] == pytest.approx(x, abs=1e-9)
    gap = (values.max() - values.min()) / bins
    bound = 9 / 128 * (gap / h) ** 4 / (h * math.sqrt(2 * math.pi)) + 1e-12
    assert max(abs(r["density"] - w) for r, w in zip(got, want, strict=True)) <= bound


def test_density_of_one_value(spark):
    frame = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 1.0)], GROUPED)
    got = summaries.kernel_density(frame, ["g"], "v", 4).collect()
    assert len(got) == 8 and {r["density"] for r in got} == {None}


def test_density_rows_do_not_grow_with_the_log(spark):
    """After the first aggregate there is a row per group and bin at most."""
    for copies in (1, 40):
        frame = spark.range(500 * copies).select(F.lit("a").alias("g"), (F.rand(1) * 10).alias("v"))
        binned = summaries.kernel_density(frame, ["g"], "v", 8, 32)
        text = plan(binned)
        assert text.index("Generate explode") < text.index("Generate posexplode") < text.rindex("HashAggregate")
        assert binned.count() == 8


# distinct rows by fingerprint


def odd_table(spark):
    rows = [(i % 700, "x" * (i % 5), None if i % 3 else i % 2) for i in range(1000)] + [(None, None, None)] * 3
    return spark.createDataFrame(rows, "a long, b string, c int").repartition(4)


@pytest.mark.parametrize("bits", [6, 8, 26])
def test_fingerprints_change_no_result(spark, bits):
    frame = odd_table(spark)
    got = cleaning.distinct_by_fingerprint(frame, bits)
    assert got.columns == frame.columns
    want = sorted(map(repr, frame.distinct().collect()))
    assert sorted(map(repr, got.collect())) == want
    assert cleaning.distinct_by_fingerprint(frame.limit(0)).count() == 0


def test_whole_rows_are_shuffled_only_if_they_recur(spark, tmp_path):
    spark.range(5000).select("id", F.repeat(F.lit("wide "), 40).alias("text")).union(
        spark.range(7).select("id", F.repeat(F.lit("wide "), 40))
    ).write.parquet(str(tmp_path / "t"))
    frame = cleaning.distinct_by_fingerprint(spark.read.parquet(str(tmp_path / "t")))
    assert len(frame.collect()) == 5000
    node, wide = frame._jdf.queryExecution().executedPlan(), []

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            walk(p.executedPlan())
        elif "QueryStage" in name:
            walk(p.plan())
        elif name == "Exchange":
            wide.append(p.metrics().apply("shuffleRecordsWritten").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(node)
    assert 7 <= sum(wide) <= 14  # the seven rows and their copies, combined or not
