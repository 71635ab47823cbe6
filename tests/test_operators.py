"""Operators on small frames, against plain Python."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from posigauge import schemas
from posigauge.operators import (
    cleaning,
    counts,
    episodes,
    glm,
    joins,
    ordering,
    pairs,
    people,
    reshape,
    rolling,
    smooth,
)
from posigauge.plans import agreement, cleaning as clean_plan, dashboard, modelling, panels, positivity
from posigauge.session import scratch_path
from posigauge.sources import files

D0 = dt.date(2022, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def random_log(seed, rows=400, people_=12, days=60, types=("Molecular", "AntigensSelfTest", "Antigens")):
    """Third of the rows on one person, some without an id, many copies."""
    rng = random.Random(seed)
    out = []
    for _ in range(rows):
        person = "hot" if rng.random() < 0.35 else f"p{rng.randrange(people_)}"
        d = rng.randrange(days)
        out.append(
            (
                rng.choice(types),
                None if rng.random() < 0.05 else person,
                rng.choice(["positive", "negative", "other"]),
                day(d),
                day(d + rng.choice([0, 0, 1, 3, 9])),
            )
        )
    return out


SCHEMA = "testType string, patientId string, result string, date date, entry_date date"


def log(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_strict_windows(spark):
    rows = [("a", day(i), i if i != 9 else None) for i in range(18)] + [("b", day(i), 1) for i in range(6)]
    frame = spark.createDataFrame(rows, "g string, date date, x long")
    w = rolling.series(["g"])
    out = frame.select(
        "g",
        "date",
        rolling.rolling_sum(F.col("x"), w).alias("s"),
        rolling.rolling_mean_fill0(F.col("x"), w).alias("f"),
        rolling.centered_mean(F.col("x"), w).alias("c"),
    )
    got = {(r["g"], r["date"]): r for r in out.collect()}
    assert got[("a", day(5))]["s"] is None and got[("a", day(6))]["s"] == 21
    assert got[("a", day(9))]["s"] is None and got[("a", day(15))]["s"] is None
    assert got[("a", day(16))]["s"] == sum(range(10, 17))
    assert got[("a", day(5))]["f"] == 0 and got[("a", day(6))]["f"] == 3 and got[("a", day(12))]["f"] is None
    assert got[("a", day(3))]["c"] == 3 and got[("a", day(2))]["c"] is None
    assert all(got[("b", day(i))]["s"] is None for i in range(6))
    with pytest.raises(ValueError):
        rolling.centered_mean(F.col("x"), w, 6)


def test_forward_max_and_present_mean(spark):
    data = [(day(i), v) for i, v in enumerate([None, 3.0, None, 2.0, None, 5.0])]
    frame = spark.createDataFrame(data, "date date, x double")
    filled = frame.withColumn("x", rolling.forward_max(F.col("x"), rolling.series())).orderBy("date")
    assert [r["x"] for r in filled.collect()] == [None, 3.0, 3.0, 2.0, 3.0, 5.0]
    sparse = spark.createDataFrame(
        [(day(i), float(i) if i % 2 else None) for i in range(16)], "date date, x double"
    )
    means = {r["date"]: r["m"] for r in rolling.mean_of_present(sparse, "x", "m").collect()}
    assert means[day(13)] == np.mean([1, 3, 5, 7, 9, 11, 13]) and means[day(11)] is None and means[day(14)] is None


def test_positivity_windows_stop_at_strata(spark):
    rows = [(t, f"p{i}", "positive", day(i), day(i)) for i in range(8) for t in ("Molecular", "AntigensSelfTest")]
    both = log(spark, rows).withColumn("region", F.explode(F.array(F.lit("N"), F.lit("S"))))
    own = positivity.positivity(both, ["region"], start=None)
    assert own.where("n7_Molecular is not null").count() == 4
    assert [r[0] for r in own.where("n7_Molecular is not null").select("n7_Molecular").distinct().collect()] == [7]
    across = positivity.positivity(both, ["region"], start=None, across_strata=True)
    assert across.where("n7_Molecular is not null").count() == 16 - 6


def test_channel_counts_equal_pivot(spark):
    frame = log(spark, random_log(1)).where("testType <> 'Antigens'")
    direct = counts.channel_counts(frame, ["date"])
    pivoted = reshape.pivot_channels(counts.positive_counts(frame, ["testType", "date"]), ["date"])
    assert sorted(map(tuple, direct.collect()), key=str) == sorted(
        map(tuple, pivoted.select(direct.columns).collect()), key=str
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("count_missing", [False, True])
def test_trailing_week_equals_a_loop(spark, seed, count_missing):
    data = [r for r in random_log(seed, 300) if r[2] != "other"]
    first = day(5)
    got = people.trailing_week_people(
        log(spark, data).repartition(5), first, count_missing=count_missing, bounds=False
    ).collect()
    expected = {}
    for t in {r[0] for r in data}:
        mine = [r for r in data if r[0] == t]
        last = max(r[3] for r in mine)
        d = first + dt.timedelta(days=7)
        while d <= last:
            week = [r for r in mine if d - dt.timedelta(days=7) < r[3] <= d]
            week = [r for r in week if count_missing or r[1] is not None]
            known = [r for r in week if r[4] <= d]
            expected[(t, d)] = tuple(
                len({r[1] for r in rows if not positive or r[2] == "positive"})
                for rows in (week, known)
                for positive in (False, True)
            )
            d += dt.timedelta(days=1)
    assert {
        (r["testType"], r["date"]): (
            r["people_total_week"],
            r["people_positives_week"],
            r["obs_people_total_week"],
            r["obs_people_positives_week"],
        )
        for r in got
    } == expected


def test_trailing_week_shows_empty_weeks(spark):
    """Records before the first day count, weeks without tests are 0 with no rate."""
    days = [-2, 10, 40]
    data = [("T", f"p{d}", "positive", day(d), day(d + 2)) for d in days]
    rows = people.trailing_week_people(log(spark, data), day(0)).orderBy("date").collect()
    assert [r["date"] for r in rows] == [day(i) for i in range(7, 41)]
    busy = set(range(10, 17)) | {40}
    for r in rows:
        i = (r["date"] - D0).days
        assert r["people_total_week"] == r["people_positives_week"] == int(i in busy)
        assert r["fit"] == (1.0 if i in busy else None) and r["lower"] == r["fit"]
        assert r["obs_people_total_week"] == int(i in set(range(12, 17)))


def test_daily_people_equal_sets(spark):
    data = random_log(4)
    by_day = defaultdict(list)
    for r in data:
        by_day[(r[0], r[3])].append(r)
    for missing in (False, True):
        got = {
            (r["testType"], r["date"]): (r["people_total"], r["people_positives"], r["tests_total"])
            for r in people.daily_people(log(spark, data), count_missing=missing).collect()
        }
        assert got == {
            key: (
                len({r[1] for r in rows if missing or r[1] is not None}),
                len({r[1] for r in rows if r[2] == "positive" and (missing or r[1] is not None)}),
                len(rows),
            )
            for key, rows in by_day.items()
        }


def test_episodes(spark):
    days = [0, 0, 89, 189, 289, 489]  # gaps 0, 89, 100, 100, 200
    data = [("T", "p", "positive", day(d), day(d)) for d in days]
    frame = log(spark, data)
    gap = Counter()
    for r in episodes.episode_ids(frame).collect():
        gap[(r["date"], r["newId"])] += r["rows"]
        assert r["n"] == 6
    assert gap == Counter(
        {
            (day(0), "p-0"): 2,
            (day(89), "p-0"): 1,
            (day(189), "p-1"): 1,
            (day(289), "p-1"): 1,
            (day(489), "p-2"): 1,
        }
    )
    firsts = {r["date"] for r in episodes.first_per_episode(frame).collect()}
    assert firsts == {day(0), day(189), day(489)}
    running = {r["date"] for r in episodes.first_per_episode(frame, mode="cumulative").collect()}
    assert running == {day(0), day(189), day(289), day(489)}
    with pytest.raises(ValueError):
        episodes.episode_days(frame, mode="x")


def test_same_day_repeats_do_not_carry_the_gap(spark):
    data = [("T", "p", "positive", day(d), day(d)) for d in (0, 100, 100, 100)]
    got = {(r["date"], r["newId"]): r["rows"] for r in episodes.episode_ids(log(spark, data)).collect()}
    assert got == {(day(0), "p-0"): 1, (day(100), "p-1"): 1, (day(100), "p-0"): 2}


@pytest.mark.parametrize("seed", [5, 6])
def test_pairs_equal_brute_force(spark, seed):
    data = random_log(seed, 250)
    frame = log(spark, data).repartition(6)
    close = Counter()
    hit = set()
    for i, a in enumerate(data):
        for j, b in enumerate(data):
            if a[1] is not None and a[1] == b[1] and a[0] != b[0] and abs((a[3] - b[3]).days) <= 7:
                hit.add(i)
                if a[0] < b[0]:
                    close[(a[1], a[0], a[3], b[0], b[3])] += 1
    semi = Counter(tuple(r) for r in pairs.interval_semi(frame).select(*SCHEMA.split()[::2]).collect())
    assert semi == Counter(data[i] for i in hit)
    got = pairs.interval_pairs(frame).collect()
    assert {
        (r["patientId"], r["testType_a"], r["date_a"], r["testType_b"], r["date_b"]): r["pairs"] for r in got
    } == dict(close)
    assert len(got) == len(close)


def test_multi_type_people(spark):
    data = random_log(7, 60)
    types = defaultdict(set)
    for r in data:
        types[r[1]].add(r[0])
    expected = {p for p, t in types.items() if p and len(t) > 1}
    assert {r[0] for r in pairs.multi_type_people(log(spark, data)).collect()} == expected


def test_group_counts_do_not_lose_rows(spark):
    data = random_log(8)
    size = Counter((r[0], r[3]) for r in data)
    rows = pairs.attach_group_counts(log(spark, data)).collect()
    assert len(rows) == len(data)
    assert all(r["n"] == size[(r["testType"], r["date"])] for r in rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_indexes_do_not_depend_on_partitions(spark, parts):
    rows = [(random.Random(i).randrange(40), "x") for i in range(500)]
    frame = spark.createDataFrame(rows, "k long, v string").repartition(parts)
    numbered = ordering.row_index(frame, ["k"]).collect()
    assert sorted(r["index"] for r in numbered) == list(range(1, 501))
    assert [r["k"] for r in sorted(numbered, key=lambda r: r["index"])] == sorted(k for k, _ in rows)
    dense = {r["k"]: r["i"] for r in ordering.dense_index(frame, "k", "i").collect()}
    assert dense == {k: i for i, k in enumerate(sorted({k for k, _ in rows}), 1)}


def test_halves_are_exact_and_disjoint(spark):
    frame = spark.range(101).withColumnRenamed("id", "k")
    for parts in (1, 4):
        halves = ordering.hash_halves(frame.repartition(parts), "k", "s").collect()
        train = {r["k"] for r in halves if r["is_train"]}
        assert len(train) == 50 and len(halves) == 101
    other = {r["k"] for r in ordering.hash_halves(frame, "k", "t").collect() if r["is_train"]}
    assert other != train


def test_first_per_group_puts_nulls_last(spark):
    rows = [("g", None, "a"), ("g", day(3), "b"), ("g", day(3), "a"), ("h", None, "z")]
    frame = spark.createDataFrame(rows, "g string, d date, v string")
    assert {tuple(r) for r in ordering.first_per_group(frame, ["g"], ["d"]).collect()} == {
        ("g", day(3), "a"),
        ("h", None, "z"),
    }


def test_distinct_union_and_domain(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "a long, b string")
    b = spark.createDataFrame([(2,)], "a long")
    assert {tuple(r) for r in cleaning.distinct_rows(cleaning.union_by_name(a, b)).collect()} == {(1, "x"), (2, None)}
    with pytest.raises(ValueError):
        cleaning.union_by_name(a, b, strict=True)
    assert cleaning.select_numeric(a).columns == ["a"]
    combined = cleaning.add_combined_type(
        spark.createDataFrame([("Molecular",), ("Antigens",), ("Other",)], "testType string")
    )
    assert Counter(r[0] for r in combined.collect()) == Counter(
        {"Molecular": 1, "Antigens": 1, "Other": 1, "Molecular+Antigens": 2}
    )


def test_clean_tests_pipeline(spark):
    head = "testType string, patientId string, result string, collectedDate string, reportedDate string, ageRange string, region string"
    rows = [
        ("Molecular", "1", "COVID-19 Positive", "2022-01-02T02:00:00Z", "2022-01-03 10:00:00", "0 to 4", "Bayamon"),
        ("Molecular", "1", "COVID-19 Positive", "2022-01-02T02:00:00Z", "2022-01-03 10:00:00", "0 to 4", "Bayamon"),
        ("Molecular", "2", "negative", None, "2022-01-03T10:00:00", "N/A", "N/A"),
        ("Molecular", "3", "negative", "1922-01-02 10:00:00", "2022-01-03 10:00:00", "85+", None),
        ("Molecular", "4", "negative", None, None, "85+", None),
        ("Molecular", "5", "negative", "2022-07-02 10:00:00", "2022-07-02 11:00:00", "85+", None),
    ]
    raw = spark.createDataFrame(rows, head)
    out = clean_plan.clean_tests(raw, as_of=dt.date(2022, 7, 1), bin_ages=True).collect()
    got = {r["patientId"]: (r["date"], r["result"], r["region"], r["ageRange"]) for r in out}
    assert len(out) == 3 and got == {
        "1": (dt.date(2022, 1, 1), "positive", "Bayamón", "0 to 9"),
        "2": (dt.date(2022, 1, 1), "negative", "No reportada", "No reportada"),
        "3": (dt.date(2022, 1, 1), "negative", "No reportada", "75+"),
    }
    dropped = clean_plan.clean_tests(raw, as_of=dt.date(2022, 7, 1), mode="drop").collect()
    assert [r["patientId"] for r in dropped] == ["1"]


def test_deaths_use_eight_bins(spark):
    rows = [("75 to 79", "2022-01-02 10:00:00", "CONFIRMADO", "F"), ("N/A", "bad", "PROBABLE", "M")]
    out = clean_plan.clean_deaths(spark.createDataFrame(rows, schemas.DEATHS)).collect()
    assert [(r["ageRange"], r["date"]) for r in out] == [("75+", dt.date(2022, 1, 2)), (None, None)]


def test_agreement_sample_and_all(spark):
    rows = []
    for i in range(6):
        rows += [("Molecular", f"p{i}", "positive", day(0), day(0)), ("AntigensSelfTest", f"p{i}", "negative", day(i * 2), day(0))]
    frame = log(spark, rows)
    everyone = agreement.agreement(frame, start=D0, sample_n=None)
    assert {r["patientIndex"] for r in everyone.collect()} == {1, 2, 3, 4}  # 8 and 10 days apart drop out
    two = agreement.agreement(frame, start=D0, sample_n=2).collect()
    assert {r["patientId"] for r in two} == {"p0", "p1"} and len(two) == 4
    assert all(r["top"] - r["bottom"] == 2 for r in two)
    assert {r["n"] for r in two if r["testType"] == "Molecular"} == {6}


def test_dashboard_panel_is_complete(spark):
    frame = log(spark, random_log(9, 600))
    panel = dashboard.dashboard(frame, D0)
    rows = panel.collect()
    known = [r for r in random_log(9, 600) if r[2] != "other"]
    keys = {(r[0], r[3]) for r in known} | {
        ("Molecular+Antigens", r[3]) for r in known if r[0] in ("Molecular", "Antigens")
    }
    assert {(r["testType"], r["date"]) for r in rows} == keys and len(rows) == len(keys)
    assert all(r["cases"] is not None and r["negative_cases"] is not None for r in rows)
    assert all(r["lower"] <= r["fit"] <= r["upper"] for r in rows if r["fit"] is not None)


def test_compare_deviance_only_nested(spark):
    rng = np.random.default_rng(1)
    data = [(float(x), int(rng.binomial(50, 0.1 + 0.3 * x)), 50) for x in rng.random(40)]
    rows = glm.model_rows(spark.createDataFrame(data, "x double, k long, n long"), "x", "k", "n")
    a, b = glm.fit_binomial(rows, "x"), glm.fit_binomial(rows, "x", "log")
    table = glm.compare_deviance(rows, a, b).collect()
    assert [r["p_value"] for r in table] == [None, None]
    wald = dict((t, (lo, hi)) for t, lo, hi in glm.wald_interval(a))
    profile = {r["term"]: (r["lower"], r["upper"]) for r in glm.profile_interval(rows, a).collect()}
    for term, (lo, hi) in profile.items():
        assert lo == pytest.approx(wald[term][0], rel=0.1) and hi == pytest.approx(wald[term][1], rel=0.1)
    with pytest.raises(ValueError):
        glm.fit_binomial(rows, "x", "probit")


def test_log_link_near_the_border(spark):
    """Shares close to 1, where a full step would leave the means below 1."""
    data = [(0.0, 5, 100), (0.5, 40, 100), (0.9, 97, 100), (1.0, 99, 100)]
    rows = glm.model_rows(spark.createDataFrame(data, "x double, k long, n long"), "x", "k", "n")
    fit = glm.fit_binomial(rows, "x", "log")
    assert fit.intercept + fit.slope < 0
    for eps in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
        near = glm.evaluate(rows, "log", [(fit.intercept + eps[0], fit.slope + eps[1])])[0]
        assert near is None or near.deviance >= fit.deviance - 1e-9


def test_spline_and_loess(spark):
    line = spark.createDataFrame([("a", day(i), 2.0 * i + 1) for i in range(40)], "g string, date date, y double")
    for out in (
        smooth.spline_smooth(line, ["g"], "date", "y", "s", penalty=10.0),
        smooth.loess_smooth(line, ["g"], "date", "y", "s", span=0.3),
    ):
        got = {r["date"]: r["s"] for r in out.collect()}
        assert len(got) == 40
        assert all(got[day(i)] == pytest.approx(2 * i + 1, abs=1e-6) for i in range(40))
    # no penalty: least squares over natural cubic splines, solved densely
    x = np.arange(30.0)
    y = np.sin(x / 5) + 0.1 * np.cos(3 * x)
    fit = smooth._spline(x, y, 10, 0.0)
    knots = smooth._knots(x, 10)
    truncated = [np.maximum(x - k, 0) ** 3 for k in knots]
    last = (truncated[-2] - truncated[-1]) / (knots[-1] - knots[-2])
    columns = [np.ones_like(x), x]
    columns += [(truncated[i] - truncated[-1]) / (knots[-1] - knots[i]) - last for i in range(len(knots) - 2)]
    dense = np.column_stack(columns)
    best = dense @ np.linalg.lstsq(dense, y, rcond=None)[0]
    assert np.allclose(fit, best, atol=1e-6)
    heavy = smooth._spline(x, y, 10, 1e5)
    assert np.allclose(heavy, np.polyval(np.polyfit(x, y, 1), x), atol=1e-3)


def test_weekday_columns_and_long_form(spark):
    frame = spark.createDataFrame([(dt.date(2022, 1, 2), 1), (dt.date(2022, 1, 5), 2)], "date date, v int")
    hot = reshape.weekday_one_hot(frame).collect()
    assert (hot[0]["Sunday"], hot[0]["Monday"], hot[1]["Wednesday"]) == (1, 0, 1)
    long = reshape.unpivot_long(frame, ["date"]).collect()
    assert [r["predictor_value"] for r in long] == [1.0, 2.0]


def test_prediction_fills_before_reshaping(spark):
    rows = [(0.1, 0.2), (None, 0.3)]
    table = spark.createDataFrame(rows, "x double, v double")
    fit = glm.BinomialFit("logit", "x", -1.0, 2.0, 1, 0, 1, 2, 1, 1, 1, 1)
    out = {(r["predictors"], r["predictor_value"]) for r in modelling.prediction_long(table, fit, ["v"]).collect()}
    assert ("p_hat", 0.0) in out and ("v", 0.3) in out


def test_files(spark):
    assert len(schemas.HOSPITAL_COUNTERS) == 37
    tests = spark.range(50).selectExpr("id", "cast(id % 3 as string) testType", "cast(id as string) patientId")
    path = scratch_path(spark, "slices")
    files.write_json_slices(tests, path, "id", rows_per_slice=7)
    back = files.read_json_log(spark, path, schemas.TESTS)
    assert back.count() == 50 and back.where("result is not null").count() == 0
    lines = scratch_path(spark, "lines")
    tests.write.json(lines)
    assert files.read_json_log(spark, lines, schemas.TESTS, lines=True).count() == 50
    missing = scratch_path(spark, "missing")
    with pytest.raises(FileNotFoundError):
        files.read_first_available([lambda: files.read_snapshot(spark, missing)])


def test_slices_prune_partitions(spark):
    frame = log(spark, random_log(10)).withColumn("created", F.col("date"))
    path = scratch_path(spark, "sliced")
    files.write_snapshot(frame, path, ["testType"])
    kept = files.read_slice(files.read_snapshot(spark, path), "Molecular", "created", day(0), day(10))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(testType" in plan and "PushedFilters: [IsNotNull(created)" in plan
    assert kept.count() == sum(1 for r in random_log(10) if r[0] == "Molecular" and r[3] < day(10))


def test_rebalanced_snapshot_is_whole(spark):
    frame = log(spark, random_log(11))
    path = scratch_path(spark, "even")
    files.write_snapshot(frame, path, ["testType"], rebalance=True)
    back = files.read_snapshot(spark, path).select(frame.columns)
    assert Counter(map(tuple, back.collect())) == Counter(random_log(11))
    joined = frame.selectExpr("testType as `a.x`", "date as b", "result as `c.y`")
    assert cleaning.drop_containing(joined, ".x", ".y").columns == ["b"]


def test_smoothed_daily_model(spark):
    rng = random.Random(3)
    data = []
    for i in range(40):
        for t, n in (("Molecular", 30), ("AntigensSelfTest", 10)):
            share = 0.2 + 0.01 * i
            data += [(t, f"p{j}", "positive" if rng.random() < share else "negative", day(i), day(i)) for j in range(n)]
    frame = log(spark, data)
    plain = modelling.daily_model(frame, start=D0, outliers=[])
    smoothed = modelling.daily_model(frame, start=D0, outliers=[], penalty=1e-3)
    assert plain.fit.observations == smoothed.fit.observations == 20
    assert smoothed.fit.slope > plain.fit.slope > 0
    assert smoothed.predicted.where("fit is not null and ribbon_low < fit").count() == 20
    all_positive = log(spark, [d for d in data if d[2] == "positive"])
    with pytest.raises(ValueError):
        modelling.daily_model(all_positive, start=D0, outliers=[])


def test_hospital_panel_prefers_new_counters(spark):
    beds = spark.createDataFrame(
        [(str(day(i)), "5" if i else None, "2", "1", None, "3") for i in range(8)],
        "FE_REPORTE string, CAMAS_ADULTOS_COVID string, CAMAS_ICU_COVID string, CAMAS_ICU_DISP string, CAMAS_PED_COVID string, CAMAS_PICU_COVID string",
    )
    legacy = spark.createDataFrame(
        [("1/1/2022", "9", "8", "7"), ("1/20/2022", "4", "4", "4")], schemas.LEGACY_HOSPITAL
    )
    vaccines = spark.createDataFrame([("PR", "2022-01-01", "1", "1", "1", None), ("XX", "2022-01-02", "9", "9", "9", "9")], schemas.VACCINES)
    deaths = spark.createDataFrame([(day(3),), (day(3),), (day(40),)], "date date")
    panel = panels.hospital_panel(
        clean_plan.clean_hospital(beds),
        clean_plan.clean_legacy_hospital(legacy),
        panels.fill_vaccines(clean_plan.clean_vaccines(vaccines), "PR"),
        deaths,
        D0,
    )
    rows = {r["date"]: r for r in panel.collect()}
    assert rows[day(0)]["HospitCOV19"] == 9 and rows[day(1)]["HospitCOV19"] == 5
    assert rows[day(19)]["HospitCOV19"] == 4 and rows[day(3)]["IncMueSalud"] == 2 and rows[day(40)]["IncMueSalud"] == 1
    assert rows[day(7)]["hosp_week_avg"] == 5 and rows[day(6)]["hosp_week_avg"] == pytest.approx((9 + 6 * 5) / 7)
    assert rows[day(7)]["ped_hosp_week_avg"] is None and rows[day(7)]["picu_week_avg"] == 3
    assert rows[day(0)]["people_fully_vaccinated"] is None and len(rows) == 10
