"""Records with undeclared fields, sources that fail late, and the log's layout."""

import datetime as dt
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from posigauge import schemas
from posigauge.catalog import QUERIES
from posigauge.sources import files

COLUMNS = schemas.text_schema("testType", "patientId", "result")


def land(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


@pytest.mark.parametrize("lines", [True, False])
def test_undeclared_fields_keep_records_apart(spark, tmp_path, lines):
    base = {"testType": "a", "patientId": "1", "result": "x"}
    records = [
        base,
        base,
        base | {"lot": 1},
        base | {"lot": 2},
        base | {"lot": 2},
        {"lot": 2, "site": {"b": [1, None], "a": "é"}, **base},
        {"site": {"a": "é", "b": [1, None]}, **base, "lot": 2},
        {"patientId": 7, "result": None},
        {},
    ]
    text = "\n".join(map(json.dumps, records)) if lines else json.dumps(records)
    path = land(tmp_path / "log", "a.json", text)
    log = files.read_json_records(spark, path, COLUMNS, lines=lines)
    assert log.columns == ["testType", "patientId", "result", "rest"]
    got = sorted(map(tuple, log.distinct().collect()), key=repr)
    rest = [None, '{"lot":1}', '{"lot":2}', '{"lot":2,"site":{"a":"é","b":[1,null]}}']
    want = [("a", "1", "x", r) for r in rest] + [(None, "7", None, None), (None, None, None, None)]
    assert got == sorted(want, key=repr)


def test_single_record_files(spark, tmp_path):
    path = land(tmp_path / "log", "a.json", '{"testType": "a", "more": true}')
    assert [tuple(r) for r in files.read_json_records(spark, path, COLUMNS).collect()] == [("a", None, None, '{"more":true}')]


GOOD, BAD = '{"testType": "a", "patientId": "1", "result": "x"}\n', '{"testType": "a", "patient\n'


def candidate(spark, path):
    return lambda: files.read_accounted(spark, path, COLUMNS)


def test_a_bad_record_in_the_last_file_turns_to_the_next_source(spark, tmp_path):
    path = land(tmp_path / "new", "a.json", GOOD * 50)
    land(tmp_path / "new", "b.json", GOOD * 50 + BAD + GOOD)
    old = land(tmp_path / "old", "a.json", GOOD * 3)
    bad = files.corrupt_files(files.read_accounted(spark, path, COLUMNS)).collect()
    assert [(r[files.FILE].rsplit("/", 1)[1], r["n"], r["bad"]) for r in bad] == [("b.json", 52, 1)]
    got = files.read_first_available([candidate(spark, path), candidate(spark, old)])
    assert got.columns == COLUMNS.names and got.count() == 3
    with pytest.raises(FileNotFoundError):
        files.read_first_available([candidate(spark, path), candidate(spark, str(tmp_path / "none"))])


def test_csv_rows_of_the_wrong_width_count_as_bad(spark, tmp_path):
    path = land(tmp_path / "csv", "a.csv", "testType,patientId,result\na,1,x\na,1\n")
    frame = files.read_accounted(spark, path, COLUMNS, "csv", header="true")
    assert [r["bad"] for r in files.corrupt_files(frame).collect()] == [1]


def test_an_unreadable_file_behind_the_first_is_found(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    spark.range(1000).repartition(4).write.parquet(path)
    part = sorted((tmp_path / "snapshot").glob("*.parquet"))[-1]
    part.write_bytes(b"PAR1" + b"\0" * 100 + b"PAR1")
    (tmp_path / "snapshot" / f".{part.name}.crc").unlink(missing_ok=True)
    backup = spark.range(5)
    got = files.read_first_available([lambda: spark.read.schema("id long").parquet(path), lambda: backup])
    assert got.count() == 5


def scan_metrics(frame):
    frame.collect()
    found = {}

    def walk(p):
        if p.nodeName() == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if p.nodeName().startswith("Scan"):
            for name in ("numFiles", "numOutputRows", "numPartitions"):
                if p.metrics().contains(name):
                    found[name] = p.metrics().apply(name).value()
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return found


def test_a_slice_reads_its_month_only(spark, tmp_path):
    days = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 120).cast("int"))
    kinds = F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int"))
    log = spark.range(24_000).select("id", kinds.alias("testType"), days.alias("created"))
    path = str(tmp_path / "log")
    files.write_log(log, path, "created")
    assert len(list((tmp_path / "log").rglob("*.parquet"))) >= 8
    start, end = dt.date(2024, 2, 5), dt.date(2024, 2, 9)
    kept = files.read_log_slice(spark, path, "a", "created", start, end)
    want = log.where((F.col("testType") == "a") & (F.col("created") >= start) & (F.col("created") < end))
    assert sorted(r["id"] for r in kept.collect()) == sorted(r["id"] for r in want.collect())
    again = files.read_log_slice(spark, path, "a", "created", start, end)
    assert scan_metrics(again)["numFiles"] == 1  # one type, one month
    both = files.read_log_slice(spark, path, "a", "created", dt.date(2024, 1, 31), dt.date(2024, 3, 1))
    assert scan_metrics(both)["numFiles"] == 2  # March begins where the period ends


def test_rows_inside_a_file_are_in_order(spark, tmp_path):
    """So row groups and pages have narrow bounds, and the scan gets the period as a filter."""
    days = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.pmod(F.xxhash64("id"), F.lit(31))).cast("int"))
    path = str(tmp_path / "log")
    kinds = F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int"))
    files.write_log(spark.range(9000).select("id", kinds.alias("testType"), days.alias("created")), path, "created")
    for part in (tmp_path / "log").rglob("*.parquet"):
        created = pq.ParquetFile(part).read().column("created").to_pylist()
        assert created == sorted(created)
    files.write_log(spark.sql("select 1 as id, cast(null as string) as testType, date'2024-01-01' as created"), path + "n", "created")
    assert spark.read.parquet(path + "n").first()["testType"] is None
    kept = files.read_log_slice(spark, path, "a", "created", dt.date(2024, 1, 10), dt.date(2024, 1, 11))
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "GreaterThanOrEqual(created" in text


def test_joins_of_metrics_shuffle_nothing_again(spark, sf_dir):
    """One exchange for each aggregate, none above them."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        text = QUERIES["left_join_metrics"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    before = text[: text.index("Exchange")]
    assert before.count("Join") == 2
    assert text.count("Exchange ") == 3
