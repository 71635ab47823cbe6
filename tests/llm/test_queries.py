"""Every registered training-data query on the small tables, against SQL or a plain version."""

import brute
import duckdb
import pytest

from posigauge.llm.queries import QUERIES, SQL

TABLES = ["documents", "embeddings", "labels"]


@pytest.fixture(scope="module")
def engine(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, engine, sf_dir):
    frame = QUERIES[name](spark, sf_dir)
    cursor = engine.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    assert sorted(frame.columns) == sorted(names)
    assert sorted((tuple(r) for r in frame.select(*names).collect()), key=repr) == want


def test_op1(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op1_substring_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute.substring(rows)


def test_op9(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op9_simhash"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == brute.simhash(rows)


def test_op4_and_op10_on_held_out_documents(spark, sf_dir):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [r for r in QUERIES["op4_toxicity"](spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(brute.fold(r["doc_id"], 5) == 0 for r in got)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in got) > 0.93 * len(got)
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = [r for r in QUERIES["op10_language_id"](spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in got) > 0.98 * len(got)


def test_op2_on_held_out_documents(spark, sf_dir):
    got = [r for r in QUERIES["op2_hmm"](spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["score"] > r["base_score"] for r in got) > 0.9 * len(got)
