"""Every named query against its SQL on the small tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def engine(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def _rows(columns, rows):
    order = sorted(columns)
    where = [list(columns).index(c) for c in order]
    clean = (
        tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in row) for row in rows
    )
    return order, Counter(repr(tuple(row[i] for i in where)) for row in clean)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_matches_sql(name, spark, engine, sf_dir):
    frame = entry_module.queries()[name](spark, sf_dir)
    columns, got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    assert got, "no rows"
    cursor = engine.execute(entry_module.oracle_sql()[name])
    expected_columns, expected = _rows([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == expected_columns
    assert got == expected


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 1000
