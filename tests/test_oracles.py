"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import duckdb
import pytest

from conftest import SF_DIR
from stockflow.oracles import ORACLES
from stockflow.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "string": "VARCHAR",
    "double": "DOUBLE",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


def _text(value) -> str:
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def _table(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(row[i]) for i in order) for row in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    described = cursor.description
    columns = [c[0] for c in described]
    assert sorted(df.columns) == sorted(columns)
    assert {c: TYPES[k] for c, k in df.dtypes} == {c[0]: str(c[1]) for c in described}
    assert _table(df.columns, df.collect()) == _table(columns, cursor.fetchall())
