import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = db.execute(sql)
    columns = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(columns) == sorted(frame.columns)
    assert digest(frame.columns, rows) == digest(columns, expected)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
