"""The registered queries against their checking SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from pagemark.catalog.oracle import ORACLE
from pagemark.catalog.queries import QUERIES

DIRECTORY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIRECTORY).exists(), reason="test tables not there")
TABLES = ("pages", "documents")


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    return float(value) if isinstance(value, (int, float)) else str(value)


def ordered(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows),
                  key=lambda row: [(v is None, str(v)) for v in row])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIRECTORY}/{table}.parquet'")
    df = entry.queries()[name](spark, DIRECTORY)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = ordered(df.collect(), df.columns, sorted(columns))
    want = ordered(cursor.fetchall(), columns, sorted(columns))
    assert got and got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 44
