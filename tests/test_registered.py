"""Every registered query against its SQL in another engine, at the smallest scale and with all rows."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def other_engine():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted((tuple(row[at] for at in order) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, other_engine, name):
    got = entry.queries()[name](spark, DATA)
    cursor = other_engine.execute(entry.oracle_sql()[name])
    types = {column[0]: str(column[1]) for column in cursor.description}
    assert {column: TYPES[kind] for column, kind in got.dtypes} == types
    want = rows_by_name(list(types), cursor.fetchall())
    assert rows_by_name(got.columns, [tuple(row) for row in got.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert not entry.queries()[name](spark, DATA).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).columns == ["run_id", "queue_rank", "queue_score", "finding_id", "image_id", "level", "action"]
