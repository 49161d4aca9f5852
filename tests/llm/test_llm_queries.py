"""Queries with an SQL twin against DuckDB; and what every query returns."""

import duckdb
import pytest

from layerflow.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    cursor = connection.execute(SQL[name])
    order = [[d[0] for d in cursor.description].index(n) for n in names]
    assert len(order) == len(cursor.description)
    expected = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == expected


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES
