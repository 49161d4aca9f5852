"""Every registered query against its SQL twin on the smallest tables."""

import decimal
import re

import duckdb
import pytest

from helpers import SMALL, plan
from layerflow.queries import QUERIES, models
from layerflow.sales.views import BASE_TABLES

@pytest.fixture(scope="module")
def ansi():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def plain(value):
    return str(value) if isinstance(value, decimal.Decimal) else value


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, ansi, name):
    df = QUERIES[name].run(spark, SMALL)
    text = plan(df)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text and "Python" not in text
    names = sorted(df.columns)
    got = sorted(([plain(r[n]) for n in names] for r in df.collect()), key=repr)
    if QUERIES[name].sql is None:
        assert got
        return
    cursor = ansi.execute(QUERIES[name].sql)
    order = [[d[0] for d in cursor.description].index(n) for n in names]
    assert sorted(([plain(r[i]) for i in order] for r in cursor.fetchall()), key=repr) == got


@pytest.mark.parametrize("name", ["q_channel_90d", "q_theta_join", "q_gold_category"])
def test_layouts_have_plans_of_their_own(spark, name):
    layered, baseline = (plan(QUERIES[n].run(spark, SMALL)) for n in (name, f"{name}_baseline"))
    tables = [sorted(set(re.findall(r"parquet [^\[]*", text))) for text in (layered, baseline)]
    assert tables[0] != tables[1]
    if name != "q_gold_category":
        assert "PartitionFilters: [isnotnull(p_date" in layered and "PartitionFilters: [isnotnull(p_date" in baseline


def test_the_layered_scans_read_no_more(spark):
    found = {r["query"]: r for r in QUERIES["scan_reduction_stored"].run(spark, SMALL).collect()}
    assert set(found) == {"channel_scan", "cross_layer", "category_rollup"}
    assert all(0 < r.layered_bytes <= r.baseline_bytes for r in found.values())
    assert found["category_rollup"].layered_bytes < 0.5 * found["category_rollup"].baseline_bytes


def test_a_query_writes_the_stored_tables_it_reads(spark, monkeypatch):
    monkeypatch.setattr(models, "_WRITTEN", {})
    QUERIES["q_channel_90d_baseline"].run(spark, SMALL).collect()
    (made,) = models._WRITTEN.values()
    assert list(made.written) == [f"{made.folder}/orders"]
    QUERIES["q_gold_category_baseline"].run(spark, SMALL).collect()
    assert list(made.written) == [f"{made.folder}/{t}" for t in ("orders", "items", "products")]
