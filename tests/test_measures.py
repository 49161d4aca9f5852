import random
import statistics

import pytest
from pyspark.sql import functions as F

from helpers import SMALL, plan, rows
from layerflow.operators import envelope, ranks
from layerflow.plans import governance
from layerflow.plans.models import REVENUE_BY_CHANNEL
from layerflow.queries import QUERIES
from layerflow.queries.base import REGISTRY, flow, moment
from layerflow.sales.specs import sales_registry
from layerflow.sales.views import SalesSource

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def nearest(values, p):
    ordered = sorted(values)
    return ordered[int(round((len(ordered) - 1) * p))] if ordered else 0


@pytest.mark.parametrize("n, spread", [(1, 5), (2, 5), (7, 3), (1000, 20), (3000, 10**6)])
def test_nearest_rank_equals_sorting(spark, n, spread):
    rng = random.Random(n)
    values = [rng.choice([7, rng.randrange(spread)]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    got = ranks.nearest_rank(df, "v", QUANTILES)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert rows(got) == [tuple(float(nearest(values, p)) for p in QUANTILES.values()) + (n,)]


def test_ranks_of_nothing_are_zero(spark):
    df = spark.createDataFrame([], "g string, v long")
    assert rows(ranks.nearest_rank(df, "v", {"p50": 0.5})) == [(0.0, 0)]
    assert rows(ranks.median(df, "v")) == [(0.0,)]


def test_median_per_group(spark):
    rng = random.Random(5)
    data = [("abc"[min(i % 7, 2)], rng.randrange(1000)) for i in range(2001)]
    want = {g: float(statistics.median(v for k, v in data if k == g)) for g in "abc"}
    got = dict(rows(ranks.median(spark.createDataFrame(data, "g string, v long"), "v", ["g"])))
    assert got == want


def test_ranks_over_many_ranges(spark):
    """There are as many ranges as the shuffle has partitions; a NULL group is a group."""
    changed = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        data = [(None if k % 5 else "g", (k * 7919) % 1000) for k in range(1000)]
        df = spark.createDataFrame(data, "g string, v long")
        table = ranks.cumulative_histogram(df, "v", ["g"])
        got = {(r.g, r._value): (r._upto, r._total) for r in table.collect()}
        for g in (None, "g"):
            values = sorted(v for k, v in data if k == g)
            for v in values:
                assert got[(g, v)] == (sum(x <= v for x in values), len(values))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_envelope_round_trip_with_deletes_and_bad_text(spark):
    df = spark.createDataFrame([(1, "u", "12.50", "2024-01-01"), (2, "d", "bad", None)], "order_id long, op string, total_amount string, order_date string")
    events = envelope.build_events(
        df, topic="sales.order", key_columns=["order_id"], batch_run_id="r", source={"table": "src_order"},
        op=F.col("op"), ts_ms=F.lit(5).cast("long"), row_columns=["order_id", "total_amount", "order_date"],
    )
    log = events.withColumns({"partition": F.lit(0), "offset": F.lit(0), "timestamp": moment()})
    out = envelope.decode_events(log, flow("fact_order"), REGISTRY.runtime)
    assert rows(out.select("order_id", F.col("total_amount").cast("string"), "_meta_is_deleted")) == [
        (1, "12.50", False), (2, None, True)
    ]
    twice = envelope.build_events(
        df, topic="sales.order", key_columns=["order_id"], batch_run_id="r", source={"table": "src_order"},
        op=F.col("op"), ts_ms=F.lit(5).cast("long"), row_columns=["order_id", "total_amount", "order_date"],
    )
    assert rows(twice) == rows(events)
    assert plan(out).count("from_json") == 1 and "get_json_object" not in plan(out)


def test_paths_with_wildcards_fall_back(spark):
    assert envelope.absolute_path("after.x") == "$.payload.after.x"
    assert envelope.absolute_path("payload.op") == "$.payload.op"
    assert envelope.absolute_path("$.a[0].b") == "$.a[0].b"
    fields = envelope._JsonFields("value", "_doc", ["$.a.b", "$.a", "$.c[0]", "$.d"])
    assert set(fields.plain) == {"$.a.b", "$.d"}
    df = spark.createDataFrame([('{"a":{"b":"1"},"c":["x"],"d":2.50}',)], "value string").withColumn("_doc", fields.parse())
    got = df.select(*[fields.get(p) for p in ("$.a.b", "$.a", "$.c[0]", "$.d")]).first()
    assert tuple(got) == ("1", '{"b":"1"}', "x", "2.5")


def test_malformed_events_become_null_rows(spark):
    log = spark.createDataFrame([("not json",), (None,)], "value string").withColumns(
        {"topic": F.lit("t"), "partition": F.lit(0), "offset": F.lit(1).cast("long"), "timestamp": moment()}
    )
    out = envelope.decode_events(log, flow("fact_order"), REGISTRY.runtime)
    assert rows(out, "order_id", "_meta_is_deleted") == [(None, False), (None, False)]


def test_upstream_hops_are_shortest_and_stop_on_cycles(spark):
    edges = spark.createDataFrame(
        [("m", "a"), ("m", "b"), ("a", "c"), ("b", "c"), ("c", "m"), ("c", "d"), ("m", "d"), ("x", "y")],
        "asset string, upstream string",
    )
    assert rows(governance.upstream_hops(edges, "m")) == [("a", 1), ("b", 1), ("c", 2), ("d", 1), ("m", 0)]
    assert rows(governance.lineage_depth(edges, "alone")) == [(0, 1)]


def test_rounds_read_the_edges_where_they_lie(spark, monkeypatch):
    edges = spark.range(300).selectExpr("concat('n', id div 3) AS asset", "concat('n', id) AS upstream")
    plans = []
    kept = governance.materialize
    monkeypatch.setattr(governance, "materialize", lambda df, label: (plans.append(plan(df)), kept(df, label))[1])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(governance.upstream_hops(edges, "n0").groupBy("hops").count()) == [(0, 1), (1, 2), (2, 6), (3, 18), (4, 54), (5, 162), (6, 57)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    rounds = [text for text in plans if "Join" in text]
    assert rounds and all(text.count("Exchange hashpartitioning(_from") <= 1 for text in rounds)


def test_edges_per_asset_cover_the_edge_table(spark):
    found = dict(rows(QUERIES["lineage_edges"].run(spark, SMALL)))
    stored = dict(rows(SalesSource(spark, SMALL)["asset_edge"].groupBy("asset").agg(F.countDistinct("upstream"))))
    assert len(stored) > 1000 and stored.items() <= found.items()
    assert found["raw.orders"] > 1 and found["mart.sales_board"] == 1


def test_declared_inventory_and_edges(spark):
    registry = sales_registry()
    columns = governance.asset_columns(spark, registry)
    silver = columns.filter("asset = 'silver.dim_customer'")
    assert silver.count() == 9 + len(governance.EMBEDDED_COLUMNS) and len(governance.EMBEDDED_COLUMNS) == 27
    assert silver.filter("column_name = 'email'").first().tags == ["PII"]
    edges = governance.lineage_edges(spark, registry)
    assert edges.filter("upstream = 'work.order_rows'").count() == 2
    assert rows(governance.lineage_depth(edges, "mart.sales_board"), "depth") == [(5,)]
    coverage = governance.metadata_coverage(governance.asset_inventory(spark, registry)).first()
    assert 0 < coverage.covered_assets < coverage.total_assets
    known = columns.filter("asset = 'silver.dim_customer'")
    written = spark.createDataFrame([(1, "e", "n", 0)], "customer_id long, email string, tier string, _layer int")
    fresh = governance.refreshed_columns(written, "silver.dim_customer", known)
    assert rows(fresh, "column_name", "tags") == [("customer_id", []), ("email", ["PII"]), ("tier", None)]


def test_sections_pick_metrics_by_text(spark):
    metrics = governance.metric_rollup(spark.range(1, 4).withColumnRenamed("id", "rows"), ["rows"], "gold")
    assert rows(metrics) == [("gold.count", 3.0), ("gold.rows.max", 3.0), ("gold.rows.sum", 6.0)]
    picked = governance.section_metrics(metrics, {"serving": ["rows"], "none": ["absent"]})
    assert rows(picked, "section", "metric") == [("serving", "gold.rows.max"), ("serving", "gold.rows.sum")]


def test_metric_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"table":"t","scale":"small","rows_per_sec":2.0}')
    (tmp_path / "b.json").write_text('{"table":"u","rows_per_sec":3.0}')
    got = governance.read_metric_files(spark, str(tmp_path), "table string, scale string, rows_per_sec double")
    assert rows(got, "table", "scale") == [("t", "small"), ("u", "unknown")]


def test_enforcement_counts_distinct_pairs_once(spark):
    expected = spark.createDataFrame([("t", "1", "R"), ("t", "1", "R"), ("t", "2", "R")], "source_table string, source_pk string, rule_id string")
    quarantine = spark.createDataFrame([(1, ["R", "S"]), (1, ["R"]), (9, ["R"])], "id int, _dq_errors array<string>")
    rate = governance.enforcement_rate(expected, [governance.found_violations(quarantine, "t", "id")])
    assert rows(rate) == [(2, 1, 50.0)]


def test_split_payments_count_an_order_twice(spark):
    orders = spark.createDataFrame([(1, "2024-01-01", "web", 10), (2, "2024-01-01", "web", 5)], "order_id int, order_date string, channel string, total_amount int")
    payments = spark.createDataFrame([(1, 4), (1, 6)], "order_id int, amount int")
    got = spark.sql(REVENUE_BY_CHANNEL, orders=orders.withColumn("order_date", F.col("order_date").cast("timestamp")), payments=payments)
    assert rows(got, "order_count", "gross_revenue", "paid_amount") == [(2, 25, 10)]
