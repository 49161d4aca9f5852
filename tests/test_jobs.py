import json

import pytest
from pyspark.sql import functions as F

from helpers import SMALL, rows
from layerflow.__main__ import arguments, run
from layerflow.config import ConfigError, chosen, expand_env, load_registry, registry_from, summary
from layerflow.plans import layers
from layerflow.plans.layers import LayerJobs
from layerflow.plans.models import run_models
from layerflow.plans.publish import enabled_sources, publish
from layerflow.plans.reconciliation import run_reconciliations
from layerflow.plans.tables import TableJobs
from layerflow.sales.specs import DOCUMENT, sales_registry
from layerflow.sales.views import SalesSource
from layerflow.sources.tables import TableStore
from layerflow.streaming.flows import FlowStreams, append_stream
from layerflow.operators.envelope import LOG_SCHEMA, decode_app_events


def moved(value, mark):
    """The declared document with every table name under its own namespaces."""
    if isinstance(value, dict):
        return {k: moved(v, mark) for k, v in value.items()}
    if isinstance(value, list):
        return [moved(v, mark) for v in value]
    if isinstance(value, str):
        for layer in ("raw", "work", "silver", "gold", "mart", "quarantine"):
            value = value.replace(f" {layer}.", f" {mark}_{layer}.")
            if value.startswith(f"{layer}."):
                value = f"{mark}_{value}"
    return value


@pytest.fixture
def project(spark, tmp_path, space):
    """Registry, store and an event log directory, apart from other tests."""
    log = str(tmp_path / "log")
    document = moved(DOCUMENT, space)
    for flow in document["flows"]:
        flow["target"].pop("partition_by", None)
    for model in document["models"]:
        model.pop("partition_by", None)
    registry = registry_from(
        {
            **document,
            "connections": {"event_log": {"type": "files", "path": log, "format": "parquet"}},
            "runtime": {"config_version": "1", "source_system": "postgres", "audit_namespace": f"{space}_audit",
                        "checkpoint_base": str(tmp_path / "checkpoints")},
        }
    )
    return registry, TableStore(spark, str(tmp_path / "tables")), log


def publish_to_log(spark, registry, store, log, names, start=0):
    """Publish sources and number their events, as a broker would."""
    src = SalesSource(spark, SMALL)
    total = 0
    for name in names:
        view = name.replace("_snapshot", "")
        src[f"src_{view}"].createOrReplaceTempView(f"src_{view}")
        job = next(s for s in enabled_sources(registry) if s["name"] == name)
        staging = f"{log}-staging-{name}-{start}"
        result = publish(spark, registry, job, {"path": staging}, run_id=f"run-{name}")
        total += result["rows_published"]
        numbered = spark.read.parquet(staging).select(
            "key", "value", "topic", F.lit(0).alias("partition"),
            (F.monotonically_increasing_id() + start).alias("offset"), F.current_timestamp().alias("timestamp"),
        )
        numbered.select([F.col(f.name).cast(f.dataType) for f in LOG_SCHEMA.fields]).write.mode("append").parquet(log)
    return total


def test_flows_from_snapshot_to_mart_with_late_dimension(spark, project):
    registry, store, log = project
    jobs = LayerJobs(store, registry)
    fact, customer = registry.flows["fact_order"], registry.flows["dim_customer"]
    assert publish_to_log(spark, registry, store, log, ["order_snapshot"]) == 1500

    FlowStreams(spark, registry, store.location).start_all([fact], style="raw_only", once=True)
    first = jobs.raw_to_work(fact, run_id=1)
    assert first.metrics == {"work_rows": 1500}
    done = jobs.work_to_silver(fact, run_id=2)
    assert done.metrics["silver_rows"] == 1471 and done.metrics["quarantine_rows"] == 29
    # Repeating a run leaves every table as it is.
    jobs.raw_to_work(fact, run_id=1)
    jobs.work_to_silver(fact, run_id=2)
    silver = store.read(jobs.name(fact, "silver"))
    assert silver.count() == 1471 and store.read(jobs.name(fact, "work")).count() == 1500
    assert store.read(jobs.name(fact, "quarantine")).count() == 29
    assert rows(silver.select("customer_sk").distinct()) == [(-1,)]

    # The customers arrive late, through the full style, twice.
    publish_to_log(spark, registry, store, log, ["customer_snapshot"])
    streams = FlowStreams(spark, registry, store.location)
    streams.start_all([customer], style="full", once=True)
    versions = store.read(jobs.name(customer, "silver"))
    before = rows(versions, "customer_id", "customer_sk", "is_current")
    publish_to_log(spark, registry, store, log, ["customer_snapshot"], start=10_000_000)
    streams.start_all([customer], style="full", once=True)
    after = store.read(jobs.name(customer, "silver"))
    assert rows(after, "customer_id", "customer_sk", "is_current") == before
    assert after.filter("email RLIKE '^[^*]+@'").count() == 0

    status = run_reconciliations(store, registry)
    assert status[0]["status"] == "success" and status[0]["updated_rows"] > 0
    again = run_reconciliations(store, registry)
    assert again[0]["updated_rows"] == 0
    fixed = store.read(jobs.name(fact, "silver"))
    known = {r.customer_id for r in after.collect()}
    assert fixed.filter("customer_sk = -1").count() == sum(r.customer_id not in known for r in fixed.collect())

    runs = run_models(store, chosen(registry.models, layers=["gold", "mart"]), registry, "m1")
    assert [r.status for r in runs] == ["success", "success"], runs
    assert all(q["status"] == "success" for r in runs for q in r.quality)
    audit = registry.runtime.audit_namespace
    assert store.read(f"{audit}.model_quality").count() == 7
    assert store.read(f"{audit}.lineage_events").count() == 2
    assert store.read(f"{audit}.batch_metrics").filter("metric_name = 'dq_failed_ORDER_STATUS_KNOWN'").count() >= 1


def test_checked_rows_keep_the_log_text_only_where_they_fail(spark, project, monkeypatch):
    registry, store, log = project
    publish_to_log(spark, registry, store, log, ["order_snapshot"])
    seen = []
    kept = layers.materialize
    monkeypatch.setattr(layers, "materialize", lambda df, label: (seen.append(kept(df, label)), seen[-1])[1])
    FlowStreams(spark, registry, store.location).start_all([registry.flows["fact_order"]], style="full", once=True)
    counts = {r[0]: r[1:] for r in seen[0].groupBy("_meta_dq_passed").agg(F.count(F.lit(1)), F.count("_raw_event_json")).collect()}
    assert counts[True][0] > 0 and counts[True][1] == 0
    assert counts[False][0] > 0 and counts[False][0] == counts[False][1]


def test_missing_tables_are_reported(project):
    registry, store, _ = project
    assert run_reconciliations(store, registry)[0]["status"] == "fact_missing"


def test_stream_restart_neither_loses_nor_repeats(spark, project):
    registry, store, log = project
    flow = registry.flows["dim_product"]
    jobs = LayerJobs(store, registry)
    for start in (0, 1_000_000):
        publish_to_log(spark, registry, store, log, ["product_snapshot"], start)
        FlowStreams(spark, registry, store.location).start_all([flow], style="full", once=True)
    assert store.read(jobs.name(flow, "raw")).count() == 400
    silver = store.read(jobs.name(flow, "silver"))
    assert silver.count() == silver.select("product_id").distinct().count() == 195


def test_two_fresh_flows_run_side_by_side(spark, project):
    """Both create the audit table; neither may fail on it."""
    registry, store, log = project
    publish_to_log(spark, registry, store, log, ["product_snapshot"])
    publish_to_log(spark, registry, store, log, ["customer_snapshot"], start=1_000_000)
    flows = [registry.flows["dim_product"], registry.flows["dim_customer"]]
    FlowStreams(spark, registry, store.location).start_all(flows, style="full", once=True)
    jobs = LayerJobs(store, registry)
    assert store.read(jobs.name(flows[0], "silver")).count() == 195
    assert store.read(jobs.name(flows[1], "silver")).count() > 0
    audit = store.read(f"{registry.runtime.audit_namespace}.batch_metrics")
    assert audit.select("flow_name").distinct().count() == 2


def test_failing_flow_stops_the_others(spark, project, monkeypatch):
    registry, store, log = project
    publish_to_log(spark, registry, store, log, ["product_snapshot"])
    flows = [registry.flows["dim_product"], registry.flows["dim_customer"]]

    def process(self, batch, batch_id, flow, style):
        raise ValueError("broken flow")

    monkeypatch.setattr(FlowStreams, "process", process)
    with pytest.raises(Exception, match="broken flow"):
        FlowStreams(spark, registry, store.location).start_all(flows, style="full", once=False)
    assert not spark.streams.active


def test_empty_rerun_of_a_run_removes_its_rows(spark, project):
    registry, store, log = project
    jobs, fact = LayerJobs(store, registry), registry.flows["fact_order"]
    publish_to_log(spark, registry, store, log, ["order_snapshot"])
    FlowStreams(spark, registry, store.location).start_all([fact], style="raw_only", once=True)
    raw = store.read(jobs.name(fact, "raw"))
    jobs.raw_to_work(fact, run_id=1, raw=raw)
    jobs.raw_to_work(fact, run_id=1, raw=raw.where("false"))
    assert store.read(jobs.name(fact, "work")).count() == 0


def test_dry_run_publishes_nothing(spark, project, tmp_path):
    registry, store, _ = project
    SalesSource(spark, SMALL)["src_product"].createOrReplaceTempView("src_product")
    job = enabled_sources(registry, ("product_snapshot",))[0]
    result = publish(spark, registry, job, {"path": str(tmp_path / "never")}, dry_run=True)
    assert result["rows_published"] == 0 and len(result["sample"]) == 3
    assert not (tmp_path / "never").exists()
    assert "order_backfill" not in {s["name"] for s in enabled_sources(registry)}


def test_typed_events_stream_to_a_table(spark, tmp_path, space):
    data = [('{"event_id":"e1","event_time":"2024-01-01T00:00:00.000Z","amount":1.5}', "app")]
    log = spark.createDataFrame(data, "value string, topic string").select(
        F.lit("k").alias("key"), "value", "topic", F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"),
        F.lit("2024-01-01 00:00:01").cast("timestamp").alias("timestamp"),
    )
    log.write.parquet(str(tmp_path / "log"))
    stream = decode_app_events(spark.readStream.schema(LOG_SCHEMA).parquet(str(tmp_path / "log")), batch_id="b")
    for _ in range(2):
        append_stream(stream, f"{space}_app", str(tmp_path / "cp"), once=True).awaitTermination()
    assert rows(spark.table(f"{space}_app"), "event_id", "amount", "_transport_latency_ms") == [("e1", 1.5, 1000)]


def table_document(space, tables=None, on_error="continue"):
    names = {t["name"]: t for t in DOCUMENT["tables"]}
    picked = [
        {**names[n], "target": {**names[n]["target"], "table_name": f"{n}_{space}", "partition_by": None}}
        for n in tables or ("customers", "orders", "payments")
    ]
    return {"tables": picked, "pipeline": {"on_error": on_error}, "runtime": {
        "audit_namespace": f"{space}_audit", "quarantine_namespace": f"{space}_q", "source_system": "postgres"}}


def test_tables_run_all_stages_and_rerun(spark, store, space):
    src = SalesSource(spark, SMALL)
    for name, view in (("customers", "src_customer"), ("orders", "src_order"), ("payments", "src_payment")):
        src[view].createOrReplaceTempView(f"source_{name}")
    registry = registry_from(table_document(space))
    jobs = TableJobs(store, registry)
    assert set(jobs.run_tables(registry.tables.values()).values()) == {"SUCCESS"}
    orders = registry.tables["orders"]
    assert store.read(jobs.name(orders, "silver")).count() == 1471
    failed = store.read(jobs.name(orders, "quarantine"))
    assert failed.count() == 29 and failed.filter("_quarantine_reason = ''").count() == 0
    # Orders are merged by key: a second load adds nothing to silver.
    jobs.run_tables([orders])
    assert store.read(jobs.name(orders, "silver")).count() == 1471
    payments = store.read(jobs.name(registry.tables["payments"], "silver"))
    assert payments.filter("card_number NOT LIKE '****-****-****-%'").count() == 0
    audit = f"{space}_audit"
    assert store.read(f"{audit}.pipeline_events").filter("stage = 'silver'").count() == 4
    quality = store.read(f"{audit}.quality_results").filter("rule_id = 'ORDER_STATUS_KNOWN'").first()
    assert (quality.failed_rows, quality.passed_rows, quality.total_failed_rows) == (15, 1471, 29)
    assert store.read(f"{audit}.batch_metrics").filter("bytes_written > 0").count() == 4


def test_variants(spark, store, space):
    SalesSource(spark, SMALL)["src_customer"].createOrReplaceTempView("source_customers")
    registry = registry_from(table_document(space, ["customers"]))
    jobs, table = TableJobs(store, registry), registry.tables["customers"]
    jobs.run_raw(table, "r")
    jobs.run_work(table, "w")
    got = {v: jobs.run_silver(table, v, variant=v) for v in ("layers_only", "no_work_layer", "full")}
    assert got == {"layers_only": (150, 0), "no_work_layer": (144, 6), "full": (144, 6)}


def test_incremental_load_takes_newer_rows_only(spark, store, space):
    src = SalesSource(spark, SMALL)["src_order"]
    document = table_document(space, ["orders"])
    document["tables"][0]["source"] = {"type": "table", "table": f"inc_{space}", "load_strategy": "incremental"}
    registry = registry_from(document)
    jobs, table = TableJobs(store, registry), registry.tables["orders"]
    src.filter("updated_at < '1998-01-01'").createOrReplaceTempView(f"inc_{space}")
    first = jobs.run_raw(table, "one")
    src.createOrReplaceTempView(f"inc_{space}")
    second = jobs.run_raw(table, "two")
    assert first + second == 1500 and jobs.run_raw(table, "three") == 0
    assert jobs.run_raw(table, "two") == second and store.read(jobs.name(table, "raw")).count() == 1500


def test_a_repeated_batch_changes_nothing(spark, store, space):
    for name, view in (("products", "src_product"), ("orders", "src_order")):
        SalesSource(spark, SMALL)[view].createOrReplaceTempView(f"source_{name}")
    registry = registry_from(table_document(space, ["products", "orders"]))
    jobs = TableJobs(store, registry)
    counts = []
    for _ in range(2):
        assert set(jobs.run_tables(registry.tables.values(), batch_id="b1").values()) == {"SUCCESS"}
        counts.append([
            store.read(jobs.name(t, layer)).count() for t in registry.tables.values() for layer in ("raw", "work", "silver", "quarantine")
        ])
    assert counts[0] == counts[1] and counts[0][:3] == [200, 200, 195] and counts[0][3] == 5


def test_errors_continue_or_stop(store, space):
    def registry(mode):
        document = table_document(space, ["customers", "orders"], mode)
        for t in document["tables"]:
            t["source"] = {"type": "table", "table": f"absent_{space}"}
        return registry_from(document)

    soft = registry("continue")
    assert set(TableJobs(store, soft).run_tables(soft.tables.values()).values()) == {"FAILED"}
    assert store.read(f"{space}_audit.pipeline_events").filter("status = 'FAILED'").count() == 2
    hard = registry("fail_fast")
    with pytest.raises(Exception):
        TableJobs(store, hard).run_tables(hard.tables.values())


def test_config_loading(tmp_path):
    assert expand_env({"a": ["${X:-d}", "$Y", "${Z}"]}, {"Y": "y"}) == {"a": ["d", "y", "${Z}"]}
    path = tmp_path / "c.json"
    path.write_text('{"connections": {"l": {}}, "flows": [{"name": "f", "source": {"connection": "l"}, "target": {}}]}')
    with pytest.raises(ConfigError, match="raw_table"):
        load_registry(path)
    registry = sales_registry()
    assert [r["column"] for r in registry.flows["dim_customer"].standard_rules[:2]] == ["email", "email"]
    assert [m.name for m in chosen(registry.models, layers=["MART"])] == ["sales_board"]
    assert registry.models["daily_revenue"].rules[0]["rule_id"] == "MODEL_NOT_EMPTY"
    for broken in (
        {"tables": [{}]},
        {"models": [{"name": "m"}]},
        {"tables": [{"name": "t", "source": {"type": "jdbc", "connection": "no"}}]},
        {"tables": [{"name": "t", "primary_key": ["x"], "schema_contract": {"columns": [{"name": "y"}]}}]},
        {"tables": [{"name": "t", "governance": {"dq_rules": [{"type": "odd", "rule_id": "r"}]}}]},
    ):
        with pytest.raises(ConfigError):
            registry_from(broken)


def test_compact_tables_and_summary(spark, store, space):
    SalesSource(spark, SMALL)["src_payment"].createOrReplaceTempView(f"pay_{space}")
    document = {
        "tables": {
            f"payments_{space}": {
                "source_table": f"pay_{space}", "primary_key": ["payment_id"], "watermark_column": "updated_at",
                "columns": [{"name": "payment_id", "dataType": "BIGINT"}, {"name": "updated_at", "dataType": "TIMESTAMP"},
                            {"name": "card_number", "dataType": "TEXT", "pii": "PII.Financial"}],
                "pii_columns": {"card_number": {"method": "last4"}},
                "dq_rules": [{"rule_id": "CARD", "column": "card_number", "type": "pii_present"},
                             {"rule_id": "UNIQUE", "column": "payment_id", "type": "unique"}],
            }
        },
        "runtime": {"audit_namespace": f"{space}_audit", "quarantine_namespace": f"{space}_q"},
    }
    registry = registry_from(document)
    table = registry.tables[f"payments_{space}"]
    assert TableJobs(store, registry).run_tables([table]) == {table.name: "SUCCESS"}
    silver = store.read(f"silver.payments_{space}")
    assert silver.count() == 1425 and silver.filter("card_number LIKE '4%'").count() == 0
    assert summary(registry)[0]["rules"] == ["CARD", "UNIQUE"] and len(summary(sales_registry())) == 10


def test_command_line(tmp_path, capsys):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(DOCUMENT))
    got = run(arguments().parse_args(["summary", "--config", str(path)]))
    assert [g["name"] for g in got][:3] == ["dim_customer", "dim_product", "fact_order"]
