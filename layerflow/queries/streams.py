"""Flows run as drained streams over a file log, compared with batch SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.plans.layers import LayerJobs
from layerflow.plans.tables import TableJobs
from layerflow.queries.base import change_log, order_log, query, text
from layerflow.queries.merging import SCD2_CTES
from layerflow.sales.specs import DOCUMENT, sales_registry
from layerflow.session import CODEC, scratch_dir
from layerflow.sources.tables import TableStore
from layerflow.streaming.flows import FlowStreams


def _isolated(src, log):
    """A registry whose tables and log live apart from every other run."""
    mark = f"s{uuid.uuid4().hex[:12]}"
    base = f"{scratch_dir(src.spark)}/{mark}"
    log.write.option("compression", CODEC).partitionBy("partition").parquet(f"{base}/log")
    flows = []
    for item in DOCUMENT["flows"]:
        target = {k: f"{mark}_{v}" if k.endswith("_table") else v for k, v in item["target"].items()}
        keys = [{**fk, "lookup_table": f"{mark}_{fk['lookup_table']}"} for fk in item.get("foreign_keys", [])]
        flows.append({**item, "target": target, "foreign_keys": keys})
    registry = sales_registry(
        flows=flows,
        models=[],
        connections={"event_log": {"type": "files", "path": f"{base}/log", "format": "parquet"}},
        runtime={"config_version": "2026.1", "source_system": "postgres", "checkpoint_base": f"{base}/checkpoints",
                 "audit_namespace": f"{mark}_audit"},
    )
    return registry, f"{base}/tables"


def _drain(src, style: str):
    registry, location = _isolated(src, order_log(src))
    spec = registry.flows["fact_order"]
    FlowStreams(src.spark, registry, location).start_all([spec], style=style, once=True)
    return LayerJobs(TableStore(src.spark, location), registry), spec


@query(
    "SELECT order_id, order_status, CAST(order_date AS STRING) AS order_date, 'raw' AS layer FROM src_order",
    ("src_order",),
)
def stream_log_to_raw(src):
    jobs, spec = _drain(src, "raw_only")
    rows = jobs.store.read(jobs.name(spec, "raw"))
    return rows.select("order_id", "order_status", *text("order_date"), F.col("_meta_layer").alias("layer"))


@query(
    "SELECT 'fact_order' AS flow, 'raw' AS layer, count(*) AS n FROM src_order UNION ALL "
    "SELECT 'dim_customer', 'raw', count(*) FROM customer_changes UNION ALL "
    "SELECT 'fact_order', 'silver', count(*) FROM src_order WHERE total_amount > 0 AND order_id % 101 <> 0 UNION ALL "
    "SELECT 'dim_customer', 'silver', count(*) FROM linked WHERE op <> 'd' AND customer_id % 50 <> 1 AND customer_id >= 1",
    ("src_order", "customer_changes"),
    SCD2_CTES,
)
def stream_two_flows(src):
    """Two flows started at once on fresh tables, every layer."""
    log = order_log(src).unionByName(change_log(src))
    registry, location = _isolated(src, log)
    specs = [registry.flows["fact_order"], registry.flows["dim_customer"]]
    FlowStreams(src.spark, registry, location).start_all(specs, style="full", once=True)
    jobs = LayerJobs(TableStore(src.spark, location), registry)
    read = [(s, layer) for s in specs for layer in ("raw", "silver")]
    parts = [
        jobs.store.read(jobs.name(s, layer)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s.name).alias("flow"), F.lit(layer).alias("layer"), "n")
        for s, layer in read
    ]
    return reduce(DataFrame.unionAll, parts)


@query(
    "SELECT layer, n FROM (SELECT 'raw' AS layer, count(*) AS n FROM src_product UNION ALL "
    "SELECT 'work', count(*) FROM src_product UNION ALL "
    "SELECT 'silver', count(*) FROM src_product WHERE sku IS NOT NULL AND unit_price > 0 UNION ALL "
    "SELECT 'quarantine', count(*) FROM src_product WHERE sku IS NULL OR NOT unit_price > 0) s",
    ("src_product",),
)
def tables_rerun(src):
    """A declared table run twice under one batch id: every layer holds it once."""
    mark = f"t{uuid.uuid4().hex[:12]}"
    src["src_product"].createOrReplaceTempView(f"source_{mark}")
    entry = next(t for t in DOCUMENT["tables"] if t["name"] == "products")
    entry = {**entry, "source": {"type": "table", "table": f"source_{mark}"}, "target": {**entry["target"], "table_name": f"products_{mark}"}}
    runtime = {"audit_namespace": f"{mark}_audit", "quarantine_namespace": f"{mark}_quarantine"}
    registry = sales_registry(flows=[], models=[], batch_sources=[], jobs=[], tables=[entry], runtime=runtime)
    jobs = TableJobs(TableStore(src.spark, f"{scratch_dir(src.spark)}/{mark}"), registry)
    table = registry.tables["products"]
    for _ in range(2):
        outcome = jobs.run_tables([table], batch_id="b1")
        if outcome != {"products": "SUCCESS"}:
            raise RuntimeError(f"table run: {outcome}")
    parts = [
        jobs.store.read(jobs.name(table, layer)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(layer).alias("layer"), "n")
        for layer in ("raw", "work", "silver", "quarantine")
    ]
    return reduce(DataFrame.unionAll, parts)


@query(
    "SELECT order_id, upper(trim(order_status)) AS order_status, CAST(total_amount AS DOUBLE) AS total_amount, "
    "CAST(CAST(order_date AS DATE) AS STRING) AS order_ds FROM src_order WHERE total_amount > 0 AND order_id % 101 <> 0",
    ("src_order",),
)
def stream_log_to_silver(src):
    jobs, spec = _drain(src, "full")
    rows = jobs.store.read(jobs.name(spec, "silver"))
    return rows.select("order_id", "order_status", F.col("total_amount").cast("double"), *text("order_ds"))
