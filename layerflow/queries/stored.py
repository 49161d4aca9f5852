"""Jobs that write their tables, read back and compared with plain SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.operators.envelope import LOG_SCHEMA, opaque_changes
from layerflow.plans import governance
from layerflow.plans.models import run_models
from layerflow.plans.publish import publish
from layerflow.plans.reconciliation import run_reconciliations
from layerflow.plans.tables import TableJobs
from layerflow.queries.base import apart, change_log, counted, money, moment, query
from layerflow.queries.models import _FACT, _GOLD, _fact
from layerflow.sales.specs import DOCUMENT, sales_registry
from layerflow.sources import readers, sizes
from layerflow.streaming.flows import append_stream


# -- the store ----------------------------------------------------------------
_PRODUCT = "product_id, sku, category, CAST(unit_price AS DOUBLE) AS unit_price"
_WRITES = " UNION ALL ".join(
    (
        f"SELECT 'append' AS mode, {_PRODUCT}, CASE WHEN product_id % 2 = 1 THEN product_id % 7 END AS grade FROM src_product",
        f"SELECT 'overwrite', {_PRODUCT}, NULL FROM src_product WHERE product_id % 2 = 1",
        "SELECT 'merge', product_id, sku, CASE WHEN product_id % 3 = 0 THEN 'moved' ELSE category END, CAST(unit_price AS DOUBLE), NULL FROM src_product",
        f"SELECT 'replace', {_PRODUCT}, product_id % 7 FROM src_product WHERE product_id % 2 = 1",
    )
)


@query(_WRITES, ("src_product",))
def store_write_modes(src):
    """Every write mode by the week of the last change, dispatched as declared: an append with a new
    column, an overwrite, a merge that moves rows to other days, a replacement."""
    mark, _, store = apart(src)
    products = src["src_product"].withColumn("week", F.date_trunc("week", "updated_at"))
    even, odd = products.filter("product_id % 2 = 0"), products.filter("product_id % 2 = 1")
    graded = odd.withColumn("grade", F.col("product_id") % 7)
    by_day = {"partition_by": "week"}
    store.write(even, f"{mark}.append", **by_day)
    store.write(graded, f"{mark}.append", **by_day)
    for rows in (even, odd):
        store.write(rows, f"{mark}.overwrite", write_mode="overwrite", **by_day)
    moved = products.filter("product_id % 3 = 0").withColumns(
        {"category": F.lit("moved"), "week": F.col("week") + F.make_dt_interval(F.lit(42))}
    )
    for rows in (products, moved, moved):
        store.write(rows, f"{mark}.merge", write_mode="merge", primary_key=["product_id"], **by_day)
    store.replace(even, f"{mark}.replace", **by_day)
    store.replace(graded, f"{mark}.replace", **by_day)
    parts = []
    for mode in ("append", "overwrite", "merge", "replace"):
        rows = store.read(f"{mark}.{mode}")
        grade = F.col("grade") if "grade" in rows.columns else F.lit(None)
        parts.append(rows.select(F.lit(mode).alias("mode"), "product_id", "sku", "category", *money("unit_price"), grade.cast("long").alias("grade")))
    return reduce(DataFrame.unionAll, parts)


@query(
    "SELECT fmt AS format, product_id, sku, CAST(unit_price AS DOUBLE) AS unit_price FROM src_product, (VALUES ('parquet'), ('json'), ('orc')) f(fmt)",
    ("src_product",),
)
def file_scan_formats(src):
    """A declared file source in three formats."""
    _, folder, _ = apart(src)
    parts = []
    for form in ("parquet", "json", "orc"):
        src["src_product"].write.format(form).save(f"{folder}/{form}")
        entry = {**DOCUMENT["tables"][1], "source": {"type": "file", "format": form, "path": f"{folder}/{form}"}}
        registry = sales_registry(flows=[], models=[], batch_sources=[], jobs=[], tables=[entry])
        rows = readers.read_source(src.spark, registry, registry.tables["products"])
        parts.append(rows.select(F.lit(form).alias("format"), F.col("product_id").cast("long"), "sku", *money("unit_price")))
    return reduce(DataFrame.unionAll, parts)


@query(
    "SELECT coalesce(scale, 'unknown') AS scale, count(*) AS runs, CAST(sum(row_count) AS BIGINT) AS row_count FROM "
    "(SELECT CASE WHEN scale <> 'small' THEN scale END AS scale, row_count FROM batch_run) b GROUP BY 1",
    ("batch_run",),
)
def metric_files_by_scale(src):
    """Run records kept as JSON, those of the small scale without naming it."""
    _, folder, _ = apart(src)
    kept = src["batch_run"].withColumn("scale", F.when(F.col("scale") != "small", F.col("scale")))
    kept.select("batch_id", "scale", "row_count").write.json(f"{folder}/metrics")
    read = governance.read_metric_files(src.spark, f"{folder}/metrics", "batch_id string, scale string, row_count bigint")
    return read.groupBy("scale").agg(F.count(F.lit(1)).alias("runs"), F.sum("row_count").alias("row_count"))


@query(
    "SELECT category, count(*) AS products FROM src_product WHERE updated_at >= TIMESTAMP '2023-08-15 00:00:00' GROUP BY category",
    ("src_product",),
)
def registered_partitions(src):
    """A day-partitioned Parquet folder as a catalog table."""
    mark, folder, _ = apart(src)
    sizes.write_day_partitioned(src["src_product"], f"{folder}/by-day", "updated_at")
    sizes.register_partitioned(src.spark, f"{mark}_products", f"{folder}/by-day")
    recent = src.spark.table(f"{mark}_products").filter(F.col("p_date") >= F.lit("2023-08-15").cast("date"))
    return recent.groupBy("category").agg(F.count(F.lit(1)).alias("products"))


# -- publishing and streams ---------------------------------------------------
@query(
    "SELECT sha256('{\"order_id\":' || order_id || '}') AS kafka_key, 'sales.order' AS topic, CAST(order_id AS STRING) AS order_id FROM src_order",
    ("src_order",),
)
def published_snapshot(src):
    """The snapshot job of the orders, from its source to the files of its topic."""
    _, folder, _ = apart(src)
    registry = sales_registry()
    job = next(s for s in registry.batch_sources if s["name"] == "order_snapshot")
    view = f"orders_{uuid.uuid4().hex}"
    src["src_order"].createOrReplaceTempView(view)
    job = {**job, "source": {**job["source"], "query": f"SELECT * FROM {view}"}}
    done = publish(src.spark, registry, job, {"path": f"{folder}/topic"}, run_id="orders-1")
    events = src.spark.read.parquet(f"{folder}/topic")
    if done["rows_published"] != events.count():
        raise RuntimeError(f"published {done['rows_published']} events")
    return events.select(
        F.col("key").cast("string").alias("kafka_key"), "topic",
        F.get_json_object(F.col("value").cast("string"), "$.payload.after.order_id").alias("order_id"),
    )


@query(
    "SELECT sha256('{\"customer_id\":' || customer_id || '}') AS kafka_key, op, count(*) AS n FROM customer_changes GROUP BY 1, 2",
    ("customer_changes",),
)
def stream_opaque_changes(src):
    """Change records kept as text by a stream that is stopped and started
    again: the second start takes only what came in between."""
    mark, folder, _ = apart(src)
    log = change_log(src)
    for part in (log.filter("offset < 2000000"), log.filter("offset >= 2000000")):
        part.select([F.col(f.name).cast(f.dataType) for f in LOG_SCHEMA.fields]).write.mode("append").parquet(f"{folder}/log")
        for _ in range(2):  # the second time there is nothing new
            stream = opaque_changes(src.spark.readStream.schema(LOG_SCHEMA).parquet(f"{folder}/log"), batch_id="load-1", at=moment())
            append_stream(stream, f"{mark}_changes", f"{folder}/checkpoint", once=True).awaitTermination()
    kept = src.spark.table(f"{mark}_changes")
    return kept.groupBy("kafka_key", F.get_json_object("debezium_json", "$.payload.op").alias("op")).agg(F.count(F.lit(1)).alias("n"))


# -- audit --------------------------------------------------------------------
_CHECKED = "sku IS NOT NULL AND unit_price > 0"


@query(
    "SELECT 'pipeline_events' AS kind, stage AS name, n AS rows_seen FROM (SELECT 'raw' AS stage, count(*) AS n FROM src_product "
    f"UNION ALL SELECT 'work', count(*) FROM src_product UNION ALL SELECT 'silver', count(*) FROM src_product WHERE {_CHECKED}) e "
    "UNION ALL SELECT 'batch_metrics', 'products', count(*) FROM src_product "
    "UNION ALL SELECT 'quality_results', 'LIST_PRICE_IN_RANGE', count(*) FILTER (WHERE unit_price < 0.01) FROM src_product "
    "UNION ALL SELECT 'quality_results', 'STOCK_NUMBER_SHAPE', CAST(0 AS BIGINT) "
    "UNION ALL SELECT 'quality_results', 'STOCK_NUMBER_GIVEN', count(*) FILTER (WHERE sku IS NULL) FROM src_product "
    f"UNION ALL SELECT 'governance_metrics', 'full', count(*) FILTER (WHERE NOT ({_CHECKED})) FROM src_product "
    "UNION ALL SELECT 'lineage_events', job, CAST(1 AS BIGINT) FROM (VALUES ('raw-products'), ('work-products'), ('silver-products')) j(job)",
    ("src_product",),
)
def table_audit_rows(src):
    """What two runs of one batch leave in the audit tables: one batch's rows."""
    mark, _, store = apart(src)
    src["src_product"].createOrReplaceTempView(f"source_{mark}")
    entry = next(t for t in DOCUMENT["tables"] if t["name"] == "products")
    entry = {**entry, "source": {"type": "table", "table": f"source_{mark}"}, "target": {**entry["target"], "table_name": f"products_{mark}"}}
    runtime = {"audit_namespace": f"{mark}_audit", "quarantine_namespace": f"{mark}_quarantine"}
    registry = sales_registry(flows=[], models=[], batch_sources=[], jobs=[], tables=[entry], runtime=runtime)
    for _ in range(2):
        if TableJobs(store, registry).run_tables(registry.tables.values(), batch_id="b1") != {"products": "SUCCESS"}:
            raise RuntimeError("the table's run failed")
    one = F.lit(1).cast("long")
    shown = {
        "pipeline_events": ("stage", F.col("row_count")), "batch_metrics": ("table_name", F.col("row_count")),
        "quality_results": ("rule_id", F.col("failed_rows")), "governance_metrics": ("variant", F.col("quarantined_rows")),
        "lineage_events": ("job_name", one),
    }
    parts = [
        store.read(f"{mark}_audit.{kind}").select(F.lit(kind).alias("kind"), F.col(name).alias("name"), value.alias("rows_seen"))
        for kind, (name, value) in shown.items()
    ]
    return reduce(DataFrame.unionAll, parts)


@query(
    "SELECT 'daily_revenue' AS part, count(*) AS n FROM gold UNION ALL SELECT 'sales_board', count(*) FROM gold "
    "UNION ALL SELECT 'model_runs', CAST(2 AS BIGINT) UNION ALL SELECT 'model_quality', CAST(7 AS BIGINT) "
    "UNION ALL SELECT 'lineage_events', CAST(2 AS BIGINT)",
    ("src_order",),
    (_FACT, ("gold", _GOLD.format(keep="WHERE NOT gone"))),
)
def model_runs_recorded(src):
    """Declared models over stored orders, run twice in one batch: their tables,
    and one batch's records of runs, checks and lineage."""
    mark, _, store = apart(src)
    store.overwrite(_fact(src), f"{mark}_silver.fact_order", partition_by="order_month")

    def own(value):
        if isinstance(value, str):
            for layer in ("silver", "gold", "mart"):
                value = value.replace(f"{layer}.", f"{mark}_{layer}.")
            return value
        return [own(v) for v in value] if isinstance(value, list) else value

    models = [{k: own(v) if k in ("target", "upstream", "sql") else v for k, v in m.items()} for m in DOCUMENT["models"]]
    registry = sales_registry(flows=[], tables=[], batch_sources=[], jobs=[], models=models, runtime={"audit_namespace": f"{mark}_audit"})
    for _ in range(2):
        runs = run_models(store, registry.models.values(), registry, "m1")
        if [r.status for r in runs] != ["success", "success"]:
            raise RuntimeError(f"models: {[r.error for r in runs]}")
    found = {m.name: store.read(registry.runtime.ident(m.table)) for m in registry.models.values()}
    audit = {kind: store.read(f"{mark}_audit.{kind}") for kind in ("model_runs", "model_quality", "lineage_events")}
    return counted({**found, **audit}, "part")


@query(
    "SELECT 'success' AS status, count(*) FILTER (WHERE c.customer_segment = 'building') AS updated_rows, "
    "count(*) FILTER (WHERE c.customer_id IS NULL) AS still_unknown FROM src_order o "
    "LEFT JOIN src_customer c ON o.customer_id = c.customer_id",
    ("src_order", "src_customer"),
)
def reconciliation_recorded(src):
    """The declared late-key job over stored tables by day, and its status row."""
    mark, _, store = apart(src)
    customers = src["src_customer"].select(
        "customer_id", "customer_segment", (F.col("customer_id") * 10 + 3).alias("customer_sk"), F.lit(True).alias("is_current"), "updated_at"
    )
    known = customers.filter("customer_segment <> 'building'").select("customer_id", F.col("customer_sk"))
    facts = src["src_order"].join(known, "customer_id", "left").withColumn("customer_sk", F.coalesce("customer_sk", F.lit(-1).cast("long")))
    store.overwrite(customers, f"{mark}_silver.dim_customer")
    facts = facts.withColumn("order_month", F.trunc("order_date", "MM"))
    store.overwrite(facts, f"{mark}_silver.fact_order", partition_by="order_month")
    job = {**DOCUMENT["jobs"][0], "fact_table": f"{mark}_silver.fact_order", "lookup_table": f"{mark}_silver.dim_customer"}
    registry = sales_registry(flows=[], tables=[], batch_sources=[], models=[], jobs=[job], runtime={"audit_namespace": f"{mark}_audit"})
    run_reconciliations(store, registry)
    unknown = store.read(f"{mark}_silver.fact_order").agg(F.count_if(F.col("customer_sk") == -1).alias("still_unknown"))
    status = store.read(f"{mark}_audit.reconciliation_metrics").select("status", "updated_rows")
    return status.withColumn("still_unknown", unknown.scalar())


# -- evolution and variants ---------------------------------------------------
_LAYERS = (("raw", "true"), ("work", "true"), ("silver", "false"))


@query(
    " UNION ALL ".join(
        f"SELECT '{layer}' AS layer, '{seen}' AS visible, count(*) AS n, "
        f"{'count(*) FILTER (WHERE customer_id % 2 = 1)' if seen == 'true' else 'CAST(0 AS BIGINT)'} AS filled FROM src_customer"
        for layer, seen in _LAYERS
    ),
    ("src_customer",),
)
def schema_evolution_layers(src):
    """A column that the second of two batches brings: raw and work take it in,
    silver is closed to new columns. Seen in the schemas of the written tables."""
    mark, _, store = apart(src)
    first = src["src_customer"].filter("customer_id % 2 = 0")
    second = src["src_customer"].filter("customer_id % 2 = 1").withColumn("loyalty_tier", F.lit("standard"))
    modes = {"raw": "add_columns", "work": "add_columns", "silver": "permissive"}
    for rows in (first, second):
        for layer, mode in modes.items():
            store.write(rows, f"{mark}.{layer}", on_schema_change=mode)
    layers = {layer: store.read(f"{mark}.{layer}") for layer in modes}
    seen = dict(governance.column_visibility(layers, "loyalty_tier"))
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"), (F.count("loyalty_tier") if seen[layer] else F.lit(0).cast("long")).alias("filled"))
        .select(F.lit(layer).alias("layer"), F.lit(str(seen[layer]).lower()).alias("visible"), "n", "filled")
        for layer, df in layers.items()
    ]
    return reduce(DataFrame.unionAll, parts)
