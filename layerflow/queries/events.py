"""Event building, decoding and latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerflow.functions.hashing import JSON_OPTIONS
from layerflow.operators import envelope
from layerflow.operators.ranks import nearest_rank, trailing
from layerflow.queries.base import (
    MOMENT,
    change_log,
    decoded_changes,
    decoded_orders,
    moment,
    money,
    order_log,
    query,
    text,
)

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f')"


def _json_text(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 'null' ELSE '\"' || {column} || '\"' END"


ORDER_JSON = (
    "'{\"channel\":' || " + _json_text("channel") + " || ',\"customer_id\":' || customer_id || ',\"order_date\":\"' || "
    + _ISO.format("order_date") + " || '\",\"order_id\":' || order_id || ',\"order_status\":\"' || order_status"
    " || '\",\"total_amount\":\"' || CAST(total_amount AS VARCHAR) || '\",\"updated_at\":\"' || "
    + _ISO.format("updated_at") + " || '\"}'"
)
PRODUCT_JSON = (
    "'{\"category\":\"' || category || '\",\"product_id\":' || product_id || ',\"product_name\":\"' || product_name"
    " || '\",\"sku\":' || " + _json_text("sku") + " || ',\"unit_price\":\"' || CAST(unit_price AS VARCHAR)"
    " || '\",\"updated_at\":\"' || " + _ISO.format("updated_at") + " || '\"}'"
)


def _event_id(run: str, topic: str) -> str:
    return (
        f"sha256('{{\"batch_run_id\":\"{run}\",\"key\":\"' || event_key || '\",\"row_hash\":\"' || row_hash || "
        f"'\",\"topic\":\"{topic}\"}}')"
    )


ORDER_EVENT = (
    (
        "body",
        f"SELECT *, {ORDER_JSON} AS doc, sha256('{{\"order_id\":' || order_id || '}}') AS event_key FROM src_order",
    ),
    ("hashed", "SELECT *, sha256(doc) AS row_hash FROM body"),
    ("named", f"SELECT *, {_event_id('orders-1', 'sales.order')} AS event_id FROM hashed"),
)


@query(
    "SELECT 'sales.order' AS topic, event_key AS \"key\", "
    "'{\"payload\":{\"after\":' || doc || ',\"before\":null,\"op\":\"r\",\"source\":{\"batch_run_id\":\"orders-1\","
    "\"config_version\":\"2026.1\",\"connector\":\"batch-snapshot\",\"db\":\"sales\",\"event_id\":\"' || event_id || '\","
    "\"extraction_mode\":\"snapshot\",\"name\":\"postgres\",\"row_hash\":\"' || row_hash || '\",\"schema\":\"public\","
    "\"snapshot\":\"true\",\"table\":\"src_order\",\"version\":\"layerflow-batch\"},\"transaction\":null,\"ts_ms\":' "
    "|| epoch_ms(updated_at) || '},\"schema\":null}' AS \"value\" FROM named",
    ("src_order",),
    ORDER_EVENT,
)
def snapshot_envelope(src):
    return order_log(src).select("topic", "key", "value")


@query(
    f"SELECT product_id, doc, event_key, row_hash, {_event_id('products-1', 'sales.product')} AS event_id FROM hashed",
    ("src_product",),
    (
        (
            "body",
            f"SELECT *, {PRODUCT_JSON} AS doc, sha256('{{\"product_id\":' || product_id || '}}') AS event_key "
            "FROM src_product",
        ),
        ("hashed", "SELECT *, sha256(doc) AS row_hash FROM body"),
    ),
)
def envelope_ids(src):
    products = src["src_product"]
    events = envelope.build_events(
        products, topic="sales.product", key_columns=["product_id"], batch_run_id="products-1",
        source={"name": "postgres", "table": "src_product"}, ts_ms=F.unix_millis("updated_at"),
        carry=["product_id", "_row"],
    )
    return events.select(
        "product_id",
        F.to_json("_row", JSON_OPTIONS).alias("doc"),
        F.col("key").alias("event_key"),
        F.get_json_object("value", "$.payload.source.row_hash").alias("row_hash"),
        F.get_json_object("value", "$.payload.source.event_id").alias("event_id"),
    )


_HASH_ORDER = (
    "sha256(concat_ws('||', CAST(order_id AS STRING), CAST(customer_id AS STRING), CAST(order_date AS STRING), "
    "order_status, channel, CAST(total_amount AS STRING), CAST(updated_at AS STRING)))"
)


@query(
    "SELECT order_id, customer_id, CAST(order_date AS STRING) AS order_date, order_status, channel, "
    "CAST(total_amount AS DOUBLE) AS total_amount, CAST(updated_at AS STRING) AS updated_at, 'r' AS op, "
    f"epoch_ms(updated_at) AS ts_ms, 'src_order' AS source_table, {_HASH_ORDER} AS record_hash FROM src_order",
    ("src_order",),
)
def cdc_decode(src):
    return decoded_orders(src).select(
        "order_id", "customer_id", *text("order_date"), "order_status", "channel", *money("total_amount"),
        *text("updated_at"), F.col("_meta_source_operation").alias("op"), F.col("_meta_source_ts_ms").alias("ts_ms"),
        F.col("_meta_source_table").alias("source_table"), F.col("_meta_record_hash").alias("record_hash"),
    )


@query(
    "SELECT customer_id, email, province, CAST(updated_at AS STRING) AS updated_at, op, "
    "CAST(op = 'd' AS STRING) AS is_deleted, "
    f"CASE WHEN op = 'd' THEN '{MOMENT}' END AS deleted_at FROM customer_changes",
    ("customer_changes",),
)
def cdc_delete_before_image(src):
    return decoded_changes(src).select(
        "customer_id", "email", "province", *text("updated_at"), F.col("_meta_source_operation").alias("op"),
        F.col("_meta_is_deleted").cast("string").alias("is_deleted"),
        F.col("_meta_deleted_at").cast("string").alias("deleted_at"),
    )


@query(
    "SELECT order_id, sha256('sales.order|' || (order_id % 4) || '|' || order_id) AS event_id, "
    "sha256('order_id:long|customer_id:long|order_date:timestamp|order_status:string|channel:string|"
    "total_amount:decimal(18,2)|updated_at:timestamp') AS schema_hash, '[]' AS pii_tags, "
    "'{\"flow\":\"fact_order\",\"topics\":[\"sales.order\"],\"raw\":\"raw.order_events\",\"work\":\"work.order_rows\","
    "\"silver\":\"silver.fact_order\"}' AS lineage, 'sales' AS source_database, 'public' AS source_schema, "
    "'raw' AS layer, 'fact_order' AS flow, '2026.1' AS config_version FROM src_order",
    ("src_order",),
)
def embedded_metadata(src):
    return decoded_orders(src, prefer_source_event_id=False).select(
        "order_id", F.col("_meta_event_id").alias("event_id"), F.col("_meta_schema_hash").alias("schema_hash"),
        F.col("_meta_pii_tags").alias("pii_tags"), F.col("_meta_lineage").alias("lineage"),
        F.col("_meta_source_database").alias("source_database"), F.col("_meta_source_schema").alias("source_schema"),
        F.col("_meta_layer").alias("layer"), F.col("_meta_pipeline_name").alias("flow"),
        F.col("_meta_config_version").alias("config_version"),
    )


@query(
    f"SELECT sha256('{{\"customer_id\":' || customer_id || '}}') AS kafka_key, op, "
    "CAST(customer_id AS STRING) AS customer_id, 'load-1' AS batch_id FROM customer_changes",
    ("customer_changes",),
)
def opaque_change_records(src):
    kept = envelope.opaque_changes(change_log(src), batch_id="load-1", at=moment())
    image = F.coalesce(
        F.get_json_object("debezium_json", "$.payload.after.customer_id"),
        F.get_json_object("debezium_json", "$.payload.before.customer_id"),
    )
    return kept.select(
        "kafka_key", F.get_json_object("debezium_json", "$.payload.op").alias("op"), image.alias("customer_id"),
        F.col("_batch_id").alias("batch_id"),
    )


def _app_log(src):
    events = src["src_app_event"]
    names = ["event_id", "event_time", "customer_id", "session_id", "event_type", "channel", "page", "amount"]
    document = F.to_json(F.struct(*names), JSON_OPTIONS)
    return events.select(
        F.col("event_id").alias("key"), document.alias("value"), F.lit("app-events").alias("topic"),
        F.lit(0).alias("partition"), F.col("event_id").cast("long").alias("offset"),
        F.col("kafka_ts").alias("timestamp"), "ingest_ts",
    )


@query(
    "SELECT event_id, CAST(event_time AS STRING) AS event_time, customer_id, session_id, event_type, channel, page, "
    "amount, epoch_ms(kafka_ts) - epoch_ms(event_time) AS transport_ms FROM src_app_event",
    ("src_app_event",),
)
def typed_app_events(src):
    return envelope.decode_app_events(_app_log(src), batch_id="app-1", at=moment()).select(
        "event_id", *text("event_time"), "customer_id", "session_id", "event_type", "channel", "page", "amount",
        F.col("_transport_latency_ms").alias("transport_ms"),
    )


@query(
    "SELECT event_id, epoch_ms(ingest_ts) - epoch_ms(event_time) AS event_ms, "
    "epoch_ms(kafka_ts) - epoch_ms(event_time) AS transport_ms FROM src_app_event",
    ("src_app_event",),
)
def event_latency(src):
    timed = envelope.add_latencies(src["src_app_event"], ingest="ingest_ts")
    return timed.select(
        "event_id", F.col("_event_latency_ms").alias("event_ms"), F.col("_transport_latency_ms").alias("transport_ms")
    )


QUANTILES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}
_RANKED = (
    "ranked",
    "SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS i, count(*) OVER () AS n FROM picked",
)
_PICK = "CAST(coalesce(max(CASE WHEN i = round_even((n - 1) * {p}, 0) THEN ms END), 0) AS DOUBLE) AS {name}"
_PERCENTILES = (
    "SELECT " + ", ".join(_PICK.format(p=p, name=n) for n, p in QUANTILES.items())
    + ", count(*) AS sample_count FROM ranked"
)


@query(
    _PERCENTILES,
    ("src_app_event",),
    (("picked", "SELECT epoch_ms(ingest_ts) - epoch_ms(event_time) AS ms FROM src_app_event"), _RANKED),
)
def latency_percentiles(src):
    timed = envelope.add_latencies(src["src_app_event"], ingest="ingest_ts")
    return nearest_rank(timed, "_event_latency_ms", QUANTILES)


@query(
    _PERCENTILES,
    ("src_app_event",),
    (
        (
            "picked",
            "SELECT epoch_ms(ingest_ts) - epoch_ms(event_time) AS ms FROM src_app_event WHERE ingest_ts >= "
            "(SELECT max(ingest_ts) FROM src_app_event) - INTERVAL '2' DAY",
        ),
        _RANKED,
    ),
)
def latency_trailing_window(src):
    """Percentiles of the last stretch before the newest load time."""
    recent = trailing(src["src_app_event"], "ingest_ts", minutes=2 * 24 * 60)
    return nearest_rank(envelope.add_latencies(recent, ingest="ingest_ts"), "_event_latency_ms", QUANTILES)

