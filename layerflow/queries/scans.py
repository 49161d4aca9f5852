"""Scans and storage measures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from layerflow.plans.layers import BATCH, INGESTED
from layerflow.queries.base import money, moment, query, text
from layerflow.session import scratch_dir
from layerflow.sources import readers, sizes
from layerflow.sources.tables import TableStore


@query(
    "SELECT event_id, CAST(ingest_ts AS STRING) AS ingest_ts FROM src_app_event "
    "WHERE ingest_ts >= TIMESTAMP '2024-01-08 00:00:00' AND ingest_ts < TIMESTAMP '2024-01-22 00:00:00'",
    ("src_app_event",),
)
def layer_window_scan(src):
    """Two weeks of a layer kept by ingest day and batch, as jobs read it."""
    mark = f"l{uuid.uuid4().hex[:12]}"
    store = TableStore(src.spark, f"{scratch_dir(src.spark)}/{mark}")
    layer = src["src_app_event"].withColumnsRenamed({"ingest_ts": INGESTED}).withColumn(BATCH, F.lit(1).cast("long"))
    store.append(layer, f"{mark}_events", partition_by=INGESTED, batch_column=BATCH, batch=1)
    window = store.read_days(f"{mark}_events", INGESTED, "2024-01-08 00:00:00", "2024-01-22 00:00:00")
    return window.select("event_id", F.col("_meta_ingest_ts").cast("string").alias("ingest_ts"))


@query(
    "SELECT product_id, sku, category, CAST(unit_price AS DOUBLE) AS unit_price FROM src_product", ("src_product",)
)
def snapshot_select(src):
    src["src_product"].createOrReplaceTempView("layerflow_src_product")
    statement = readers.snapshot_query({"table": "src_product", "query": "SELECT * FROM layerflow_src_product"})
    return src.spark.sql(statement).select("product_id", "sku", "category", *money("unit_price"))


@query(
    "SELECT order_id, CAST(updated_at AS STRING) AS updated_at FROM src_order "
    "WHERE updated_at >= TIMESTAMP '1997-01-01 00:00:00' AND updated_at < TIMESTAMP '1998-01-01 00:00:00'",
    ("src_order",),
)
def backfill_window(src):
    src["src_order"].createOrReplaceTempView("layerflow_src_order")
    template = "SELECT * FROM layerflow_src_order WHERE updated_at >= %(from_ts)s AND updated_at < %(to_ts)s"
    statement = readers.snapshot_query({"query_template": template}, "1997-01-01 00:00:00", "1998-01-01 00:00:00")
    return src.spark.sql(statement).select("order_id", *text("updated_at"))


@query(
    "SELECT order_id, CAST(updated_at AS STRING) AS updated_at FROM src_order WHERE updated_at > TIMESTAMP '1999-06-30 00:00:00'",
    ("src_order",),
)
def incremental_load(src):
    loaded_until = moment("1999-06-30 00:00:00")
    return readers.incremental(src["src_order"], "updated_at", loaded_until).select("order_id", *text("updated_at"))


@query(
    "SELECT category, count(*) AS products, CAST(sum(unit_price) AS DOUBLE) AS total_price FROM src_product "
    "WHERE updated_at >= TIMESTAMP '2023-08-15 00:00:00' GROUP BY category",
    ("src_product",),
)
def parquet_partitioned_scan(src):
    """Written per day once, then a scan that opens only the days it needs."""
    path = f"{scratch_dir(src.spark)}/products-by-day-{uuid.uuid4().hex}"
    sizes.write_day_partitioned(src["src_product"], path, "updated_at")
    recent = src.spark.read.parquet(path).filter(F.col("p_date") >= F.lit("2023-08-15").cast("date"))
    return recent.groupBy("category").agg(
        F.count(F.lit(1)).alias("products"), F.sum("unit_price").cast("double").alias("total_price")
    )


@query()
def table_bytes(src):
    return sizes.table_bytes(src["lineitem"])


@query()
def layer_sizes(src):
    layers = {name: f"{src.directory}/{name}.parquet" for name in ("orders", "lineitem", "customer", "events")}
    return sizes.layer_sizes(src.spark, layers)
