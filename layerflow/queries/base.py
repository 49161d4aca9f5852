"""Registration of queries and helpers they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.config import FlowSpec
from layerflow.operators.envelope import build_events, decode_events
from layerflow.sales.specs import sales_registry
from layerflow.sales.views import SalesSource, as_ansi, view_chain
from layerflow.session import scratch_dir
from layerflow.sources.tables import TableStore

REGISTRY = sales_registry()

# A fixed moment in place of the clock, so that results can be compared.
MOMENT = "2024-06-01 00:00:00"


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SalesSource], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, directory: str) -> DataFrame:
        return self.build(SalesSource(spark, directory))


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, views: tuple[str, ...] = (), ctes: tuple[tuple[str, str], ...] = ()):
    """Register the function under its name; views become leading CTEs."""

    def register(build: Callable[[SalesSource], DataFrame]):
        text = None
        if sql is not None:
            parts = [(v, as_ansi(v)) for v in view_chain(*views)] + list(ctes)
            recursive = "RECURSIVE " if any("UNION" in body and f" {name} " in body for name, body in ctes) else ""
            lead = ", ".join(f"{name} AS ({body})" for name, body in parts)
            text = f"WITH {recursive}{lead} {sql}" if lead else sql
        QUERIES[build.__name__] = Query(build.__name__, build, text)
        return build

    return register


def moment(text: str = MOMENT) -> Column:
    return F.lit(text).cast("timestamp")


def text(*names: str) -> list[Column]:
    return [F.col(n).cast("string").alias(n) for n in names]


def money(*names: str) -> list[Column]:
    return [F.col(n).cast("double").alias(n) for n in names]


def flow(name: str) -> FlowSpec:
    return REGISTRY.flows[name]


ORDER_ROW = ["order_id", "customer_id", "order_date", "order_status", "channel", "total_amount", "updated_at"]
CUSTOMER_ROW = [
    "customer_id", "full_name", "email", "telephone", "address", "province", "customer_segment", "created_at", "updated_at",
]


# Partitions of each topic.
PARTITIONS = 4


def as_log(events: DataFrame, offset: Column, partitions: int = PARTITIONS) -> DataFrame:
    """Events as log records with a given offset."""
    return events.select(
        "key",
        "value",
        "topic",
        F.pmod(offset, F.lit(partitions)).cast("int").alias("partition"),
        offset.cast("long").alias("offset"),
        moment().alias("timestamp"),
    )


def order_log(src: SalesSource) -> DataFrame:
    events = build_events(
        src["src_order"],
        topic="sales.order",
        key_columns=["order_id"],
        batch_run_id="orders-1",
        source={"name": "postgres", "db": "sales", "table": "src_order"},
        ts_ms=F.unix_millis("updated_at"),
        config_version="2026.1",
        carry=["order_id"],
    )
    return as_log(events, F.col("order_id"))


def change_log(src: SalesSource) -> DataFrame:
    changes = src["customer_changes"]
    events = build_events(
        changes,
        topic="sales.customer",
        key_columns=["customer_id"],
        batch_run_id="customers-1",
        source={"name": "postgres", "db": "sales", "table": "src_customer"},
        op=F.col("op"),
        ts_ms=F.unix_millis("updated_at"),
        row_columns=CUSTOMER_ROW,
        carry=["log_offset", "customer_id"],
    )
    return as_log(events, F.col("log_offset") + F.when(F.col("log_offset") == 0, F.col("customer_id")).otherwise(0))


def decoded_orders(src: SalesSource, **options) -> DataFrame:
    """Orders as work starts from them: decoded from their log."""
    return decode_events(order_log(src), flow("fact_order"), REGISTRY.runtime, at=moment(), **options)


def decoded_changes(src: SalesSource, **options) -> DataFrame:
    """Customer changes, decoded from their log likewise."""
    return decode_events(change_log(src), flow("dim_customer"), REGISTRY.runtime, at=moment(), **options)


def apart(src) -> tuple[str, str, TableStore]:
    """A mark for names, a folder, and a store in it that no other run uses."""
    mark = f"d{uuid.uuid4().hex[:12]}"
    folder = f"{scratch_dir(src.spark)}/{mark}"
    return mark, folder, TableStore(src.spark, f"{folder}/tables")


def counted(frames: dict[str, DataFrame], name: str) -> DataFrame:
    """One row per frame: its name and its rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias(name), "n") for k, df in frames.items()]
    return reduce(DataFrame.unionAll, parts)
