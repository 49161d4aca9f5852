"""The whole path in one plan: events to daily revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from layerflow.operators.upsert import initial_rows
from layerflow.plans.layers import raw_to_work, work_to_silver
from layerflow.queries.base import decoded_orders, flow, moment
from layerflow.sales.specs import DAILY_REVENUE_SQL, LIVE_ONLY
from layerflow.sales.views import SalesSource


def silver_orders(src: SalesSource) -> DataFrame:
    spec = flow("fact_order")
    work = raw_to_work(decoded_orders(src), spec, now=moment())
    silver, _ = work_to_silver(work, spec, moment())
    return initial_rows(silver, spec.merge_keys, sequence=["updated_at"], now=moment())


def order_events_to_revenue(spark: SparkSession, directory: str) -> DataFrame:
    src = SalesSource(spark, directory)
    return src.sql(DAILY_REVENUE_SQL.replace("{keep}", LIVE_ONLY), fact_order=silver_orders(src))
