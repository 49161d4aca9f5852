"""Source tables of the sales domain as SQL views over the given Parquet tables.

Every text runs on Spark and on an ANSI engine alike; ``{name}`` stands for
another view or table. Times are timestamps of the session's zone (use UTC).
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


VIEWS = {
    "src_customer": """
        SELECT c_custkey AS customer_id, concat(' ', c_name, ' ') AS full_name,
          CASE WHEN c_custkey % 50 = 0 THEN NULL
               WHEN c_custkey % 50 = 1 THEN concat('invalid-email-', CAST(c_custkey AS STRING))
               ELSE concat('User', CAST(c_custkey AS STRING), '@Example.com') END AS email,
          concat('09', lpad(CAST(c_custkey AS STRING), 8, '0')) AS telephone,
          concat('No ', CAST(c_custkey AS STRING), ' Street') AS address,
          n_name AS province, lower(c_mktsegment) AS customer_segment,
          CAST('2022-01-01 00:00:00' AS TIMESTAMP) + (c_custkey % 900) * INTERVAL '1' DAY AS created_at,
          CAST('2022-01-01 00:00:00' AS TIMESTAMP) + (c_custkey % 900 + c_custkey % 120) * INTERVAL '1' DAY AS updated_at
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "src_product": """
        SELECT p_partkey AS product_id,
          CASE WHEN p_partkey % 89 = 0 THEN NULL ELSE concat('SKU-', lpad(CAST(p_partkey AS STRING), 6, '0')) END AS sku,
          p_name AS product_name, lower(p_type) AS category,
          CASE WHEN p_partkey % 97 = 0 THEN CAST(-1 AS DECIMAL(18,2)) ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS unit_price,
          CAST('2023-06-01 00:00:00' AS TIMESTAMP) + (p_partkey % 100) * INTERVAL '1' DAY AS updated_at
        FROM {part}""",
    "src_order": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS TIMESTAMP) AS order_date,
          CASE WHEN o_orderkey % 101 = 0 THEN 'UNKNOWN' WHEN o_orderstatus = 'O' THEN 'created'
               WHEN o_orderstatus = 'P' THEN ' PAID ' ELSE 'SHIPPED' END AS order_status,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'web' WHEN '2' THEN 'mobile' WHEN '3' THEN 'agent' ELSE 'api' END AS channel,
          CASE WHEN o_orderkey % 100 = 0 THEN CAST(-1 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS total_amount,
          CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 5) * INTERVAL '1' DAY AS updated_at
        FROM {orders}""",
    "src_order_item": """
        SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id,
          CASE WHEN l_orderkey % 103 = 0 THEN -1 ELSE CAST(l_quantity AS INT) END AS quantity,
          CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
          CAST(l_discount AS DECIMAL(18,2)) AS discount_amount, CAST(l_extendedprice AS DECIMAL(18,2)) AS line_amount,
          CAST(l_shipdate AS TIMESTAMP) AS updated_at
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    # The item columns that need no price, so without the join to the parts.
    "src_order_line": """
        SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id,
          CASE WHEN l_orderkey % 103 = 0 THEN -1 ELSE CAST(l_quantity AS INT) END AS quantity,
          CAST(l_discount AS DECIMAL(18,2)) AS discount_amount, CAST(l_extendedprice AS DECIMAL(18,2)) AS line_amount,
          CAST(l_shipdate AS TIMESTAMP) AS updated_at
        FROM {lineitem}""",
    # A second payment of some orders; one scan per part, no join.
    "src_payment": """
        SELECT order_id * 10 + k AS payment_id, order_id, 'CARD' AS payment_method,
          CASE WHEN order_id % 37 = 0 THEN NULL ELSE concat('4', lpad(CAST(order_id AS STRING), 15, '0')) END AS card_number,
          CASE WHEN order_id % 100 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE amount END AS amount,
          paid_at, paid_at + k * INTERVAL '1' DAY AS updated_at
        FROM (SELECT o_orderkey AS order_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
                CAST(o_orderdate AS TIMESTAMP) AS paid_at, 0 AS k FROM {orders} WHERE o_orderkey % 10 <> 9
              UNION ALL
              SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)), CAST(o_orderdate AS TIMESTAMP), 1
              FROM {orders} WHERE o_orderkey % 20 = 3) s""",
    "src_app_event": """
        SELECT CAST(event_id AS STRING) AS event_id, CAST(ts AS TIMESTAMP) AS event_time, user_id AS customer_id,
          concat('s', CAST(user_id % 50 AS STRING)) AS session_id, event_type,
          CASE event_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' WHEN 2 THEN 'agent' ELSE 'api' END AS channel,
          concat('/', event_type) AS page, CASE WHEN event_type = 'purchase' THEN value ELSE NULL END AS amount,
          CAST(ts AS TIMESTAMP) + (event_id % 100) * INTERVAL '0.001' SECOND AS kafka_ts,
          CAST(ts AS TIMESTAMP) + (event_id % 100 + event_id % 700) * INTERVAL '0.001' SECOND AS ingest_ts
        FROM {events}""",
    "customer_changes": """
        SELECT c.*, 'r' AS op, 0 AS seq, CAST(0 AS BIGINT) AS log_offset FROM {src_customer} c
        UNION ALL SELECT customer_id, full_name, email, telephone, address, province, 'vip', created_at,
          updated_at + INTERVAL '30' DAY, 'u', 1, 1000000 + customer_id FROM {src_customer} WHERE customer_id % 3 = 0
        UNION ALL SELECT customer_id, full_name, email, telephone, address, 'MOVED', 'vip', created_at,
          updated_at + INTERVAL '60' DAY, 'u', 2, 2000000 + customer_id FROM {src_customer} WHERE customer_id % 9 = 0
        UNION ALL SELECT customer_id, full_name, email, telephone, address, province, 'vip', created_at,
          updated_at + INTERVAL '30' DAY, 'u', 3, 3000000 + customer_id FROM {src_customer} WHERE customer_id % 6 = 0
        UNION ALL SELECT customer_id, full_name, email, telephone, address, province, customer_segment, created_at,
          updated_at + INTERVAL '90' DAY, 'd', 4, 4000000 + customer_id FROM {src_customer} WHERE customer_id % 21 = 0""",
    "expected_violation": """
        SELECT 'src_customer' AS source_table, CAST(customer_id AS STRING) AS source_pk,
          CASE WHEN email IS NULL THEN 'CUST_EMAIL_PRESENT' ELSE 'CUST_EMAIL_FORMAT' END AS rule_id
        FROM {src_customer} WHERE email IS NULL OR customer_id % 50 = 1
        UNION ALL SELECT 'src_order', CAST(order_id AS STRING), 'ORDER_TOTAL_POSITIVE' FROM {src_order} WHERE order_id % 100 = 0
        UNION ALL SELECT 'src_order', CAST(order_id AS STRING), 'ORDER_STATUS_KNOWN' FROM {src_order} WHERE order_id % 101 = 0
        UNION ALL SELECT 'src_payment', CAST(payment_id AS STRING), 'PAY_AMOUNT_POSITIVE' FROM {src_payment} WHERE order_id % 100 = 0""",
    # Run records: one load run per customer, its size taken from the orders.
    "batch_run": """
        SELECT concat('run-', CAST(o_custkey AS STRING)) AS batch_id,
          CASE WHEN o_custkey % 2 = 0 THEN 'orders' ELSE 'payments' END AS table_name,
          CASE WHEN o_custkey % 5 = 0 THEN 'baseline' ELSE 'layered' END AS layout,
          CASE o_custkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN '1gb' ELSE '10gb' END AS scale,
          count(*) AS row_count, CAST(1 + o_custkey % 7 AS BIGINT) AS elapsed_sec,
          CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS bytes_written
        FROM {orders} GROUP BY o_custkey""",
    "governed_run": """
        SELECT concat('run-', CAST(o_custkey AS STRING)) AS batch_id,
          count(*) AS source_rows FROM {orders} WHERE o_orderstatus <> 'P' GROUP BY o_custkey""",
    "lineage_event": """
        SELECT concat('source.c', CAST(o_custkey % 7 AS STRING)) AS from_entity, 'raw.orders' AS to_entity,
          concat('run-', CAST(o_custkey AS STRING)) AS batch_id
        FROM {orders} WHERE o_orderpriority = '1-URGENT'""",
    # Catalog assets: one per product.
    "catalog_asset": """
        SELECT concat('sales.', replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING)) AS asset,
          CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat('Table of ', p_name, ' parts') END AS description,
          CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS owner,
          CASE WHEN p_partkey % 5 = 0 THEN '' ELSE lower(p_type) END AS tags,
          concat('size_', CAST(p_size AS STRING), ',', lower(p_type), '_price') AS column_names
        FROM {part}""",
    # Upstream edges: mart -> every tenth order -> earlier orders -> customers -> nations -> regions.
    "asset_edge": """
        SELECT 'mart' AS asset, concat('order:', CAST(o_orderkey AS STRING)) AS upstream FROM {orders} WHERE o_orderkey % 10 = 9
        UNION ALL SELECT concat('order:', CAST(o_orderkey AS STRING)), concat('order:', CAST(o_orderkey - 1 AS STRING))
          FROM {orders} WHERE o_orderkey % 10 <> 0
        UNION ALL SELECT concat('order:', CAST(o_orderkey AS STRING)), concat('customer:', CAST(o_custkey AS STRING)) FROM {orders}
        UNION ALL SELECT concat('customer:', CAST(c_custkey AS STRING)), concat('nation:', CAST(c_nationkey AS STRING)) FROM {customer}
        UNION ALL SELECT concat('nation:', CAST(n_nationkey AS STRING)), concat('region:', CAST(n_regionkey AS STRING)) FROM {nation}
        UNION ALL SELECT concat('region:', CAST(r_regionkey AS STRING)), 'mart' FROM {region}""",
    # Query runs: time and bytes of each run of a query class in a layout.
    "query_run": """
        SELECT CASE l_linenumber % 3 WHEN 0 THEN 'channel_scan' WHEN 1 THEN 'cross_layer' ELSE 'category_rollup' END AS query,
          CASE WHEN l_returnflag = 'A' THEN 'baseline' ELSE 'layered' END AS layout,
          CAST(l_quantity AS BIGINT) * 10 + l_linenumber AS exec_ms,
          CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS scanned_bytes
        FROM {lineitem}""",
}

DEPENDS = {
    name: tuple(n for n in (*BASE_TABLES, *VIEWS) if "{" + n + "}" in text) for name, text in VIEWS.items()
}


class SalesSource:
    """Tables and views of one data directory, each built once and lazily."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in VIEWS:
                inputs = {dep: self[dep] for dep in DEPENDS[name]}
                self._known[name] = self.spark.sql(VIEWS[name], **inputs)
            else:
                self._known[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        return self._known[name]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """A SQL text whose ``{name}`` marks are frames, views or tables."""
        named = {n: self[n] for n in (*BASE_TABLES, *VIEWS) if "{" + n + "}" in text and n not in frames}
        return self.spark.sql(text, **named, **frames)


def view_chain(*names: str) -> list[str]:
    """The views needed for ``names``, dependencies first."""
    chain: list[str] = []

    def visit(name: str) -> None:
        for dep in DEPENDS[name]:
            if dep in VIEWS:
                visit(dep)
        if name not in chain:
            chain.append(name)

    for name in names:
        visit(name)
    return chain


def as_ansi(name: str) -> str:
    text = VIEWS[name]
    for dep in DEPENDS[name]:
        text = text.replace("{" + dep + "}", dep)
    return text
