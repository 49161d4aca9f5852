"""Contract, standardization, audit and final projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerflow.operators import contract, shaping
from layerflow.operators.dedup import latest_per_key
from layerflow.plans.layers import raw_to_work, to_silver
from layerflow.queries.base import decoded_orders, flow, money, moment, query, text


@query(
    "SELECT TRY_CAST(order_id AS INT) AS order_id, CAST(total_amount AS DOUBLE) AS total_amount, "
    "TRY_CAST(channel AS BIGINT) AS channel, CAST(NULL AS STRING) AS coupon, order_status FROM src_order",
    ("src_order",),
)
def schema_contract(src):
    columns = [
        {"name": "order_id", "type": "int"},
        {"name": "total_amount", "type": "double"},
        {"name": "channel", "type": "bigint"},
        {"name": "coupon", "type": "string"},
    ]
    shaped = contract.apply_contract(src["src_order"], columns)
    return shaped.select("order_id", "total_amount", "channel", "coupon", "order_status")


@query(
    "SELECT order_id AS order_no, upper(trim(order_status)) AS status, "
    "length(upper(trim(order_status))) AS status_length FROM src_order WHERE total_amount > 100000",
    ("src_order",),
)
def rename_derive_filter(src):
    out = shaping.rename(src["src_order"], [{"from": "order_id", "to": "order_no"}, {"from": "absent", "to": "x"}])
    out = shaping.derive(
        out,
        [
            {"name": "status", "expr": "upper(trim(order_status))"},
            {"name": "status_length", "expr": "CAST(length(status) AS BIGINT)"},
        ],
    )
    return shaping.keep_where(out, "total_amount > 100000").select("order_no", "status", "status_length")


_CUSTOMER_HASH = (
    "sha256(concat_ws('||', CAST(customer_id AS STRING), full_name, coalesce(email, chr(0)), telephone, address, "
    "province, customer_segment, CAST(created_at AS STRING), CAST(updated_at AS STRING)))"
)


@query(
    "SELECT customer_id, email, 'raw' AS _layer, 'postgres' AS _source_system, 'load-1' AS _batch_id, "
    f"'customers' AS _table_name, {_CUSTOMER_HASH} AS _row_hash FROM src_customer",
    ("src_customer",),
)
def audit_row_hash(src):
    stamped = shaping.stamp_audit(
        src["src_customer"], layer="raw", batch_id="load-1", source_system="postgres", table_name="customers", at=moment()
    )
    return stamped.select("customer_id", "email", "_layer", "_source_system", "_batch_id", "_table_name", "_row_hash")


@query(
    "SELECT province, email, 'work' AS _layer FROM src_customer", ("src_customer",)
)
def select_keep_technical(src):
    stamped = src["src_customer"].withColumn("_layer", F.lit("work"))
    return shaping.select_keeping_technical(stamped, ["province", "email", "absent"])


@query(
    "SELECT customer_id, lower(trim(email)) AS email, trim(full_name) AS full_name, upper(trim(province)) AS province, "
    "upper(customer_segment) AS customer_segment, regexp_replace(telephone, '^09', '+849') AS telephone, "
    "coalesce(lower(trim(email)), telephone) AS contact, CAST(customer_id AS STRING) AS customer_code FROM src_customer",
    ("src_customer",),
)
def standardize_rules(src):
    rules = [
        {"name": "contact", "action": "expr", "expr": "telephone"},
        *flow("dim_customer").standard_rules[:-1],
        {"name": "contact", "action": "coalesce", "columns": ["email", "contact"]},
        {"column": "telephone", "action": "regexp_replace", "pattern": "^09", "replacement": "+849"},
        {"name": "customer_code", "action": "expr", "expr": "customer_id"},
        {"column": "customer_code", "action": "cast", "type": "string"},
    ]
    out = shaping.standardize(src["src_customer"], rules)
    return out.select(
        "customer_id", "email", "full_name", "province", "customer_segment", "telephone", "contact", "customer_code"
    )


@query(
    "SELECT order_id, customer_id, CAST(order_date AS STRING) AS order_date, upper(trim(order_status)) AS order_status, "
    "channel, CAST(total_amount AS DOUBLE) AS total_amount, CAST(updated_at AS STRING) AS updated_at, "
    "CAST(CAST(order_date AS DATE) AS STRING) AS order_ds, "
    "CAST(upper(trim(order_status)) IN ('PAID', 'SHIPPED') AS STRING) AS is_success_order, 'silver' AS _meta_layer "
    "FROM src_order",
    ("src_order",),
)
def final_projection(src):
    work = raw_to_work(decoded_orders(src), flow("fact_order"), now=moment())
    silver = to_silver(work, flow("fact_order")).drop("order_sk", "customer_sk")
    kept = [c for c in silver.columns if not c.startswith("_meta_") or c == "_meta_layer"]
    out = silver.select(*kept)
    return out.select(
        "order_id", "customer_id", *text("order_date"), "order_status", "channel", *money("total_amount"),
        *text("updated_at", "order_ds", "is_success_order"), "_meta_layer",
    )


@query(
    "SELECT customer_id, province, customer_segment, CAST(updated_at AS STRING) AS updated_at, log_offset FROM "
    "(SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC, log_offset DESC) AS r "
    "FROM customer_changes) s WHERE r = 1",
    ("customer_changes",),
)
def dedup_latest(src):
    latest = latest_per_key(src["customer_changes"], ["customer_id"], ["updated_at", "log_offset"])
    return latest.select("customer_id", "province", "customer_segment", *text("updated_at"), "log_offset")


@query(
    "SELECT customer_id, seq, CASE WHEN seq >= 2 THEN 'gold' END AS loyalty_tier, province FROM customer_changes",
    ("customer_changes",),
)
def schema_evolution_align(src):
    """A column that appears later: earlier rows get NULL, order is kept."""
    changes = src["customer_changes"].withColumn("seq", F.col("seq").cast("int"))
    first = changes.filter("seq < 2").select("customer_id", "seq", "province")
    later = changes.filter("seq >= 2").select("province", "customer_id", "seq", F.lit("gold").alias("loyalty_tier"))
    aligned, schema = contract.evolve(later, first.schema)
    return contract.align_to(first, schema).unionByName(aligned)

