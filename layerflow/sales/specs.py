"""Flows, tables, models and jobs of the sales domain, declared as data."""

from __future__ import annotations

from layerflow.config import registry_from

# Order states, and the two that count as a sale.
ORDER_STATES = ["CREATED", "PAID", "SHIPPED", "CANCELLED"]
CHANNELS = ["agent", "api", "mobile", "web"]
EMAIL_RULE = r"^[^@]+@[^@]+\.[^@]+$"

PERSON_MASKS = {
    "full_name": {"method": "sha256"},
    "email": {"method": "email_mask"},
    "telephone": {"method": "phone_mask"},
    "address": {"method": "nullify"},
}
CARD_MASKS = {"card_number": {"method": "last4"}}


def _columns(**types):
    return [{"name": n, "type": t} for n, t in types.items()]


CUSTOMER_COLUMNS = [
    {"name": "customer_id", "type": "long", "nullable": False, "description": "Customer number of the source"},
    *[
        {"name": n, "type": "string", "classification": ["PII"]}
        for n in ("full_name", "email", "telephone", "address")
    ],
    *_columns(province="string", customer_segment="string", created_at="timestamp", updated_at="timestamp"),
]
PRODUCT_COLUMNS = [
    {"name": "product_id", "type": "long", "nullable": False},
    {"name": "sku", "type": "string", "nullable": False},
    *_columns(product_name="string", category="string", unit_price="decimal(18,2)", updated_at="timestamp"),
]
ORDER_COLUMNS = [
    {"name": "order_id", "type": "long", "nullable": False},
    {"name": "customer_id", "type": "long", "nullable": False},
    *_columns(order_date="timestamp", order_status="string", channel="string",
              total_amount="decimal(18,2)", updated_at="timestamp"),
]
ITEM_COLUMNS = [
    {"name": "order_item_id", "type": "long", "nullable": False},
    *_columns(order_id="long", product_id="long", quantity="int", line_amount="decimal(18,2)", updated_at="timestamp"),
]
PAYMENT_COLUMNS = [
    {"name": "payment_id", "type": "long", "nullable": False},
    *_columns(order_id="long", payment_method="string"),
    {"name": "card_number", "type": "string", "classification": ["PCI"]},
    *_columns(amount="decimal(18,2)", paid_at="timestamp", updated_at="timestamp"),
]



def _rule(rule_id, kind, column, severity="critical", **more):
    return {"rule_id": rule_id, "type": kind, "column": column, "severity": severity, **more}


def _month(name, column):
    """The first day of a date's month. Tables are partitioned by it: the orders of
    a day are few, and a partition of its own for each makes thousands of files."""
    return {"name": name, "expr": f"trunc({column}, 'MM')"}


def _text(**actions):
    """Standardization per column: spaces go, then the named actions."""
    return [{"column": c, "action": a} for c, then in actions.items() for a in ("trim", *then.split())]


# Rules of the declared tables. The ids of these are compared by queries.
CUSTOMER_RULES = [
    _rule("CUST_PHONE_SHAPE", "regex", "telephone", "warning", pattern="^09[0-9]{8}$"),
    _rule("CUST_EMAIL_FORMAT", "regex", "email", "warning", pattern=EMAIL_RULE),
    _rule("CUST_EMAIL_PRESENT", "not_null", "email"),
    _rule("CUST_CHANGED_LATER", "expr", "updated_at", "warning", expr="updated_at >= created_at"),
]
ORDER_RULES = [
    _rule("ORDER_CHANGED_LATER", "expr", "updated_at", "warning", expr="updated_at >= order_date"),
    _rule("ORDER_CHANNEL_KNOWN", "in_set", "channel", "warning", values=CHANNELS),
    _rule("ORDER_STATUS_KNOWN", "in_set", "order_status", values=ORDER_STATES),
    _rule("ORDER_TOTAL_POSITIVE", "positive", "total_amount"),
]
PRODUCT_RULES = [
    _rule("LIST_PRICE_IN_RANGE", "range", "unit_price", min=0.01, max=1_000_000),
    _rule("STOCK_NUMBER_SHAPE", "regex", "sku", pattern="^SKU-[0-9]{6,}$"),
    _rule("STOCK_NUMBER_GIVEN", "not_null", "sku"),
]
ITEM_RULES = [
    _rule("LINE_TOTAL_AGREES", "expr", "line_amount", "warning", expr="line_amount >= 0.01 * quantity"),
    _rule("QUANTITY_IN_RANGE", "range", "quantity", min=1, max=10_000),
]
PAYMENT_RULES = [
    _rule("PAY_AMOUNT_POSITIVE", "positive", "amount"),
    _rule("CARD_HAS_DIGITS", "regex", "card_number", "warning", pattern="[0-9]{4}$"),
    _rule("PAID_BEFORE_CHANGED", "expr", "paid_at", "warning", expr="paid_at <= updated_at OR updated_at IS NULL"),
]


def _flow_target(entity: str, silver: str, partition_by: str) -> dict:
    return {
        "raw_table": f"raw.{entity}_events",
        "work_table": f"work.{entity}_rows",
        "silver_table": f"silver.{silver}",
        "quarantine_table": f"quarantine.{silver}_failed",
        "partition_by": partition_by,
        "delete_mode": "soft_delete",
    }


DAILY_REVENUE_SQL = """
    WITH kept AS (
      SELECT order_ds, order_status, order_id, total_amount, if(is_success_order, total_amount, 0) AS earned
      FROM {fact_order} {keep})
    SELECT order_ds, order_status, sum(earned) AS success_amount, sum(total_amount) AS total_amount,
      count(DISTINCT order_id) AS order_count
    FROM kept GROUP BY order_status, order_ds"""
LIVE_ONLY = "WHERE NOT coalesce(_meta_is_deleted, false)"
SUCCESS_RATIO_SQL = """
    SELECT order_ds, order_status, success_amount, total_amount, order_count,
      if(total_amount = 0, 0, success_amount / total_amount) AS success_ratio
    FROM {daily_revenue}"""

DOCUMENT = {
    "metadata_version": "1",
    "runtime": {"config_version": "2026.1", "source_system": "postgres"},
    "connections": {"event_log": {"type": "files", "path": "${EVENT_LOG_DIR:-event-log}", "format": "parquet"}},
    "rule_sets": {
        "reachable": _text(email="lower", telephone=""),
        "written_names": _text(address="", full_name="", customer_segment="upper"),
    },
    "quality_rule_sets": {"not_empty": [{"rule_id": "MODEL_NOT_EMPTY", "type": "row_count_positive"}]},
    "flows": [
        {
            "name": "dim_customer",
            "entity_type": "dimension",
            "scd_type": 2,
            "description": "Customers with their history.",
            "owner": "sales-data",
            "domain": "sales",
            "tags": ["dimension", "personal-data"],
            "source": {"connection": "event_log", "topics": ["sales.customer"]},
            "target": _flow_target("customer", "dim_customer", "changed_month"),
            "natural_key": ["customer_id"],
            "sequence_column": "updated_at",
            "schema_contract": {"columns": CUSTOMER_COLUMNS},
            "standardization": {
                "use_rule_sets": ["reachable", "written_names"],
                "rules": [{"name": "mail_domain", "action": "expr", "expr": "substring_index(email, '@', -1)"}],
            },
            "business_logic": {
                "derive_columns": [
                    {"name": "known_days", "expr": "datediff(updated_at, created_at)"},
                    {"name": "area_code", "expr": "split_part(telephone, '-', 1)"},
                    _month("changed_month", "updated_at"),
                ]
            },
            "data_quality": {
                "rules": [
                    _rule("CUSTOMER_NUMBER_IN_RANGE", "range", "customer_id", min=1),
                    _rule("MAIL_SHAPE", "regex", "email", pattern=EMAIL_RULE),
                    _rule("CHANGED_AFTER_CREATED", "expr", "updated_at", "warning", expr="known_days >= 0"),
                ]
            },
            "pii_policy": PERSON_MASKS,
            "surrogate_key": {
                "column": "customer_sk",
                "keys": ["customer_id"],
                "scd_type": 2,
                "effective_from": "updated_at",
            },
        },
        {
            "name": "dim_product",
            "entity_type": "dimension",
            "scd_type": 1,
            "description": "Products, newest state only.",
            "owner": "sales-data",
            "domain": "sales",
            "tags": ["dimension"],
            "source": {"connection": "event_log", "topics": ["sales.product"]},
            "target": _flow_target("product", "dim_product", "changed_month"),
            "natural_key": ["product_id"],
            "sequence_column": "updated_at",
            "schema_contract": {"columns": PRODUCT_COLUMNS},
            "standardization": {
                "rules": _text(product_name="lower", category="")
            },
            "business_logic": {
                "derive_columns": [
                    {"name": "price_band", "expr": "width_bucket(unit_price, 0, 2000, 8)"},
                    {"name": "material", "expr": "substring_index(category, ' ', -1)"},
                    _month("changed_month", "updated_at"),
                ]
            },
            "data_quality": {"rules": PRODUCT_RULES},
            "surrogate_key": {"column": "product_sk", "keys": ["product_id"], "scd_type": 1},
        },
        {
            "name": "fact_order",
            "entity_type": "fact",
            "description": "Orders with their customer key.",
            "owner": "sales-data",
            "domain": "sales",
            "tags": ["fact"],
            "source": {"connection": "event_log", "topics": ["sales.order"]},
            "target": _flow_target("order", "fact_order", "order_month"),
            "natural_key": ["order_id"],
            "sequence_column": "updated_at",
            "schema_contract": {"columns": ORDER_COLUMNS},
            "standardization": {
                "rules": [
                    {"column": "order_status", "action": "trim"},
                    {"column": "order_status", "action": "upper"},
                    {"column": "total_amount", "action": "cast", "type": "decimal(18,2)"},
                    {"name": "order_ds", "action": "expr", "expr": "to_date(order_date)"},
                ]
            },
            "business_logic": {
                "derive_columns": [
                    {"name": "is_success_order", "expr": "coalesce(order_status IN ('PAID', 'SHIPPED'), false)"},
                    _month("order_month", "order_date"),
                ]
            },
            "data_quality": {
                "rules": [
                    *ORDER_RULES,
                    _rule("CHANGED_WITHIN_A_MONTH", "expr", "updated_at", "warning", expr="datediff(updated_at, order_date) <= 31"),
                ]
            },
            "surrogate_key": {"column": "order_sk", "keys": ["order_id"], "scd_type": "none"},
            "foreign_keys": [
                {
                    "name": "customer_sk",
                    "lookup_table": "silver.dim_customer",
                    "lookup_key": ["customer_id"],
                    "lookup_value": "customer_sk",
                    "unknown_value": -1,
                }
            ],
        },
    ],
    "tables": [
        {
            "name": name,
            "domain": "sales",
            "owner": "sales-data",
            "description": f"Sales {name.replace('_', ' ')}.",
            "source": {"type": "table", "table": f"source_{name}"},
            "target": {"table_name": name, "partition_by": partition_by, "write_mode": mode},
            "primary_key": [key],
            "watermark_column": "updated_at",
            "schema_contract": {"columns": columns},
            "transformations": {
                "work": {"cast_to_schema": True, **work},
                "silver": {"deduplicate": {"keys": [key], "order_by": "updated_at"}},
            },
            "governance": {"dq_rules": rules, "pii_columns": masks},
        }
        for name, key, columns, partition_by, mode, work, rules, masks in [
            (
                "customers", "customer_id", CUSTOMER_COLUMNS, "created_month", "append",
                {"derive_columns": [_month("created_month", "created_at")]},
                [*CUSTOMER_RULES, {"rule_id": "CUST_ID_UNIQUE", "type": "unique", "columns": ["customer_id"]}],
                PERSON_MASKS,
            ),
            ("products", "product_id", PRODUCT_COLUMNS, "updated_at", "append", {}, PRODUCT_RULES, {}),
            (
                "orders", "order_id", ORDER_COLUMNS, "order_month", "merge",
                {"derive_columns": [
                    {"name": "order_status", "expr": "upper(trim(order_status))"},
                    {"name": "order_ds", "expr": "to_date(order_date)"},
                    _month("order_month", "order_date"),
                ]},
                ORDER_RULES, {},
            ),
            (
                "order_items", "order_item_id", ITEM_COLUMNS, "changed_month", "merge",
                {"derive_columns": [_month("changed_month", "updated_at")]}, ITEM_RULES, {},
            ),
            (
                "payments", "payment_id", PAYMENT_COLUMNS, "paid_month", "merge",
                {"derive_columns": [_month("paid_month", "paid_at")]}, PAYMENT_RULES, CARD_MASKS,
            ),
        ]
    ],
    "models": [
        {
            "name": "daily_revenue",
            "layer": "gold",
            "target": "gold.daily_revenue",
            "upstream": ["silver.fact_order"],
            "description": "Revenue per day and order state.",
            "sql": DAILY_REVENUE_SQL.replace("{keep}", LIVE_ONLY).replace("{fact_order}", "silver.fact_order"),
            "quality": {
                "use_rule_sets": ["not_empty"],
                "rules": [
                    {"rule_id": "REVENUE_DAY_PRESENT", "type": "not_null", "column": "order_ds"},
                    {"rule_id": "REVENUE_AMOUNT_NOT_NEGATIVE", "type": "non_negative", "column": "total_amount"},
                    {"rule_id": "REVENUE_COUNT_NOT_NEGATIVE", "type": "non_negative", "column": "order_count"},
                ],
            },
        },
        {
            "name": "sales_board",
            "layer": "mart",
            "target": "mart.sales_board",
            "upstream": ["gold.daily_revenue"],
            "description": "Revenue with its success share.",
            "sql": SUCCESS_RATIO_SQL.replace("{daily_revenue}", "gold.daily_revenue"),
            "quality": {
                "use_rule_sets": ["not_empty"],
                "rules": [
                    {"rule_id": "BOARD_DAY_PRESENT", "type": "not_null", "column": "order_ds"},
                    {"rule_id": "BOARD_RATIO_RANGE", "type": "range", "column": "success_ratio",
                     "min": 0, "max": 1, "severity": "warning"},
                ],
            },
        },
    ],
    "batch_sources": [
        {
            "name": f"{name}_snapshot",
            "flow_name": flow,
            "source": {"table": f"src_{name}", "database": "sales", "query": f"SELECT * FROM src_{name}"},
            "event": {"topic": f"sales.{name}", "key_columns": [f"{name}_id"], "op": "r"},
        }
        for name, flow in (("customer", "dim_customer"), ("product", "dim_product"), ("order", "fact_order"))
    ]
    + [
        {
            "name": "order_backfill",
            "enabled": False,
            "flow_name": "fact_order",
            "mode": "backfill",
            "source": {
                "table": "src_order",
                "database": "sales",
                "query_template": "SELECT * FROM src_order WHERE updated_at >= %(from_ts)s AND updated_at < %(to_ts)s",
            },
            "event": {"topic": "sales.order", "key_columns": ["order_id"], "op": "r"},
        }
    ],
    "jobs": [
        {
            "name": "order_customer_keys",
            "fact_table": "silver.fact_order",
            "fact_key": ["order_id"],
            "unknown_fk_column": "customer_sk",
            "unknown_value": -1,
            "lookup_table": "silver.dim_customer",
            "lookup_keys": [{"fact_column": "customer_id", "lookup_column": "customer_id"}],
            "lookup_value": "customer_sk",
            "current_filter": "is_current",
            "update_columns": ["customer_sk"],
        }
    ],
}


def sales_registry(**changes):
    """The sales registry; keyword arguments replace top-level entries."""
    return registry_from({**DOCUMENT, **changes})
