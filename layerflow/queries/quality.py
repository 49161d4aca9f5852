"""Quality rules, quarantine and masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerflow.functions.conditions import rule_condition
from layerflow.operators import privacy, quality
from layerflow.plans.models import REVENUE_BY_STATUS
from layerflow.plans.tables import governed
from layerflow.queries.base import REGISTRY, moment, query
from layerflow.sales.specs import CARD_MASKS, CUSTOMER_RULES, EMAIL_RULE, ORDER_RULES, PERSON_MASKS


def _failures(df, key: str, rule: dict, as_of=None):
    """Keys of the rows a single rule sends to quarantine."""
    rule = {"rule_id": "R", **rule}
    _, failed = quality.split(quality.annotate(df, [rule], as_of=as_of), [rule])
    return failed.select(key)


@query("SELECT customer_id FROM src_customer WHERE email IS NULL", ("src_customer",))
def dq_not_null(src):
    return _failures(src["src_customer"], "customer_id", {"type": "not_null", "column": "email"})


@query(
    f"SELECT customer_id FROM src_customer WHERE NOT regexp_matches(email, '{EMAIL_RULE}')", ("src_customer",)
)
def dq_regex(src):
    return _failures(src["src_customer"], "customer_id", {"type": "regex", "column": "email", "pattern": EMAIL_RULE})


@query("SELECT payment_id FROM src_payment WHERE NOT amount > 0", ("src_payment",))
def dq_positive(src):
    return _failures(src["src_payment"], "payment_id", {"type": "positive", "column": "amount"})


@query("SELECT order_id FROM src_order WHERE NOT total_amount >= 0", ("src_order",))
def dq_non_negative(src):
    return _failures(src["src_order"], "order_id", {"type": "non_negative", "column": "total_amount"})


@query(
    "SELECT order_id FROM src_order WHERE upper(trim(order_status)) NOT IN ('CREATED', 'PAID', 'SHIPPED', 'CANCELLED')",
    ("src_order",),
)
def dq_in_set(src):
    orders = src["src_order"].withColumn("order_status", F.upper(F.trim("order_status")))
    return _failures(orders, "order_id", next(r for r in ORDER_RULES if r["rule_id"] == "ORDER_STATUS_KNOWN"))


@query("SELECT product_id FROM src_product WHERE unit_price < 1 OR unit_price > 1000", ("src_product",))
def dq_range(src):
    return _failures(src["src_product"], "product_id", {"type": "range", "column": "unit_price", "min": 1, "max": 1000})


@query(
    "SELECT product_id FROM src_product WHERE abs(epoch(updated_at) - epoch(TIMESTAMP '2023-08-01 00:00:00')) > 720 * 3600",
    ("src_product",),
)
def dq_freshness(src):
    rule = {"type": "freshness_hours", "column": "updated_at", "threshold": 720}
    return _failures(src["src_product"], "product_id", rule, moment("2023-08-01 00:00:00"))


@query(
    "SELECT order_item_id, product_id FROM (SELECT *, count(*) OVER (PARTITION BY order_item_id) AS n "
    "FROM src_order_line) s WHERE n > 1",
    ("src_order_line",),
)
def dq_unique(src):
    rule = {"rule_id": "ITEM_UNIQUE", "type": "unique", "columns": ["order_item_id"]}
    _, failed = quality.split(quality.annotate(src["src_order_line"], [rule]), [rule])
    return failed.select("order_item_id", "product_id")


@query("SELECT order_item_id, product_id FROM src_order_line WHERE NOT (discount_amount < 0.05 OR quantity > 30)",
       ("src_order_line",))
def dq_expr(src):
    rule = {"rule_id": "R", "type": "expr", "expr": "discount_amount < 0.05 OR quantity > 30"}
    checked = quality.annotate(src["src_order_line"], [rule])
    return quality.split(checked, [rule])[1].select("order_item_id", "product_id")


_ORDER_ERRORS = (
    "concat_ws(',', CASE WHEN NOT updated_at >= order_date THEN 'ORDER_CHANGED_LATER' END, "
    "CASE WHEN channel NOT IN ('agent', 'api', 'mobile', 'web') THEN 'ORDER_CHANNEL_KNOWN' END, "
    "CASE WHEN upper(trim(order_status)) NOT IN ('CREATED', 'PAID', 'SHIPPED', 'CANCELLED') THEN 'ORDER_STATUS_KNOWN' END, "
    "CASE WHEN NOT total_amount > 0 THEN 'ORDER_TOTAL_POSITIVE' END)"
)


def _standard_orders(src):
    return src["src_order"].withColumn("order_status", F.upper(F.trim("order_status")))


@query(
    f"SELECT order_id, {_ORDER_ERRORS} AS errors, CAST({_ORDER_ERRORS} = '' AS STRING) AS passed FROM src_order",
    ("src_order",),
)
def dq_split_errors(src):
    checked = quality.annotate(_standard_orders(src), ORDER_RULES)
    return checked.select(
        "order_id", F.concat_ws(",", "_dq_errors").alias("errors"), F.col("_dq_passed").cast("string").alias("passed")
    )


_METRIC = (
    "SELECT '{rule}' AS rule_id, '{severity}' AS severity, count(*) AS total_rows, "
    "count(*) FILTER (WHERE errors = '') AS passed_rows, count(*) FILTER (WHERE errors LIKE '%{rule}%') AS failed_rows, "
    "count(*) FILTER (WHERE errors <> '') AS total_failed_rows FROM checked"
)


@query(
    " UNION ALL ".join(_METRIC.format(rule=r["rule_id"], severity=r["severity"]) for r in ORDER_RULES),
    ("src_order",),
    (("checked", f"SELECT {_ORDER_ERRORS} AS errors FROM src_order"),),
)
def dq_rule_metrics(src):
    return quality.rule_metrics(quality.annotate(_standard_orders(src), ORDER_RULES), ORDER_RULES)


@query(
    "SELECT customer_id, CASE WHEN email IS NULL THEN 'CUST_EMAIL_PRESENT' ELSE 'CUST_EMAIL_FORMAT' END AS reason "
    f"FROM src_customer WHERE email IS NULL OR NOT regexp_matches(email, '{EMAIL_RULE}')",
    ("src_customer",),
)
def quarantine_reason(src):
    _, failed = governed(src["src_customer"], REGISTRY.tables["customers"])
    return failed.select("customer_id", F.col("_quarantine_reason").alias("reason"))


@query(
    "SELECT customer_id FROM src_customer WHERE email IS NULL", ("src_customer",)
)
def dq_critical_only(src):
    """Warnings are recorded but only critical failures are quarantined."""
    checked = quality.annotate(src["src_customer"], CUSTOMER_RULES)
    return quality.split(checked, CUSTOMER_RULES, enforce="critical")[1].select("customer_id")


_MODEL_RULES = [
    {"rule_id": "NOT_EMPTY", "type": "row_count_positive"},
    {"rule_id": "DAY_PRESENT", "type": "not_null", "column": "order_ds"},
    {"rule_id": "AMOUNT_NOT_NEGATIVE", "type": "non_negative", "column": "order_amount", "severity": "warning"},
    {"rule_id": "PAID_RANGE", "type": "range", "column": "paid_amount", "min": 0, "max": 2000000},
]
_MODEL_SQL = (
    "SELECT to_d AS order_ds, order_status, sum(total_amount) AS order_amount, sum(paid) AS paid_amount FROM "
    "(SELECT CAST(o.order_date AS DATE) AS to_d, o.order_status, o.total_amount, coalesce(p.amount, 0) AS paid "
    "FROM src_order o LEFT JOIN src_payment p ON o.order_id = p.order_id) s GROUP BY to_d, order_status"
)
_CHECK = (
    "SELECT 'revenue' AS model, 'gold.revenue' AS target, '{id}' AS rule_id, '{severity}' AS severity, "
    "count(*) AS total_rows, {failed} AS failed_rows, CASE WHEN {failed} = 0 THEN 'success' ELSE 'failed' END AS status "
    "FROM model"
)


@query(
    " UNION ALL ".join(
        _CHECK.format(id=r["rule_id"], severity=r.get("severity", "critical"), failed=f)
        for r, f in zip(
            _MODEL_RULES,
            (
                "CAST(CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS BIGINT)",
                "count(*) FILTER (WHERE order_ds IS NULL)",
                "count(*) FILTER (WHERE NOT order_amount >= 0)",
                "count(*) FILTER (WHERE NOT (paid_amount >= 0 AND paid_amount <= 2000000))",
            ),
        )
    ),
    ("src_order", "src_payment"),
    (("model", _MODEL_SQL),),
)
def model_quality(src):
    model = src.sql(REVENUE_BY_STATUS, orders=src["src_order"], payments=src["src_payment"])
    return quality.model_quality(model, _MODEL_RULES, model="revenue", target="gold.revenue")


@query(
    "SELECT customer_id, sha256(full_name) AS full_name, CASE WHEN email IS NOT NULL THEN "
    "concat(substr(string_split(email, '@')[1], 1, 1), '***@', string_split(email, '@')[-1]) END AS email, "
    "concat('***', right(telephone, 4)) AS telephone, CAST(NULL AS STRING) AS address, province FROM src_customer",
    ("src_customer",),
)
def mask_person(src):
    masked = privacy.apply_masks(src["src_customer"], {**PERSON_MASKS, "province": {"method": "keep"}, "absent": {}})
    return masked.select("customer_id", "full_name", "email", "telephone", "address", "province")


@query(
    "SELECT payment_id, CASE WHEN card_number IS NOT NULL THEN concat('****-****-****-', right(card_number, 4)) END "
    "AS card_number FROM src_payment",
    ("src_payment",),
)
def mask_card(src):
    return privacy.apply_masks(src["src_payment"], CARD_MASKS).select("payment_id", "card_number")


_CHECKS = (
    ("full_name", "sha256", "count(full_name)", "count(*) FILTER (WHERE NOT regexp_matches(full_name, '^[0-9a-f]{64}$'))"),
    ("email", "email_mask", "count(email)",
     f"count(*) FILTER (WHERE regexp_matches(email, '{EMAIL_RULE}') AND NOT contains(email, '***'))"),
    ("telephone", "phone_mask", "count(telephone)", "count(*) FILTER (WHERE NOT starts_with(telephone, '***'))"),
    ("address", "nullify", "count(*)", "count(address)"),
)
_HALF_MASKED = (
    "SELECT CASE WHEN customer_id % 4 = 0 THEN full_name ELSE sha256(full_name) END AS full_name, "
    "CASE WHEN customer_id % 3 = 0 THEN email ELSE 'U***@' || string_split(email, '@')[-1] END AS email, "
    "concat('***', right(telephone, 4)) AS telephone, CASE WHEN customer_id % 10 = 0 THEN address END AS address "
    "FROM src_customer"
)


@query(
    " UNION ALL ".join(
        f"SELECT 'customers' AS table_name, '{c}' AS column_name, '{m}' AS method, {t} AS total, {u} AS unmasked FROM half"
        for c, m, t, u in _CHECKS
    ),
    ("src_customer",),
    (("half", _HALF_MASKED),),
)
def masking_checks(src):
    """A table whose masks were applied to some rows only."""
    customers = src["src_customer"]
    key = F.col("customer_id")
    half = customers.select(
        F.when(key % 4 == 0, F.col("full_name")).otherwise(F.sha2("full_name", 256)).alias("full_name"),
        F.when(key % 3 == 0, F.col("email"))
        .otherwise(F.concat(F.lit("U***@"), F.substring_index("email", "@", -1))).alias("email"),
        F.concat(F.lit("***"), F.substring("telephone", -4, 4)).alias("telephone"),
        F.when(key % 10 == 0, F.col("address")).alias("address"),
    )
    return privacy.masking_checks(half, PERSON_MASKS, "customers")


@query(
    "SELECT 3 * n + count_email AS total, CAST(0 AS BIGINT) AS unmasked, CAST(100 AS DOUBLE) AS accuracy_pct FROM "
    "(SELECT count(*) AS n, count(email) AS count_email FROM src_customer) s",
    ("src_customer",),
)
def masking_accuracy(src):
    masked = privacy.apply_masks(src["src_customer"], PERSON_MASKS)
    return privacy.masking_accuracy(privacy.masking_checks(masked, PERSON_MASKS, "customers"))


@query("SELECT count(*) AS rows_true FROM src_payment", ("src_payment",))
def dq_always_pass(src):
    """``pii_present`` and ``always_pass`` never fail a row."""
    condition = rule_condition({"type": "pii_present", "column": "card_number"}) & rule_condition({"type": "always_pass"})
    return src["src_payment"].agg(F.count_if(condition).alias("rows_true"))
