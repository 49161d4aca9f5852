"""KPI models and the workload queries in both layouts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from layerflow.operators.shaping import derive, standardize
from layerflow.plans import governance, models, workload
from layerflow.queries.base import flow, query
from layerflow.sales.specs import DAILY_REVENUE_SQL, LIVE_ONLY, SUCCESS_RATIO_SQL
from layerflow.session import scratch_dir
from layerflow.sources.tables import TableStore

_DAY = "CAST(CAST({0} AS DATE) AS STRING) AS {0}"


def _shown(df, *days, drop=()):
    """Days as text, decimals as double, counts as bigint."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if f.name in drop:
            continue
        if f.name in days:
            out.append(F.col(f.name).cast("string").alias(f.name))
        elif kind == "decimal":
            out.append(F.col(f.name).cast("double").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _inputs(src):
    return {"orders": src["src_order"], "payments": src["src_payment"]}


_CHANNEL = (
    "SELECT CAST(CAST(o.order_date AS DATE) AS STRING) AS business_date, o.channel, count(DISTINCT o.order_id) AS order_count, "
    "sum(o.total_amount) AS gross_revenue, sum(p.amount) AS paid_amount FROM src_order o "
    "LEFT JOIN src_payment p ON o.order_id = p.order_id GROUP BY 1, 2"
)
_AS_MONEY = (
    "SELECT business_date, channel, order_count, CAST(gross_revenue AS DOUBLE) AS gross_revenue, "
    "CAST(paid_amount AS DOUBLE) AS paid_amount FROM daily"
)


@query(_AS_MONEY, ("src_order", "src_payment"), (("daily", _CHANNEL),))
def kpi_daily_revenue_channel(src):
    return _shown(src.sql(models.REVENUE_BY_CHANNEL, **_inputs(src)), "business_date")


@query(
    _AS_MONEY,
    ("src_order", "src_payment"),
    (
        (
            "daily",
            _CHANNEL.replace("src_payment p", "(SELECT order_id, sum(amount) AS amount FROM src_payment GROUP BY 1) p"),
        ),
    ),
)
def kpi_daily_revenue_no_fanout(src):
    return _shown(src.sql(models.REVENUE_BY_CHANNEL_NO_FANOUT, **_inputs(src)), "business_date")


_PRODUCTS = (
    "SELECT category, product_id, product_name, CAST(sum(quantity) AS BIGINT) AS qty_sold, "
    "CAST(sum(line_amount) AS DOUBLE) AS net_sales FROM (SELECT quantity, line_amount, "
    "CASE WHEN product_id % 89 = 0 THEN -product_id ELSE product_id END AS product_id FROM src_order_line) l "
    "{how} JOIN src_product p USING (product_id) GROUP BY category, product_id, product_name"
)


def _lines(src):
    """All order lines; those of every 89th product name one that is not listed."""
    key = F.col("product_id")
    return src["src_order_line"].withColumn("product_id", F.when(key % 89 == 0, -key).otherwise(key))


@query(_PRODUCTS.format(how="LEFT"), ("src_order_line", "src_product"))
def kpi_product_sales(src):
    return _shown(models.product_sales(_lines(src), src["src_product"]))


@query(_PRODUCTS.format(how="INNER"), ("src_order_line", "src_product"))
def kpi_product_sales_inner(src):
    return _shown(models.product_sales(_lines(src), src["src_product"], "inner"))


@query(
    "SELECT business_date, channel, CAST(sum(order_count) AS BIGINT) AS order_count, "
    "CAST(sum(gross_revenue) AS DOUBLE) AS gross_revenue, CAST(sum(paid_amount) AS DOUBLE) AS paid_amount, "
    "CAST(sum(gross_revenue) - sum(paid_amount) AS DOUBLE) AS revenue_gap FROM daily GROUP BY business_date, channel",
    ("src_order", "src_payment"),
    (("daily", _CHANNEL),),
)
def mart_revenue_gap(src):
    return _shown(models.revenue_board(src.sql(models.REVENUE_BY_CHANNEL, **_inputs(src))), "business_date")


_STATUS = (
    "SELECT CAST(CAST(o.order_date AS DATE) AS STRING) AS order_ds, o.order_status, count(DISTINCT o.order_id) AS order_count, "
    "CAST(sum(o.total_amount) AS DOUBLE) AS order_amount, "
    "CAST(sum(CASE WHEN p.payment_id IS NOT NULL THEN p.amount ELSE 0 END) AS DOUBLE) AS paid_amount "
    "FROM src_order o LEFT JOIN src_payment p ON o.order_id = p.order_id GROUP BY 1, 2"
)


@query(_STATUS, ("src_order", "src_payment"))
def kpi_daily_revenue_status(src):
    return _shown(src.sql(models.REVENUE_BY_STATUS, **_inputs(src)), "order_ds")


@query("SELECT order_ds, order_status, order_count, order_amount, paid_amount FROM daily",
       ("src_order", "src_payment"), (("daily", _STATUS),))
def mart_sales_projection(src):
    daily = src.sql(models.REVENUE_BY_STATUS, **_inputs(src))
    return _shown(
        src.sql("SELECT order_ds, order_status, order_count, order_amount, paid_amount FROM {daily}", daily=daily),
        "order_ds",
    )


_FACT = (
    "fact",
    "SELECT order_id, CAST(CAST(order_date AS DATE) AS STRING) AS order_ds, upper(trim(order_status)) AS order_status, "
    "total_amount, upper(trim(order_status)) IN ('PAID', 'SHIPPED') AS ok, channel = 'agent' AS gone FROM src_order",
)
_GOLD = (
    "SELECT order_ds, order_status, count(DISTINCT order_id) AS order_count, "
    "CAST(sum(total_amount) AS DOUBLE) AS total_amount, "
    "CAST(sum(CASE WHEN ok THEN total_amount ELSE 0 END) AS DOUBLE) AS success_amount FROM fact {keep} "
    "GROUP BY order_ds, order_status"
)


def _fact(src):
    """Silver orders, those of agents soft-deleted."""
    spec = flow("fact_order")
    rows = derive(standardize(src["src_order"], spec.standard_rules), spec.derive)
    return rows.withColumn("_meta_is_deleted", F.col("channel") == "agent")


@query(_GOLD.format(keep="WHERE NOT gone"), ("src_order",), (_FACT,))
def gold_daily_revenue(src):
    return _shown(src.sql(DAILY_REVENUE_SQL.replace("{keep}", LIVE_ONLY), fact_order=_fact(src)), "order_ds")


@query(_GOLD.format(keep=""), ("src_order",), (_FACT,))
def kpi_daily_revenue_all(src):
    """Deleted orders are not left out."""
    return _shown(src.sql(DAILY_REVENUE_SQL.replace("{keep}", ""), fact_order=_fact(src)), "order_ds")


@query(
    "SELECT order_ds, order_status, order_count, total_amount, success_amount, "
    "CASE WHEN total_amount = 0 THEN 0 ELSE round(success_amount / total_amount, 6) + 0.0 END AS success_ratio FROM gold",
    ("src_order",),
    (_FACT, ("gold", _GOLD.format(keep="WHERE NOT gone"))),
)
def mart_success_ratio(src):
    gold = src.sql(DAILY_REVENUE_SQL.replace("{keep}", LIVE_ONLY), fact_order=_fact(src))
    board = src.sql(SUCCESS_RATIO_SQL, daily_revenue=_shown(gold))
    return _shown(board.withColumn("success_ratio", F.round("success_ratio", 6)), "order_ds")


# -- workload -----------------------------------------------------------------
_AS_OF = "(SELECT max(order_date) FROM src_order)"


# The layouts of a directory; their tables are written by the first query that asks for them.
_WRITTEN: dict[tuple, workload.Layouts] = {}


def _layouts(src) -> workload.Layouts:
    """Both stored layouts of the given tables, each table written once per application."""
    views = {
        "orders": "src_order", "payments": "src_payment", "customers": "src_customer", "items": "src_order_line", "products": "src_product",
    }
    files = tuple(sorted(f for base in ("orders", "customer", "lineitem", "part") for f in src[base].inputFiles()))
    mark = (src.spark.sparkContext.applicationId, files)
    if mark not in _WRITTEN:
        space = f"w{uuid.uuid4().hex[:12]}"
        folder = f"{scratch_dir(src.spark)}/{space}"
        sources = {name: src[view] for name, view in views.items()}
        _WRITTEN[mark] = workload.Layouts(TableStore(src.spark, f"{folder}/tables"), space, f"{folder}/baseline", sources)
    return _WRITTEN[mark]


def _workload(src, name: str, layout: str):
    case = next(c for c in workload.cases(_layouts(src)) if (c.query, c.layout) == (name, layout))
    return _shown(case.result(case.inputs()), "business_date")


_CHANNEL_90D = (
    "SELECT channel, count(*) AS order_count, CAST(sum(total_amount) AS DOUBLE) AS revenue FROM src_order "
    f"WHERE order_date >= {_AS_OF} - INTERVAL '90' DAY GROUP BY channel"
)


@query(_CHANNEL_90D, ("src_order",))
def q_channel_90d(src):
    return _workload(src, "channel_scan", workload.LAYERED)


@query(_CHANNEL_90D, ("src_order",))
def q_channel_90d_baseline(src):
    return _workload(src, "channel_scan", workload.BASELINE)


_THETA = (
    "SELECT d.business_date, d.channel, CAST(d.gross_revenue AS DOUBLE) AS gross_revenue, "
    "count(c.customer_id) AS customer_count FROM daily d LEFT JOIN src_customer c ON c.province IS NOT NULL "
    f"WHERE CAST(d.business_date AS DATE) >= CAST({_AS_OF} AS DATE) - INTERVAL '90' DAY "
    "GROUP BY d.business_date, d.channel, d.gross_revenue"
)


@query(_THETA, ("src_order", "src_payment", "src_customer"), (("daily", _CHANNEL),))
def q_theta_join(src):
    return _workload(src, "cross_layer", workload.LAYERED)


@query(_THETA, ("src_order", "src_payment", "src_customer"), (("daily", _CHANNEL),))
def q_theta_join_baseline(src):
    return _workload(src, "cross_layer", workload.BASELINE)


_CATEGORY = (
    "SELECT category, CAST(sum(quantity) AS BIGINT) AS qty_sold, CAST(sum(line_amount) AS DOUBLE) AS net_sales "
    "FROM src_order_line LEFT JOIN src_product USING (product_id) GROUP BY category"
)


@query(_CATEGORY, ("src_order_line", "src_product"))
def q_gold_category(src):
    return _workload(src, "category_rollup", workload.LAYERED)


@query(_CATEGORY, ("src_order_line", "src_product"))
def q_gold_category_baseline(src):
    return _workload(src, "category_rollup", workload.BASELINE)


@query()
def scan_reduction_stored(src):
    """Bytes that each workload query reads in both layouts, and the saving."""
    runs = workload.measured(src.spark, workload.cases(_layouts(src)), repeats=1)
    return governance.scan_reduction(runs).select("query", "layered_bytes", "baseline_bytes", "reduction_pct")
