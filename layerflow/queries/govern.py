"""Governance measures over tables derived from the given data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.operators import quality
from layerflow.operators.ranks import median
from layerflow.plans import governance
from layerflow.plans.tables import VARIANTS, TableJobs, run_variant
from layerflow.queries.base import REGISTRY, apart, query
from layerflow.sales.specs import CUSTOMER_RULES, DOCUMENT, ORDER_RULES, PAYMENT_RULES, sales_registry

KEYWORDS = ["ring", "price", "brand#1", "economy", "size_11", "absent-word"]


def _checked(src):
    """Table, key, rows and rules of everything that is checked."""
    orders = src["src_order"].withColumn("order_status", F.upper(F.trim("order_status")))
    return (
        ("src_customer", "customer_id", src["src_customer"], CUSTOMER_RULES),
        ("src_order", "order_id", orders, ORDER_RULES),
        ("src_payment", "payment_id", src["src_payment"], PAYMENT_RULES),
    )


def _enforced(src, enforce: str):
    found = []
    for table, key, rows, rules in _checked(src):
        _, failed = quality.split(quality.annotate(rows, rules), rules, enforce=enforce)
        found.append(governance.found_violations(failed, table, key))
    return governance.enforcement_rate(src["expected_violation"], found)


@query(
    "SELECT count(*) AS expected, count(*) FILTER (WHERE rule_id <> 'CUST_EMAIL_FORMAT') AS detected, "
    "round(count(*) FILTER (WHERE rule_id <> 'CUST_EMAIL_FORMAT') * 100.0 / count(*), 6) AS rate_pct "
    "FROM (SELECT DISTINCT * FROM expected_violation) s",
    ("expected_violation",),
)
def dq_enforcement_rate(src):
    """Only critical rules are enforced, so violations of a warning are missed."""
    return _enforced(src, "critical").withColumn("rate_pct", F.round("rate_pct", 6))


@query(
    "SELECT count(*) AS expected, count(*) AS detected, CAST(100 AS DOUBLE) AS rate_pct "
    "FROM (SELECT DISTINCT * FROM expected_violation) s",
    ("expected_violation",),
)
def dq_enforcement_full(src):
    return _enforced(src, "all")


@query(
    "SELECT count(*) AS total_runs, count(e.batch_id) AS covered_runs FROM "
    "(SELECT batch_id FROM batch_run UNION SELECT batch_id FROM governed_run) r "
    "LEFT JOIN (SELECT DISTINCT batch_id FROM lineage_event) e ON r.batch_id = e.batch_id",
    ("batch_run", "governed_run", "lineage_event"),
)
def lineage_capture_rate(src):
    rate = governance.lineage_capture([src["batch_run"], src["governed_run"]], src["lineage_event"])
    return rate.select("total_runs", "covered_runs")


@query(
    "SELECT scale, layout, table_name, count(*) AS runs, round(sum(row_count) / sum(elapsed_sec), 6) AS rows_per_sec, "
    "round(sum(bytes_written) / 1048576 / sum(elapsed_sec), 6) AS mb_per_sec FROM batch_run "
    "GROUP BY scale, layout, table_name",
    ("batch_run",),
)
def batch_throughput(src):
    rates = governance.throughput(src["batch_run"])
    return rates.withColumns({c: F.round(c, 6) for c in ("rows_per_sec", "mb_per_sec")})


_MEDIANS = "SELECT query, layout, median(scanned_bytes) AS b, median(exec_ms) AS ms FROM query_run GROUP BY query, layout"
_SIDE = ", ".join(
    f"max(CASE WHEN layout = '{lay}' THEN {c} END) AS {lay}_{n}"
    for lay in ("layered", "baseline")
    for c, n in (("b", "bytes"), ("ms", "ms"))
)


@query(
    "SELECT query, layered_bytes, layered_ms, baseline_bytes, baseline_ms, "
    "round((baseline_bytes - layered_bytes) / baseline_bytes * 100, 2) AS reduction_pct FROM side",
    ("query_run",),
    (("medians", _MEDIANS), ("side", f"SELECT query, {_SIDE} FROM medians GROUP BY query")),
)
def scan_reduction(src):
    return governance.scan_reduction(src["query_run"])


@query("SELECT query, layout, median(exec_ms) AS median_ms FROM query_run GROUP BY query, layout", ("query_run",))
def median_by_query(src):
    return median(src["query_run"], "exec_ms", ["query", "layout"], "median_ms")


_PROBES = "(SELECT count(*) AS probes, count(*) FILTER (WHERE event_type <> 'error') AS ok FROM events) p"


@query(
    " UNION ALL ".join(
        f"SELECT '{layer}' AS layer, '{seen}' AS visible, probes, round(ok * 100.0 / probes, 6) AS availability_pct FROM {_PROBES}"
        for layer, seen in (("raw", "true"), ("work", "true"), ("silver", "false"))
    )
)
def schema_visibility(src):
    """A column that reached raw and work; events stand for the probes."""
    customers = src["src_customer"]
    tiered = customers.withColumn("loyalty_tier", F.lit("standard"))
    layers = {"raw": tiered, "work": tiered, "silver": customers}
    seen = governance.schema_visibility(layers, "loyalty_tier", src["events"], "event_type <> 'error'")
    return seen.withColumns(
        {"visible": F.col("visible").cast("string"), "availability_pct": F.round("availability_pct", 6)}
    )


_FILLED = "coalesce(length(description) > 0, false) AND coalesce(length(owner) > 0, false) AND coalesce(length(tags) > 0, false)"


@query(
    f"SELECT count(*) AS total_assets, count(*) FILTER (WHERE {_FILLED}) AS covered_assets, "
    f"round(count(*) FILTER (WHERE {_FILLED}) * 100.0 / count(*), 2) AS coverage_pct FROM catalog_asset",
    ("catalog_asset",),
)
def metadata_coverage(src):
    return governance.metadata_coverage(src["catalog_asset"])


@query(
    " UNION ALL ".join(
        f"SELECT '{k}' AS keyword, count(*) FILTER (WHERE contains(lower(concat_ws(' ', asset, description, owner, tags, "
        f"column_names)), '{k}')) AS hits FROM catalog_asset"
        for k in KEYWORDS
    ),
    ("catalog_asset",),
)
def asset_search(src):
    return governance.keyword_hits(
        src["catalog_asset"], KEYWORDS, ["asset", "description", "owner", "tags", "column_names"]
    )


_HOPS = (
    "hop",
    "SELECT 'mart' AS asset, 0 AS hops UNION SELECT e.upstream, h.hops + 1 FROM hop h "
    "JOIN asset_edge e ON e.asset = h.asset WHERE e.upstream <> 'mart'",
)


@query(
    "SELECT CAST(max(hops) AS BIGINT) AS depth, count(*) AS assets FROM "
    "(SELECT asset, min(hops) AS hops FROM hop GROUP BY asset) s",
    ("asset_edge",),
    (_HOPS,),
)
def lineage_depth(src):
    """Edges run from a mart over orders and customers to regions and back."""
    depth = governance.lineage_depth(src["asset_edge"], "mart")
    return depth.withColumn("depth", F.col("depth").cast("bigint"))


def _declared() -> str:
    """The sales registry's edges, written out."""
    flows = [("customer", "dim_customer"), ("product", "dim_product"), ("order", "fact_order")]
    edges = [
        edge
        for topic, silver in flows
        for edge in (
            (f"raw.{topic}_events", f"sales.{topic}"), (f"work.{topic}_rows", f"raw.{topic}_events"),
            (f"silver.{silver}", f"work.{topic}_rows"), (f"quarantine.{silver}_failed", f"work.{topic}_rows"),
        )
    ]
    for name in ("customers", "products", "orders", "order_items", "payments"):
        edges += [(f"raw.{name}", f"source_{name}"), (f"work.{name}", f"raw.{name}"), (f"silver.{name}", f"work.{name}")]
    edges += [("gold.daily_revenue", "silver.fact_order"), ("mart.sales_board", "gold.daily_revenue")]
    return ", ".join(f"('{asset}', '{upstream}')" for asset, upstream in edges)


@query(
    f"SELECT asset, count(DISTINCT upstream) AS upstreams FROM (SELECT * FROM (VALUES {_declared()}) d(asset, upstream) "
    "UNION ALL SELECT to_entity, from_entity FROM lineage_event UNION ALL SELECT asset, upstream FROM asset_edge) e GROUP BY asset",
    ("lineage_event", "asset_edge"),
)
def lineage_edges(src):
    """Upstream edges per asset: declared ones, those that runs recorded, and those
    of the edge table."""
    declared = governance.lineage_edges(src.spark, REGISTRY).select("asset", "upstream")
    known = governance.known_edges(declared.unionByName(src["asset_edge"]), src["lineage_event"])
    return known.groupBy("asset").agg(F.count(F.lit(1)).alias("upstreams"))


@query(
    "SELECT 'batch.count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM batch_run "
    + "".join(
        f"UNION ALL SELECT 'batch.{c}.{f}', CAST({f}({c}) AS DOUBLE) FROM batch_run "
        for c in ("row_count", "elapsed_sec", "bytes_written")
        for f in ("sum", "max")
    ),
    ("batch_run",),
)
def metric_rollup(src):
    return governance.metric_rollup(src["batch_run"], ["row_count", "elapsed_sec", "bytes_written"], "batch")


@query(
    " UNION ALL ".join(
        f"SELECT 'orders' AS table_name, '{v}' AS variant, count(*) AS source_rows, {p} AS passed_rows, {q} AS quarantined_rows FROM src_order"
        for v, p, q in (
            ("layers_only", "count(*)", "CAST(0 AS BIGINT)"),
            *[
                (v, "count(*) FILTER (WHERE total_amount > 0 AND order_id % 101 <> 0)",
                 "count(*) FILTER (WHERE NOT (total_amount > 0 AND order_id % 101 <> 0))")
                for v in ("no_work_layer", "full")
            ],
        )
    ),
    ("src_order",),
)
def variant_counts(src):
    """Each variant runs its stages into tables of its own; the counts are read
    from what was written."""
    parts = []
    for variant in VARIANTS:
        mark, _, store = apart(src)
        src["src_order"].createOrReplaceTempView(f"source_{mark}")
        entry = next(t for t in DOCUMENT["tables"] if t["name"] == "orders")
        entry = {**entry, "source": {"type": "table", "table": f"source_{mark}"}, "target": {**entry["target"], "table_name": f"orders_{mark}"}}
        runtime = {"audit_namespace": f"{mark}_audit", "quarantine_namespace": f"{mark}_quarantine"}
        registry = sales_registry(flows=[], models=[], batch_sources=[], jobs=[], tables=[entry], runtime=runtime)
        parts.append(run_variant(TableJobs(store, registry), registry.tables["orders"], variant, "b1"))
    return reduce(DataFrame.unionByName, parts)


@query(
    "SELECT asset, c.column_name, CASE WHEN contains(c.column_name, 'price') THEN tags END AS tags FROM "
    "(SELECT asset, tags, unnest(string_split(column_names, ',')) AS column_name FROM catalog_asset) c",
    ("catalog_asset",),
)
def asset_columns(src):
    """Column inventory of all assets: tags known before are carried over by name."""
    assets = src["catalog_asset"]
    columns = assets.select("asset", F.explode(F.split("column_names", ",")).alias("column_name"), "tags")
    technical = assets.select("asset", F.lit("_batch_id").alias("column_name"))
    current = columns.select("asset", "column_name").unionAll(technical)
    return governance.with_known_tags(current, columns.filter(F.col("column_name").contains("price")))
