"""Keys, upserts, histories and late foreign keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from layerflow.functions.hashing import surrogate_key as hashed_key
from layerflow.operators import history, keys, reconcile, upsert
from layerflow.operators.shaping import LOG_COLUMNS
from layerflow.plans.layers import history_of, raw_to_work
from layerflow.queries.base import REGISTRY, decoded_changes, decoded_orders, flow, moment, query, text
from layerflow.session import materialize, scratch_dir
from layerflow.sources.tables import TableStore


def stored_changes(src, **options):
    """Decoded changes, written once: merges read them batch by batch. Like silver
    they don't keep the text of the log."""
    return materialize(decoded_changes(src, **options).drop(*LOG_COLUMNS), "changes")


@query(
    "SELECT count(*) AS total_rows, count(DISTINCT order_id) AS distinct_keys, CAST(0 AS BIGINT) AS negative_keys "
    "FROM src_order",
    ("src_order",),
)
def surrogate_key(src):
    keyed = keys.add_surrogate_key(src["src_order"], flow("fact_order"))
    return keyed.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("order_sk").alias("distinct_keys"),
        F.count_if(F.col("order_sk") < 0).alias("negative_keys"),
    )


@query(
    "SELECT 'order' AS of_keys, count(*) AS total_rows, count(DISTINCT order_id) AS natural_keys, CAST(0 AS BIGINT) AS collisions FROM src_order "
    "UNION ALL SELECT 'halves', 2 * count(*), 2 * count(DISTINCT customer_id), CAST(0 AS BIGINT) FROM src_order",
    ("src_order",),
)
def surrogate_collisions(src):
    """Natural keys that share a surrogate: none of the orders, and none of keys
    of two parts of which one is NULL, on either side."""
    orders = keys.add_surrogate_key(src["src_order"], flow("fact_order"))
    number, none = F.col("customer_id"), F.lit(None).cast("long")
    halves = src["src_order"].select(F.explode(F.array(F.struct(number.alias("a"), none.alias("b")), F.struct(none.alias("a"), number.alias("b")))).alias("k"))
    halves = halves.select("k.*").withColumn("sk", hashed_key(["a", "b"]))
    found = (("order", keys.key_collisions(orders, ["order_id"], "order_sk")), ("halves", keys.key_collisions(halves, ["a", "b"], "sk")))
    parts = [df.select(F.lit(name).alias("of_keys"), "total_rows", "natural_keys", "collisions") for name, df in found]
    return parts[0].unionAll(parts[1])


# Customers the dimension already has; the building segment arrives late.
KNOWN = "customer_segment <> 'building'"


def _dimension(src, known):
    """Customers with three versions each, the newest one current."""
    base = src["src_customer"].filter(known).select("customer_id", "province")
    versions = base.withColumn("version", F.explode(F.array(*[F.lit(v) for v in (1, 2, 3)])))
    return versions.select(
        "customer_id",
        (F.col("customer_id") * 10 + F.col("version")).alias("customer_sk"),
        (F.col("version") == 3).alias("is_current"),
        F.make_timestamp(F.lit(2020) + F.col("version"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("effective_from"),
    )


_KNOWN_SK = "CASE WHEN c.customer_id IS NULL THEN -1 ELSE c.customer_id * 10 + 3 END"


@query(
    f"SELECT o.order_id, o.customer_id, {_KNOWN_SK} AS customer_sk FROM src_order o LEFT JOIN "
    "(SELECT customer_id FROM src_customer WHERE customer_segment <> 'building') c ON o.customer_id = c.customer_id",
    ("src_order", "src_customer"),
)
def fk_lookup(src):
    orders = src["src_order"].select("order_id", "customer_id")
    dimension = _dimension(src, KNOWN)
    resolved = keys.resolve_keys(orders, flow("fact_order"), {"silver.dim_customer": dimension})
    return resolved.select("order_id", "customer_id", "customer_sk")


@query(
    "SELECT count(*) AS total_rows, count(*) FILTER (WHERE c.customer_id IS NULL) AS unknown_rows FROM src_order o "
    "LEFT JOIN (SELECT customer_id FROM src_customer WHERE customer_segment <> 'building') c ON o.customer_id = c.customer_id",
    ("src_order", "src_customer"),
)
def fk_unknown_rate(src):
    return keys.unknown_rate(fk_lookup(src), "customer_sk").select("total_rows", "unknown_rows")


_LAST = (
    "last_live",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC, log_offset DESC) AS r "
    "FROM customer_changes WHERE op <> 'd') s WHERE r = 1",
)
_STATE = (
    "SELECT customer_id, province, customer_segment, CAST(updated_at AS STRING) AS updated_at, "
    "CAST(customer_id % 21 = 0 AS STRING) AS is_deleted FROM last_live"
)


def _customer_state(df):
    return df.select(
        "customer_id", "province", "customer_segment", *text("updated_at"),
        F.col("_meta_is_deleted").cast("string").alias("is_deleted"),
    )


# The change log in three batches: snapshot, changes, late replays with deletes.
BATCHES = (
    "_meta_kafka_offset < 1000000",
    "_meta_kafka_offset BETWEEN 1000000 AND 2999999",
    "_meta_kafka_offset >= 3000000",
)


def _upserted(src, delete_mode: str):
    changes = stored_changes(src)
    parts = [changes.filter(batch) for batch in BATCHES]
    options = {"sequence": ["updated_at"], "delete_mode": delete_mode, "stored": True}
    target = upsert.initial_rows(parts[0], ["customer_id"], **options)
    for part in parts[1:]:
        target = upsert.upsert(
            materialize(target, "target"), part, ["customer_id"], guard="updated_at", now=moment(), **options
        )
    return target


@query(_STATE, ("customer_changes",), (_LAST,))
def upsert_soft_delete(src):
    """Three batches: snapshot, changes, then stale replays and deletes."""
    return _customer_state(_upserted(src, "soft_delete"))


@query(_STATE + " WHERE customer_id % 21 <> 0", ("customer_changes",), (_LAST,))
def upsert_hard_delete(src):
    return _customer_state(_upserted(src, "hard_delete"))


_SOME_KEYS = "CASE WHEN customer_id % 10 = 0 THEN NULL ELSE customer_id END"


@query(
    "SELECT k AS customer_id, province, customer_segment FROM (SELECT *, CASE WHEN k IS NULL THEN 1 ELSE "
    "row_number() OVER (PARTITION BY k ORDER BY seq DESC) END AS r FROM "
    f"(SELECT *, {_SOME_KEYS} AS k FROM customer_changes) c) s WHERE r = 1",
    ("customer_changes",),
)
def keyed_upsert(src):
    """Upsert without deletes on a plain key: all changes, replays included. A
    NULL key, that of every tenth customer, never matches."""
    changes = src["customer_changes"].drop("op").withColumn("customer_id", F.expr(_SOME_KEYS))
    merged = upsert.upsert(
        changes.filter("seq = 0"), changes.filter("seq > 0"), ["customer_id"], sequence=["seq"], null_safe=False
    )
    return merged.select("customer_id", "province", "customer_segment")


@query(
    "SELECT k AS customer_id, province, customer_segment FROM (SELECT *, CASE WHEN k IS NULL THEN 1 ELSE "
    "row_number() OVER (PARTITION BY k ORDER BY seq DESC) END AS r FROM "
    f"(SELECT *, {_SOME_KEYS} AS k FROM customer_changes) c) s WHERE r = 1",
    ("customer_changes",),
)
def stored_upsert_replayed(src):
    """The same in a stored table, with each batch written twice."""
    changes = src["customer_changes"].drop("op").withColumn("customer_id", F.expr(_SOME_KEYS))
    space = f"m{uuid.uuid4().hex[:12]}"
    store = TableStore(src.spark, f"{scratch_dir(src.spark)}/{space}")
    name = f"{space}.customers"
    for _ in range(2):
        store.overwrite(changes.filter("seq = 0"), name)
    for _ in range(2):
        store.merge_rows(changes.filter("seq > 0"), name, ["customer_id"], sequence=["seq"], null_safe=False)
    return store.read(name).select("customer_id", "province", "customer_segment")


# The version chain in SQL: one event per key and start, repeats dropped, then
# the next remaining event closes a version.
SCD2_CTES = (
    (
        "unique_events",
        "SELECT *, concat_ws('|', full_name, coalesce(email, chr(0)), telephone, address, province, customer_segment, "
        "CAST(created_at AS STRING), CAST(updated_at AS STRING)) AS content FROM (SELECT *, row_number() OVER "
        "(PARTITION BY customer_id, updated_at ORDER BY log_offset DESC) AS r FROM customer_changes) s WHERE r = 1",
    ),
    (
        "seen",
        "SELECT *, lag(content) OVER w AS prev_content, lag(op) OVER w AS prev_op FROM unique_events "
        "WINDOW w AS (PARTITION BY customer_id ORDER BY updated_at)",
    ),
    (
        "changed",
        "SELECT * FROM seen WHERE CASE WHEN op = 'd' THEN coalesce(prev_op <> 'd', false) "
        "ELSE NOT (coalesce(prev_op <> 'd', false) AND content = prev_content) END",
    ),
    (
        "linked",
        "SELECT *, lead(updated_at) OVER w AS next_at, lead(op) OVER w AS next_op FROM changed "
        "WINDOW w AS (PARTITION BY customer_id ORDER BY updated_at)",
    ),
)
SCD2_SQL = (
    "SELECT customer_id, province, customer_segment, CAST(updated_at AS STRING) AS effective_from, "
    "CAST(next_at AS STRING) AS effective_to, CAST(next_at IS NULL AS STRING) AS is_current, "
    "CAST(coalesce(next_op = 'd', false) AS STRING) AS is_deleted FROM linked WHERE op <> 'd'"
)


def _versions(df):
    return df.select(
        "customer_id", "province", "customer_segment",
        *text("effective_from", "effective_to", "is_current"),
        F.col("_meta_is_deleted").cast("string").alias("is_deleted"),
    )


@query(SCD2_SQL, ("customer_changes",), SCD2_CTES)
def scd2_history(src):
    return _versions(history.build_history(_plain_events(src), history_of(flow("dim_customer")), moment()))


def _plain_events(src):
    return keys.add_version_columns(
        keys.add_surrogate_key(stored_changes(src), flow("dim_customer")), flow("dim_customer"), moment()
    )


def _merged_history(src, *batches: str):
    events = _plain_events(src)
    columns = history_of(flow("dim_customer"))
    table = history.build_history(events.filter(batches[0]), columns, moment())
    for batch in batches[1:]:
        rebuilt, untouched = history.merge_history(
            materialize(table, "versions"), events.filter(batch), columns, moment()
        )
        table = rebuilt.unionByName(untouched)
    return _versions(table)


@query(SCD2_SQL, ("customer_changes",), SCD2_CTES)
def scd2_late_changes(src):
    """The +60 day changes arrive before the +30 day ones; deletes last."""
    return _merged_history(
        src,
        "_meta_kafka_offset < 1000000",
        "_meta_kafka_offset BETWEEN 2000000 AND 2999999",
        "_meta_kafka_offset BETWEEN 1000000 AND 1999999 OR _meta_kafka_offset >= 3000000",
    )


@query(SCD2_SQL, ("customer_changes",), SCD2_CTES)
def scd2_replay_idempotent(src):
    """Every batch a second time: nothing changes."""
    first, second = "_meta_kafka_offset < 2000000", "_meta_kafka_offset >= 2000000"
    return _merged_history(src, first, second, first, second)


@query(
    "SELECT count(*) AS versions, count(*) FILTER (WHERE next_op = 'd') AS closed_by_delete, "
    "count(*) FILTER (WHERE next_at IS NULL) AS current_versions FROM linked WHERE op <> 'd'",
    ("customer_changes",),
    SCD2_CTES,
)
def scd2_delete_close(src):
    versions = history.build_history(_plain_events(src), history_of(flow("dim_customer")), moment())
    return versions.agg(
        F.count(F.lit(1)).alias("versions"),
        F.count_if("_meta_is_deleted").alias("closed_by_delete"),
        F.count_if("is_current").alias("current_versions"),
    )


_JOB = REGISTRY.reconciliations[0]


def _unknown_orders(src):
    orders = raw_to_work(decoded_orders(src), flow("fact_order"), now=moment())
    half = keys.lookup_key(
        orders.drop("customer_sk"), _dimension(src, KNOWN), name="customer_sk", value="customer_sk",
        lookup=["customer_id"], current="is_current",
    )
    return half.select("order_id", "order_sk", "customer_id", "customer_sk")


@query(
    "SELECT o.order_id, o.customer_id * 10 + 3 AS customer_sk, 'order_customer_keys' AS reconciled_by FROM src_order o "
    "JOIN src_customer c ON o.customer_id = c.customer_id WHERE c.customer_segment = 'building'",
    ("src_order", "src_customer"),
)
def reconcile_updates(src):
    updates = reconcile.late_matches(_unknown_orders(src), _dimension(src, "true"), _JOB, moment())
    return updates.select("order_id", "customer_sk", F.col("_meta_reconciled_by").alias("reconciled_by"))


@query(
    f"SELECT o.order_id, {_KNOWN_SK} AS customer_sk, CASE WHEN c.customer_segment = 'building' THEN 'order_customer_keys' END "
    "AS reconciled_by FROM src_order o LEFT JOIN src_customer c ON o.customer_id = c.customer_id",
    ("src_order", "src_customer"),
)
def reconcile_unknown_fk(src):
    facts = materialize(_unknown_orders(src), "facts")
    updates = reconcile.late_matches(facts, _dimension(src, "true"), _JOB, moment())
    fixed = upsert.update_columns(facts, updates, _JOB["fact_key"], reconcile.updated_columns(_JOB))
    return fixed.select("order_id", "customer_sk", F.col("_meta_reconciled_by").alias("reconciled_by"))
