"""Type-2 history: the whole version chain of every changed key."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerflow.functions.hashing import NULL_MARK
from layerflow.operators.contract import align_to, evolve
from layerflow.operators.dedup import latest_per_key
from layerflow.operators.envelope import is_delete
from layerflow.operators.neighbors import RANGE, add_neighbors, in_ranges, same_key

MANY = 1000  # events of one key and start that may meet in a task
DEFAULT_ORDER = ("_meta_source_ts_ms", "_meta_kafka_partition", "_meta_kafka_offset")


@dataclass(frozen=True)
class HistoryColumns:
    """Names a version table uses; ``sequence`` orders events of equal start."""

    keys: tuple[str, ...]
    start: str = "effective_from"
    end: str = "effective_to"
    current: str = "is_current"
    content: str = "_meta_record_hash"
    operation: str = "_meta_source_operation"
    event: str = "_meta_event_id"
    sequence: tuple[str, ...] = DEFAULT_ORDER


def _chain(
    events: DataFrame, c: HistoryColumns, now: Column, within: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Version rows of events that are unique per key and start, at least after
    ``within``, which sees all rows of a key and start together.

    ``_gone`` marks delete events. A repeat of the state before it opens no
    version; a delete only ends the version it meets.
    """
    ranged = in_ranges(events, [*c.keys, c.start], within)
    seen = add_neighbors(ranged, c.keys, c.start, previous={"_prev_hash": c.content, "_prev_gone": "_gone"})
    alive_before = F.coalesce(~F.col("_prev_gone"), F.lit(False))
    unchanged = alive_before & F.col(c.content).eqNullSafe(F.col("_prev_hash"))
    changed = seen.filter(F.when(F.col("_gone"), alive_before).otherwise(~unchanged))
    linked = add_neighbors(
        changed.drop("_prev_hash", "_prev_gone"),
        c.keys,
        c.start,
        following={"_next_start": c.start, "_next_gone": "_gone", "_next_event": c.event},
    )
    closed = F.col("_next_start").isNotNull()
    ended_by_delete = F.coalesce(F.col("_next_gone"), F.lit(False))
    same_close = F.col(c.end).eqNullSafe(F.col("_next_start")) & F.col("_meta_closed_at").isNotNull()
    return (
        linked.filter(~F.col("_gone"))
        .withColumns(
            {
                "_meta_closed_at": F.when(closed, F.when(same_close, F.col("_meta_closed_at")).otherwise(now)),
                "_meta_deleted_at": F.when(
                    ended_by_delete,
                    F.when(same_close, F.coalesce(F.col("_meta_deleted_at"), now)).otherwise(now),
                ),
            }
        )
        .withColumns(
            {
                c.end: F.col("_next_start"),
                c.current: ~closed,
                "_meta_is_deleted": ended_by_delete,
                "_meta_closed_by_event_id": F.when(closed, F.col("_next_event")),
            }
        )
        .drop("_gone", "_next_start", "_next_gone", "_next_event", RANGE)
    )


def _prepare(df: DataFrame, c: HistoryColumns) -> DataFrame:
    """Events with every bookkeeping column present."""
    missing = {
        c.end: "timestamp",
        c.current: "boolean",
        c.operation: "string",
        c.event: "string",
        "_meta_is_deleted": "boolean",
        "_meta_deleted_at": "timestamp",
        "_meta_closed_by_event_id": "string",
        "_meta_closed_at": "timestamp",
    }
    df = df.withColumns({n: F.lit(None).cast(t) for n, t in missing.items() if n not in df.columns})
    return df.withColumn(c.start, F.col(c.start).cast("timestamp"))


def _latest(df: DataFrame, c: HistoryColumns) -> DataFrame:
    return latest_per_key(df, [*c.keys, c.start], [*c.sequence, "_gone"])


def build_history(events: DataFrame, c: HistoryColumns, now: Column | None = None) -> DataFrame:
    """Version table from events alone (first load), which are read twice: store them.

    Events of one key and start are ranked where the shuffle into ranges puts them.
    Only where some start has very many are they first cut down before a shuffle.
    """
    now = F.current_timestamp() if now is None else now
    marked = _prepare(events, c).withColumn("_gone", is_delete(F.col(c.operation)))
    most = marked.groupBy(*c.keys, c.start).agg(F.count(F.lit(1)).alias("_times")).agg(F.max("_times")).first()[0]
    if (most or 0) > MANY:
        return _chain(_latest(marked, c), c, now)
    return _chain(marked, c, now, lambda df: _latest(df, c))


def _as_events(versions: DataFrame, c: HistoryColumns) -> DataFrame:
    """Stored versions as the events that made them, deletes included."""
    opened = versions.withColumn("_gone", F.lit(False))
    ended = versions.filter(F.col("_meta_is_deleted")).withColumns(
        {
            "_gone": F.lit(True),
            c.start: F.col(c.end),
            c.event: F.col("_meta_closed_by_event_id"),
            c.end: F.lit(None).cast("timestamp"),
        }
    )
    return opened.unionByName(ended)


def merge_history(
    target: DataFrame, events: DataFrame, c: HistoryColumns, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rebuilt versions of the changed keys, untouched versions).

    Late events take their place in the chain and replays change nothing.
    """
    now = F.current_timestamp() if now is None else now
    incoming = _prepare(events, c).withColumn("_gone", is_delete(F.col(c.operation)))
    incoming = _latest(incoming, c)
    _, schema = evolve(incoming.drop("_gone"), target.schema)
    target = align_to(target, schema)
    names = [f"_changed_{i}" for i in range(len(c.keys))]
    changed = events.select(*[F.col(k).alias(n) for k, n in zip(c.keys, names)]).distinct()
    on_key = same_key(target, changed, c.keys, names)
    touched, untouched = target.join(changed, on_key, "left_semi"), target.join(changed, on_key, "left_anti")

    stored = _as_events(touched, c).withColumn("_new", F.lit(False))
    both = stored.unionByName(align_to(incoming.withColumn("_new", F.lit(True)), stored.schema))

    def settled(df: DataFrame) -> DataFrame:
        """The latest of a key and start; an incoming repeat of what is stored goes."""
        version = ~F.col("_new") & ~F.col("_gone")
        at = Window.partitionBy(*c.keys, c.start)
        content = F.coalesce(F.col(c.content).cast("string"), F.lit(NULL_MARK))
        known = F.collect_set(F.when(version, content)).over(at)
        repeat = F.col("_new") & ~F.col("_gone") & F.col(c.start).isNotNull() & F.array_contains("_known", content)
        left = df.withColumn("_known", known).filter(~repeat).drop("_known", "_new")
        return _latest(left, c)

    rebuilt = _chain(both, c, now, settled)
    return align_to(rebuilt, schema), untouched


def history_columns(keys: Sequence[str], **names) -> HistoryColumns:
    return HistoryColumns(keys=tuple(keys), **names)
