"""Keyed upserts and deletes as plain DataFrame joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerflow.operators.contract import align_to, evolve
from layerflow.operators.dedup import latest_per_key
from layerflow.operators.envelope import is_delete
from layerflow.operators.history import DEFAULT_ORDER
from layerflow.operators.neighbors import same_key
from layerflow.session import materialize

DELETE_MODES = ("soft_delete", "hard_delete")
DELETED, DELETED_AT = "_meta_is_deleted", "_meta_deleted_at"


def change_images(
    changes: DataFrame,
    keys: Sequence[str],
    *,
    sequence: Sequence[str] = (),
    guard: str | None = None,
    operation: str = "_meta_source_operation",
    stored: bool = False,
) -> DataFrame:
    """One row per key: its newest live row, and whether a delete came after.

    Columns: ``_s_0..`` the key, ``_row`` the live row or NULL, ``_gone``, and
    the guard values ``_row_guard`` and ``_gone_guard``. A hot key is cut to
    two candidates per map task before anything is shuffled. Of changes that are
    ``stored``, so that reading their keys is cheap, a row whose key has no other
    row is its image as it is, and only the rest is shuffled whole.
    """
    options = {"sequence": sequence, "guard": guard, "operation": operation}
    names = [f"_s_{i}" for i in range(len(keys))]
    if not stored:
        return _ranked_images(changes, keys, **options)
    counted = changes.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("_times"))
    repeated = materialize(counted.filter("_times > 1"), "repeated")
    held = repeated.agg(F.sum("_times")).first()[0] or 0
    if held == 0:
        return _plain_images(changes, keys, guard, operation)
    if 4 * held > changes.count():  # the joins would move more than the ranking does
        return _ranked_images(changes, keys, **options)
    on_key = same_key(changes, repeated, keys, names)
    once, several = changes.join(repeated, on_key, "left_anti"), changes.join(repeated, on_key, "left_semi")
    return _plain_images(once, keys, guard, operation).unionByName(_ranked_images(several, keys, **options))


def _plain_images(changes: DataFrame, keys: Sequence[str], guard: str | None, operation: str) -> DataFrame:
    """Images of changes of which no two have one key."""
    columns = changes.columns
    gone = is_delete(F.col(operation)) if operation in columns else F.lit(False)
    value = F.col(guard) if guard in columns else F.lit(None).cast("timestamp")
    return changes.select(
        *[F.col(k).alias(f"_s_{i}") for i, k in enumerate(keys)],
        F.when(~gone, F.struct(*columns)).alias("_row"),
        F.when(~gone, value).alias("_row_guard"),
        F.when(gone, value).alias("_gone_guard"),
        gone.alias("_gone"),
    )


def _ranked_images(
    changes: DataFrame, keys: Sequence[str], *, sequence: Sequence[str], guard: str | None, operation: str
) -> DataFrame:
    columns = changes.columns
    order = [c for c in (*sequence, *DEFAULT_ORDER) if c in columns]
    gone = is_delete(F.col(operation)) if operation in columns else F.lit(False)
    marked = changes.withColumn("_gone", gone)
    newest = latest_per_key(marked, [*keys, "_gone"], order, need_order=False)
    place = F.struct(*(order or [F.lit(0)]))
    guard_value = F.col(guard) if guard in columns else F.lit(None).cast("timestamp")

    def only(when: Column, value: Column) -> Column:
        return F.first(F.when(when, value), ignorenulls=True)

    live, dead = ~F.col("_gone"), F.col("_gone")
    per_key = newest.groupBy(*[F.col(k).alias(f"_s_{i}") for i, k in enumerate(keys)]).agg(
        only(live, F.struct(*columns)).alias("_row"),
        only(live, place).alias("_live_at"),
        only(dead, place).alias("_dead_at"),
        only(live, guard_value).alias("_row_guard"),
        only(dead, guard_value).alias("_gone_guard"),
    )
    deleted = F.col("_dead_at").isNotNull() & (
        F.col("_live_at").isNull() | (F.col("_dead_at") >= F.col("_live_at"))
    )
    return per_key.withColumn("_gone", F.coalesce(deleted, F.lit(False))).drop("_live_at", "_dead_at")


def _marked(image: dict[str, Column], deleted: Column, now: Column) -> dict[str, Column]:
    """The row's columns with the soft-delete flag and time set where deleted."""
    out = dict(image)
    if DELETED in out:
        out[DELETED] = F.when(deleted, F.lit(True)).otherwise(image[DELETED])
    if DELETED_AT in out:
        already = F.coalesce(image[DELETED], F.lit(False)) & image[DELETED_AT].isNotNull() if DELETED in out else F.lit(False)
        out[DELETED_AT] = F.when(deleted & ~already, now).otherwise(image[DELETED_AT])
    return out


def _new_rows(images: DataFrame, columns: Sequence[str], hard: bool, now: Column) -> DataFrame:
    """Rows of keys that are not stored yet; a bare delete leaves nothing."""
    live = images.filter(F.col("_row").isNotNull())
    if hard:
        return live.filter(~F.col("_gone")).select("_row.*")
    image = _marked({c: F.col(f"_row.{c}") for c in columns}, F.col("_gone"), now)
    return live.select(*[value.alias(name) for name, value in image.items()])


def _present(df: DataFrame, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & df[name].isNotNull()
    return condition


def apply_images(
    target: DataFrame,
    images: DataFrame,
    keys: Sequence[str],
    *,
    guard: str | None = None,
    delete_mode: str = "soft_delete",
    now: Column | None = None,
) -> DataFrame:
    """Target after the change images, which are read three times: store them.

    ``target`` already has every column of the images' rows.
    """
    if delete_mode not in DELETE_MODES:
        raise ValueError(f"unknown delete mode: {delete_mode}")
    hard = delete_mode == "hard_delete"
    now = F.current_timestamp() if now is None else now
    columns = target.columns
    key_names = [f"_s_{i}" for i in range(len(keys))]
    joined = target.join(images, same_key(target, images, keys, key_names), "left")
    stored_guard = F.col(guard) if guard in columns else F.lit(None).cast("timestamp")
    fresh = F.coalesce(F.col("_row_guard") >= stored_guard, F.lit(True))
    fresh_delete = F.coalesce(F.col("_gone_guard") >= stored_guard, F.lit(True))
    replaced = F.coalesce(F.col("_row").isNotNull() & fresh, F.lit(False))
    removed = F.coalesce(F.col("_gone") & fresh_delete, F.lit(False))
    image = {c: F.when(replaced, F.col(f"_row.{c}")).otherwise(F.col(c)) for c in columns}
    if hard:
        joined = joined.filter(~removed)
    else:
        image = _marked(image, removed, now)
    updated = joined.select(*[value.alias(name) for name, value in image.items()])

    # Keys already stored. The semi join reads only the target's key columns and
    # leaves at most one row per change, so nothing target-sized is shuffled.
    stored_names = [f"_t_{i}" for i in range(len(keys))]
    stored = target.select(*[F.col(k).alias(n) for k, n in zip(keys, stored_names)])
    known = stored.join(images, same_key(stored, images, stored_names, key_names), "left_semi")
    unseen = images.join(known, same_key(images, known, key_names, stored_names), "left_anti")
    return updated.unionByName(_new_rows(unseen, columns, hard, now))


def upsert(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    *,
    sequence: Sequence[str] = (),
    guard: str | None = None,
    operation: str = "_meta_source_operation",
    delete_mode: str = "soft_delete",
    null_safe: bool = True,
    now: Column | None = None,
    stored: bool = False,
) -> DataFrame:
    """Target after the changes: updated, inserted and deleted rows applied.

    The newest live change of a key wins, and a delete after it marks or drops
    the row, so the outcome does not depend on how events fall into batches.
    With ``guard`` (a sequence column) changes older than the stored row are
    ignored. Keys match null-safely unless ``null_safe`` is off, where a NULL
    key never matches and its rows are added. Catalyst broadcasts the change
    side where its known size allows; the target is then not shuffled.
    """
    changes, schema = evolve(changes, target.schema)
    target = align_to(target, schema)
    keyless = None
    if not null_safe:
        keyless = changes.filter(~_present(changes, keys))
        changes = changes.filter(_present(changes, keys))

    images = materialize(
        change_images(changes, keys, sequence=sequence, guard=guard, operation=operation, stored=stored), "images"
    )
    result = apply_images(target, images, keys, guard=guard, delete_mode=delete_mode, now=now)
    return result if keyless is None else result.unionByName(keyless)


def initial_rows(
    changes: DataFrame,
    keys: Sequence[str],
    *,
    sequence: Sequence[str] = (),
    operation: str = "_meta_source_operation",
    delete_mode: str = "soft_delete",
    now: Column | None = None,
    stored: bool = False,
) -> DataFrame:
    """First write: what ``upsert`` into an empty table would give."""
    now = F.current_timestamp() if now is None else now
    images = change_images(changes, keys, sequence=sequence, operation=operation, stored=stored)
    return _new_rows(images, changes.columns, delete_mode == "hard_delete", now)


def update_columns(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Set only ``columns`` of the rows whose null-safe key is in ``updates``.

    Of several updates of one key the latest counts (by the event order, where
    the updates have its columns), so no row is ever multiplied.
    """
    order = [c for c in DEFAULT_ORDER if c in updates.columns]
    updates = latest_per_key(updates, keys, order, need_order=False)
    added = [f for f in updates.schema.fields if f.name in columns and f.name not in target.columns]
    target = target.withColumns({f.name: F.lit(None).cast(f.dataType) for f in added}) if added else target
    image = updates.select(
        *[F.col(k).alias(f"_s_{i}") for i, k in enumerate(keys)], F.struct(*columns).alias("_s_row")
    )
    joined = target.join(image, same_key(target, image, keys, [f"_s_{i}" for i in range(len(keys))]), "left")
    hit = F.col("_s_row").isNotNull()
    return joined.select(
        *[
            (F.when(hit, F.col(f"_s_row.{c}")).otherwise(F.col(c)) if c in columns else F.col(c)).alias(c)
            for c in target.columns
        ]
    )
