"""Surrogate keys, version columns and foreign-key lookup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerflow.config import FlowSpec
from layerflow.functions.hashing import surrogate_key

UNKNOWN = -1


def add_surrogate_key(df: DataFrame, flow: FlowSpec) -> DataFrame:
    """Key column from the natural key; a type-2 key also covers the start."""
    if not flow.surrogate_column:
        return df
    inputs = list(flow.surrogate.get("keys") or flow.natural_key)
    if flow.is_scd2 and flow.surrogate.get("effective_from"):
        inputs.append(flow.surrogate["effective_from"])
    return df.withColumn(flow.surrogate_column, surrogate_key(inputs))


def key_collisions(df: DataFrame, natural: Sequence[str], surrogate: str) -> DataFrame:
    """Rows, different natural keys, and how many of these share their surrogate
    with another one. Both counts are combined map-side."""
    keys = df.groupBy(F.col(surrogate).alias("_sk"), F.struct(*natural).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    per_surrogate = keys.groupBy("_sk").agg(F.sum("_rows").alias("_rows"), F.count(F.lit(1)).alias("_keys"))
    none = F.lit(0).cast("long")
    return per_surrogate.agg(
        F.coalesce(F.sum("_rows"), none).alias("total_rows"),
        F.coalesce(F.sum("_keys"), none).alias("natural_keys"),
        F.coalesce(F.sum(F.when(F.col("_keys") > 1, F.col("_keys"))), none).alias("collisions"),
    )


def add_version_columns(df: DataFrame, flow: FlowSpec, at: Column | None = None) -> DataFrame:
    if not flow.is_scd2:
        return df
    start = flow.effective_from
    now = F.current_timestamp() if at is None else at
    return df.withColumns(
        {
            "effective_from": F.col(start).cast("timestamp") if start in df.columns else now,
            flow.effective_to_column: F.lit(None).cast("timestamp"),
            flow.current_column: F.lit(True),
        }
    )


def lookup_key(
    df: DataFrame,
    dimension: DataFrame,
    *,
    name: str,
    value: str,
    lookup: Sequence[str],
    source: Sequence[str] | None = None,
    unknown: int = UNKNOWN,
    current: str | None = None,
    latest_by: str | None = None,
) -> DataFrame:
    """Add ``name``: the dimension's key for each row, ``unknown`` if absent.

    Only current dimension rows count, one per key, and no lookup column leaks
    into the result. There is no broadcast hint: Catalyst broadcasts the
    dimension if its measured size allows, else AQE splits a hot key.
    """
    source = list(source or lookup)
    if current:
        dimension = dimension.filter(F.expr(current))
    aliases = [f"_fk_{i}" for i in range(len(lookup))]
    pick = F.max(value) if latest_by is None else F.max_by(value, latest_by)
    present = F.lit(True)
    for key in lookup:
        present = present & F.col(key).isNotNull()
    keyed = (
        dimension.filter(present)
        .groupBy(*[F.col(k).alias(a) for k, a in zip(lookup, aliases)])
        .agg(pick.alias("_fk_value"))
    )
    match = F.lit(True)
    for key, alias in zip(source, aliases):
        match = match & (df[key] == keyed[alias])
    joined = df.join(keyed, match, "left")
    return joined.withColumn(name, F.coalesce(F.col("_fk_value"), F.lit(unknown)).cast("long")).drop(
        "_fk_value", *aliases
    )


def resolve_keys(df: DataFrame, flow: FlowSpec, dimensions: Mapping[str, DataFrame]) -> DataFrame:
    """All foreign keys of a flow; ``dimensions`` maps lookup tables to frames.

    A dimension that does not exist yet leaves every row unknown.
    """
    for fk in flow.foreign_keys:
        unknown = fk.get("unknown_value", UNKNOWN)
        dimension = dimensions.get(fk["lookup_table"])
        if dimension is None:
            df = df.withColumn(fk["name"], F.lit(unknown).cast("long"))
            continue
        current = fk.get("current_filter")
        if current is None and "is_current" in dimension.columns:
            current = "is_current"
        df = lookup_key(
            df,
            dimension,
            name=fk["name"],
            value=fk["lookup_value"],
            lookup=fk["lookup_key"],
            source=fk.get("source_key"),
            unknown=unknown,
            current=current,
            latest_by="effective_from" if "effective_from" in dimension.columns else None,
        )
    return df


def unknown_rate(df: DataFrame, column: str, unknown: int = UNKNOWN) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col(column) == unknown).alias("unknown_rows")
    ).withColumn("unknown_pct", F.when(F.col("total_rows") > 0, F.col("unknown_rows") / F.col("total_rows") * 100))
