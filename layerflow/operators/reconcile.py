"""Late foreign keys: unknown fact rows matched to dimensions that came later."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerflow.operators.keys import UNKNOWN

STAMPS = ("_meta_reconciled_at", "_meta_reconciled_by")


def stamp_columns(job: Mapping[str, Any]) -> tuple[str, str]:
    audit = job.get("audit_columns") or {}
    return (
        audit.get("reconciled_at_column", STAMPS[0]),
        audit.get("reconciled_by_column", STAMPS[1]),
    )


def late_matches(fact: DataFrame, dimension: DataFrame, job: Mapping[str, Any], now: Column | None = None) -> DataFrame:
    """Fact rows with the unknown key that now have a current dimension row.

    Keys match null-safely; a key with several current rows takes the highest.
    """
    column = job["unknown_fk_column"]
    pairs = job["lookup_keys"]
    if job.get("current_filter"):
        dimension = dimension.filter(F.expr(job["current_filter"]))
    aliases = [f"_fk_{i}" for i in range(len(pairs))]
    keyed = dimension.groupBy(
        *[F.col(p["lookup_column"]).alias(a) for p, a in zip(pairs, aliases)]
    ).agg(F.max(job["lookup_value"]).alias("_fk_value"))
    unknown = fact.filter(F.col(column) == job.get("unknown_value", UNKNOWN))
    match = F.lit(True)
    for pair, alias in zip(pairs, aliases):
        match = match & unknown[pair["fact_column"]].eqNullSafe(keyed[alias])
    at, by = stamp_columns(job)
    return (
        unknown.join(keyed, match, "inner")
        .withColumns(
            {
                column: F.col("_fk_value").cast("long"),
                at: F.current_timestamp() if now is None else now,
                by: F.lit(job["name"]),
            }
        )
        .drop("_fk_value", *aliases)
    )


def updated_columns(job: Mapping[str, Any]) -> list[str]:
    return list(dict.fromkeys([*(job.get("update_columns") or [job["unknown_fk_column"]]), *stamp_columns(job)]))
