"""Projections, filters, standardization and audit stamps."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerflow.functions.hashing import joined_hash

# Column names carried by the event record and dropped from silver tables.
LOG_COLUMNS = ("_raw_event_json", "_kafka_topic", "_kafka_partition", "_kafka_offset", "_kafka_timestamp")


def rename(df: DataFrame, pairs: Iterable[Mapping[str, str]]) -> DataFrame:
    present = set(df.columns)
    return df.withColumnsRenamed({p["from"]: p["to"] for p in pairs if p["from"] in present})


def derive(df: DataFrame, items: Iterable[Mapping[str, str]]) -> DataFrame:
    """Columns from SQL expressions, in order; later ones may use earlier ones."""
    for item in items:
        df = df.withColumn(item["name"], F.expr(item["expr"]))
    return df


def keep_where(df: DataFrame, condition: str | None) -> DataFrame:
    return df.filter(F.expr(condition)) if condition else df


def select_keeping_technical(df: DataFrame, names: Iterable[str] | None) -> DataFrame:
    """The named columns that exist, then every column starting with ``_``."""
    if not names:
        return df
    picked = [n for n in names if n in df.columns]
    return df.select(*picked, *[c for c in df.columns if c.startswith("_") and c not in picked])


def drop_technical(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def stamp_audit(
    df: DataFrame,
    *,
    layer: str,
    batch_id: str,
    source_system: str,
    table_name: str | None = None,
    hash_all_columns: bool = False,
    null_safe_hash: bool = True,
    at: Column | None = None,
) -> DataFrame:
    """Audit columns; the row hash covers the business columns, or every one."""
    hashed = [c for c in df.columns if hash_all_columns or not c.startswith("_")]
    stamps = {
        "_layer": F.lit(layer),
        "_source_system": F.lit(source_system),
        "_batch_id": F.lit(batch_id),
        "_ingest_ts": F.current_timestamp() if at is None else at,
        "_row_hash": joined_hash(hashed, null_safe_hash),
    }
    if table_name is not None:
        stamps["_table_name"] = F.lit(table_name)
    return df.withColumns(stamps)


def _replaced(rule: Mapping[str, Any], column: str) -> tuple[str, Column]:
    action = rule["action"]
    source = F.col(column)
    if action == "trim":
        return column, F.trim(source)
    if action == "upper":
        return column, F.upper(source)
    if action == "lower":
        return column, F.lower(source)
    if action == "cast":
        return column, source.try_cast(rule["type"])
    return column, F.regexp_replace(source.cast("string"), rule["pattern"], rule.get("replacement", ""))


IN_PLACE_ACTIONS = ("trim", "upper", "lower", "cast", "regexp_replace")


def standardize(df: DataFrame, rules: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Apply the standardization rules in order.

    An unknown action, or a rule on a column the frame lacks, is an error.
    """
    for rule in rules:
        action, column = rule.get("action"), rule.get("column")
        if action in IN_PLACE_ACTIONS and column in df.columns:
            name, value = _replaced(rule, column)
        elif action == "coalesce":
            name, value = rule.get("name") or column, F.coalesce(*[F.col(c) for c in rule["columns"]])
        elif action == "expr":
            name, value = rule.get("name") or column, F.expr(rule["expr"])
        else:
            raise ValueError(f"cannot apply standardization rule: {dict(rule)}")
        df = df.withColumn(name, value)
    return df


def final_projection(df: DataFrame, contract: Iterable[str]) -> DataFrame:
    """Contract columns, then derived ones, then ``_meta_*``; nothing else."""
    first = [c for c in contract if c in df.columns]
    derived = [c for c in df.columns if not c.startswith("_") and c not in first]
    return df.select(*first, *derived, *[c for c in df.columns if c.startswith("_meta_")])
