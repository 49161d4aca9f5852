"""Declared schema contract and column-adding evolution."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVOLUTION_MODES = ("fail", "add_columns", "permissive")


def apply_contract(df: DataFrame, columns: Iterable[Mapping[str, Any]], strict: bool = False) -> DataFrame:
    """Cast the contract columns, add missing ones as typed NULL, keep the others.

    Text that does not fit the type becomes NULL. ``strict`` refuses a missing
    column that is declared as not nullable.
    """
    present = set(df.columns)
    changes = {}
    for spec in columns:
        name, dtype = spec["name"], spec.get("type", "string")
        if name in present:
            changes[name] = F.col(name).try_cast(dtype)
        elif strict and spec.get("nullable", True) is False:
            raise ValueError(f"required column is missing: {name}")
        else:
            changes[name] = F.lit(None).cast(dtype)
    return df.withColumns(changes) if changes else df


def new_columns(df: DataFrame, target: T.StructType) -> list[T.StructField]:
    known = set(target.fieldNames())
    return [f for f in df.schema.fields if f.name not in known]


def align_to(df: DataFrame, target: T.StructType) -> DataFrame:
    """Order columns like the target; columns the frame lacks become NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def evolve(df: DataFrame, target: T.StructType, mode: str = "add_columns") -> tuple[DataFrame, T.StructType]:
    """Frame aligned to the target schema after evolution, and that schema.

    ``fail`` refuses unknown columns, ``permissive`` drops them and
    ``add_columns`` appends them to the target.
    """
    if mode not in EVOLUTION_MODES:
        raise ValueError(f"unknown on_schema_change mode: {mode}")
    added = new_columns(df, target)
    if added and mode == "fail":
        raise ValueError(f"columns not in the target: {[f.name for f in added]}")
    if mode == "add_columns":
        target = T.StructType(target.fields + [T.StructField(f.name, f.dataType, True) for f in added])
    return align_to(df, target), target
