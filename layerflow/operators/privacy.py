"""Masking of personal columns and the accuracy of a masked table."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.functions.masking import is_unmasked, mask


def apply_masks(df: DataFrame, policy: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Mask the declared columns that exist; others are skipped."""
    masked = {c: mask(spec.get("method", "nullify"), F.col(c)) for c, spec in policy.items() if c in df.columns}
    return df.withColumns(masked) if masked else df


def masking_checks(df: DataFrame, policy: Mapping[str, Mapping[str, Any]], table: str) -> DataFrame:
    """Per column: values that had to be masked, and those that were not.

    One pass over the table whatever the number of columns. A removed column
    counts every row, the others only non-NULL values.
    """
    counts, rows = [], []
    for name, spec in policy.items():
        if name not in df.columns:
            continue
        method = spec.get("method", "nullify")
        total = F.count(F.lit(1)) if method == "nullify" else F.count(F.col(name))
        counts += [total.alias(f"total_{name}"), F.count_if(is_unmasked(method, F.col(name))).alias(f"bare_{name}")]
        rows.append(
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(name).alias("column_name"),
                F.lit(method).alias("method"),
                F.col(f"total_{name}").alias("total"),
                F.col(f"bare_{name}").alias("unmasked"),
            )
        )
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def masking_accuracy(checks: DataFrame) -> DataFrame:
    """Share of checked values that are masked, in percent."""
    return checks.agg(F.sum("total").alias("total"), F.sum("unmasked").alias("unmasked")).withColumn(
        "accuracy_pct", F.when(F.col("total") > 0, (1 - F.col("unmasked") / F.col("total")) * 100)
    )
