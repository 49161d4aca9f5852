"""Exact ranks of a value without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerflow.operators.neighbors import RANGE, in_ranges, same_key


def cumulative_histogram(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct values with ``_upto``, the number of rows at or below each, and
    ``_total``; NULLs are left out.

    Counting per value is combined map-side, so repeated values cost nothing.
    The counts are put into ranges of group and value, whose number follows
    their size; running sums are taken inside a range and shifted by the counts
    of the group's ranges before it.
    """
    groups = list(groups)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = in_ranges(counts, [*groups, "_value"])
    names = [f"_of_{i}" for i in range(len(groups))]
    per_range = placed.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names)], F.col(RANGE).alias("_in")).agg(
        F.sum("_n").alias("_inside")
    )
    # One row per group and range is left here.
    scope = [F.col(n) for n in names] or [F.lit(0)]
    offsets = per_range.select(
        *names,
        "_in",
        (F.sum("_inside").over(Window.partitionBy(*scope).orderBy("_in")) - F.col("_inside")).alias("_before"),
        F.sum("_inside").over(Window.partitionBy(*scope)).alias("_total"),
    )
    inside = Window.partitionBy(*groups, RANGE).orderBy("_value")
    of_group = same_key(placed, offsets, groups, names) & (placed[RANGE] == offsets["_in"])
    return placed.join(offsets, of_group).select(
        *groups, "_value", (F.sum("_n").over(inside) + F.col("_before")).alias("_upto"), "_total"
    )


def trailing(df: DataFrame, column: str, minutes: int = 5) -> DataFrame:
    """Rows of the last ``minutes`` before the newest value of ``column``."""
    newest = df.agg(F.max(column).alias("_newest")).scalar()
    return df.filter(F.col(column) >= newest - F.make_dt_interval(mins=F.lit(minutes)))


def _at_rank(rank: Column) -> Column:
    return F.min(F.when(F.col("_upto") > rank, F.col("_value")))


def nearest_rank(
    df: DataFrame, value: str, quantiles: Mapping[str, float], groups: Sequence[str] = ()
) -> DataFrame:
    """Value at index round((n - 1) * p), halves to even; 0 for an empty frame.

    Adds ``sample_count``. This is the nearest-rank percentile, which differs
    from the interpolating ``percentile`` function.
    """
    table = cumulative_histogram(df, value, groups)
    picks = [
        F.coalesce(_at_rank(F.bround((F.col("_total") - 1) * F.lit(p))).cast("double"), F.lit(0.0)).alias(name)
        for name, p in quantiles.items()
    ]
    size = F.coalesce(F.max("_total"), F.lit(0)).alias("sample_count")
    return table.groupBy(*groups).agg(*picks, size)


def median(df: DataFrame, value: str, groups: Sequence[str] = (), name: str = "median") -> DataFrame:
    """Middle value, or the mean of the middle two; 0 for an empty frame."""
    table = cumulative_histogram(df, value, groups)
    low = F.floor((F.col("_total") - 1) / 2)
    high = F.floor(F.col("_total") / 2)
    middle = (_at_rank(low).cast("double") + _at_rank(high).cast("double")) / 2
    return table.groupBy(*groups).agg(F.coalesce(middle, F.lit(0.0)).alias(name))
