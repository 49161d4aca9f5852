"""Previous and next row of a key, however many rows the key has.

``lag``/``lead`` over ``partitionBy(key)`` sorts a whole key in one task. Here
the rows are first put into ranges of key and order, all of about one size, so
that a key with most of the rows lies in many of them. Windows then run per key
and range. Only a key that ends one range and starts the next one can have
neighbors elsewhere: there is at most one such key per range, and its edge rows,
a table of two rows per range, supply the values across ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerflow.session import materialize

RANGE = "_range"


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> Column:
    match = F.lit(True)
    for key, name in zip(keys, names or keys):
        match = match & left[key].eqNullSafe(right[name])
    return match


def in_ranges(
    df: DataFrame, columns: Sequence[str], within: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The frame, written once in ranges of ``columns``, with each row's range.

    ``within`` may thin out rows that are equal in all ``columns`` before they are
    written: its windows over these columns need no shuffle of their own.

    There are as many ranges as shuffle partitions, or fewer where AQE joins
    small ones. Rows that are equal in all ``columns`` share a range.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in columns])
    ranged = within(ranged) if within else ranged
    return materialize(ranged.withColumn(RANGE, F.spark_partition_id()), "ranges")


def _spanning(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Keys that lie in more than one range: fewer than there are ranges."""
    ends = df.groupBy(RANGE).agg(F.min(F.struct(*keys)).alias("_low"), F.max(F.struct(*keys)).alias("_high"))
    before = F.lag("_high").over(Window.partitionBy(F.lit(0)).orderBy(RANGE))  # one row per range
    met = ends.withColumn("_before", before).filter(F.col("_before").eqNullSafe(F.col("_low")))
    return met.select(*[F.col(f"_low.{k}").alias(n) for k, n in zip(keys, names)]).distinct()


def add_neighbors(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add values of the row before (``previous``) and after (``following``).

    Both map a new column to the column it is read from. Rows are unique per
    key and ``order``, and come from ``in_ranges`` of the keys and ``order``;
    some may have been filtered out since.
    """
    previous, following = dict(previous or {}), dict(following or {})
    local = Window.partitionBy(*keys, RANGE).orderBy(order)
    step = df.withColumns(
        {
            **{new: F.lag(col).over(local) for new, col in previous.items()},
            **{new: F.lead(col).over(local) for new, col in following.items()},
            "_first": F.lag(F.lit(1)).over(local).isNull(),
            "_last": F.lead(F.lit(1)).over(local).isNull(),
        }
    )
    image = F.struct(*dict.fromkeys([*previous.values(), *following.values()]))
    names = [f"_edge_{i}" for i in range(len(keys))]
    spanning = _spanning(df, keys, names)
    by_key = Window.partitionBy(*names).orderBy("_edge_range")
    edges = (
        df.join(F.broadcast(spanning), same_key(df, spanning, keys, names))
        .groupBy(*names, F.col(RANGE).alias("_edge_range"))
        .agg(F.min_by(image, order).alias("_head"), F.max_by(image, order).alias("_tail"))
        .select(*names, "_edge_range", F.lag("_tail").over(by_key).alias("_before"), F.lead("_head").over(by_key).alias("_after"))
    )
    joined = step.join(
        F.broadcast(edges), same_key(step, edges, keys, names) & (step[RANGE] == edges["_edge_range"]), "left"
    )
    filled = {
        **{
            new: F.when(F.col("_first"), F.col("_before").getField(col)).otherwise(F.col(new))
            for new, col in previous.items()
        },
        **{
            new: F.when(F.col("_last"), F.col("_after").getField(col)).otherwise(F.col(new))
            for new, col in following.items()
        },
    }
    return joined.withColumns(filled).drop("_first", "_last", "_before", "_after", "_edge_range", *names)
