"""Latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


EVENT = "_meta_event_id"


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], *, need_order: bool = True
) -> DataFrame:
    """One row per key: the highest ``order_by``, NULLs last.

    Rows that are equal so far are told apart by content, so reruns pick the
    same one. Without an order column the frame is returned as it is, or ranked
    by content alone where ``need_order`` is off.

    ``row_number() = 1`` lets Spark keep one candidate per key and map task
    before the shuffle (``WindowGroupLimit``), so a hot key sends at most one
    row per task.
    """
    order = [c for c in order_by if c in df.columns]
    if not keys or (need_order and not order):
        return df
    rest = [c for c in df.columns if c not in keys and c not in order and not c.startswith("_meta_")]
    ranking = [F.col(c).desc_nulls_last() for c in order]
    if rest:
        ranking.append(F.xxhash64(*rest).desc())
    if EVENT in df.columns:
        ranking.append(F.col(EVENT).desc_nulls_last())  # equal rows of different events
    window = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*ranking)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def latest_of_stored(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """``latest_per_key`` of rows that come from files: reading their keys first is
    cheap, and where no key repeats the rows stay as they are, unshuffled."""
    if not keys or not any(c in df.columns for c in order_by):
        return df
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1")
    return df if repeated.isEmpty() else latest_per_key(df, keys, order_by)
