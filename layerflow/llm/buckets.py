"""Packing into length buckets that pad least, and batches of a token budget.

Documents above the longest bucket are split without loss. The lengths of all
pieces are counted in a histogram of at most ``longest / align`` bars, over
which dynamic programming finds the bucket boundaries with the least padding.
Pieces are then numbered inside their bucket in seeded order and cut into
batches of ``budget`` padded tokens. Numbers come from counts per hash range and
places inside a range, so no bucket is sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layerflow.llm.mixture import words

LONGEST = 8192
ALIGN = 8
BUCKETS = 16
BUDGET = 1 << 16
RANGE_ROWS = 4096


def boundaries(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least padding.

    ``length`` rises; every length is in the first bucket whose end is not below
    it. Of equal solutions the one with the lowest ends from the right is taken.
    """
    m = len(length)
    if not m:
        return []
    upto = np.concatenate([[0], np.cumsum(count)]).astype(float)
    best = np.full(m + 1, np.inf)
    best[0] = 0
    choice: list[np.ndarray] = []
    for _ in range(min(buckets, m)):
        cost = best[:, None] + length[None, :] * (upto[None, 1:] - upto[:, None])
        cost[np.arange(m + 1)[:, None] > np.arange(m)[None, :]] = np.inf
        pick = cost.argmin(0)
        new = np.concatenate([[np.inf], cost[pick, np.arange(m)]])
        choice.append(pick)
        totals = new[m]
        best = new
        if not np.isfinite(totals):
            break
    ends, j = [], m
    for pick in reversed(choice):
        if j == 0:
            break
        ends.append(int(length[j - 1]))
        j = int(pick[j - 1])
    return ends[::-1]


def pack(
    docs: DataFrame,
    tokens: Column | None = None,
    *,
    longest: int = LONGEST,
    align: int = ALIGN,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    seed: int = 0,
) -> DataFrame:
    """(doc_id, n_tokens, piece, start, length, bucket, padded, batch, slot) per piece.

    ``bucket`` counts from 0, ``padded`` is its end, ``batch`` counts inside the
    bucket and ``slot`` inside the batch. A batch holds as many pieces as fit into
    ``budget`` padded tokens, one at least. Rows without tokens are one piece
    of length 0 in no bucket (nulls). Repeated ids are packed for each row. An
    empty table gives no rows.
    """
    if longest % align:
        raise ValueError("longest must be a multiple of align")
    size = words() if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    narrow = docs.select("doc_id", size.alias("n_tokens"))
    last = F.greatest(F.ceil(F.col("n_tokens") / longest), F.lit(1)) - 1
    pieces = narrow.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id", "n_tokens", "piece", (F.col("piece") * longest).alias("start"),
        F.least(F.lit(longest), F.col("n_tokens") - F.col("piece") * longest).alias("length"),
    )
    bar = (F.ceil(F.col("length") / align) * align).alias("bar")
    bars = sorted(pieces.where("length > 0").groupBy(bar).count().collect())
    ends = boundaries(np.array([b[0] for b in bars]), np.array([b[1] for b in bars]), buckets)
    held = [0] * len(ends)
    for length, count in bars:
        held[int(np.searchsorted(ends, length))] += count
    bucket = F.lit(None).cast("int")
    for k in reversed(range(len(ends))):
        bucket = F.when(F.col("length") <= ends[k], F.lit(k)).otherwise(bucket)
    bucket = F.when(F.col("length") > 0, bucket)
    if not ends:
        nothing = F.lit(None)
        return pieces.select(
            "*", nothing.cast("int").alias("bucket"), nothing.cast("long").alias("padded"),
            nothing.cast("long").alias("batch"), nothing.cast("long").alias("slot"),
        )
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1).cast("long")
    ranges = [-(-n // RANGE_ROWS) for n in held]
    at = F.xxhash64(F.lit(seed), "doc_id", "piece")
    named = pieces.withColumn("bucket", bucket).withColumn("h", at)
    named = named.withColumn("range", F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * of(ranges)), of(ranges) - 1))
    full = named.where("bucket IS NOT NULL")
    before = W.partitionBy("bucket").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = full.groupBy("bucket", "range").count().select(
        "bucket", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    inside = W.partitionBy("bucket", "range").orderBy("h", "doc_id", "piece")
    numbered = full.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["bucket", "range"])
    number = F.col("offset") + F.col("place")
    fits = [max(1, budget // e) for e in ends]
    first = ["doc_id", "n_tokens", "piece", "start", "length", "bucket"]
    packed = numbered.select(*first, of(ends).alias("padded"), F.floor(number / of(fits)).alias("batch"), (number % of(fits)).alias("slot"))
    nothing = F.lit(None).cast("long")
    return packed.union(named.where("bucket IS NULL").select(*first, nothing, nothing, nothing))
