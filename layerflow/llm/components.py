"""Connected components of a graph that may have hot vertices.

Alternating large-star and small-star rounds (Kiveris et al., 2014). A vertex's
neighbours are never gathered: each round is a minimum per vertex, which Spark
combines before the shuffle, and a join that it can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerflow.llm.common import materialize


def _star(sides: DataFrame) -> DataFrame:
    """Each vertex ``u`` with its neighbours ``v`` and the least of them all."""
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return sides.join(least, "u")


def _edges(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex that has an edge to another one.

    ``component`` is the least id that can be reached. Null ends and loops are
    ignored; an empty graph gives no rows. Rounds run until none changes an
    edge, about the logarithm of the longest path.
    """
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    now = materialize(now.where("a <> b").select(*_edges("a", "b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = _star(both).where("v > u").select(*_edges("v", "m")).where("a <> b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        star = _star(down)
        small = star.select(*_edges("v", "m")).union(star.select(*_edges("u", "m")))
        now = materialize(small.where("a <> b").distinct(), "edges")
    tops = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(tops)
