"""Storage measures from file metadata: no data page is read."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.session import CODEC


def table_bytes(df: DataFrame) -> DataFrame:
    """Files and bytes behind a file-based scan, after partition pruning.

    Grouping by file combines map-side to one row per file and task.
    """
    files = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"))
    return (
        files.groupBy("f").agg(F.max("s").alias("s"))
        .agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("bytes"))
    )


def _listing(spark: SparkSession, layer: str, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.lit(layer).alias("layer"), F.col("length"))
    )


def layer_sizes(spark: SparkSession, layers: Mapping[str, str]) -> DataFrame:
    """Bytes, MB and GB per layer directory, with a ``total`` row."""
    files = reduce(DataFrame.unionByName, [_listing(spark, n, p) for n, p in layers.items()])
    per_layer = files.groupBy("layer").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    total = per_layer.agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes")).select(
        F.lit("total").alias("layer"), "files", "bytes"
    )
    return per_layer.unionByName(total).withColumns(
        {"mb": F.round(F.col("bytes") / 1024**2, 2), "gb": F.round(F.col("bytes") / 1024**3, 3)}
    )


def register_partitioned(spark: SparkSession, name: str, path: str) -> None:
    """Catalog entry for an existing partitioned Parquet directory."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{path}'")
    if any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.sql(f"MSCK REPAIR TABLE {name}")


def write_day_partitioned(df: DataFrame, path: str, column: str | None) -> None:
    """Plain Parquet, one directory per day of ``column``; replaces the path."""
    if column and column in df.columns:
        dated = df.withColumn("p_date", F.to_date(F.col(column))).hint("rebalance", "p_date")
        writer = dated.write.partitionBy("p_date")
    else:
        writer = df.write
    writer.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", CODEC).parquet(path)
