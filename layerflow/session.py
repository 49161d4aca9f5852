"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

# Settings the operators count on. AQE is what turns an un-hinted join into a
# broadcast once the real size is known, and what splits a hot join key.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# Of all stored tables: much of them are hashes as hex text, which only a codec
# with entropy coding makes smaller.
CODEC = "zstd"


def build_session(app_name: str = "layerflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="layerflow-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared scratch folder and read it back.

    Cuts lineage like a checkpoint does and survives lost executors, and the
    columnar copy still allows pruning and pushdown in the readers.
    """
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(watch: Observation, names: Iterable[str], empty: Any = 0) -> dict[str, Any]:
    """Metrics of an observed write that has run.

    Where AQE finds the result empty it may cut the observed node out of the
    final plan. The observation then has no values: nothing was counted.
    """
    try:
        return dict(watch.get)
    except Py4JJavaError:
        return {name: empty for name in names}
