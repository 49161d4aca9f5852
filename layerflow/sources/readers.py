"""Scans: JDBC, files, catalog tables, layer windows and the event log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.config import ConfigError, FlowSpec, Registry, TableSpec
from layerflow.operators.envelope import LOG_SCHEMA


def jdbc_options(source: Mapping[str, Any], connection: Mapping[str, Any]) -> dict[str, str]:
    """Reader options; a query is pushed to the database as it is.

    With ``partition_column`` the scan runs as many range reads as asked
    instead of one connection.
    """
    options = {k: str(connection[k]) for k in ("url", "user", "password") if k in connection}
    options["driver"] = str(connection.get("driver", "org.postgresql.Driver"))
    if source.get("query"):
        if source.get("partition_column"):
            options["dbtable"] = f"({source['query']}) q"
        else:
            options["query"] = source["query"]
    else:
        options["dbtable"] = source["table"]
    if source.get("partition_column"):
        options |= {
            "partitionColumn": str(source["partition_column"]),
            "lowerBound": str(source["lower_bound"]),
            "upperBound": str(source["upper_bound"]),
            "numPartitions": str(source.get("num_partitions", 32)),
        }
    if source.get("fetch_size"):
        options["fetchsize"] = str(source["fetch_size"])
    return options


def read_source(
    spark: SparkSession, registry: Registry, table: TableSpec, loaded_until: Any = None
) -> DataFrame:
    """The table's source; an incremental one keeps rows past the watermark."""
    source = table.source
    kind = source.get("type")
    if kind == "jdbc":
        options = jdbc_options(source, registry.connections[source["connection"]])
        df = spark.read.format("jdbc").options(**options).load()
    elif kind == "file":
        df = (
            spark.read.format(source.get("format", "parquet"))
            .options(**{k: str(v) for k, v in (source.get("options") or {}).items()})
            .load(source["path"])
        )
    elif kind == "table":
        df = spark.table(source["table"])
    else:
        raise ConfigError(f"table {table.name}: unknown source type {kind}")
    if source.get("load_strategy", "full") == "incremental":
        return incremental(df, table.watermark_column, loaded_until)
    return df


def incremental(df: DataFrame, watermark: str | None, loaded_until: Any) -> DataFrame:
    """Rows with a watermark above the last loaded one; all on the first load."""
    if not watermark or loaded_until is None:
        return df
    return df.filter(F.col(watermark) > F.lit(loaded_until))


def layer_window(
    df: DataFrame, from_ts: str | None = None, to_ts: str | None = None, limit: int | None = None,
    prefer: Sequence[str] = ("_meta_ingest_ts",),
) -> DataFrame:
    """Half-open window on the first ``prefer`` column the layer has.

    Plain comparisons on a stored column, so they reach the Parquet scan.
    """
    column = next((c for c in prefer if c in df.columns), None)
    if column and from_ts:
        df = df.filter(F.col(column) >= F.lit(from_ts).cast("timestamp"))
    if column and to_ts:
        df = df.filter(F.col(column) < F.lit(to_ts).cast("timestamp"))
    return df.limit(limit) if limit else df


WORK_WINDOW = ("_meta_work_ts", "_meta_ingest_ts")


def snapshot_query(source: Mapping[str, Any], from_ts: str | None = None, to_ts: str | None = None) -> str:
    """SQL of a snapshot or backfill source.

    A backfill template needs both bounds. They become typed literals, so the
    template stays one statement that Spark or a database can run.
    """
    if source.get("query_template"):
        if not from_ts or not to_ts:
            raise ConfigError("a backfill needs from_ts and to_ts")
        bounds = {"from_ts": from_ts, "to_ts": to_ts}
        text = source["query_template"]
        for name, value in bounds.items():
            literal = "TIMESTAMP '" + str(value).replace("'", "''") + "'"
            text = text.replace(f"%({name})s", literal)
        return text
    if source.get("query"):
        return source["query"]
    return f"SELECT * FROM {source.get('schema', 'public')}.{source['table']}"


def backfill(df: DataFrame, column: str, from_ts: str | None, to_ts: str | None) -> DataFrame:
    if not from_ts or not to_ts:
        raise ConfigError("a backfill needs from_ts and to_ts")
    return df.filter(
        (F.col(column) >= F.lit(from_ts).cast("timestamp")) & (F.col(column) < F.lit(to_ts).cast("timestamp"))
    )


def kafka_options(flow: FlowSpec, connection: Mapping[str, Any]) -> dict[str, str]:
    """Reader options of a flow's topics; a trigger may be limited in offsets."""
    options = {
        "kafka.bootstrap.servers": connection["bootstrap_servers"],
        "subscribe": ",".join(flow.topics),
        "startingOffsets": connection.get("starting_offsets", "latest"),
        "failOnDataLoss": str(connection.get("fail_on_data_loss", False)).lower(),
    }
    limit = connection.get("max_offsets_per_trigger")
    return {**options, "maxOffsetsPerTrigger": str(limit)} if limit else options


def read_log_stream(spark: SparkSession, flow: FlowSpec, connection: Mapping[str, Any]) -> DataFrame:
    """Event log of a flow's topics as a stream.

    ``type: kafka`` subscribes to brokers; ``type: files`` reads a directory of
    Parquet or JSON log records and keeps the flow's topics.
    """
    if connection.get("type", "kafka") == "kafka":
        return spark.readStream.format("kafka").options(**kafka_options(flow, connection)).load()
    reader = spark.readStream.schema(LOG_SCHEMA).format(connection.get("format", "parquet"))
    if connection.get("max_files_per_trigger"):
        reader = reader.option("maxFilesPerTrigger", int(connection["max_files_per_trigger"]))
    return reader.load(connection["path"]).filter(F.col("topic").isin(flow.topics))
