"""Event log to layers, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from layerflow.config import FlowSpec, Registry
from layerflow.operators.envelope import decode_events
from layerflow.plans.layers import BATCH, LayerJobs
from layerflow.session import scratch_dir
from layerflow.sources.readers import read_log_stream
from layerflow.sources.tables import TableStore

STYLES = ("raw_only", "full")


class FlowStreams:
    """Starts one streaming query per flow.

    ``raw_only`` stops at the raw table; ``full`` runs every layer of a
    micro-batch. Delivery is at least once, and all writes of a batch id are
    repeatable, so a retried micro-batch changes nothing.
    """

    def __init__(self, spark: SparkSession, registry: Registry, location: str | None = None):
        self.spark, self.registry, self.location = spark, registry, location

    def decoded(self, flow: FlowSpec) -> DataFrame:
        connection = self.registry.connections[flow.source["connection"]]
        log = read_log_stream(self.spark, flow, connection)
        return decode_events(log, flow, self.registry.runtime)

    def process(self, batch: DataFrame, batch_id: int, flow: FlowSpec, style: str) -> None:
        if batch.isEmpty():
            return
        # A micro-batch runs in the query's own session; so must its tables.
        jobs = LayerJobs(TableStore(batch.sparkSession, self.location), self.registry)
        jobs.write_raw(batch, flow, batch_id)
        if style == "full":
            raw = jobs.store.read(jobs.name(flow, "raw"))
            jobs.raw_to_silver(flow, batch_id, raw=raw.filter(raw[BATCH] == batch_id))

    def start(self, flow: FlowSpec, *, style: str = "raw_only", once: bool = False) -> StreamingQuery:
        if style not in STYLES:
            raise ValueError(f"unknown stream style: {style}")
        base = self.registry.runtime.checkpoint_base or f"{scratch_dir(self.spark)}/streams"
        writer = (
            self.decoded(flow)
            .writeStream.foreachBatch(lambda df, batch_id: self.process(df, batch_id, flow, style))
            .option("checkpointLocation", f"{base.rstrip('/')}/{flow.name}/{style}")
            .queryName(f"{style}_{flow.name}")
        )
        interval = flow.source.get("trigger", self.registry.runtime.default_trigger)
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
        return writer.start()

    def start_all(self, flows: Iterable[FlowSpec], *, style: str = "raw_only", once: bool = False) -> None:
        """Run the flows side by side and wait for all of them. Where one fails,
        the others are stopped and its error is raised."""
        queries = [self.start(flow, style=style, once=once) for flow in flows]
        try:
            while running := [q for q in queries if q.isActive]:
                for query in running:
                    query.awaitTermination(1)
            for query in queries:
                query.awaitTermination()  # raises what ended it
        finally:
            for query in queries:
                query.stop()


def append_stream(stream: DataFrame, table: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Append a projected stream to a catalog table, exactly once."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.toTable(table)
