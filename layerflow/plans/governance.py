"""Governance measures as ordinary DataFrame jobs over tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerflow.config import FlowSpec, ModelSpec, Registry, TableSpec
from layerflow.operators.ranks import median
from layerflow.session import CODEC, materialize, scratch_dir

# The context columns every flow record carries, with their text.
EMBEDDED_COLUMNS = {
    "_meta_event_id": "Identifier of the event.",
    "_meta_source_system": "System the record came from.",
    "_meta_source_database": "Database the record came from.",
    "_meta_source_schema": "Schema the record came from.",
    "_meta_source_table": "Table the record came from.",
    "_meta_source_operation": "Change operation.",
    "_meta_source_ts_ms": "Change time at the source in milliseconds.",
    "_meta_kafka_topic": "Topic of the event log.",
    "_meta_kafka_partition": "Partition of the event log.",
    "_meta_kafka_offset": "Offset in the event log.",
    "_meta_micro_batch_id": "Micro-batch that loaded the record.",
    "_meta_ingest_ts": "Load time.",
    "_meta_config_version": "Version of the configuration used.",
    "_meta_pipeline_name": "Flow that processed the record.",
    "_meta_layer": "Layer the record is in.",
    "_meta_record_hash": "Hash of the business columns.",
    "_meta_schema_hash": "Hash of the schema contract.",
    "_meta_dq_errors": "Failed quality rules.",
    "_meta_dq_passed": "Whether every quality rule passed.",
    "_meta_pii_tags": "Columns with personal data.",
    "_meta_lineage": "Where the record came through.",
    "_meta_is_deleted": "Whether the source deleted the record.",
    "_meta_deleted_at": "When the delete was applied.",
    "_meta_closed_by_event_id": "Event that closed the version.",
    "_meta_closed_at": "When the version was closed.",
    "_meta_reconciled_at": "When the foreign key was filled in.",
    "_meta_reconciled_by": "Job that filled in the foreign key.",
}


# -- quality, masking and lineage coverage ------------------------------------
def found_violations(quarantine: DataFrame, source_table: str, key: str, errors: str = "_dq_errors") -> DataFrame:
    """Distinct (table, key, rule) of quarantined rows."""
    return quarantine.select(
        F.lit(source_table).alias("source_table"),
        F.col(key).cast("string").alias("source_pk"),
        F.explode(errors).alias("rule_id"),
    ).distinct()


def enforcement_rate(expected: DataFrame, found: Iterable[DataFrame]) -> DataFrame:
    """Share of the expected violations that were quarantined, in percent."""
    keys = ["source_table", "source_pk", "rule_id"]
    wanted = expected.select(*keys).distinct()
    seen = reduce(DataFrame.unionByName, found).distinct().withColumn("_hit", F.lit(1))
    return (
        wanted.join(seen, keys, "left")
        .agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("detected"))
        .withColumn("rate_pct", F.when(F.col("expected") > 0, F.col("detected") / F.col("expected") * 100))
    )


def lineage_capture(runs: Sequence[DataFrame], lineage: DataFrame) -> DataFrame:
    """Share of the pipeline runs that left lineage evidence, in percent."""
    all_runs = reduce(DataFrame.unionByName, [r.select("batch_id") for r in runs]).distinct()
    evidence = lineage.select("batch_id").distinct().withColumn("_hit", F.lit(1))
    return (
        all_runs.join(evidence, "batch_id", "left")
        .agg(F.count(F.lit(1)).alias("total_runs"), F.count("_hit").alias("covered_runs"))
        .withColumn("capture_pct", F.when(F.col("total_runs") > 0, F.col("covered_runs") / F.col("total_runs") * 100))
    )


# -- performance --------------------------------------------------------------
def throughput(runs: DataFrame) -> DataFrame:
    """Rows and MB per second by scale, layout and table over all runs."""
    return runs.groupBy("scale", "layout", "table_name").agg(
        F.count(F.lit(1)).alias("runs"),
        (F.sum("row_count") / F.sum("elapsed_sec")).alias("rows_per_sec"),
        (F.sum("bytes_written") / F.lit(1024 * 1024) / F.sum("elapsed_sec")).alias("mb_per_sec"),
    )


def read_metric_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metric records kept as JSON files, with a scale on every row."""
    df = spark.read.schema(schema).json(path)
    return df.withColumn("scale", F.coalesce("scale", F.lit("unknown")))


def scan_reduction(runs: DataFrame) -> DataFrame:
    """Median bytes of both layouts per query, and the saving in percent."""
    medians = median(runs, "scanned_bytes", ["query", "layout"], "bytes")
    times = median(runs, "exec_ms", ["query", "layout"], "ms")
    side = medians.join(times, ["query", "layout"]).groupBy("query").agg(
        *[
            F.max(F.when(F.col("layout") == layout, F.col(column))).alias(f"{layout}_{column}")
            for layout in ("layered", "baseline")
            for column in ("bytes", "ms")
        ]
    )
    saved = (F.col("baseline_bytes") - F.col("layered_bytes")) / F.col("baseline_bytes") * 100
    return side.withColumn("reduction_pct", F.when(F.col("baseline_bytes") > 0, F.round(saved, 2)))


# -- schema evolution ---------------------------------------------------------
def column_visibility(layers: Mapping[str, DataFrame], column: str) -> list[tuple[str, bool]]:
    return [(name, column in df.columns) for name, df in layers.items()]


def schema_visibility(
    layers: Mapping[str, DataFrame], column: str, probes: DataFrame, succeeded: str
) -> DataFrame:
    """Per layer: is the column there, its rows, and the share of good probes."""
    availability = probes.agg(
        F.count(F.lit(1)).alias("probes"), F.count_if(F.expr(succeeded)).alias("ok")
    ).select("probes", (F.col("ok") / F.col("probes") * 100).alias("availability_pct"))
    marked = [
        availability.select(F.lit(name).alias("layer"), F.lit(seen).alias("visible"), "probes", "availability_pct")
        for name, seen in column_visibility(layers, column)
    ]
    return reduce(DataFrame.unionByName, marked)


# -- catalog ------------------------------------------------------------------
def metadata_coverage(assets: DataFrame) -> DataFrame:
    """Assets with description, owner and a tag, in percent of all assets."""
    def filled(name: str):
        return F.coalesce(F.length(F.col(name)) > 0, F.lit(False))

    return assets.agg(
        F.count(F.lit(1)).alias("total_assets"),
        F.count_if(filled("description") & filled("owner") & filled("tags")).alias("covered_assets"),
    ).withColumn(
        "coverage_pct",
        F.when(F.col("total_assets") > 0, F.round(F.col("covered_assets") / F.col("total_assets") * 100, 2))
        .otherwise(F.lit(0.0)),
    )


def keyword_hits(assets: DataFrame, keywords: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Assets per keyword whose fields contain it, case-insensitively.

    One pass for all keywords; no asset is paired with a keyword list.
    """
    text = F.lower(F.concat_ws(" ", *fields))
    counts = assets.agg(*[F.count_if(text.contains(k.lower())).alias(f"k{i}") for i, k in enumerate(keywords)])
    rows = F.array(
        *[F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("hits")) for i, k in enumerate(keywords)]
    )
    return counts.select(F.inline(rows))


BUCKET_ROWS, MOST_BUCKETS = 500_000, 4096  # of the tables that a search reads round by round


def upstream_hops(edges: DataFrame, root: str, node: str = "asset", upstream: str = "upstream") -> DataFrame:
    """Fewest hops from ``root`` to every asset upstream of it.

    Breadth first: a round joins the last round's assets with their edges and
    drops those seen before, so cycles end it and no depth is cut off. Edges and
    seen assets are tables bucketed by the asset, about one bucket per
    ``BUCKET_ROWS`` edges, so the rounds read them in place: edges are shuffled
    once, and a round shuffles only its own assets and what their edges lead to.
    """
    spark = edges.sparkSession
    mark = f"hops_{uuid.uuid4().hex}"
    place = f"{scratch_dir(spark)}/{mark}"
    links = edges.select(F.col(node).alias("_from"), F.col(upstream).alias("asset")).filter("_from IS NOT NULL AND asset IS NOT NULL")
    buckets = min(MOST_BUCKETS, links.count() // BUCKET_ROWS + 1)
    seen = "asset string, hops int"

    def bucketed(df: DataFrame, name: str, key: str) -> None:
        """Append rows that are dealt by the key: one file per bucket."""
        writer = df.write.mode("append").format("parquet").option("compression", CODEC).option("path", f"{place}/{name}")
        writer.bucketBy(buckets, key).saveAsTable(f"{mark}_{name}")

    def keep(df: DataFrame, hops: int) -> DataFrame:
        level = materialize(df.select("asset", F.lit(hops).alias("hops")), "level")
        bucketed(level.repartition(buckets, "asset"), "seen", "asset")
        return level.select("asset")

    try:
        # The distinct rows of a bucket are found where the shuffle by its key left them.
        bucketed(links.repartition(buckets, "_from").distinct(), "links", "_from")
        level, hops = keep(spark.range(1).select(F.lit(root).alias("asset")), 0), 0
        while not level.isEmpty():
            hops += 1
            level = level.withColumnRenamed("asset", "_from")
            found = spark.table(f"{mark}_links").join(level, "_from").select("asset").distinct()
            level = keep(found.join(spark.table(f"{mark}_seen").select("asset"), "asset", "left_anti"), hops)
    finally:
        # The names go, the files stay: the result reads them.
        for name in ("links", "seen"):
            spark.sql(f"DROP TABLE IF EXISTS {mark}_{name}")
    return spark.read.schema(seen).parquet(f"{place}/seen")


def lineage_depth(edges: DataFrame, root: str) -> DataFrame:
    return upstream_hops(edges, root).agg(F.max("hops").alias("depth"), F.count(F.lit(1)).alias("assets"))


COLUMN_SCHEMA = (
    "asset string, column_name string, data_type string, required boolean, description string, tags array<string>"
)
CONTRACT_SCHEMA = "owner string, column_name string, data_type string, nullable boolean, path string, description string, tags array<string>"


def _contracts(spark: SparkSession, specs: Iterable[FlowSpec | TableSpec]) -> DataFrame:
    """Declared columns of flows or tables, with the tag PII where a mask hides them."""
    specs = list(specs)
    declared = [
        (s.name, c["name"], c.get("type"), c.get("nullable"), c.get("path"), c.get("description"), list(c.get("classification") or ()))
        for s in specs
        for c in s.columns
    ]
    masks = [(s.name, column) for s in specs for column in s.masks]
    hidden = spark.createDataFrame(masks, "owner string, column_name string").withColumn("hidden", F.array(F.lit("PII")))
    columns = spark.createDataFrame(declared, CONTRACT_SCHEMA).join(hidden, ["owner", "column_name"], "left")
    return columns.select(
        "owner", "column_name", F.coalesce("data_type", F.lit("string")).alias("data_type"),
        (~F.coalesce("nullable", F.lit(True))).alias("required"),
        F.coalesce("description", F.format_string("Column read from %s.", F.coalesce("path", "column_name"))).alias("description"),
        F.when(F.col("hidden").isNull(), F.col("tags")).otherwise(F.array_union("tags", "hidden")).alias("tags"),
    )


def asset_columns(spark: SparkSession, registry: Registry) -> DataFrame:
    """Column inventory of every flow and table layer; event flows carry the embedded columns too."""
    ident, place = registry.runtime.ident, "owner string, asset string"
    layers = [(f.name, ident(f.table(x))) for f in registry.flows.values() for x in ("raw", "work", "silver", "quarantine")]
    flow_assets = spark.createDataFrame(layers, place)
    stored = [(t.name, ident(f"{x}.{t.target_name}")) for t in registry.tables.values() for x in ("raw", "work", "silver")]
    table_assets = spark.createDataFrame(stored, place)
    embedded = F.array(*(F.struct(F.lit(n).alias("column_name"), F.lit(text).alias("description")) for n, text in EMBEDDED_COLUMNS.items()))
    names = [part.split()[0] for part in COLUMN_SCHEMA.split(", ")]
    parts = [
        flow_assets.join(_contracts(spark, registry.flows.values()), "owner"),
        table_assets.join(_contracts(spark, registry.tables.values()), "owner"),
        flow_assets.select("asset", F.inline(embedded)).withColumns(
            {"data_type": F.lit("string"), "required": F.lit(False), "tags": F.array(F.lit("embedded"))}
        ),
    ]
    return reduce(DataFrame.unionByName, [p.select(*names) for p in parts])


def with_known_tags(current: DataFrame, known: DataFrame) -> DataFrame:
    """Columns of assets, technical ones left out, with the tags that columns of
    the same name had before."""
    business = current.filter(~F.col("column_name").startswith("_"))
    return business.join(known.select("asset", "column_name", "tags"), ["asset", "column_name"], "left")


def refreshed_columns(written: DataFrame, asset: str, known: DataFrame) -> DataFrame:
    """Inventory of a written table, from its schema and what was known before."""
    rows = [(asset, f.name, f.dataType.simpleString()) for f in written.schema.fields]
    current = written.sparkSession.createDataFrame(rows, "asset string, column_name string, data_type string")
    return with_known_tags(current, known)


EDGE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("asset", "upstream", "job")])


def _flow_edges(flow: FlowSpec, registry: Registry) -> list[tuple[str, str, str]]:
    ident = registry.runtime.ident
    raw, work = ident(flow.table("raw")), ident(flow.table("work"))
    return [
        *[(raw, topic, flow.name) for topic in flow.topics],
        (work, raw, flow.name),
        (ident(flow.table("silver")), work, flow.name),
        (ident(flow.table("quarantine")), work, flow.name),
    ]


def _table_edges(table: TableSpec, registry: Registry) -> list[tuple[str, str, str]]:
    chain = [table.source_name, *[registry.runtime.ident(f"{x}.{table.target_name}") for x in ("raw", "work", "silver")]]
    return [(down, up, table.name) for up, down in zip(chain, chain[1:])]


def _model_edges(model: ModelSpec, registry: Registry) -> list[tuple[str, str, str]]:
    return [(registry.runtime.ident(model.table), registry.runtime.ident(up), model.name) for up in model.upstream]


def lineage_edges(spark: SparkSession, registry: Registry) -> DataFrame:
    """Declared edges of flows, tables and models."""
    rows = [e for f in registry.flows.values() if f.enabled for e in _flow_edges(f, registry)]
    rows += [e for t in registry.tables.values() if t.enabled for e in _table_edges(t, registry)]
    rows += [e for m in registry.models.values() if m.enabled for e in _model_edges(m, registry)]
    return spark.createDataFrame(rows, EDGE_SCHEMA)


def known_edges(declared: DataFrame, recorded: DataFrame) -> DataFrame:
    """Declared edges and those of recorded lineage events, each once."""
    seen = recorded.select(F.col("to_entity").alias("asset"), F.col("from_entity").alias("upstream"))
    return declared.select("asset", "upstream").unionAll(seen).distinct()


def asset_inventory(spark: SparkSession, registry: Registry) -> DataFrame:
    """One row per declared asset: description, owner, tags."""
    rows = []
    for flow in registry.flows.values():
        for layer in ("raw", "work", "silver", "quarantine"):
            tags = ",".join([*flow.tags, flow.entity_type])
            rows.append((registry.runtime.ident(flow.table(layer)), flow.description, flow.owner, tags))
    for t in registry.tables.values():
        for layer in ("raw", "work", "silver"):
            tags = ",".join([*t.tags, *t.glossary_terms])
            rows.append((registry.runtime.ident(f"{layer}.{t.target_name}"), t.description, t.owner, tags))
    for m in registry.models.values():
        rows.append((registry.runtime.ident(m.table), m.description, m.owner, ",".join(m.tags)))
    return spark.createDataFrame(rows, "asset string, description string, owner string, tags string")


# -- rollups ------------------------------------------------------------------
def metric_rollup(records: DataFrame, measures: Sequence[str], section: str) -> DataFrame:
    """Count of the records, and sum and maximum of every measure, in long form."""
    counts = [F.count(F.lit(1)).cast("double").alias("count")]
    names = ["count"]
    for m in measures:
        counts += [F.sum(m).cast("double").alias(f"{m}.sum"), F.max(m).cast("double").alias(f"{m}.max")]
        names += [f"{m}.sum", f"{m}.max"]
    rows = F.array(
        *[F.struct(F.lit(f"{section}.{n}").alias("metric"), F.col(f"`{n}`").alias("value")) for n in names]
    )
    return records.agg(*counts).select(F.inline(rows))


def section_metrics(metrics: DataFrame, sections: Mapping[str, Sequence[str]]) -> DataFrame:
    """Metrics of each section: those whose name contains a declared text."""
    def one(name: str, texts: Sequence[str]) -> DataFrame:
        wanted = reduce(lambda a, b: a | b, [F.col("metric").contains(t) for t in texts])
        return metrics.filter(wanted).select(F.lit(name).alias("section"), "metric", "value")

    return reduce(DataFrame.unionByName, [one(n, t) for n, t in sections.items()])
