"""Event flows between layers: raw -> work -> silver and quarantine."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from layerflow.config import FlowSpec, Registry
from layerflow.operators.history import HistoryColumns
from layerflow.operators.keys import add_surrogate_key, add_version_columns, resolve_keys
from layerflow.operators.privacy import apply_masks
from layerflow.operators.quality import annotate, enforced_condition, metric_columns, split
from layerflow.operators.shaping import LOG_COLUMNS, derive, final_projection, keep_where, standardize
from layerflow.session import materialize, observed
from layerflow.sources.tables import DAY, TableStore

BATCH = "_meta_micro_batch_id"

# Their dates are the days of the raw and the work tables.
INGESTED, WORKED = "_meta_ingest_ts", "_meta_work_ts"

# Partition column of work and quarantine tables: the run that wrote the rows.
RUN = "_run_id"


def new_run() -> int:
    return int(time.time() * 1000)


def stamp_run(df: DataFrame, run_id: int) -> DataFrame:
    return df.withColumn(RUN, F.lit(int(run_id)).cast("long"))


def stamp_raw(decoded: DataFrame, batch_id: int) -> DataFrame:
    return decoded.withColumns({BATCH: F.lit(int(batch_id)).cast("long"), "_meta_layer": F.lit("raw")})


def raw_to_work(
    raw: DataFrame, flow: FlowSpec, dimensions: Mapping[str, DataFrame] | None = None, now: Column | None = None
) -> DataFrame:
    """Standardize, derive, filter, then surrogate, version and foreign keys."""
    now = F.current_timestamp() if now is None else now
    work = standardize(raw, flow.standard_rules)
    work = keep_where(derive(work, flow.derive), flow.where)
    work = add_version_columns(add_surrogate_key(work, flow), flow, now)
    work = resolve_keys(work, flow, dimensions or {})
    return work.withColumns({"_meta_layer": F.lit("work"), "_meta_work_ts": now})


def check_work(work: DataFrame, flow: FlowSpec, as_of: Column | None = None) -> DataFrame:
    return annotate(work, flow.rules, style="meta", as_of=as_of)


def to_silver(passed: DataFrame, flow: FlowSpec) -> DataFrame:
    masked = apply_masks(passed, flow.masks).withColumn("_meta_layer", F.lit("silver"))
    return final_projection(masked.drop(*LOG_COLUMNS), flow.column_names)


def to_quarantine(failed: DataFrame, flow: FlowSpec) -> DataFrame:
    """Failed rows as they are; masked, and without the raw text, if asked."""
    if flow.mask_quarantine:
        failed = apply_masks(failed, flow.masks).drop("_raw_event_json")
    return failed.withColumn("_meta_layer", F.lit("quarantine"))


def work_to_silver(work: DataFrame, flow: FlowSpec, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    passed, failed = split(check_work(work, flow, as_of), flow.rules, style="meta", enforce=flow.enforce)
    return to_silver(passed, flow), to_quarantine(failed, flow)


def history_of(flow: FlowSpec) -> HistoryColumns:
    return HistoryColumns(
        keys=tuple(flow.natural_key), end=flow.effective_to_column, current=flow.current_column
    )


def write_silver(store: TableStore, silver: DataFrame, flow: FlowSpec, registry: Registry, run_id: int) -> None:
    """Type-2 dimensions get a history merge, other entities an upsert; the rows
    come from files, as those of ``work_to_silver`` do. Rows that
    are only appended are kept by run, so that a repeated run replaces its own."""
    name = registry.runtime.ident(flow.table("silver"))
    sequence = [flow.sequence_column] if flow.sequence_column else []
    if flow.entity_type == "dimension" and flow.is_scd2:
        store.merge_history(
            silver, name, history_of(flow), partition_by=flow.partition_by, on_schema_change=flow.on_schema_change
        )
    elif flow.entity_type in ("dimension", "fact"):
        store.merge_rows(
            silver, name, flow.merge_keys, partition_by=flow.partition_by, sequence=sequence,
            guard=flow.sequence_column, delete_mode=flow.delete_mode, on_schema_change=flow.on_schema_change, stored=True,
        )
    elif (flow.target.get("write_mode") or "append").lower() == "append":
        store.append(stamp_run(silver, run_id), name, batch_column=RUN, on_schema_change=flow.on_schema_change)
    else:
        store.write(
            silver, name, write_mode=flow.target["write_mode"], partition_by=flow.partition_by,
            primary_key=flow.merge_keys, on_schema_change=flow.on_schema_change,
        )


def dimensions_of(store: TableStore, flow: FlowSpec, registry: Registry) -> dict[str, DataFrame]:
    found = {fk["lookup_table"]: store.read_optional(registry.runtime.ident(fk["lookup_table"])) for fk in flow.foreign_keys}
    return {name: df for name, df in found.items() if df is not None}


@dataclass(frozen=True)
class LayerRun:
    """What one layer transition did."""

    flow: str
    run_id: int
    target: str
    metrics: Mapping[str, int]


AUDIT_SCHEMA = "flow_name string, micro_batch_id bigint, target_table string, metric_name string, metric_value double"


def write_metrics(store: TableStore, registry: Registry, run: LayerRun, step: str = "layer") -> None:
    """Audit rows of a transition in long form; a repeated run replaces its own."""
    rows = [
        {"flow_name": run.flow, "micro_batch_id": run.run_id, "target_table": run.target, "metric_name": name if step == "layer" else f"{step}_{name}", "metric_value": value}
        for name, value in run.metrics.items()
    ]
    name = registry.runtime.ident(f"{registry.runtime.audit_namespace}.batch_metrics")
    store.record(rows, name, AUDIT_SCHEMA, f"{run.flow}.{run.run_id}.{step}")


class LayerJobs:
    """Runs single layer transitions of flows against a table store."""

    def __init__(self, store: TableStore, registry: Registry):
        self.store, self.registry = store, registry

    def name(self, flow: FlowSpec, layer: str) -> str:
        return self.registry.runtime.ident(flow.table(layer))

    def write_raw(self, decoded: DataFrame, flow: FlowSpec, batch_id: int) -> None:
        """A repeated micro-batch replaces its own partition."""
        self.store.append(
            stamp_raw(decoded, batch_id), self.name(flow, "raw"), partition_by=INGESTED, batch_column=BATCH, batch=batch_id,
            on_schema_change=flow.on_schema_change,
        )

    def raw_to_work(
        self, flow: FlowSpec, run_id: int | None = None, from_ts: str | None = None, to_ts: str | None = None,
        limit: int | None = None, raw: DataFrame | None = None, audit: bool = True,
    ) -> LayerRun:
        """Work rows of a raw window; repeating a run id replaces its rows."""
        run_id = new_run() if run_id is None else run_id
        target = self.name(flow, "work")
        raw = self.store.read_days(self.name(flow, "raw"), INGESTED, from_ts, to_ts, limit) if raw is None else raw.drop(DAY)
        work = raw_to_work(raw, flow, dimensions_of(self.store, flow, self.registry))
        watch = Observation()
        counted = stamp_run(work, run_id).observe(watch, F.count(F.lit(1)).alias("work_rows"))
        self.store.append(
            counted, target, partition_by=WORKED, batch_column=RUN, batch=run_id, on_schema_change=flow.on_schema_change
        )
        run = LayerRun(flow.name, run_id, target, observed(watch, ["work_rows"]))
        if not run.metrics["work_rows"]:
            self.store.drop_batch(target, RUN, run_id)  # what an earlier try left
        if audit:
            write_metrics(self.store, self.registry, run, "raw_to_work")
        return run

    def work_to_silver(
        self, flow: FlowSpec, run_id: int | None = None, from_ts: str | None = None, to_ts: str | None = None,
        limit: int | None = None, work: DataFrame | None = None, audit: bool = True,
    ) -> LayerRun:
        """Check once, write the checked rows once, then silver and quarantine.

        Every count comes from the single pass that writes the checked rows. They
        keep the columns of the log only where they fail, as silver has none.
        """
        run_id = new_run() if run_id is None else run_id
        target = self.name(flow, "silver")
        work = self.store.read_days(self.name(flow, "work"), WORKED, from_ts, to_ts, limit) if work is None else work.drop(DAY)
        watch = Observation()
        counts = metric_columns(flow.rules, style="meta", enforce=flow.enforce)
        checked = check_work(work, flow).observe(watch, *[c.alias(n) for n, c in counts.items()])
        good = enforced_condition(flow.rules, style="meta", enforce=flow.enforce)
        of_log = {c: F.when(~good, F.col(c)) for c in LOG_COLUMNS if c in checked.columns}
        checked = materialize(checked.withColumns(of_log), "checked")
        found = observed(watch, counts)
        passed, failed = split(checked, flow.rules, style="meta", enforce=flow.enforce)
        if found["failed_rows"]:
            self.store.append(
                stamp_run(to_quarantine(failed, flow), run_id), self.name(flow, "quarantine"), batch_column=RUN
            )
        else:
            self.store.drop_batch(self.name(flow, "quarantine"), RUN, run_id)
        if found["passed_rows"]:
            write_silver(self.store, to_silver(passed, flow), flow, self.registry, run_id)
        metrics = {
            "input_rows": found["total_rows"],
            "silver_rows": found["passed_rows"],
            "quarantine_rows": found["failed_rows"],
            **{f"dq_failed_{r['rule_id']}": found[f"failed_{r['rule_id']}"] for r in flow.rules},
        }
        run = LayerRun(flow.name, run_id, target, metrics)
        if audit:
            write_metrics(self.store, self.registry, run)
        return run

    def raw_to_silver(
        self, flow: FlowSpec, run_id: int | None = None, from_ts: str | None = None, to_ts: str | None = None,
        limit: int | None = None, raw: DataFrame | None = None,
    ) -> tuple[LayerRun, LayerRun]:
        """Both transitions; the second one reads what the first one wrote."""
        run_id = new_run() if run_id is None else run_id
        first = self.raw_to_work(flow, run_id, from_ts, to_ts, limit, raw)
        written = self.store.read(first.target).filter(F.col(RUN) == int(run_id))
        return first, self.work_to_silver(flow, run_id, work=written)
