"""Runs the declared late-key jobs and records what they did."""

from __future__ import annotations

import time
from collections.abc import Mapping
from typing import Any

from layerflow.config import Registry
from layerflow.operators.reconcile import late_matches, updated_columns
from layerflow.sources.tables import TableStore

STATUS_SCHEMA = (
    "job string, status string, updated_rows bigint, elapsed_seconds double, "
    "fact_table string, lookup_table string, ts_ms bigint"
)


def reconcile(store: TableStore, job: Mapping[str, Any]) -> dict[str, Any]:
    """Fill in late keys of one fact table: success, fact_missing or lookup_missing."""
    started = time.time()
    status = {"job": job["name"], "fact_table": job["fact_table"], "lookup_table": job["lookup_table"],
              "updated_rows": 0, "elapsed_seconds": 0.0, "ts_ms": int(started * 1000)}
    for table, missing in ((job["fact_table"], "fact_missing"), (job["lookup_table"], "lookup_missing")):
        if not store.exists(table):
            return {**status, "status": missing}
    updates = late_matches(store.read(job["fact_table"]), store.read(job["lookup_table"]), job)
    rows = store.update_rows(updates, job["fact_table"], job["fact_key"], updated_columns(job))
    return {**status, "status": "success", "updated_rows": rows, "elapsed_seconds": round(time.time() - started, 3)}


def run_reconciliations(store: TableStore, registry: Registry, names: tuple[str, ...] = ()) -> list[dict[str, Any]]:
    jobs = [j for j in registry.reconciliations if j.get("enabled", True) and (not names or j["name"] in names)]
    results = [reconcile(store, job) for job in jobs]
    table = registry.runtime.ident(f"{registry.runtime.audit_namespace}.reconciliation_metrics")
    for result in results:
        store.record([result], table, STATUS_SCHEMA, f"{result['job']}.{result['ts_ms']}")
    return results
