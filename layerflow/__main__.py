"""Command line: ``spark-submit`` or ``python -m layerflow <job> --config file``."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from layerflow.config import chosen, load_registry, summary
from layerflow.plans.layers import LayerJobs
from layerflow.plans.models import run_models
from layerflow.plans.publish import enabled_sources, publish
from layerflow.plans.reconciliation import run_reconciliations
from layerflow.plans.tables import TableJobs
from layerflow.session import build_session
from layerflow.sources.tables import TableStore
from layerflow.streaming.flows import FlowStreams

LAYER_JOBS = ("raw-to-work", "work-to-silver", "raw-to-silver")
JOBS = ("summary", "tables", *LAYER_JOBS, "stream", "models", "publish", "reconcile")


def _names(text: str) -> tuple[str, ...]:
    return tuple(part.strip() for part in text.split(",") if part.strip())


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="layerflow")
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("--config", required=True)
    parser.add_argument("--names", type=_names, default=(), help="flows, tables, models or jobs; default all enabled")
    parser.add_argument("--layers", type=_names, default=(), help="model layers")
    parser.add_argument("--stages", type=_names, default=(), help="table stages")
    parser.add_argument("--location", default=None, help="root directory of the tables")
    parser.add_argument("--run-id", default=None)
    parser.add_argument("--from-ts", default=None)
    parser.add_argument("--to-ts", default=None)
    parser.add_argument("--limit", type=int, default=None)
    parser.add_argument("--style", choices=("raw_only", "full"), default="raw_only")
    parser.add_argument("--once", action="store_true", help="drain the stream and stop")
    parser.add_argument("--sink", default=None, help="connection name events are published to")
    parser.add_argument("--dry-run", action="store_true")
    return parser


def run(args: argparse.Namespace):
    registry = load_registry(args.config)
    if args.job == "summary":
        return summary(registry)
    spark = build_session(f"layerflow-{args.job}")
    store = TableStore(spark, args.location)
    if args.job == "tables":
        return TableJobs(store, registry).run_tables(chosen(registry.tables, args.names), args.stages or None, args.run_id)
    if args.job == "models":
        runs = run_models(store, chosen(registry.models, args.names, args.layers), registry, args.run_id)
        return [asdict(r) for r in runs]
    if args.job == "reconcile":
        return run_reconciliations(store, registry, args.names)
    if args.job == "publish":
        sources = enabled_sources(registry, args.names)
        return [
            publish(
                spark, registry, job, registry.connections[args.sink or job["event"]["connection"]],
                run_id=args.run_id, from_ts=args.from_ts, to_ts=args.to_ts, dry_run=args.dry_run,
            )
            for job in sources
        ]
    flows = chosen(registry.flows, args.names)
    if args.job == "stream":
        return FlowStreams(spark, registry, args.location).start_all(flows, style=args.style, once=args.once)
    jobs = LayerJobs(store, registry)
    run_id = int(args.run_id) if args.run_id else None
    step = getattr(jobs, args.job.replace("-", "_"))
    return [str(step(flow, run_id, args.from_ts, args.to_ts, args.limit)) for flow in flows]


def main() -> None:
    print(json.dumps(run(arguments().parse_args()), indent=2, default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
