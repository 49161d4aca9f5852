"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Every query runs over its whole tables; the figure of a
query is the median of its runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from layerflow.queries import QUERIES
from layerflow.sales.views import SalesSource
from layerflow.session import build_session

# Workload queries in both layouts, the KPI models, the event path, the merges.
TIMED = [
    "q_channel_90d", "q_channel_90d_baseline", "q_theta_join", "q_theta_join_baseline",
    "q_gold_category", "q_gold_category_baseline",
    "kpi_daily_revenue_channel", "kpi_product_sales", "gold_daily_revenue", "mart_revenue_gap",
    "snapshot_envelope", "cdc_decode", "final_projection",
    "dq_rule_metrics", "dq_unique", "dedup_latest", "mask_person", "fk_lookup", "latency_percentiles",
    "scd2_history", "scd2_late_changes", "upsert_soft_delete", "reconcile_unknown_fk", "stream_log_to_silver",
]
RUNS = 3

# Input rows of the chain and of the history merge, for rows a second.
ROWS_OF = {"stream_log_to_silver": "src_order", "scd2_late_changes": "customer_changes"}


def timed(query, spark, directory: str) -> float:
    started = time.perf_counter()
    query.run(spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def machine(spark) -> float:
    """Seconds of a fixed job that reads nothing, to compare machines by."""
    spent = []
    for _ in range(RUNS + 1):
        started = time.perf_counter()
        spark.range(100_000_000).selectExpr("sum(xxhash64(id) % 1000)").collect()
        spent.append(time.perf_counter() - started)
    return round(statistics.median(spent[1:]), 3)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    work = tempfile.mkdtemp(prefix="layerflow-bench-")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.sql.warehouse.dir": f"{work}/warehouse",
            "spark.checkpoint.dir": f"{work}/scratch",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    figures: dict[str, float] = {}
    for name in TIMED:
        if wanted and name not in wanted:
            continue
        warm_up = timed(QUERIES[name], spark, directory)
        runs = [timed(QUERIES[name], spark, directory) for _ in range(RUNS)]
        figures[name] = round(statistics.median(runs), 3)
        print(f"{name}: {figures[name]} s (first {warm_up:.2f} s)", file=sys.stderr)
    rates = {
        name: round(SalesSource(spark, directory)[view].count() / figures[name])
        for name, view in ROWS_OF.items()
        if name in figures
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(figures.values()), 3),
                "unit": "sec",
                "queries": figures,
                "rows_per_sec": rates,
                "machine_sec": machine(spark),
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
