"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyline.plans.registry import callables  # noqa: E402
from tallyline.session import local_session  # noqa: E402

HEADLINE = (
    "kpi_cards", "dashboard_summary", "report_group_health", "val_control_equations", "val_transformed_failed",
    "val_report_generation", "batch_bridge_candidates", "bridge_by_group", "txn_bridge_candidates",
    "missed_definition_candidates", "locate_recon_detail", "txn_root_cause", "evidence_tabs", "stage_status",
    "open_backlog_aging", "group_breakdown", "report_lag", "soft_dedup", "build_batch_reconciliation",
    "grade_cases", "threshold_structuring", "guarded_transitions", "assemble_stream", "route_documents",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    plans = callables()
    runs = int(os.environ.get("BENCH_RUNS", "1"))

    def run(name: str) -> float:
        start = time.perf_counter()
        plans[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # Start-up, the first read and the first compilation of each query are not part of its time; of several runs the median counts.
    for name in HEADLINE:
        run(name)
    times = {name: round(median(run(name) for _ in range(runs)), 3) for name in HEADLINE}
    total = round(sum(times.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
