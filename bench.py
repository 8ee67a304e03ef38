"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every query runs to completion over all its rows
into a sink that discards them; an eager step inside a query (a written table) counts towards its time. Each query
runs twice and the better time counts; the first one is mostly the JVM compiling that query's code, and its sum is
reported beside.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from catalog import QUERIES
from faultline.session import local_session

HEADLINE = [
    "work_queue",
    "queue_top10",
    "score_breakdown",
    "queue_export",
    "bridge_export",
    "forced_route",
    "gate_confusion",
    "gate_by_dataset",
    "worst_level",
    "predicted_ordinal",
    "grading_matrix",
    "grading_rates",
    "qwk",
    "surge_counts",
    "level_counts_by_run",
    "run_summary",
    "cost_by_stage",
    "ops_median",
    "run_metrics",
    "review_agreement",
    "review_timeline",
    "review_replay",
    "review_state",
    "requeue_after_review",
    "tile_targets",
    "model_size",
    "resume_ungated",
    "resume_ungraded",
    "exemplars_rr",
    "stratified_sample",
    "quota_sample",
    "contract_violations",
    "rubric_audit",
    "bootstrap_gate",
    "bootstrap_grading",
    "batch_score_gate",
    "batch_score_grade",
    "batch_run",
    "stream_incremental_gate",
    "stream_cost_hourly",
]


def seconds_for(spark: SparkSession, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    first, best = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        first[name] = seconds_for(spark, name, sf_dir)
        best[name] = min(first[name], seconds_for(spark, name, sf_dir))
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "first_run_value": round(sum(first.values()), 3),
            }
        )
    )


if __name__ == "__main__":
    main()
