"""Wall time of the headline queries: one JSON line on standard output.

Every query runs once to warm up and then BENCH_RUNS times; its median counts. Results are
computed in full and written to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from fitledger.plans import all_queries
from fitledger.session import build_session

HEADLINE = [
    "application_match", "best_match", "match_records", "match_counts", "candidate_join", "unresolved_rows",
    "candidate_cap", "resolver_merge", "engine_tier", "categorize", "gate_issues", "dedupe_rows",
    "baseline_divergence", "route_records", "record_score", "record_diff", "validate_records", "response_ingest",
    "ingest_split", "discover_new", "supersede_mark", "lineage", "baseline_import", "latest_extraction",
    "budget_prefix", "event_timeline", "run_summary", "part_index", "part_search", "cascade", "replace_matches",
    "holdback_roundtrip", "approval_detail", "trajectory_check",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            t0 = time.perf_counter()
            all_queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total median seconds over headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
