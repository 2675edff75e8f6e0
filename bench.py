"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Each query runs once to warm up and then
``BENCH_RUNS`` times; the median counts. Every run builds the plan anew and writes all rows to the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tagloom.session import local_session
from workload.queries import REGISTRY

HEADLINE = [
    "tag_status_flow", "message_route", "readiness", "retry_accounting", "run_windowed_tags", "readiness_stream",
    "readiness_rounds", "dependency_resolve", "message_normalise", "schedule_batches", "messages_ignored",
    "unfinished_report", "tag_coverage", "finish_message", "dict_replace", "dict_json_validate", "run_ready_tags",
]


def once(spark, sf: str, name: str) -> float:
    began = time.perf_counter()
    REGISTRY[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    timings = {}
    for name in names:
        once(spark, sf, name)
        timings[name] = round(statistics.median(once(spark, sf, name) for _ in range(runs)), 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cores": cores, "runs": runs,
    }))


if __name__ == "__main__":
    main()
