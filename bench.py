"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR``, ``BENCH_CPUS`` and ``BENCH_RUNS``; each query runs once
to warm up and then ``BENCH_RUNS`` times, of which the median counts.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from platenlog.plans.reports import REPORTS
from platenlog.plans.session import build_session

HEADLINE = [
    "request_rollup",
    "job_registry",
    "job_lookup",
    "attribute_query",
    "first_value",
    "grouped_values",
    "newest_page",
    "page_numbers",
    "decode_roundtrip",
    "exploded_attributes",
    "reject_rollup",
    "judged_messages",
    "presence_intervals",
]
STREAMED = ["stream_registry", "stream_presence"]


def run(query, spark, sf_dir: str) -> float:
    begun = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = build_session(f"local[{cpus}]", "bench", cpus, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE + STREAMED:
        query = REPORTS[name]
        repeats = runs if name in HEADLINE else 1
        if repeats > 1:
            run(query, spark, sf_dir)
        took[name] = round(statistics.median(run(query, spark, sf_dir) for _ in range(repeats)), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
