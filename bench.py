"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed in full with the ``noop`` sink (every row computed, nothing collected to the driver).
A warm-up run of every headline query on the smallest scale factor first takes JVM start and code generation out
of the per-query numbers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans.catalog import QUERIES  # noqa: E402
from quire.session import get_spark  # noqa: E402

HEADLINE = [
    "k_pages_to_markdown_blocks",   # flagship: pages -> Markdown (C1-C3, D1-D3, K1-K18)
    "c6_serialize",                 # pages -> sanitized HTML
    "c7_subtree_text",              # interval text per element
    "g7_payload_metrics",           # sizes, ratio, savings over the rendered pages
    "b3_entries",                   # both equivalents of HTML payloads (repairs, naming, collapse, tables)
    "b1_route",
    "k21_tsv_markdown",
    "d6_style_audit",
    "f7_stale_check",
    "f8_same_entry",
    "e9_aria_cells",
    "e10_repair_grid",
    "k12_cells_markdown",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # one shuffle partition per core locally (AQE coalesces further); on a cluster the session's own setting rules
    spark = get_spark(f"local[{cpus}]", int(cpus), app="quire-bench",
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):   # JVM / code-generation warm-up on the smallest scale, not part of the timings
        for name in HEADLINE:
            if name in QUERIES:
                QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
