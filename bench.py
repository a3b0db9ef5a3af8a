"""Benchmark the headline queries and print one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1),
    BENCH_ONLY (optional comma-separated subset of query names)

Each query is executed in full with the ``noop`` sink (no collection to the driver) after one
warm-up run of a small query; the reported value is the sum of the per-query medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shiftlens.plans import registered as rq  # noqa: E402
from shiftlens.session import get_spark  # noqa: E402

HEADLINE = {
    "a15_investigate_order_count": rq.q_investigate("order_count"),
    "a15_investigate_planted_duplicates": rq.q_investigate("item_revenue", planted_dup=True),
    "a10_candidates_large_item_rate": rq.q_candidates("large_item_rate"),
    "m8_by_dimension_revenue": rq.q_by_dimension("revenue"),
    "r10_search": rq.q_search,
    "r7_bm25_top10": rq.q_bm25_top,
    "a16_anomaly_scores": rq.q_anomaly_scores,
    "g3_unsupported_numbers": rq.q_unsupported_numbers,
    "u8_verify_audit_tampered": rq.q_audit_verify,
    "q2_top_brands": rq.q_top_brands,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus * 2)
    rq.q_top_brands(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    times = {}
    for name, fn in HEADLINE.items():
        if only and name not in only:
            continue
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
