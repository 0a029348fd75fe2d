"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query
runs twice to warm up, then three times over its whole result; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from spendloom.session import local_session
from spendloom.verification.queries import QUERIES

HEADLINE = (
    "abcde_tiers",
    "abcde_tiers_blocks",
    "tier_summary",
    "attach_segment",
    "fetch_purchase",
    "purchase_build",
    "order_build",
    "product_build",
    "enrich",
    "year_split",
    "year_metrics",
    "describe",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=8)
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(3)), 3)
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
