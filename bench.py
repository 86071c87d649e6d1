"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query runs once to warm up and once for the record, writing its rows to the no-op sink.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from nearname.plans.queries import REGISTRY
from nearname.session import local_session

HEADLINE = [
    "ingest_parse",
    "ingest_rr",
    "export_roundtrip",
    "typo_candidates_of_hosts",
    "fuzzy_osa",
    "fuzzy_keyboard",
    "fuzzy_site_assign",
    "extract_typo_lookups",
    "ttl_suppressed",
    "pairs_v1",
    "pairs_status",
    "pair_ratio",
    "exists_by_rules",
    "typo_stats",
    "summary_by_exists",
    "transition_scores",
    "tld_cached_check",
    "consecutive_gap",
    "kmeans_fixed_passes",
    "stream_ingest_by_site",
    "stream_pairs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        for _ in range(2):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
