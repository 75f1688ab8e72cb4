"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query is run to completion into a sink that drops the rows: once to warm up,
then three times, of which the median counts.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from siftwork.plans import catalog
from siftwork.session import local_session

HEADLINE = [
    "search_bm25_top20", "search_publisher_diversity", "facet_set_documents", "document_frequency", "quotes_grounded", "exact_duplicates",
    "noisy_or_edges", "similar_to_one", "related_two_hops", "activity_trend", "failure_streaks", "source_health", "versioned_upsert", "pricing_summary", "left_join_top8",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cores, partitions=cores, memory=os.environ.get("BENCH_MEMORY", "8g"))
    known, took = catalog.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            t = time.time()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
        took[name] = round(median(times[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cores}))


if __name__ == "__main__":
    main()
