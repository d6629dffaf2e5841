"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and
``BENCH_CPUS`` (default: all cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

from reviewmill.plans import QUERIES
from reviewmill.session import build_session

HEADLINE = [
    "prepare_reviews", "prepare_report", "column_profile", "quality_controls", "vocabulary_summary", "word_counts",
    "bigram_counts", "word_contrast", "pattern_rates", "duplicates_by_platform", "monthly_pivot",
    "reconcile_counts", "raw_asof", "parse_feed_pages", "ordered_digest",
    "unique_texts", "encode_reviews", "knn_top5", "quantise_int8", "silhouette",
    "class_bow", "topic_keywords", "representative_reviews", "topic_sentiment", "classify_sentiment",
    "mart_topics", "density_clusters", "classification_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", spark__sql__shuffle__partitions=str(cpus), spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["platform_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
