"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice; the second (warm) time counts, both are reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradeloom.catalog import QUERIES  # noqa: E402
from gradeloom.session import build_session  # noqa: E402

HEADLINE = [
    "p01_flagship", "p01_build_corpus", "d01_exact_survivors", "d03_near_duplicate_labels", "d04_components",
    "x30_signals", "x02_norm_key", "x48_page_blocks", "f01_quality_filter", "a09_source_report", "a15_metrics_by_cut",
    "a14_ladder_accuracy", "a17_percentiles", "j03_resolve_prompt", "j06_leave_group_out", "w02_marker_segments",
    "w03_section_records", "w06_prompt_spread", "w08_best_grader", "q06_leakage", "i05_parsed_reviews",
    "p06_review_batch", "r01_harvest", "r02_ceiling_breaches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = build_session(cpus, "bench", shuffle_partitions=int(cpus) if cpus.isdigit() else None)

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    cold, warm = {}, {}
    for name in only:
        cold[name] = once(name)
        warm[name] = once(name)
        print(f"{name} cold {cold[name]} warm {warm[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total_warm", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "cold": cold, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
