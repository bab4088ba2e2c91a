"""Headline queries, timed warm: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

# What a user of the workbench waits for: reading a benchmark, pairing, verifying, scoring, reports.
HEADLINE = (
    "entry_clip_to_auc",
    "p01_where_filter",
    "s01_jsonl_scan",
    "r02_carve_72_14_14",
    "k04_benchmark_draw",
    "j02_index_with_reasons",
    "j03_verify_counts",
    "j06_fake_real_pairs",
    "w02_latest_outcome",
    "r13_batch_scoring",
    "a06_median",
    "a20_all_metrics_by_group",
    "a16_ece_adaptive",
    "a19_aurc",
    "a21_auc_bootstrap_ci",
    "a25_breakdown_by_method",
    "a30_fingerprint",
    "a37_delong",
    "a41_platt_fit",
)


def main() -> None:
    from scoreloom.plans.all_queries import QUERIES
    from scoreloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    took: dict[str, float] = {}
    for name in names:
        for _ in range(2):  # the second run is the one that counts: classes loaded, plans compiled
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
