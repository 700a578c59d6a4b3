"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import catalog
from tidemark.session import local_session

HEADLINE = (
    "g1_downstream_all_boards",
    "g2_staleness_cascade",
    "g3_merged_marks",
    "g7_reach_within_hops",
    "g13_rerun_waves",
    "f4_content_fingerprint",
    "f9_fingerprint_all_tables",
    "c1_compare_fingerprints",
    "o2_resolve_verdicts",
    "o8_fold_completion",
    "o10_restored",
    "a3_a8_validate_attestations",
    "e12_attested_fixpoint",
    "e18_summary",
    "s7_ledger_append",
    "s8_ledger_prefix",
    "t8_trace_passes",
    "p7_labeled_trips",
    "p14_p15_borough_weeks",
    "p19_revenue_overview",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": sf_dir}))


if __name__ == "__main__":
    main()
