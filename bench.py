"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "page_quality_triage", "page_verdicts", "marker_page_classes", "role_headings",
    "labelled_document_number", "collapse_blank_rows", "amount_extract", "id_check_digit",
    "legal_rate_pairs", "identity_findings", "distrust_confidence", "canonical_strings",
    "resolve_parties", "names_agree", "payee_from_id", "assemble_bills", "certificate_link",
    "card_asof_attach", "slip_unique_match", "orphan_fill", "consecutive_runs", "merge_spanning",
    "merge_pairwise", "ticket_parse", "ticket_sum", "evidence_tags", "span_invariants",
    "response_nest", "contract_validate", "field_match", "calibration_bands",
    "accuracy_grouping_sets", "run_compare", "level_summary", "best_reading", "reconcile_bills",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("docrecon-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        # Small tables with costly rows: keep all cores busy after a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from docrecon.catalog import QUERIES

    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        # The noop sink computes every row and column and moves none to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
