"""Headline queries, timed.  Prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8).
Each query is planned and run to the end into the no-op sink, once to warm up
and once for the record.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from maskframe import session_conf  # noqa: E402
from maskframe.plans.queries import registered  # noqa: E402

HEADLINE = (
    "classify_customers", "classify_counts", "mask_heuristic", "mask_rules",
    "mask_json_cells", "mask_pg_array_cells", "mask_lineitem_days",
    "mask_coerced_orders", "mask_documents", "mask_consistent_join",
    "change_log_rows", "masking_counts", "scan_profile", "scan_findings",
    "scan_type_breakdown", "schema_report", "audit_latest", "audit_rollup",
    "statement_counters", "history_last_60", "active_sessions", "idle_sessions",
    "health_state", "rate_flag", "latency_summary", "rules_first_match",
    "findings_uncovered", "redact_documents", "token_scan_documents",
    "mask_prose_documents", "prose_scan_documents", "rate_token_bucket", "audit_cube",
    "latency_sketch_merge", "scan_bottom_k", "row_counts_footer", "scan_json_paths", "mask_as_of",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("maskframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
    )
    for key, value in session_conf().items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    known = registered()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
