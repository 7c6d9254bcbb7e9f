"""Headline jobs and queries, timed once each after a warm-up; prints one JSON line.

Queries are written to a sink that discards rows, so every column of every row is
computed. Jobs include reading, checking and writing their output files.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from contractflow.checks.queries import QUERIES  # noqa: E402
from contractflow.model import MANUFACTURING, SALES  # noqa: E402
from contractflow.operators import audit, cdc  # noqa: E402
from contractflow.plans import batch, changes  # noqa: E402
from contractflow.session import build_session, scratch_path  # noqa: E402
from contractflow.sources import views  # noqa: E402
from contractflow.sources.files import Storage  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "status_counts", "contract_violations", "policy_coerce", "normalize_changes", "dedup_first_wins", "dedup_counts",
    "envelope", "quarantine_rows", "audit_log", "microbatch_telemetry", "stream_events", "kafka_decode",
    "cdc_feed", "cdc_trigger_based", "cdc_op_counts", "profile_numeric", "profile_categorical", "synth_sales",
    "synth_warehouse", "batch_summary", "low_stock_alerts",
)


def discard(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]", "contractflow-bench",
        spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, action):
        started = time.perf_counter()
        result = action()
        seconds[name] = round(time.perf_counter() - started, 3)
        return result

    discard(QUERIES["status_counts"](spark, FOLDER))  # warm-up
    for name in HEADLINE:
        timed(name, lambda: discard(QUERIES[name](spark, FOLDER)))

    storage = Storage(scratch_path(spark, "bench"))
    sales, made = views.sales(spark, FOLDER), views.manufacturing(spark, FOLDER)
    rows = sales.count()
    report = timed("job_ingest_sales", lambda: batch.ingest(sales, SALES, storage))
    timed("job_ingest_manufacturing", lambda: batch.ingest(made, MANUFACTURING, storage))
    timed("job_microbatch_3x200", lambda: batch.ingest_slices(
        views.sales(spark, FOLDER, first=600), SALES, storage, 200, 3).collect())
    timed("job_microbatch_3x200_manufacturing", lambda: batch.ingest_slices(
        made.where("_row <= 600"), MANUFACTURING, storage, 200, 3).collect())
    timed("job_storage_audit", lambda: audit.storage_audit(spark, storage.areas()).collect())
    feed = cdc.change_feed(sales, sales, SALES, "2026-04-05T00:00:00+00:00", 5000.0, "burst", existing_count=rows)
    timed("job_write_change_log", lambda: changes.write_change_log(feed, storage, SALES, "burst"))
    timed("job_extract_log", lambda: changes.extract_by_log(spark, storage, SALES, "burst"))
    timed("job_extract_trigger", lambda: changes.extract_by_trigger(spark, storage, SALES, "burst"))
    timed("job_extract_timestamp", lambda: changes.extract_by_timestamp(spark, storage, SALES, "burst"))

    print(json.dumps({
        "metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "sales_rows": rows,
        "batch_load_rows_per_sec": round(rows / seconds["job_ingest_sales"]),
        "batch_load_accepted": report.records_ingested,
        "change_log_rows_per_sec": round(rows / seconds["job_write_change_log"]),
        "log_extraction_rows_per_sec": round(rows / seconds["job_extract_log"]),
    }))


if __name__ == "__main__":
    main()
