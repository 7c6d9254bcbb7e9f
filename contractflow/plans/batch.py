"""Batch jobs: full load, row-count slices and pushed records.

The judged rows are written once to a staging table split by status. The three
sinks then read only their own split, so the scan, the deduplication and the
contract run once, and nothing depends on one executor's memory or disk.
"""

from __future__ import annotations

import logging
import time
from dataclasses import replace
from datetime import datetime, timezone

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from contractflow.model import CONTRACTS, DEDUP_KEYS, LEGACY, SOURCES, WEATHER, DataContract, OperationType, dataset_for
from contractflow.operators import audit, contracts, dedup, envelope, rows, telemetry
from contractflow.operators.normalize import CHANGE_COUNT, CHANGES, normalize
from contractflow.session import scratch_path
from contractflow.sources.files import (
    CODEC, FILE, LoadError, Storage, data_files, landed_payloads, number_splits, read_source_csv, remove)

log = logging.getLogger(__name__)

#: Contract of legacy rows after migration, when the old column name is gone.
MIGRATED_LEGACY = replace(
    CONTRACTS[LEGACY],
    required_fields=("product_id", "historical_period", "total_monthly_sales"),
    fields=tuple(replace(f, name="product_id") if f.name == "old_product_code" else f
                 for f in CONTRACTS[LEGACY].fields),
)


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


def contract_for(source_id: str, compat: bool = False) -> DataContract | None:
    """The contract of a batch source.

    ``compat`` keeps the registered legacy contract, whose required old column
    never survives migration, so that every good legacy row is COERCED.
    """
    if source_id == LEGACY and not compat:
        return MIGRATED_LEGACY
    return CONTRACTS.get(source_id)


def first_wins_key(df: DataFrame, source_id: str, compat: bool = False) -> Column | None:
    """The dedup key after normalization, NULL where a row has none.

    Legacy rows lose their key column in migration. ``compat`` then falls back to
    the product alone, which keeps one period per product; otherwise product and
    period form the key.
    """
    name = DEDUP_KEYS.get(source_id)
    if name is None:
        return None
    if source_id == LEGACY and not compat:
        return F.when(
            F.col("product_id").isNotNull(),
            F.concat_ws("\u0001", "product_id", F.coalesce("historical_period", F.lit(""))))
    return dedup.dedup_key(df, name)


def prepare(df: DataFrame, source_id: str) -> DataFrame:
    """The audit key as the row arrived, then normalization."""
    if rows.ROW not in df.columns and DEDUP_KEYS.get(source_id) not in df.columns:
        raise ValueError(f"Rows of {source_id} need row numbers or their key column.")
    return normalize(df.withColumn(audit.KEY, audit.record_key(df, DEDUP_KEYS.get(source_id))), source_id)


def _require_order(df: DataFrame, key: Column | None, identity: list[str] | None) -> None:
    if key is not None and not identity and rows.ROW not in df.columns:
        raise ValueError(
            "First-wins needs a row order: scan with row numbers, number the rows by an order, or pass identity columns.")


def judge(
    df: DataFrame,
    source_id: str,
    compat: bool = False,
    contract: DataContract | None = None,
    identity: list[str] | None = None,
    within: tuple[str, ...] = (),
    typed_per_value: tuple[str, ...] = (),
) -> DataFrame:
    """Normalize, flag duplicates, check the contract: one row out per row in.

    Rows carry ``_row`` numbers, or ``identity`` names the columns that identify
    and order them.
    """
    normal = prepare(df, source_id)
    key = first_wins_key(normal, source_id, compat)
    _require_order(normal, key, identity)
    if key is None:
        marked = normal
    elif identity in (None, [rows.ROW]):
        # Rows cross the shuffle as they arrived: normalization adds texts that are several times as long.
        known = dedup.with_first(df, dedup.first_rows(normal, key, [rows.ROW], list(within)), [rows.ROW])
        marked = dedup.flag_duplicates(prepare(known, source_id), key)
    else:
        marked = dedup.mark_duplicates(normal, key, identity, within)
    return contracts.apply_contract(
        marked, contract or contract_for(source_id, compat), typed_per_value,
        dedup.DUP if key is not None else None)


def judge_survivors(
    df: DataFrame,
    source_id: str,
    compat: bool = False,
    contract: DataContract | None = None,
    identity: list[str] | None = None,
    within: tuple[str, ...] = (),
    typed_per_value: tuple[str, ...] = (),
) -> DataFrame:
    """As ``judge`` but without the duplicate rows, which saves a join."""
    normal = prepare(df, source_id)
    key = first_wins_key(normal, source_id, compat)
    _require_order(normal, key, identity)
    kept = dedup.keep_first(normal, key, identity, within) if key is not None else normal
    return contracts.apply_contract(kept, contract or contract_for(source_id, compat), typed_per_value)


# -- the three outputs ---------------------------------------------------------------

_PRIVATE = {rows.ROW, rows.BATCH, "_slice_row", audit.KEY, CHANGES, CHANGE_COUNT, dedup.DUP}


def payload_of(judged: DataFrame) -> list[str]:
    return [n for n in judged.columns if n not in _PRIVATE and not n.startswith("_")]


def good_rows(
    judged: DataFrame, source_id: str, ingested_at: str, identity: tuple[str, ...] = (audit.KEY, rows.ROW),
    operation: OperationType = OperationType.SNAPSHOT, also: tuple[str, ...] = (),
) -> DataFrame:
    """Accepted rows in their envelope."""
    names = payload_of(judged)
    accepted = judged.where(F.col(contracts.STATUS).isin(*contracts.ACCEPTED))
    meta = envelope.lineage(
        source_id, dataset_for(source_id), [F.col(n) for n in identity], operation,
        envelope.event_time(names), envelope.source_time(names), ingested_at)
    payload = [*contracts.accepted_payload(judged, names), *[F.col(n) for n in also]]
    return envelope.wrap(accepted, meta, payload)


def quarantine_rows(judged: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Quarantined rows as normalized, not coerced and not enveloped, with their reasons."""
    return judged.where(F.col(contracts.STATUS) == contracts.QUARANTINE).select(
        *[F.col(f"`{n}`") for n in payload_of(judged)],
        *also,
        F.to_json(contracts.VIOLATIONS).alias("_violations"),
        F.array_join(contracts.VIOLATIONS, "; ").alias("_quarantine_reason"),
    )


# -- jobs -------------------------------------------------------------------------------

def stage(judged: DataFrame, path: str, keep_changes: bool = False) -> tuple[DataFrame, dict]:
    """Write the judged rows once below ``path``, split by status, and return the table with its counters.

    The change messages are only made and kept where the record lines need them.
    """
    spark = judged.sparkSession
    watch = Observation()
    latency = telemetry.latency_seconds(envelope.event_time(payload_of(judged)), utc_now())
    counted = telemetry.observed(judged, watch, latency_seconds=latency, changes=CHANGE_COUNT)
    kept = counted if keep_changes else counted.drop(CHANGES)
    kept.write.option("compression", CODEC).partitionBy(contracts.STATUS).parquet(path)
    return spark.read.schema(kept.schema).parquet(path), watch.get


def job_report(job_id: str, source_id: str, started: float, counts: dict) -> telemetry.JobReport:
    ended = time.time()
    def iso(moment: float) -> str:
        return datetime.fromtimestamp(moment, timezone.utc).isoformat()
    return telemetry.JobReport(job_id, source_id, iso(started), iso(ended), ended - started, **counts)


def ingest(
    df: DataFrame, source_id: str, storage: Storage, suffix: str = "", compat: bool = False,
    typed_per_value: tuple[str, ...] = (), identity: list[str] | None = None, record_lines: bool = False, part: str = "",
) -> telemetry.JobReport:
    """Run one source through to its sinks. A sink without rows is not written, and what an earlier run left there goes.

    ``record_lines`` also writes the readable log line of every row. With ``part``
    the run owns that folder of each sink and leaves the rest as it is.
    """
    spark, started = df.sparkSession, time.time()
    job_id, done = f"job_{source_id}_{int(started)}", {}
    path = scratch_path(spark, "judged")
    try:
        judged = judge(df, source_id, compat, identity=identity, typed_per_value=typed_per_value)
        staged, counts = stage(judged, path, record_lines)
        marker = tuple(identity or [rows.ROW])
        target = storage.good(source_id, suffix) + part
        _replace(
            good_rows(staged, source_id, utc_now(), (audit.KEY, *marker)), target, counts["records_ingested"])
        done |= {n: counts[n] for n in ("records_ingested", "records_coerced", "avg_ingestion_latency_sec")}
        _replace(quarantine_rows(staged), storage.quarantine(source_id, suffix) + part, counts["records_quarantined"])
        done["records_quarantined"] = counts["records_quarantined"]
        audit.audit_rows(staged).write.mode("overwrite").option("compression", "gzip").json(storage.audit(source_id, suffix) + part)
        if record_lines:
            lines = audit.record_lines(
                staged, source_id, contract_for(source_id, compat), changes_shown=None, violations_shown=None)
            lines.select("line").write.mode("overwrite").text(storage.record_lines(source_id, suffix) + part)
        report = job_report(job_id, source_id, started, counts)
        if counts["records_ingested"]:
            report.file_count_per_partition, report.snapshot_count = data_files(spark, target), 1
        return report
    except (PySparkException, Py4JError) as error:
        raise JobFailed(job_report(job_id, source_id, started, done | {"records_failed": 1})) from error
    finally:
        remove(spark, path)


class JobFailed(Exception):
    """A job that ended early; ``report`` has what its finished sinks hold, and one failure."""

    def __init__(self, report: telemetry.JobReport):
        super().__init__(report.job_id)
        self.report = report


def _replace(frame: DataFrame, path: str, count: int) -> None:
    """Write the rows of this run, or leave nothing of an earlier one where there are none."""
    if count:
        frame.write.mode("overwrite").option("compression", CODEC).parquet(path)
    else:
        remove(frame.sparkSession, path)


def failed_load(source_id: str) -> telemetry.JobReport:
    """The report of a job whose source could not be read."""
    now = utc_now()
    return telemetry.JobReport(f"job_{source_id}_{int(time.time())}", source_id, now, now, 0.0, records_failed=1)


def ingest_csv(
    spark: SparkSession, path: str, source_id: str, storage: Storage, suffix: str = "", compat: bool = False,
) -> telemetry.JobReport:
    """Ingest one CSV source; a file that cannot be opened is one failure and no more.

    What fails later, while rows are read or sinks are written, raises ``JobFailed``.
    """
    try:
        raw = read_source_csv(spark, path, source_id)
    except LoadError as error:
        log.error("%s could not be ingested from %s: %s", source_id, path, error)
        return failed_load(source_id)
    return ingest(raw, source_id, storage, suffix, compat, SOURCES[source_id].numeric_fields())


def ingest_landed(
    spark: SparkSession, folder: str, storage: Storage, most_files: int = 10_000,
) -> list[telemetry.JobReport]:
    """Ingest the weather responses that landed since the last run: one job for each batch of files.

    The stream's checkpoint is the ledger of files, so each is taken once. Each batch
    owns a folder ``landed=<number>`` of every sink, so a batch that is repeated
    after a failure replaces itself. A batch that fails is reported with one
    failure, ends the run, and is tried again by the next.
    """
    reports: list[telemetry.JobReport] = []

    def take(batch: DataFrame, number: int) -> None:
        numbered = number_splits(batch).drop("_start")
        try:
            reports.append(ingest(numbered, WEATHER, storage, identity=[FILE, rows.ROW], part=f"/landed={number}"))
        except JobFailed as failure:
            reports.append(failure.report)
            raise

    try:
        payloads = landed_payloads(spark, folder, most_files)
    except LoadError as error:
        log.error("%s could not be ingested from %s: %s", WEATHER, folder, error)
        return [failed_load(WEATHER)]
    try:
        (payloads.writeStream.foreachBatch(take).option("checkpointLocation", storage.landed(WEATHER))
         .trigger(availableNow=True).start().awaitTermination())
    except StreamingQueryException as error:
        log.error("%s failed: %s", WEATHER, error)
        if not any(r.records_failed for r in reports):
            reports.append(failed_load(WEATHER))
    return reports


def ingest_all(
    spark: SparkSession, paths: dict[str, str], storage: Storage, compat: bool = False,
) -> DataFrame:
    """Full load of several CSV sources and of the folder of landed weather responses.

    The telemetry rows are appended and returned.

    A source whose file is not there is left out; one that is there but cannot be
    read gets a row with one failure. A job that fails on the way does not stop the
    others: its row counts one failure and what its finished sinks hold.
    """
    reports = []
    for source_id, path in paths.items():
        if not audit.path_exists(spark, path):
            continue
        if source_id == WEATHER:
            reports += ingest_landed(spark, path, storage)
            continue
        try:
            reports.append(ingest_csv(spark, path, source_id, storage, compat=compat))
        except JobFailed as failure:
            log.error("%s failed: %s", source_id, failure.__cause__)
            reports.append(failure.report)
    table = telemetry.telemetry_table(spark, reports)
    table.write.mode("append").parquet(storage.telemetry())
    return table


def ingest_slices(
    df: DataFrame, source_id: str, storage: Storage, batch_size: int = 500, max_batches: int | None = None,
    typed_per_value: tuple[str, ...] = (),
) -> DataFrame:
    """Ingest in row-count slices, all in one pass; returns one telemetry row per slice.

    Every slice forgets the keys of the others, so a key may pass once per slice.
    The slice number is a column of the outputs: the number of files depends on the
    tasks and not on the slices. ``max_batches`` stops after the first slices.
    """
    started = time.time()
    sliced = rows.with_slices(df, batch_size, max_batches)
    judged = judge(sliced, source_id, within=(rows.BATCH,), typed_per_value=typed_per_value)
    staged, _ = stage(judged, scratch_path(df.sparkSession, "judged"))  # the telemetry returned reads it too
    also = (rows.BATCH,)
    good_rows(staged, source_id, utc_now(), also=also).write.mode("overwrite").parquet(storage.micro_batch(source_id))
    quarantine_rows(staged, also=also).write.mode("overwrite").parquet(storage.quarantine(source_id, "microbatch"))
    (audit.audit_rows(staged, row="_slice_row", also=also)
     .write.mode("overwrite").option("compression", "gzip").json(storage.audit(source_id, "microbatch")))
    return slice_telemetry(staged, source_id, time.time() - started)


def slice_telemetry(judged: DataFrame, source_id: str, seconds: float | None = None) -> DataFrame:
    """Counters per slice. All slices share one pass, so they share its wall time."""
    per_slice = telemetry.job_counters(judged, by=[rows.BATCH], changes=CHANGE_COUNT)
    named = per_slice.withColumn("source_id", F.lit(source_id))
    return named if seconds is None else named.withColumn("duration_seconds", F.lit(round(seconds, 4)))


def push_records(df: DataFrame, source_id: str) -> DataFrame:
    """Pushed records checked by the contract only: no normalization, dedup or envelope."""
    return contracts.apply_contract(df, contracts.contract_of(source_id))


def accepted_records(judged: DataFrame) -> DataFrame:
    accepted = judged.where(F.col(contracts.STATUS).isin(*contracts.ACCEPTED))
    return accepted.select(*contracts.accepted_payload(judged, payload_of(judged)))


def push_ingest(df: DataFrame, source_id: str, storage: Storage) -> telemetry.JobReport:
    """Append accepted pushed records to the dataset and count the rest."""
    started = time.time()
    watch = Observation()
    counted = telemetry.observed(push_records(df, source_id), watch)
    accepted_records(counted).write.mode("append").parquet(storage.good(source_id, "pushed"))
    return job_report(f"push_{source_id}_{int(started)}", source_id, started, watch.get)
