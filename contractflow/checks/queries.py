"""One query per operator, over the whole test tables.

``oracle.py`` holds the same results as plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contractflow.functions import draws, numbers
from contractflow.model import (
    CONTRACTS, IOT, LEGACY, MANUFACTURING, SALES, WAREHOUSE, WEATHER, OperationType, ViolationPolicy)
from contractflow.operators import (
    audit, cdc, contracts, dedup, envelope, normalize, profiling, rows, serving, synth, telemetry)
from contractflow.plans import batch, changes
from contractflow.session import apply_runtime_conf, scratch_path
from contractflow.sources import files, kafka, views
from contractflow.sources.checkpoints import load_position, save_position
from contractflow.streaming import events as streaming
from contractflow.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]

RUN_AT = "2026-04-05T12:00:00+00:00"
FEED_START, FEED_RATE = "2026-04-05T00:00:00+00:00", 10.0
STATES = ("1998-01-01", "1999-01-01")
LOG_POSITION = 1999
WATERMARK = "2026-04-05T00:05:00+00:00"
JOB_SECONDS = 10.0
SEPARATOR = " ;; "

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under its function name, less a trailing underscore."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(apply_runtime_conf(spark), folder)

    QUERIES[function.__name__.removesuffix("_")] = run
    return function


def _joined(column: str, alias: str) -> Column:
    return F.array_join(column, SEPARATOR).alias(alias)


# -- normalization ---------------------------------------------------------------------

@query
def null_canon(spark, folder):
    clean = normalize.null_canonical(views.warehouse(spark, folder))
    return clean.select(F.col("_row").alias("row"), "unit_cost", F.col("unit_cost").isNull().alias("is_null"))


@query
def upper_ids(spark, folder):
    shown = normalize.normalize(views.warehouse(spark, folder), WAREHOUSE)
    return shown.select(F.col("_row").alias("row"), "product_id", "article_id")


@query
def iso_timestamps(spark, folder):
    shown = normalize.normalize(views.sales(spark, folder), SALES)
    return shown.select(F.col("_row").alias("row"), "sale_timestamp")


@query
def impute_defects(spark, folder):
    shown = normalize.normalize(views.manufacturing(spark, folder), MANUFACTURING)
    return shown.select(F.col("_row").alias("row"), "defect_count")


@query
def legacy_migrate(spark, folder):
    moved = normalize.normalize(views.legacy(spark, folder), LEGACY)
    return moved.select(
        "product_id", "historical_period", "total_monthly_sales", "market_region", _joined("_changes", "changes"))


@query
def normalize_changes(spark, folder):
    sold = normalize.normalize(views.sales(spark, folder), SALES)
    made = normalize.normalize(views.manufacturing(spark, folder), MANUFACTURING)
    return _tagged({SALES: sold, MANUFACTURING: made}, F.col("_row").alias("row"), _joined("_changes", "changes"))


def _tagged(frames: dict[str, DataFrame], *columns: Column) -> DataFrame:
    """The same columns of several sources under one another."""
    parts = [frame.select(F.lit(name).alias("source"), *columns) for name, frame in frames.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query
def normalize_counts(spark, folder):
    frames = {
        SALES: normalize.normalize(views.sales(spark, folder), SALES),
        MANUFACTURING: normalize.normalize(views.manufacturing(spark, folder), MANUFACTURING),
        WAREHOUSE: normalize.normalize(views.warehouse(spark, folder), WAREHOUSE),
        LEGACY: normalize.normalize(views.legacy(spark, folder), LEGACY),
    }
    changed = F.sum(F.when(F.size("_changes") > 0, 1).otherwise(0)).alias("changed")
    return _tagged(frames, F.col("_changes")).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), changed)


# -- contract rules ----------------------------------------------------------------------

def _raw_frames(spark, folder) -> dict[str, DataFrame]:
    return {
        SALES: views.sales(spark, folder),
        WAREHOUSE: views.warehouse(spark, folder),
        MANUFACTURING: views.manufacturing(spark, folder),
        IOT: views.iot(spark, folder),
    }


def _rule_counts(spark, folder, kind: str) -> DataFrame:
    """Broken rules of one kind, counted per source and field, in one pass per source."""
    parts = []
    for source_id, frame in _raw_frames(spark, folder).items():
        parts.append(contracts.explain_rules(frame, CONTRACTS[source_id], kind).select(
            F.lit(source_id).alias("source"), F.explode("codes").alias("code")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("source", "code").agg(F.count(F.lit(1)).alias("broken"))


@query
def contract_required(spark, folder):
    return _rule_counts(spark, folder, "required")


@query
def contract_not_null(spark, folder):
    return _rule_counts(spark, folder, "null")


@query
def contract_type(spark, folder):
    return _rule_counts(spark, folder, "type")


@query
def contract_enum(spark, folder):
    return _rule_counts(spark, folder, "enum")


@query
def contract_min(spark, folder):
    return _rule_counts(spark, folder, "min")


@query
def contract_max(spark, folder):
    return _rule_counts(spark, folder, "max")


@query
def contract_violations(spark, folder):
    judged = batch.push_records(views.warehouse(spark, folder), WAREHOUSE)
    return judged.select(
        F.col("_row").alias("row"), F.col("_status").alias("status"), _joined("_violations", "violations"))


@query
def contract_violations_iot(spark, folder):
    judged = streaming.judge_events(views.iot(spark, folder), dedup=False)
    return judged.select("event_id", F.col("_status").alias("status"), _joined("_violations", "violations"))


@query
def policy_reject(spark, folder):
    strict = replace(CONTRACTS[SALES], policy=ViolationPolicy.REJECT)
    judged = batch.judge(views.sales(spark, folder), SALES, contract=strict)
    return judged.where(F.col("_status") == contracts.REJECT).select(
        F.col("_row").alias("row"), F.col("_key").alias("key"), _joined("_violations", "violations"))


@query
def policy_quarantine(spark, folder):
    judged = batch.judge_survivors(views.warehouse(spark, folder), WAREHOUSE)
    return judged.where(F.col("_status") == contracts.QUARANTINE).select(
        F.col("_row").alias("row"), "product_id", _joined("_violations", "violations"))


@query
def policy_coerce(spark, folder):
    judged = batch.judge_survivors(views.manufacturing(spark, folder), MANUFACTURING)
    coerced = judged.where(F.col("_status") == contracts.COERCED)
    return coerced.select(
        F.col("_row").alias("row"), *contracts.accepted_payload(coerced, ["quantity_produced", "defect_count"]),
        _joined("_coercions", "coercions"))


@query
def policy_revalidate(spark, folder):
    judged = batch.judge_survivors(views.manufacturing(spark, folder), MANUFACTURING)
    return judged.where(F.col("_status") == contracts.QUARANTINE).select(
        F.col("_row").alias("row"), "quantity_produced", _joined("_violations", "violations"))


@query
def policy_legacy(spark, folder):
    """Legacy rows under the registered contract and under the migrated one."""
    frame, identity = views.legacy(spark, folder), ["product_id", "historical_period"]
    frames = {
        "compat": batch.judge(frame, LEGACY, compat=True, identity=identity),
        "migrated": batch.judge(frame, LEGACY, identity=identity),
    }
    return _tagged(frames, F.col("_status").alias("status")).groupBy("source", "status").agg(
        F.count(F.lit(1)).alias("rows"))


@query
def status_counts(spark, folder):
    judged = batch.judge(views.sales(spark, folder), SALES)
    return judged.groupBy(F.col("_status").alias("status")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_row").alias("row_sum"))


# -- deduplication -------------------------------------------------------------------------

@query
def dedup_first_wins(spark, folder):
    kept = dedup.keep_first(normalize.normalize(views.sales(spark, folder), SALES), "receipt_id")
    return kept.select(F.col("_row").alias("row"), "receipt_id", "product_id", "units_sold")


@query
def dedup_fallback_key(spark, folder):
    """Rows without a receipt, which compete by product and with receipts of that name."""
    marked = dedup.mark_duplicates(normalize.normalize(views.sales(spark, folder), SALES), "receipt_id")
    return marked.where(F.col("receipt_id").isNull()).select(
        F.col("_row").alias("row"), "product_id", F.col("_dup").alias("duplicate"))


@query
def dedup_per_slice(spark, folder):
    sliced = rows.with_slices(normalize.normalize(views.sales(spark, folder), SALES), 500, None)
    marked = dedup.mark_duplicates(sliced, "receipt_id", within=["batch_id"])
    return marked.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("_dup").alias("duplicates"))


@query
def dedup_counts(spark, folder):
    sold = dedup.duplicate_counts(normalize.normalize(views.sales(spark, folder), SALES), "receipt_id")
    made = dedup.duplicate_counts(
        normalize.normalize(views.manufacturing(spark, folder), MANUFACTURING), "production_batch_id")
    return _tagged({SALES: sold, MANUFACTURING: made}, *[F.col(n) for n in ("rows", "duplicates", "duplicate_rate")])


@query
def stream_dedup(spark, folder):
    events = views.iot_with_resends(spark.read.parquet(f"{folder}/events.parquet"))
    return streaming.drop_resends(events)


# -- envelope, outputs, audit ------------------------------------------------------------------

@query
def envelope_(spark, folder):
    judged = batch.judge_survivors(views.sales(spark, folder), SALES)
    return batch.good_rows(judged, SALES, RUN_AT)


@query
def envelope_event_time(spark, folder):
    made = batch.judge_survivors(views.manufacturing(spark, folder), MANUFACTURING)
    good = batch.good_rows(made, MANUFACTURING, RUN_AT).select("_event_timestamp", "_source_timestamp")
    names = views.iot(spark, folder).columns
    read = views.iot(spark, folder).select(
        envelope.event_time(names).alias("_event_timestamp"), envelope.source_time(names).alias("_source_timestamp"))
    stocked = batch.good_rows(batch.judge_survivors(views.warehouse(spark, folder), WAREHOUSE), WAREHOUSE, RUN_AT)
    whole = _tagged(
        {MANUFACTURING: good, IOT: read, WAREHOUSE: stocked}, F.col("_event_timestamp"), F.col("_source_timestamp"))
    return whole.groupBy("source", F.col("_event_timestamp").alias("event_time"),
                         F.col("_source_timestamp").alias("source_time")).agg(F.count(F.lit(1)).alias("rows"))


@query
def quarantine_rows(spark, folder):
    return batch.quarantine_rows(batch.judge_survivors(views.sales(spark, folder), SALES))


@query
def audit_log(spark, folder):
    entries = audit.audit_rows(batch.judge(views.manufacturing(spark, folder), MANUFACTURING))
    return entries.select("row", "key", "status", _joined("violations", "violations"), _joined("coercions", "coercions"))


@query
def audit_lines(spark, folder):
    judged = batch.judge(views.sales(spark, folder), SALES)
    return audit.record_lines(judged, SALES, CONTRACTS[SALES])


@query
def push_ingest(spark, folder):
    judged = batch.push_records(views.manufacturing(spark, folder), MANUFACTURING)
    return batch.accepted_records(judged)


# -- slices -----------------------------------------------------------------------------------

@query
def microbatch_slices(spark, folder):
    sliced = rows.with_slices(views.sales(spark, folder), 500)
    judged = batch.judge(sliced, SALES, within=("batch_id",))
    return audit.audit_rows(judged, row="_slice_row", also=("batch_id",)).select("batch_id", "row", "key", "status")


@query
def microbatch_cap(spark, folder):
    """The first five slices only, which is what the cap is for."""
    judged = batch.judge(rows.with_slices(views.sales(spark, folder), 500, 5), SALES, within=("batch_id",))
    return audit.audit_rows(judged, row="_slice_row", also=("batch_id",)).select("batch_id", "row", "key", "status")


@query
def microbatch_telemetry(spark, folder):
    sliced = rows.with_slices(views.sales(spark, folder), 500, None)
    return batch.slice_telemetry(batch.judge(sliced, SALES, within=("batch_id",)), SALES)


# -- streaming and events ------------------------------------------------------------------------

def _run_stream(spark: SparkSession, folder: str, dedup_events: bool) -> tuple[DataFrame, DataFrame]:
    """Run the stream over the event files to the end and read both sinks back."""
    storage = files.Storage(scratch_path(spark, "stream"))
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{folder}/events*.parquet")
    name = "readings"
    streaming.run_events(views.iot_with_resends(source), storage, name, dedup=dedup_events).awaitTermination()
    return streaming.read_sinks(spark, storage, name)


def _run_late_stream(spark: SparkSession, folder: str, rows_a_file: int | None = None) -> files.Storage:
    """Three runs over files that land out of order: late days first, early ones after them, then resends of both."""
    storage = files.Storage(scratch_path(spark, "stream"))
    exact = streaming.ExactFiles(storage, "readings", rows_a_file) if rows_a_file else None
    landed, early = f"{storage.root}/landed", F.dayofmonth(F.substr("timestamp", F.lit(1), F.lit(10)).cast("date")) <= 15
    whole = views.iot_with_resends(spark.read.parquet(f"{folder}/events.parquet"))
    resent = F.col("event_id").cast("bigint") % 33 == 0
    for part in (whole.where(~early), whole.where(early), whole.where(resent)):
        part.write.mode("append").parquet(landed)
        source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 100).parquet(landed)
        streaming.run_events(source, storage, "readings", seen_table=True, hook=exact).awaitTermination()
    if exact:
        exact.flush(spark)
    return storage


@query
def stream_events(spark, folder):
    good, _ = streaming.read_sinks(spark, _run_late_stream(spark, folder), "readings")
    return good.drop("_ingestion_timestamp")


@query
def stream_flush(spark, folder):
    """Files of exactly 300 accepted events, over three runs of the stream; the last file has the rest."""
    found = spark.read.parquet(_run_late_stream(spark, folder, 300).stream_files("readings"))
    placed = found.select(F.col("file").cast("bigint").alias("file"), F.col("_metadata.file_path").alias("path"))
    return placed.groupBy("file").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("path").alias("files"))


@query
def stream_progress(spark, folder):
    """What the batches stored of their progress, added up over the runs."""
    storage = _run_late_stream(spark, folder)
    rows_ = progress.stored(spark, storage.stream_progress("readings"))
    return rows_.groupBy("query").agg(
        F.count_distinct("batch_id").alias("batches"), *[F.sum(n).alias(n) for n in ("events_read", "ingested", "failed", "quarantined")],
        F.min(F.col("elapsed_seconds") > 0).alias("timed"))


@query
def stream_two_sinks(spark, folder):
    good, refused = _run_stream(spark, folder, True)
    return (
        good.select(F.lit("good").alias("sink"), "event_id", F.lit("[]").alias("violations"))
        .unionByName(refused.select(F.lit("quarantine").alias("sink"), "event_id", F.col("_violations").alias("violations")))
    )


@query
def stream_no_dedup(spark, folder):
    good, refused = _run_stream(spark, folder, False)
    both = good.select(F.lit("good").alias("sink"), "event_id").unionByName(
        refused.select(F.lit("quarantine").alias("sink"), "event_id"))
    return both.groupBy("sink", "event_id").agg(F.count(F.lit(1)).alias("copies"))


@query
def stream_resume(spark, folder):
    """The stream run twice from one checkpoint: the second run adds nothing."""
    storage = files.Storage(scratch_path(spark, "stream"))
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    for _ in range(2):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{folder}/events*.parquet")
        streaming.run_events(views.iot_with_resends(source), storage, "readings").awaitTermination()
    good, refused = streaming.read_sinks(spark, storage, "readings")
    return good.select("event_id").unionByName(refused.select("event_id"))


@query
def foreach_batch_hook(spark, folder):
    """What a hook was handed, batch by batch."""
    storage = files.Storage(scratch_path(spark, "stream"))
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{folder}/events*.parquet")
    handed = f"{storage.root}/handed"
    streaming.run_events(
        views.iot_with_resends(source), storage, "readings",
        hook=lambda good: good.select("event_id", "_operation_type").write.mode("append").parquet(handed)).awaitTermination()
    return spark.read.parquet(handed)


@query
def kafka_encode(spark, folder):
    return kafka.encode_events(views.iot(spark, folder))


@query
def kafka_decode(spark, folder):
    sent = kafka.encode_events(views.iot(spark, folder))
    wire = sent.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    return kafka.decode_events(wire)


@query
def weather_flatten(spark, folder):
    flat = files.flatten_weather(views.weather_payloads(spark, folder), also=("event_id",))
    judged = contracts.apply_contract(flat, CONTRACTS[WEATHER])
    return judged.select(
        "event_id", "city", "temperature", "humidity", "weather_description", "timestamp",
        F.col("_status").alias("status"), _joined("_violations", "violations"))


# -- change data capture -----------------------------------------------------------------------------

def _feed(spark, folder) -> DataFrame:
    """What a year changed in the table of receipts."""
    before, after = (views.sales_as_of(spark, folder, day) for day in STATES)
    return cdc.snapshot_feed(before, after, "receipt_id", SALES, FEED_START, FEED_RATE)


@query
def cdc_feed(spark, folder):
    return _feed(spark, folder)


@query
def cdc_feed_ops(spark, folder):
    numbered = views.sales(spark, folder).select((F.col("_row") - 1).alias("_log_offset"))
    return draws.seeded(numbered, "_log_offset").select("_log_offset", cdc.operation_of().alias("_operation_type"))


@query
def cdc_log_based(spark, folder):
    return cdc.after_offset(_feed(spark, folder), LOG_POSITION).select(
        "_log_offset", "_event_id", "_operation_type", "receipt_id", "units_sold")


@query
def cdc_trigger_based(spark, folder):
    log = _feed(spark, folder)
    resent = log.withColumn("_copy", F.explode(
        F.when(F.col("_log_offset") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    doubled = resent.withColumn("_log_offset", F.col("_log_offset") + F.col("_copy") * 1_000_000_000_000).drop("_copy")
    return cdc.triggered(doubled).select("_log_offset", "_event_id", "_operation_type", "receipt_id", "units_sold")


@query
def cdc_timestamp_based(spark, folder):
    return cdc.after_watermark(_feed(spark, folder), WATERMARK).select(
        "_log_offset", "_ingestion_timestamp", "_operation_type", "receipt_id")


@query
def cdc_op_counts(spark, folder):
    return cdc.operation_counts(_feed(spark, folder))


@query
def cdc_two_step(spark, folder):
    """Two real runs, each written to the log and extracted, against the whole feed."""
    whole = _feed(spark, folder)
    log = _two_runs(spark, whole)
    found = changes.read_extracted(spark, log, SALES, "log", "steady").groupBy("_log_offset").agg(F.count(F.lit(1)).alias("two"))
    per_event = whole.select("_log_offset", F.lit(1).alias("one")).join(found, "_log_offset", "full")
    return per_event.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("two").isNull()).alias("lost"),
        F.count_if(F.coalesce("two", F.lit(0)) > F.coalesce("one", F.lit(0))).alias("repeated"))


def _two_runs(spark: SparkSession, whole: DataFrame) -> files.Storage:
    """The feed written to a log in two runs, with an extraction by offset after each."""
    storage = files.Storage(scratch_path(spark, "log"))
    runs = {"one": whole.where(F.col("_log_offset") <= LOG_POSITION), "two": whole.where(F.col("_log_offset") > LOG_POSITION)}
    for run, part in runs.items():
        changes.write_change_log(part, storage, SALES, "steady", run)
        changes.extract_by_log(spark, storage, SALES, "steady")
    return storage


@query
def cdc_capture(spark, folder):
    """The capture job: its report, next to what the log holds of its run."""
    storage = files.Storage(scratch_path(spark, "log"))
    before, after = (views.sales_as_of(spark, folder, day) for day in STATES)
    report = changes.capture_changes(storage, SALES, before, after, "receipt_id", "burst", FEED_START, "year")
    log = changes.read_change_log(spark, storage, SALES, "burst")
    return cdc.operation_counts(log).withColumns({
        "reported": F.lit(report.records_ingested).cast("bigint"), "source_id": F.lit(report.source_id)})


@query
def cdc_chunks(spark, folder):
    """An extraction in chunks of 5000 offsets, read back by the manifest."""
    storage = files.Storage(scratch_path(spark, "log"))
    changes.write_change_log(_feed(spark, folder), storage, SALES, "steady", "one")
    changes.extract_by_log(spark, storage, SALES, "steady", step=5000)
    found = changes.read_extracted(spark, storage, SALES, "log", "steady")
    return found.groupBy(F.expr("_log_offset DIV 5000").alias("chunk")).agg(
        F.count(F.lit(1)).alias("events"), F.min("_log_offset").alias("first"), F.max("_log_offset").alias("last"))


@query
def cdc_commit(spark, folder):
    """The position committed after two extractions, next to what they wrote."""
    storage = _two_runs(spark, _feed(spark, folder))
    position = load_position(spark, storage.checkpoint("log_based", SALES, "steady"))
    found = changes.read_extracted(spark, storage, SALES, "log", "steady")
    return found.agg(
        F.count(F.lit(1)).alias("extracted"), F.max("_log_offset").cast("string").alias("last"),
        F.lit(position).alias("position"))


@query
def checkpoint_positions(spark, folder):
    """The latest of several saved positions, as loaded again: the row counts of two tables."""
    path = files.Storage(scratch_path(spark, "positions")).checkpoint("log_based", SALES, "steady")
    for name in ("orders", "lineitem"):
        save_position(spark, path, str(spark.read.parquet(f"{folder}/{name}.parquet").count()))
    return spark.read.parquet(f"{folder}/lineitem.parquet").agg(
        F.count(F.lit(1)).cast("string").alias("rows")).withColumn("position", F.lit(load_position(spark, path)))


# -- profiling -----------------------------------------------------------------------------------------

def _profiled(spark, folder) -> dict[str, DataFrame]:
    return {
        SALES: views.sales(spark, folder),
        WAREHOUSE: views.warehouse(spark, folder),
        "customer": spark.read.parquet(f"{folder}/customer.parquet"),
    }


def _profile_rows(spark, folder, kind: str, *columns: Column) -> DataFrame:
    """Profiles of one kind; only columns that can be of that kind are read."""
    numeric = kind == profiling.NUMERIC
    frames = {}
    for name, frame in _profiled(spark, folder).items():
        wanted = [
            f.name for f in frame.schema.fields
            if not f.name.startswith("_") and isinstance(f.dataType, T.NumericType) == numeric]
        frames[name] = profiling.profile_table(frame, profiling.profile(frame, wanted))
    return _tagged(frames, *columns, F.col("kind")).where(F.col("kind") == kind).drop("kind")


@query
def profile_kinds(spark, folder):
    frames = {name: profiling.profile_table(frame) for name, frame in _profiled(spark, folder).items()}
    return _tagged(frames, F.col("column"), F.col("kind"), F.col("present"))


@query
def profile_categorical(spark, folder):
    parts = {}
    for name, frame in _profiled(spark, folder).items():
        parts[name] = profiling.value_frequencies(frame, profiling.profile(frame))
    return _tagged(
        parts, F.col("column"), F.col("value"), F.col("count"),
        F.bround("probability", 9).alias("probability"), F.bround("null_rate", 9).alias("null_rate"))


@query
def profile_numeric(spark, folder):
    return _profile_rows(
        spark, folder, profiling.NUMERIC, F.col("column"), F.bround("mean", 6).alias("mean"),
        F.bround("std", 6).alias("std"), F.col("min"), F.col("max"), F.bround("null_rate", 9).alias("null_rate"))


@query
def profile_timestamp(spark, folder):
    return _profile_rows(
        spark, folder, profiling.TIMESTAMP, F.col("column"), F.col("min"), F.col("max"),
        F.bround("null_rate", 9).alias("null_rate"))


# -- synthetic rows ---------------------------------------------------------------------------------------

def _sales_ids(spark, folder) -> DataFrame:
    """One synthetic row per line item."""
    return views.sales(spark, folder).select("_row")


def _key_pool(spark, folder) -> tuple[DataFrame, int]:
    """Known product ids, numbered in their own order."""
    known = views.warehouse(spark, folder).where(F.col("product_id").isNotNull()).select("product_id")
    pool = rows.number_by_order(known, ["product_id"], "keys")
    return pool, pool.count()


def _profiles(frame: DataFrame, *names: str) -> list[profiling.ColumnProfile]:
    return profiling.with_domains(frame, profiling.profile(frame, list(names)))


def _from_whole_profile(spark, folder, frame: DataFrame, drawn: tuple[str, ...], hook) -> DataFrame:
    """Rows from the profile of all columns; those that the source's rules make themselves are not drawn first."""
    profiles = profiling.profile(frame)
    return synth.generate(
        _sales_ids(spark, folder), profiles, hook=hook, skip=tuple(p.name for p in profiles if p.name not in drawn))


@query
def synth_categorical(spark, folder):
    frame = views.warehouse(spark, folder)
    return synth.generate(_sales_ids(spark, folder), _profiles(frame, "size", "article_id"))


@query
def synth_numeric(spark, folder):
    made = synth.generate(_sales_ids(spark, folder), _profiles(views.warehouse(spark, folder), "unit_cost", "reorder_threshold"))
    return made.select("_row", F.bround("unit_cost", 5).alias("unit_cost"),
                       F.bround("reorder_threshold", 5).alias("reorder_threshold"))


@query
def synth_timestamp(spark, folder):
    return synth.generate(_sales_ids(spark, folder), _profiles(views.sales(spark, folder), "sale_timestamp"))


@query
def synth_rows(spark, folder):
    """Upsampled customers; names have too many values for the plan and are drawn by rank."""
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    made = synth.upsample(
        _sales_ids(spark, folder), _profiles(customers, "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    return made.withColumns({n: F.bround(n, 5) for n in ("c_nationkey", "c_acctbal")})


@query
def synth_warehouse(spark, folder):
    frame = views.warehouse(spark, folder)
    profiles = _profiles(frame, "product_name", "reorder_threshold", "max_capacity", "unit_cost")
    return synth.generate(_sales_ids(spark, folder), profiles, hook=synth.warehouse_rules)


@query
def synth_manufacturing(spark, folder):
    pool, size = _key_pool(spark, folder)
    made = views.manufacturing(spark, folder)
    typed = made.withColumn("quantity_produced", numbers.parse_float(F.col("quantity_produced")))
    return _from_whole_profile(spark, folder, typed, ("quantity_produced", "defect_count"), synth.manufacturing_rules(pool, size, RUN_AT))


@query
def synth_sales(spark, folder):
    pool, size = _key_pool(spark, folder)
    return _from_whole_profile(spark, folder, views.sales(spark, folder), ("units_sold",), synth.sales_rules(pool, size, RUN_AT))


@query
def synth_legacy(spark, folder):
    pool, size = _key_pool(spark, folder)
    return _from_whole_profile(spark, folder, views.legacy(spark, folder), ("total_monthly_sales",), synth.legacy_rules(pool, size, RUN_AT))


@query
def synth_iot(spark, folder):
    pool, size = _key_pool(spark, folder)
    return synth.iot_rows(_sales_ids(spark, folder), pool, size, RUN_AT)


@query
def synth_weather(spark, folder):
    made = synth.weather_rows(_sales_ids(spark, folder), RUN_AT)
    return made.withColumns({
        "temperature": F.bround("temperature", 5), "humidity": F.bround("humidity", 5)})


@query
def synth_fk(spark, folder):
    """Drawn keys that are not in the key table: none."""
    pool, size = _key_pool(spark, folder)
    drawn = synth.draw_key(_sales_ids(spark, folder), pool, size)
    known = pool.select(F.col("product_id").alias("_drawn_key"), F.lit(True).alias("_known"))
    return drawn.join(known, "_drawn_key", "left").agg(
        F.count_if(F.col("_known").isNull()).alias("orphans"), F.count(F.lit(1)).alias("rows"),
        F.count_distinct("_drawn_key").alias("keys"))


# -- telemetry and serving ----------------------------------------------------------------------------------

@query
def job_counters(spark, folder):
    made = telemetry.job_counters(
        batch.judge(views.manufacturing(spark, folder), MANUFACTURING), changes="_n_changes")
    sold = telemetry.job_counters(batch.judge(views.sales(spark, folder), SALES), changes="_n_changes")
    return _tagged({MANUFACTURING: made, SALES: sold}, *[F.col(n) for n in made.columns])


@query
def ingest_latency(spark, folder):
    judged = batch.judge_survivors(views.sales(spark, folder), SALES)
    lag = telemetry.latency_seconds(F.col("sale_timestamp"), RUN_AT)
    counted = telemetry.job_counters(judged, latency_seconds=lag)
    return counted.select(F.bround("avg_ingestion_latency_sec", 3).alias("avg_ingestion_latency_sec"))


def _telemetry(spark, folder) -> DataFrame:
    identity = ["product_id", "historical_period"]
    judged = {
        SALES: batch.judge(views.sales(spark, folder), SALES),
        MANUFACTURING: batch.judge(views.manufacturing(spark, folder), MANUFACTURING),
        WAREHOUSE: batch.judge(views.warehouse(spark, folder), WAREHOUSE),
        LEGACY: batch.judge(views.legacy(spark, folder), LEGACY, compat=True, identity=identity),
    }
    counted = {name: telemetry.job_counters(frame, changes="_n_changes") for name, frame in judged.items()}
    columns = [F.col(n) for n in counted[SALES].columns]
    return _tagged(counted, *columns).withColumnRenamed("source", "source_id").withColumn(
        "duration_seconds", F.lit(JOB_SECONDS))


@query
def batch_summary(spark, folder):
    return telemetry.batch_summary(_telemetry(spark, folder))


@query
def job_metrics(spark, folder):
    return telemetry.job_metrics(views.jobs(spark, folder))


@query
def job_lookup(spark, folder):
    return serving.find_job(views.jobs(spark, folder), "job-7")


@query
def dataset_limit(spark, folder):
    return serving.dataset_sample(views.sales(spark, folder), ["_row"], 100)


@query
def low_stock_alerts(spark, folder):
    return serving.low_stock_alerts(views.warehouse(spark, folder))


# -- jobs with their files -----------------------------------------------------------------------------------

def _sales_csv(spark: SparkSession, folder: str) -> str:
    """The sales rows as CSV files with their columns in another order and one more."""
    path = scratch_path(spark, "csv")
    shuffled = views.sales(spark, folder).select(
        "store_id", F.lit("x").alias("note"), "units_sold", "receipt_id", "sale_timestamp", "product_id")
    shuffled.write.option("header", True).option("escape", '"').csv(path)
    return path


@query
def csv_scan(spark, folder):
    found = files.read_source_csv(spark, _sales_csv(spark, folder), SALES)
    return found.select("receipt_id", "product_id", "sale_timestamp", F.col("units_sold").cast("double").alias("units_sold"), "store_id")


@query
def csv_quoted_breaks(spark, folder):
    """Quoted line breaks, commas and quotes in files of many splits, most of which begin inside a value or a row."""
    path = scratch_path(spark, "csv")
    note = F.concat("receipt_id", F.lit('\nsaid "yes", then\n\nleft '), "store_id")
    views.sales(spark, folder).select("receipt_id", note.alias("note"), "store_id").write.csv(
        path, header=True, quoteAll=True, escape='"')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        return files.read_source_csv(spark, path, SALES, multi_line=True).select("receipt_id", "note", "store_id")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@query
def csv_mixed_headers(spark, folder):
    """One source in files of three headers: other orders, an absent column, a further one."""
    path, sold = scratch_path(spark, "csv"), views.sales(spark, folder)
    kinds = (["receipt_id", "product_id", "units_sold", "store_id"], ["store_id", "units_sold", "receipt_id"],
             ["product_id", "store_id", "region", "receipt_id", "units_sold"])
    for number, names in enumerate(kinds):
        part = sold.where(F.col("store_id").cast("bigint") % 3 == number).withColumn("region", F.concat(F.lit("r"), "store_id"))
        part.select(*names).write.mode("append").csv(path, header=True, escape='"')
    return files.read_source_csv(spark, path, SALES).select("receipt_id", "product_id", "units_sold", "store_id", "region")


@query
def load_failure(spark, folder):
    """A full load with a file that has nothing in it: one failure, and the other source goes on."""
    storage = files.Storage(scratch_path(spark, "load"))
    empty = f"{storage.root}/empty.csv"
    spark.range(0).select(F.lit("").alias("value")).coalesce(1).write.text(empty)
    table = batch.ingest_all(spark, {MANUFACTURING: empty, SALES: _sales_csv(spark, folder)}, storage)
    return table.select("source_id", "records_failed", (F.col("records_ingested") > 0).alias("ingested"))


@query
def landed_ingest(spark, folder):
    """Weather responses that land in two goes, a run after each and one more: every file is taken once."""
    storage = files.Storage(scratch_path(spark, "landed"))
    payloads, folder = views.weather_payloads(spark, folder), f"{storage.root}/payloads"
    for landing in (0, 1):
        payloads.where(F.col("event_id") % 2 == landing).drop("event_id").write.mode("append").json(folder)
        batch.ingest_landed(spark, folder, storage)
    batch.ingest_landed(spark, folder, storage)
    return spark.read.parquet(storage.good(WEATHER)).select(
        "city", "temperature", "humidity", "weather_description", "timestamp", "landed")


def _sales_job(spark: SparkSession, folder: str) -> tuple[telemetry.JobReport, files.Storage]:
    storage = files.Storage(scratch_path(spark, "job"))
    return batch.ingest(views.sales(spark, folder), SALES, storage), storage


@query
def good_sink(spark, folder):
    _, storage = _sales_job(spark, folder)
    return spark.read.parquet(storage.good(SALES)).drop("_ingestion_timestamp")


@query
def job_telemetry(spark, folder):
    """The report row of a job: its counters, and whether its rate, lag and files follow from them."""
    report, storage = _sales_job(spark, folder)
    table = telemetry.telemetry_table(spark, [report])
    rate = F.col("records_ingested") / F.col("duration_seconds")
    written = batch.data_files(spark, storage.good(SALES))
    return table.select(
        "source_id", "records_ingested", "records_failed", "records_quarantined", "records_coerced", "records_duplicate",
        (F.abs(F.col("throughput_rec_sec") / rate - 1) < 0.01).alias("rate_follows"),
        (F.col("processing_lag_sec") == F.col("duration_seconds")).alias("lag_follows"),
        (F.col("file_count_per_partition") == written).alias("files_follow"), "snapshot_count")


@query
def file_row_counts(spark, folder):
    """Rows in the files of a job's sinks, by area."""
    _, storage = _sales_job(spark, folder)
    counted = [audit.file_row_counts(spark, area, storage.area(area)) for area in ("ingested", "quarantine")]
    return counted[0].unionByName(counted[1]).groupBy("area").agg(F.sum("rows").alias("rows"))


@query
def storage_audit(spark, folder):
    """Areas that a job leaves behind, and whether their sizes add up to the total."""
    _, storage = _sales_job(spark, folder)
    found = audit.storage_audit(spark, storage.areas())
    total = F.max(F.when(F.col("area") == "TOTAL", F.col("files")))
    return found.agg(
        F.array_join(F.array_sort(F.collect_set("area")), ",").alias("areas"),
        (F.sum(F.when(F.col("area") != "TOTAL", F.col("files"))) == total).alias("adds_up"))


@query
def profile_constant(spark, folder):
    """A column without any value is constant."""
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    emptied = customers.select("c_custkey", F.when(F.col("c_custkey") < 0, F.col("c_name")).alias("nothing"))
    found = profiling.profile_table(emptied, profiling.profile(emptied))
    return found.select("column", "kind", "rows", "present", "null_rate")


@query
def row_hook(spark, folder):
    """Generated rows with a rule of the caller's own."""
    return synth.generate(
        _sales_ids(spark, folder), _profiles(views.sales(spark, folder), "sale_timestamp"),
        hook=lambda made: made.withColumn("sale_month", F.substring("sale_timestamp", 1, 7)))
