"""Change-log writing and extraction jobs: write first, then commit."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.operators import cdc, telemetry
from contractflow.plans.batch import job_report
from contractflow.session import scratch_path
from contractflow.sources.checkpoints import load_position, save_position
from contractflow.sources.files import CODEC, Storage, read_parquet_or_none, remove

# Events per second and events of the two scenarios.
SCENARIOS = {"steady": (10.0, 100), "burst": (5000.0, 5000)}


RUN = "run"
#: Offsets that one task writes to a log, those that one step extracts, and those whose steps one job writes.
CHUNK, STEP, WAVE = 50_000, 1_000_000, 20_000_000
MANIFEST = "_manifest"


def read_change_log(spark: SparkSession, storage: Storage, source_id: str, scenario: str) -> DataFrame | None:
    """All events of a log, or None where there are none yet."""
    log = read_parquet_or_none(spark, storage.change_log(source_id, scenario))
    return None if log is None else log.drop(RUN)


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """File names of a folder in order, none where it does not exist."""
    target, system = _folder(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(target)) if system.exists(target) else []


def _created(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file, unless it is there."""
    target, system = _folder(spark, path)
    try:
        stream = system.create(target, False)
    except Py4JJavaError as error:
        if system.exists(target):
            return False
        raise error
    stream.write(text.encode())
    stream.close()
    return True


def _content(spark: SparkSession, path: str) -> str:
    """The text of a small file; another writer may not have filled it yet."""
    target, system = _folder(spark, path)
    for _ in range(100):
        length = system.getFileStatus(target).getLen()
        if length:
            stream = system.open(target)
            text = bytes(stream.readNBytes(length)).decode()
            stream.close()
            return text
        time.sleep(0.05)
    raise TimeoutError(f"{path} stays empty")


def _claimed(spark: SparkSession, claims: str, run_id: str, count: int, first: int, last: int | None) -> int:
    """The first of ``count`` offsets that belong to this run alone.

    Claims are files named by their first offset, in which their last one and the run stand. A
    file is created only if absent, so of two writers that want the same offsets one
    loses and takes those behind. A run keeps its claim when it is repeated; if it has become
    longer it claims anew, since another run may own what follows. (The file system
    has to refuse the creation of an existing file in one step, as HDFS does.)
    """
    while True:
        held = [(int(name), *_content(spark, f"{claims}/{name}").split(" ", 1)) for name in _names(spark, claims) if not name.startswith(".")]
        own = [start for start, end, run in held if run == run_id and int(end) - start + 1 >= count]
        if own:
            return own[-1]
        ends = [int(end) for _, end, _ in held] + ([] if last is None else [last])
        start = max(ends) + 1 if ends else first
        if _created(spark, f"{claims}/{start:020d}", f"{start + count - 1} {run_id}"):
            return start


def write_change_log(
    feed: DataFrame, storage: Storage, source_id: str, scenario: str, run_id: str | None = None, chunk: int = CHUNK,
) -> str:
    """Add one run's events to the log, ordered by offset so that readers can skip files and row groups.

    Offsets continue after the last one in the log, wherever the feed's own begin
    (the first run keeps them), and event ids contain the run. The offsets are claimed before
    the run writes, so runs may overlap in time. A run is a directory of its own: repeating it
    under its ``run_id`` replaces it at the offsets it had. A run must start after
    the log's last ingestion time, or extraction by time would pass it over. Tasks write whole
    chunks of offsets: dense numbers need no sample to be dealt evenly.
    """
    spark, path = feed.sparkSession, storage.change_log(source_id, scenario)
    run_id = f"r-{run_id or uuid.uuid4().hex}"
    own = feed.agg(F.min(cdc.OFFSET).alias("first"), F.max(cdc.OFFSET).alias("last"), F.min("_ingestion_timestamp").alias("at")).first()
    log, last = read_parquet_or_none(spark, path), None
    if log is not None:
        others = log.where(F.col(RUN) != run_id)
        found = others.agg(F.max(cdc.OFFSET).alias("last"), F.max("_ingestion_timestamp").alias("seen")).first()
        repeated = not log.where(F.col(RUN) == run_id).isEmpty()
        last = found["last"]
        if not repeated and found["seen"] is not None and own["at"] is not None and own["at"] <= found["seen"]:
            raise ValueError(f"The run starts at {own['at']}, not after the log's last ingestion time {found['seen']}.")
    shift = 0
    if own["first"] is not None:
        shift = _claimed(spark, storage.claims(source_id, scenario), run_id, own["last"] - own["first"] + 1, own["first"], last) - own["first"]
    placed = feed.withColumns({
        cdc.OFFSET: F.col(cdc.OFFSET) + F.lit(shift),
        "_event_id": F.sha2(F.concat_ws(":", "_event_id", F.lit(run_id)), 256)})
    ordered = placed.repartition(F.expr(f"{cdc.OFFSET} DIV {int(chunk)}")).sortWithinPartitions(cdc.OFFSET)
    ordered.write.mode("overwrite").option("compression", CODEC).parquet(f"{path}/{RUN}={run_id}")
    return path


def capture_changes(
    storage: Storage, source_id: str, before: DataFrame, after: DataFrame, key: str, scenario: str,
    started_at: str, run_id: str | None = None,
) -> telemetry.JobReport:
    """Log what turned one state of an ingested table into the next, at the pace of a scenario, and report it."""
    started, (rate, _), run_id, spark = time.time(), SCENARIOS[scenario], run_id or uuid.uuid4().hex, after.sparkSession
    events = scratch_path(spark, "events")
    try:
        feed = cdc.snapshot_feed(before, after, key, source_id, started_at, rate, scenario, path=events)
        path = write_change_log(feed, storage, source_id, scenario, run_id)
    finally:
        remove(spark, events)
    rows = spark.read.parquet(path).where(F.col(RUN) == f"r-{run_id}").count()
    return _close("capture", source_id, scenario, started, rows)


def _close(name: str, source_id: str, scenario: str, started: float, rows: int) -> telemetry.JobReport:
    return job_report(f"cdc_{name}_{source_id}_{scenario}_{int(started)}", source_id, started,
                   {"records_ingested": rows})


def _write_run(found: DataFrame, path: str, position: str) -> int:
    """Write one run's rows under its start position.

    A run that failed before its commit is overwritten by the next one, which
    starts from the same position: no row is lost and none is there twice.
    """
    target = f"{path}/from={position.replace(':', '-')}"
    found.write.mode("overwrite").option("compression", CODEC).parquet(target)
    return found.sparkSession.read.parquet(target).count()


@dataclass(frozen=True)
class _Wave:
    """Chunks that one job has written, by first offset: the rows each has, none where offsets are missing."""

    spark: SparkSession
    rows: dict[int, int]


def _write_wave(found: DataFrame, path: str, first: int, last: int, step: int) -> _Wave:
    """Write the chunks between two offsets in one job, each to a folder of its own, and count what is there.

    A chunk that an earlier run wrote but did not commit is replaced. The log's files are in
    order, so a task writes one chunk after the other and nothing is shuffled.
    """
    spark = found.sparkSession
    start = F.expr(f"({cdc.OFFSET} - {first}) DIV {step} * {step} + {first}")
    (found.withColumn("from", F.lpad(start.cast("string"), 20, "0")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", CODEC).partitionBy("from").parquet(path))
    folders = [f"{path}/from={n:020d}" for n in range(first, last + 1, step)]
    there = {n for n in _names(spark, path) if n.startswith("from=")}
    kept = [f for f in folders if f.rsplit("/", 1)[1] in there]
    if not kept:
        return _Wave(spark, {})
    written = spark.read.schema(found.schema).parquet(*kept).groupBy(start.alias("from")).agg(F.count(F.lit(1)).alias("rows"))
    return _Wave(spark, {r["from"]: r["rows"] for r in written.collect()})


def _write_chunk(wave: _Wave, path: str, first: int, last: int) -> int:
    """List one chunk that its wave has written: readers see a chunk once its line in the manifest is there."""
    rows = wave.rows.get(first, 0)
    if rows:
        _created(wave.spark, f"{path}/{MANIFEST}/{first:020d}", f"{last} {rows}")
    return rows


def extract_by_log(
    spark: SparkSession, storage: Storage, source_id: str, scenario: str, step: int = STEP,
) -> telemetry.JobReport:
    """New events in chunks of ``step`` offsets: written by waves of many chunks, each listed in turn, then committed.

    A run that fails goes on behind the last chunk it listed, or, if its process ended, behind the last
    wave. A chunk that was written but not committed is written again under its first offset.
    """
    started = time.time()
    log = read_change_log(spark, storage, source_id, scenario)
    if log is None:
        return _close("log", source_id, scenario, started, 0)
    mark, path = storage.checkpoint("log_based", source_id, scenario), storage.extracted(source_id, "log", scenario)
    saved = load_position(spark, mark)
    last = int(saved) if saved is not None else None
    ends = cdc.after_offset(log, last).agg(F.min(cdc.OFFSET).alias("first"), F.max(cdc.OFFSET).alias("last")).first()
    rows, width = 0, max(WAVE // step, 1) * step
    for begin in range(ends["first"], ends["last"] + 1, width) if ends["first"] is not None else ():
        end, listed = min(begin + width - 1, ends["last"]), None
        wave = _write_wave(cdc.after_offset(log, begin - 1, end), path, begin, end, step)
        try:
            for first in range(begin, end + 1, step):
                upto = min(first + step - 1, end)
                rows += _write_chunk(wave, path, first, upto)
                listed = upto
        finally:
            if listed is not None:
                save_position(spark, mark, str(listed))
    return _close("log", source_id, scenario, started, rows)


def extract_by_trigger(spark: SparkSession, storage: Storage, source_id: str, scenario: str) -> telemetry.JobReport:
    """The whole log each time: this strategy keeps no position."""
    started = time.time()
    log = read_change_log(spark, storage, source_id, scenario)
    if log is None:
        return _close("trigger", source_id, scenario, started, 0)
    target = storage.extracted(source_id, "trigger", scenario)
    cdc.triggered(log).write.mode("overwrite").option("compression", CODEC).parquet(target)
    return _close("trigger", source_id, scenario, started, spark.read.parquet(target).count())


def extract_by_timestamp(spark: SparkSession, storage: Storage, source_id: str, scenario: str) -> telemetry.JobReport:
    started = time.time()
    log = read_change_log(spark, storage, source_id, scenario)
    if log is None:
        return _close("ts", source_id, scenario, started, 0)
    mark = storage.checkpoint("timestamp_based", source_id, scenario)
    watermark = load_position(spark, mark)
    upto = log.agg(F.max("_ingestion_timestamp")).first()[0]
    if upto is None or (watermark is not None and upto <= watermark):
        return _close("ts", source_id, scenario, started, 0)
    found = cdc.after_watermark(log, watermark, upto)
    rows = _write_run(found, storage.extracted(source_id, "ts", scenario), watermark or "start")
    save_position(spark, mark, upto)
    return _close("ts", source_id, scenario, started, rows)


def read_extracted(spark: SparkSession, storage: Storage, source_id: str, strategy: str, scenario: str) -> DataFrame:
    """All rows one strategy has extracted so far; of chunks, those that the manifest lists."""
    path = storage.extracted(source_id, strategy, scenario)
    listed = [n for n in _names(spark, f"{path}/{MANIFEST}") if not n.startswith(".")]
    if listed:
        return spark.read.parquet(*[f"{path}/from={n}" for n in listed])
    whole = spark.read.parquet(path).drop("from")
    return whole.where(F.lit(False)) if strategy == "log" else whole
