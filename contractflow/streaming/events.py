"""The shelf-reading stream: deduplicate, check, wrap, write two sinks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contractflow.functions import times
from contractflow.model import IOT, DataContract, OperationType, dataset_for
from contractflow.operators import cdc, contracts, envelope, telemetry
from contractflow.operators.dedup import keep_first
from contractflow.plans.batch import payload_of, utc_now
from contractflow.session import scratch_path
from contractflow.sources.files import Storage, exists, remove
from contractflow.sources.kafka import decode_events
from contractflow.streaming import progress
from contractflow.streaming.progress import KEPT, READ


def drop_resends(events: DataFrame, within: str | None = None) -> DataFrame:
    """The first reading of each event id.

    Without ``within`` every id ever seen stays in the state. With it (such as
    "10 minutes") an id is forgotten once the event time has moved on that far,
    which bounds the state, and readings that come later than that are dropped
    with the resends, even first ones. ``SeenIds`` bounds the state and keeps them. Copies of one id meet in one task, so the size of a
    batch, which is set on the source, bounds that task too.
    """
    if within is None:
        return events.dropDuplicates(["event_id"])
    timed = events.withColumn("_event_time", times.parse_timestamp(F.col("timestamp")))
    return timed.withWatermark("_event_time", within).dropDuplicatesWithinWatermark(["event_id"]).drop("_event_time")


class SeenIds:
    """The ids a stream has taken, in a table by event date and batch.

    A batch is held against the dates its own events have, whenever these were,
    so a first reading is kept however late it comes and a resend is dropped
    however late it comes; nothing stays on the heap between batches. A resend has
    the timestamp of its reading: the same id on another date is another reading.
    Readings without a usable timestamp have a date of their own.

    What batch ``n`` took is written under ``n`` and only batches before ``n`` are
    read, so a replayed batch decides as it did the first time.
    """

    DATE, TAKEN = "event_date", "batch"
    SCHEMA = "event_id string, event_date string, batch bigint"

    def __init__(self, path: str):
        self.path = path

    def dated(self, events: DataFrame) -> DataFrame:
        day = F.date_format(times.parse_timestamp(F.col("timestamp")), "yyyy-MM-dd")
        return events.withColumn(self.DATE, F.coalesce(day, F.lit("none")))

    def before(self, spark: SparkSession, dates: list[str], batch_id: int) -> DataFrame:
        """Ids that earlier batches took on these dates; folders of other dates are not listed."""
        paths = [p for p in (f"{self.path}/{self.DATE}={d}" for d in dates) if exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], self.SCHEMA)
        table = spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(*paths)
        return table.where(F.col(self.TAKEN) < batch_id)

    def first_readings(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The readings of a batch that no batch before had, each id once, with their date."""
        own = self.dated(batch)
        whole = F.to_json(F.struct(*batch.columns))
        once = keep_first(own.withColumn("_whole", whole), F.concat_ws("\u0001", self.DATE, "event_id"), ["timestamp", "_whole"]).drop("_whole")
        dates = [r[0] for r in own.select(self.DATE).distinct().collect()]  # at most one a reading of the batch
        return once.join(self.before(batch.sparkSession, dates, batch_id).select("event_id", self.DATE), ["event_id", self.DATE], "left_anti")

    def take(self, fresh: DataFrame, batch_id: int) -> None:
        (fresh.select("event_id", self.DATE, F.lit(batch_id).cast("bigint").alias(self.TAKEN)).repartition(self.DATE)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.DATE, self.TAKEN).parquet(self.path))


def judge_events(
    events: DataFrame, dedup: bool = True, within: str | None = None, contract: DataContract | None = None,
) -> DataFrame:
    """Events with their status. Readings are not normalized."""
    kept = drop_resends(events, within) if dedup else events
    return contracts.apply_contract(kept, contract or contracts.contract_of(IOT))


def good_events(judged: DataFrame, ingested_at: str) -> DataFrame:
    """Accepted events as INSERTs; event and source time are the reading's own."""
    at = F.col("timestamp")
    meta = envelope.lineage(
        IOT, dataset_for(IOT), [F.col("event_id")], OperationType.INSERT, at, at, ingested_at)
    accepted = judged.where(F.col(contracts.STATUS).isin(*contracts.ACCEPTED))
    return envelope.wrap(accepted, meta, contracts.accepted_payload(judged, payload_of(judged)))


def quarantined_events(judged: DataFrame) -> DataFrame:
    refused = judged.where(F.col(contracts.STATUS).isin(contracts.QUARANTINE, contracts.REJECT))
    return refused.select(
        *[F.col(f"`{n}`") for n in payload_of(judged)], F.to_json(contracts.VIOLATIONS).alias("_violations"))


def write_two_sinks(
    storage: Storage, name: str, hook: Callable[[DataFrame], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A batch writer. Its paths contain the batch number, so a replayed batch replaces itself."""
    def write(judged: DataFrame, batch_id: int) -> None:
        judged.persist()  # two sinks, one evaluation; lost blocks are recomputed
        try:
            good = good_events(judged, utc_now())
            good.write.mode("overwrite").parquet(f"{storage.stream(name)}/batch={batch_id}")
            quarantined_events(judged).write.mode("overwrite").parquet(
                f"{storage.stream_quarantine(name)}/batch={batch_id}")
            if isinstance(hook, ExactFiles):
                hook(good, batch_id)
            elif hook is not None:
                hook(good)
        finally:
            judged.unpersist()
    return write


def write_first_readings(
    storage: Storage, name: str, hook: Callable[[DataFrame], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """As ``write_two_sinks`` for raw batches: ids are held against ``SeenIds``, then judged and written.

    The ids are noted last, so a batch that fails is decided anew. A row of progress
    is stored under the name and number of each batch.
    """
    seen = SeenIds(storage.stream_seen(name))

    def write(batch: DataFrame, batch_id: int) -> None:
        started = time.time()
        batch.persist()
        fresh = seen.first_readings(batch, batch_id).persist()
        judged = judge_events(fresh.select(*batch.columns), dedup=False).persist()
        try:
            write_two_sinks(storage, name, hook)(judged, batch_id)
            seen.take(fresh, batch_id)
            progress.store_batch(judged, batch.count(), started, name, batch_id, storage.stream_progress(name))
        finally:
            for frame in (judged, fresh, batch):
                frame.unpersist()
    return write


class ExactFiles:
    """A hook that writes accepted events in files of exactly ``rows`` events, across batches and restarts.

    A batch's events are numbered on from those before it, and a number decides the
    file. What does not fill a file is kept as the batch's remainder and opens the
    next batch's first file; ``flush`` writes the last remainder. Batch ``n`` reads the
    remainder of the batch before it and replaces what an earlier try of ``n`` wrote.
    """

    FILE = "file"

    def __init__(self, storage: Storage, name: str, rows: int):
        self.path, self.kept, self.rows = storage.stream_files(name), storage.stream_carry(name), rows

    def _before(self, spark: SparkSession, batch_id: int) -> tuple[int, DataFrame | None]:
        """How many events came before a batch, and the remainder that it starts with."""
        if not exists(spark, f"{self.kept}/totals"):
            return 0, None
        totals = spark.read.parquet(f"{self.kept}/totals").where(F.col("number") < batch_id)
        last = totals.agg(F.max(F.struct("number", "total")).alias("x")).first()["x"]
        if last is None:
            return 0, None
        return last["total"], spark.read.parquet(f"{self.kept}/rest/number={last['number']}")

    def __call__(self, good: DataFrame, batch_id: int) -> None:
        spark = good.sparkSession
        before, rest = self._before(spark, batch_id)
        path = scratch_path(spark, "events")
        try:
            numbered = cdc.dense_offsets(good.withColumn("_digest", F.col("_event_id")), first_offset=before, path=path).withColumnRenamed(
                cdc.OFFSET, "_place")
            total = before + numbered.count()
            whole = numbered if rest is None else rest.unionByName(numbered)
            filed = whole.withColumn(self.FILE, F.expr(f"_place DIV {self.rows}"))
            (filed.where(F.col(self.FILE) < total // self.rows).drop("_place").repartition(self.FILE)
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.FILE).parquet(self.path))
            # Less than one file is left over. It goes to its task by a shuffle: one task must not read the whole batch for it.
            filed.where(F.col(self.FILE) >= total // self.rows).drop(self.FILE).repartition(1).write.mode("overwrite").parquet(
                f"{self.kept}/rest/number={batch_id}")
            spark.createDataFrame([(total,)], "total bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.kept}/totals/number={batch_id}")
        finally:
            remove(spark, path)

    def flush(self, spark: SparkSession) -> None:
        """Write the last remainder as a file of fewer events."""
        total, rest = self._before(spark, 1 << 62)
        if rest is not None and total % self.rows:
            rest.drop("_place").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{self.FILE}={total // self.rows}")


def run_events(
    events: DataFrame,
    storage: Storage,
    name: str,
    dedup: bool = True,
    within: str | None = None,
    available_now: bool = True,
    interval: str = "5 seconds",
    hook: Callable[[DataFrame], None] | None = None,
    seen_table: bool = False,
) -> StreamingQuery:
    """Start the stream. It resumes from its checkpoint; batch size is set on the source.

    ``hook`` receives the accepted events of every batch as a DataFrame (``ExactFiles`` the batch's number too). With
    ``seen_table`` the ids are kept in a table by date and not in state.
    """
    if seen_table:
        judged, write = events, write_first_readings(storage, name, hook)
    else:
        read = events.observe(READ, F.count(F.lit(1)).alias("events"))
        judged = judge_events(read, dedup, within).observe(KEPT, *telemetry.counters())
        write = write_two_sinks(storage, name, hook)
    writer = (
        judged.writeStream.queryName(name)
        .option("checkpointLocation", f"{storage.area('checkpoints')}/stream_{name}")
        .foreachBatch(write)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def run_topic(messages: DataFrame, storage: Storage, name: str, **options) -> StreamingQuery:
    """The same over broker messages, by default without deduplication."""
    options.setdefault("dedup", False)
    return run_events(decode_events(messages).drop("_key"), storage, name, **options)


def read_sinks(spark: SparkSession, storage: Storage, name: str) -> tuple[DataFrame, DataFrame]:
    """Everything the stream has written so far: accepted and quarantined events."""
    return (
        spark.read.parquet(storage.stream(name)).drop("batch"),
        spark.read.parquet(storage.stream_quarantine(name)).drop("batch"),
    )
