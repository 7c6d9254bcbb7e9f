"""Streams over files that arrive one after another."""

import json
import time

from pyspark.sql import functions as F
from test_contracts import GOOD

from contractflow.model import IOT
from contractflow.sources import kafka
from contractflow.streaming import events as streaming
from contractflow.streaming.progress import ProgressLog, stored


def write_events(spark, folder, ids, zone="ZONE-A", minute=0):
    rows = [(f"e{i}", f"2026-04-07T12:{minute:02d}:00+00:00", "P", zone, 5, "50%") for i in ids]
    spark.createDataFrame(rows, kafka.event_schema()).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    return spark.readStream.schema(kafka.event_schema()).option("maxFilesPerTrigger", 1).parquet(folder)


def test_resumes_and_remembers_ids(spark, storage, tmp_path):
    folder = str(tmp_path / "in")
    write_events(spark, folder, [1, 2, 2, 3])
    streaming.run_events(stream_of(spark, folder), storage, "s").awaitTermination()
    write_events(spark, folder, [3, 4])
    write_events(spark, folder, [5], zone="ZONE-X")
    streaming.run_events(stream_of(spark, folder), storage, "s").awaitTermination()
    good, refused = streaming.read_sinks(spark, storage, "s")
    assert sorted(r["event_id"] for r in good.collect()) == ["e1", "e2", "e3", "e4"]
    row = refused.first()
    assert row["event_id"] == "e5" and "ZONE-X" in json.loads(row["_violations"])[0]
    first = good.first()
    assert first["_operation_type"] == "INSERT" and first["_event_timestamp"] == first["_source_timestamp"] == first["timestamp"]


def test_without_dedup_resends_pass(spark, storage, tmp_path):
    folder = str(tmp_path / "in")
    write_events(spark, folder, [1, 1, 2])
    streaming.run_events(stream_of(spark, folder), storage, "s", dedup=False).awaitTermination()
    assert streaming.read_sinks(spark, storage, "s")[0].count() == 3


def test_bounded_state_still_drops_close_resends(spark, storage, tmp_path):
    folder = str(tmp_path / "in")
    write_events(spark, folder, [1, 2], minute=0)
    write_events(spark, folder, [2, 3], minute=5)
    streaming.run_events(stream_of(spark, folder), storage, "s", within="10 minutes").awaitTermination()
    assert sorted(r["event_id"] for r in streaming.read_sinks(spark, storage, "s")[0].collect()) == ["e1", "e2", "e3"]


def test_replayed_batch_replaces_itself(spark, storage):
    frame = spark.createDataFrame([tuple(GOOD[IOT].values())], kafka.event_schema())
    write = streaming.write_two_sinks(storage, "s")
    for _ in range(2):
        write(streaming.judge_events(frame, dedup=False), 0)
    assert streaming.read_sinks(spark, storage, "s")[0].count() == 1


def test_hook_gets_accepted_events(spark, storage, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    write_events(spark, folder, [1, 2])
    write_events(spark, folder, [3], zone="ZONE-X")
    query = streaming.run_events(
        stream_of(spark, folder), storage, "s", hook=lambda good: seen.extend(r["event_id"] for r in good.collect()))
    query.awaitTermination()
    assert sorted(seen) == ["e1", "e2"]


def test_progress(spark, storage, tmp_path):
    folder, log = str(tmp_path / "in"), ProgressLog()
    write_events(spark, folder, [1, 2, 2])
    write_events(spark, folder, [3], zone="ZONE-X")
    spark.streams.addListener(log)
    try:
        streaming.run_events(stream_of(spark, folder), storage, "watched").awaitTermination()
        deadline = time.time() + 20
        while len(log.rows) < 2 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    totals = log.table(spark).agg(*[F.sum(n) for n in ("events_read", "ingested", "failed", "quarantined")]).first()
    assert tuple(totals) == (4, 2, 1, 1)


def test_broker_messages(spark, storage, tmp_path):
    folder = str(tmp_path / "wire")
    events = spark.createDataFrame(
        [("e1", "2026-04-07T12:00:00+00:00", "P", "ZONE-A", 5, None), ("e1", "2026-04-07T12:00:00+00:00", "P", "ZONE-X", 5, "9%")],
        kafka.event_schema())
    sent = kafka.encode_events(events)
    assert json.loads(sent.first()["value"])["battery_level"] is None
    sent.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")).write.parquet(folder)
    messages = spark.readStream.schema("key binary, value binary").parquet(folder)
    streaming.run_topic(messages, storage, "topic").awaitTermination()
    good, refused = streaming.read_sinks(spark, storage, "topic")
    assert (good.count(), refused.count()) == (1, 1)


def test_table_of_seen_ids_keeps_late_first_readings(spark, storage, tmp_path):
    """Days out of order, resends in the same and in later batches, an id on two days, times that can't be read."""
    folder = str(tmp_path / "in")

    def land(*rows):
        spark.createDataFrame([(i, t, "P", "ZONE-A", 5, "50%") for i, t in rows], kafka.event_schema()).coalesce(1).write.mode("append").parquet(folder)
        streaming.run_events(stream_of(spark, folder), storage, "s", seen_table=True).awaitTermination()

    land(("e1", "2026-04-07T12:00:00+00:00"), ("e1", "2026-04-07T12:00:00+00:00"), ("e2", "2026-04-07T13:00:00+00:00"))
    land(("e0", "2025-01-01T00:00:00+00:00"), ("e2", "2026-04-07T13:00:00+00:00"), ("e1", "2026-04-08T12:00:00+00:00"), ("e9", "soon"))
    land(("e0", "2025-01-01T00:00:00+00:00"), ("e9", "soon"), ("e3", "2024-01-01T00:00:00+00:00"))
    good, refused = streaming.read_sinks(spark, storage, "s")
    taken = sorted((r["event_id"], r["timestamp"][:4]) for r in good.select("event_id", "timestamp").union(
        refused.select("event_id", "timestamp")).collect())
    assert taken == [("e0", "2025"), ("e1", "2026"), ("e1", "2026"), ("e2", "2026"), ("e3", "2024"), ("e9", "soon")]
    rows = stored(spark, storage.stream_progress("s")).orderBy("batch_id").collect()
    assert [(r["events_read"], r["ingested"] + r["quarantined"], r["failed"]) for r in rows] == [(3, 2, 1), (4, 3, 1), (3, 1, 2)]


def test_a_replayed_batch_decides_as_before(spark, storage):
    frame = spark.createDataFrame([tuple(GOOD[IOT].values())], kafka.event_schema())
    write = streaming.write_first_readings(storage, "s")
    for number in (0, 0, 1):
        write(frame, number)
    assert streaming.read_sinks(spark, storage, "s")[0].count() == 1
    seen = streaming.SeenIds(storage.stream_seen("s"))
    assert spark.read.parquet(seen.path).count() == 1


def test_files_of_exact_size_across_batches_and_replays(spark, storage):
    exact = streaming.ExactFiles(storage, "s", 4)

    def good(first, n):
        return spark.range(first, first + n).select(F.sha2(F.col("id").cast("string"), 256).alias("_event_id"), "id")

    exact(good(0, 3), 0)
    for _ in range(2):
        exact(good(3, 6), 1)
    exact(good(9, 0), 2)
    exact(good(9, 4), 3)
    exact.flush(spark)
    rows = spark.read.parquet(storage.stream_files("s")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.collect_list("id").alias("ids")).collect()
    assert {r["file"]: r["n"] for r in rows} == {0: 4, 1: 4, 2: 4, 3: 1}
    assert sorted(i for r in rows for i in r["ids"]) == list(range(13))


def test_a_remainder_is_not_read_by_one_task(spark, storage, monkeypatch):
    """What fills no file is filtered by all tasks; only a row of totals is ever put into one without a shuffle."""
    good = spark.range(0, 1003, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("_event_id"), "id")
    real, seen = type(good).coalesce, []
    monkeypatch.setattr(type(good), "coalesce", lambda self, n: (seen.append(self.columns), real(self, n))[1])
    exact = streaming.ExactFiles(storage, "s", 10)
    exact(good, 0)
    assert seen == [["total"]]
    exact.flush(spark)
    rows = spark.read.parquet(storage.stream_files("s")).groupBy("file").count().collect()
    assert sorted(r["count"] for r in rows) == [3] + [10] * 100
