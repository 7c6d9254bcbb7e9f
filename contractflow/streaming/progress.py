"""Live progress of the streams: rows that batches store themselves, and a listener on observed counters."""

from __future__ import annotations

import time
from collections import deque
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from contractflow.operators import telemetry

#: Names of the observed counters in the query progress.
READ, KEPT = "events_read", "events_kept"
SCHEMA = (
    "query string, batch_id bigint, at string, elapsed_seconds double, events_read bigint, ingested bigint, "
    "failed bigint, quarantined bigint, throughput_rec_sec double"
)


def _row(query: str, batch_id: int, at: str, seconds: float, read: int, kept) -> tuple:
    """Events that neither sink has, resends included, count as failed."""
    ingested, quarantined = kept["records_ingested"] or 0, kept["records_quarantined"] or 0
    rate = ingested / seconds if seconds > 0 else 0.0
    return (query, batch_id, at, seconds, read, ingested, read - ingested - quarantined, quarantined, round(rate, 1))


def store_batch(judged: DataFrame, read: int, started: float, query: str, batch_id: int, path: str) -> None:
    """Write a batch's row of progress under the batch's number, so that a replayed batch replaces it."""
    spark, kept = judged.sparkSession, judged.agg(*telemetry.counters()).first()
    at = datetime.fromtimestamp(started, timezone.utc).isoformat()
    row = _row(query, batch_id, at, time.time() - started, read, kept)
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/number={batch_id}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows that the batches of a stream stored."""
    return spark.read.parquet(path).drop("number")


class ProgressLog(StreamingQueryListener):
    """Collects the progress of every batch; add it with ``spark.streams.addListener``.

    Events dropped as resends count as failed. At most ``held`` rows are kept, the
    latest ones; ``store`` appends what has come in since the last call to a table.
    Streams with a table of seen ids store their rows themselves.
    """

    def __init__(self, held: int = 10_000):
        self.rows: deque[tuple] = deque(maxlen=held)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        metrics = progress.observedMetrics
        if READ not in metrics or KEPT not in metrics:
            return
        self.rows.append(_row(
            progress.name, progress.batchId, progress.timestamp, progress.batchDuration / 1000.0, metrics[READ]["events"], metrics[KEPT]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def store(self, spark: SparkSession, path: str) -> None:
        """Append the batches that were not stored yet."""
        rows = [self.rows.popleft() for _ in range(len(self.rows))]
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), SCHEMA)
