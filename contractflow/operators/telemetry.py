"""Job counters, report rows and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from contractflow.functions import times
from contractflow.operators.contracts import ACCEPTED, COERCED, DUPLICATE, ERROR, QUARANTINE, REJECT, STATUS

TELEMETRY_SCHEMA = (
    "job_id string, source_id string, start_time string, end_time string, duration_seconds double, "
    "records_ingested bigint, records_failed bigint, records_quarantined bigint, records_coerced bigint, "
    "throughput_rec_sec double, avg_ingestion_latency_sec double, processing_lag_sec double, "
    "file_count_per_partition bigint, snapshot_count bigint, records_duplicate bigint, records_normalized bigint"
)


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def counters(latency_seconds: Column | None = None, changes: str | None = None) -> list[Column]:
    """The counters of one job, as aggregates over judged rows.

    A coerced row counts as ingested and as coerced. Duplicates have a counter
    of their own. Latency is averaged over accepted rows that have an event time.
    """
    status = F.col(STATUS)
    accepted = status.isin(*ACCEPTED)
    found = [
        _count(accepted).alias("records_ingested"),
        _count(status.isin(REJECT, ERROR)).alias("records_failed"),
        _count(status == QUARANTINE).alias("records_quarantined"),
        _count(status == COERCED).alias("records_coerced"),
        _count(status == DUPLICATE).alias("records_duplicate"),
    ]
    if changes is not None:
        found.append(_count(F.col(changes) > 0).alias("records_normalized"))
    if latency_seconds is not None:
        found.append(F.avg(F.when(accepted, latency_seconds)).alias("avg_ingestion_latency_sec"))
    return found


def job_counters(judged: DataFrame, by: list[str] | None = None, **kwargs) -> DataFrame:
    grouped = judged.groupBy(*by) if by else judged.groupBy()
    return grouped.agg(*counters(**kwargs))


def latency_seconds(event_timestamp: Column, ingested_at: str) -> Column:
    """Seconds from the event to its ingestion, NULL where the event has no readable time."""
    event = F.try_to_timestamp(event_timestamp)
    return (F.unix_micros(times.moment_literal(ingested_at)) - F.unix_micros(event)) / F.lit(1_000_000)


def observed(judged: DataFrame, observation: Observation, **kwargs) -> DataFrame:
    """Count while the rows are written, so counting costs no pass of its own."""
    return judged.observe(observation, *counters(**kwargs))


@dataclass
class JobReport:
    """What one job did; turned into one telemetry row."""

    job_id: str
    source_id: str
    start_time: str
    end_time: str
    duration_seconds: float
    records_ingested: int = 0
    records_failed: int = 0
    records_quarantined: int = 0
    records_coerced: int = 0
    records_duplicate: int = 0
    records_normalized: int = 0
    avg_ingestion_latency_sec: float | None = None
    file_count_per_partition: int = 0
    snapshot_count: int = 0

    @property
    def throughput(self) -> float:
        return self.records_ingested / self.duration_seconds if self.duration_seconds > 0 else 0.0

    def row(self) -> tuple:
        return (
            self.job_id, self.source_id, self.start_time, self.end_time, round(self.duration_seconds, 4),
            self.records_ingested, self.records_failed, self.records_quarantined, self.records_coerced,
            round(self.throughput, 2), round(self.avg_ingestion_latency_sec or 0.0, 6),
            round(self.duration_seconds, 4), self.file_count_per_partition, self.snapshot_count,
            self.records_duplicate, self.records_normalized,
        )


def telemetry_table(spark: SparkSession, reports: list[JobReport]) -> DataFrame:
    return spark.createDataFrame([report.row() for report in reports], TELEMETRY_SCHEMA)


def batch_summary(telemetry: DataFrame) -> DataFrame:
    """Totals per source over all its jobs, with the rate over their summed time."""
    totals = telemetry.groupBy("source_id").agg(
        F.sum("records_ingested").alias("ok"),
        F.sum("records_failed").alias("failed"),
        F.sum("records_quarantined").alias("quarantined"),
        F.sum("records_coerced").alias("coerced"),
        F.sum("records_normalized").alias("normalized"),
        F.sum("duration_seconds").alias("_seconds"),
    )
    rate = F.when(F.col("_seconds") > 0, F.col("ok") / F.col("_seconds")).otherwise(F.lit(0.0))
    return totals.withColumn("rate", F.bround(rate, 1)).drop("_seconds")


def job_metrics(jobs: DataFrame) -> DataFrame:
    """Jobs in all, running, and not running; a failed job counts as completed."""
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(F.col("status") == "running").alias("running_jobs"),
    ).withColumn("completed_jobs", F.col("total_jobs") - F.col("running_jobs"))
