"""Lookups over finished datasets and jobs."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.model import DATASETS, SOURCES


def dataset_sample(dataset: DataFrame, order: list[str], limit: int = 100) -> DataFrame:
    """The first records in the given order; a top-k per task and not a full sort."""
    return dataset.orderBy(*order).limit(limit)


def low_stock_alerts(warehouse: DataFrame, default_stock: int = 0, default_threshold: int = 100) -> DataFrame:
    """Products whose stock is below the threshold; a column that is absent counts as its default."""
    def or_default(name: str, value: int):
        return F.col(name).cast("bigint") if name in warehouse.columns else F.lit(value).cast("bigint")

    return warehouse.select(
        F.col("product_id"),
        or_default("current_stock", default_stock).alias("current_stock"),
        or_default("reorder_threshold", default_threshold).alias("reorder_threshold"),
        F.lit("Low stock").alias("alert"),
    ).where(F.col("current_stock") < F.col("reorder_threshold"))


def find_job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("job_id") == job_id)


def require_job(jobs: DataFrame, job_id: str) -> DataFrame:
    """As ``find_job``, but an unknown job is an error."""
    found = find_job(jobs, job_id)
    if found.isEmpty():
        raise KeyError(f"Job not found: {job_id}")
    return found


def source_catalogue(spark: SparkSession) -> DataFrame:
    rows = [
        (s.source_id, s.name, s.source_type.value, s.extraction_mode.value, s.change_capture_mode.value,
         s.ingestion_frequency.value, dict(s.expected_schema), list(s.tags))
        for s in SOURCES.values()
    ]
    return spark.createDataFrame(
        rows,
        "source_id string, name string, source_type string, extraction_mode string, change_capture_mode string, "
        "ingestion_frequency string, expected_schema map<string,string>, tags array<string>",
    )


def dataset_catalogue(spark: SparkSession) -> DataFrame:
    rows = [{**asdict(d), "classification_level": d.classification_level.value} for d in DATASETS.values()]
    names = list(rows[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names))
