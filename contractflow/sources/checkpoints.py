"""Extraction positions that survive a restart.

Commits are appended and the latest one counts, so no moment exists in which a
crash could leave no position behind.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from contractflow.operators.audit import path_exists

SCHEMA = "position string, saved_at string, commit_no bigint"


def _latest(spark: SparkSession, path: str):
    if not path_exists(spark, path):
        return None
    found = spark.read.schema(SCHEMA).json(path).agg(
        F.max("commit_no").alias("commit_no"), F.max_by("position", "commit_no").alias("position")).first()
    return found if found["commit_no"] is not None else None


def load_position(spark: SparkSession, path: str) -> str | None:
    """The committed position, or None before the first commit."""
    found = _latest(spark, path)
    return found["position"] if found else None


def save_position(spark: SparkSession, path: str, position: str) -> None:
    found = _latest(spark, path)
    commit_no = found["commit_no"] + 1 if found else 1
    row = (str(position), datetime.now(timezone.utc).isoformat(), commit_no)
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").json(path)
