"""Lineage columns in front of the payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractflow.functions.text import first_filled
from contractflow.model import SCHEMA_VERSION, OperationType

# The lineage columns in output order.
ENVELOPE = (
    "_event_id", "_trace_id", "_source_id", "_dataset_id", "_schema_version", "_operation_type",
    "_event_timestamp", "_source_timestamp", "_ingestion_timestamp",
)
EVENT_TIME_FIELDS = ("mfg_timestamp", "sale_timestamp", "timestamp")
SOURCE_TIME_FIELDS = ("mfg_timestamp", "sale_timestamp")


def _first_present(names: list[str], candidates: tuple[str, ...]) -> Column:
    found = [F.col(f"`{n}`").cast("string") for n in candidates if n in names]
    return first_filled(*found) if found else F.lit(None).cast("string")


def event_time(names: list[str]) -> Column:
    return _first_present(names, EVENT_TIME_FIELDS)


def source_time(names: list[str]) -> Column:
    return _first_present(names, SOURCE_TIME_FIELDS)


def stable_id(label: str, source_id: str, *identity: Column) -> Column:
    """An id that a rerun reproduces; absent parts are written out, not skipped."""
    parts = [F.coalesce(part.cast("string"), F.lit("")) for part in identity]
    return F.sha2(F.concat_ws(":", F.lit(label), F.lit(source_id), *parts), 256)


def lineage(
    source_id: str,
    dataset_id: str,
    identity: list[Column],
    operation: Column | OperationType,
    event_timestamp: Column,
    source_timestamp: Column,
    ingested_at: Column | str,
    schema_version: str = SCHEMA_VERSION,
    random_ids: bool = False,
) -> dict[str, Column]:
    """The nine lineage columns as expressions over one row."""
    def new_id(label: str) -> Column:
        return F.expr("uuid()") if random_ids else stable_id(label, source_id, *identity)

    return {
        "_event_id": new_id("event"),
        "_trace_id": new_id("trace"),
        "_source_id": F.lit(source_id),
        "_dataset_id": F.lit(dataset_id),
        "_schema_version": F.lit(schema_version),
        "_operation_type": F.lit(operation.value) if isinstance(operation, OperationType) else operation,
        "_event_timestamp": event_timestamp,
        "_source_timestamp": source_timestamp,
        "_ingestion_timestamp": F.lit(ingested_at) if isinstance(ingested_at, str) else ingested_at,
    }


def wrap(df: DataFrame, meta: dict[str, Column], payload: list[Column]) -> DataFrame:
    return df.select(*[meta[name].alias(name) for name in ENVELOPE], *payload)


def strip(df: DataFrame) -> DataFrame:
    """The payload of enveloped rows, without lineage or change columns."""
    return df.select(*[F.col(f"`{n}`") for n in df.columns if not n.startswith("_")])
