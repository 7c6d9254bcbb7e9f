"""Kafka events: the JSON stages as functions, and the connector around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contractflow.model import IOT, SOURCES

# Topic and broker address of the shelf readings.
TOPIC = "supply_chain_inventory"
BROKERS = "localhost:9092"


def event_schema() -> T.StructType:
    return SOURCES[IOT].typed_schema()


def encode_events(events: DataFrame, key: str = "product_id") -> DataFrame:
    """``key`` and JSON ``value`` as text; NULL fields are written, a NULL key stays NULL."""
    columns = [F.col(f"`{name}`") for name in events.columns]
    return events.select(
        F.col(f"`{key}`").cast("string").alias("key"),
        F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"),
    )


def decode_events(messages: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """The events inside ``value``; the message key is kept as ``_key``."""
    parsed = F.from_json(F.col("value").cast("string"), schema or event_schema())
    return messages.select(F.col("key").cast("string").alias("_key"), parsed.alias("_event")).select("_key", "_event.*")


def read_topic(
    spark: SparkSession, brokers: str = BROKERS, topic: str = TOPIC, max_offsets_per_trigger: int | None = None,
) -> DataFrame:
    """A stream of messages from the earliest offset on; positions live in the query's checkpoint.

    Needs the Kafka connector on the class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load()


def write_topic(events: DataFrame, brokers: str = BROKERS, topic: str = TOPIC, key: str = "product_id") -> None:
    """Send a batch of events. Needs the Kafka connector on the class path."""
    (
        encode_events(events, key).write.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("topic", topic)
        .save()
    )
