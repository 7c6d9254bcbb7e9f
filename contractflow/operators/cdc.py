"""Change feed and the three ways to extract from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contractflow.functions import draws, numbers, times
from contractflow.model import OperationType, dataset_for
from contractflow.operators import dedup, envelope
from contractflow.operators.rows import ROW
from contractflow.session import scratch_path

OFFSET, OPERATION = "_log_offset", "_operation_type"
CHANGE_COLUMNS = ("_cdc_op", "_updated_at", "_deleted_at")

# Shares of the operations in percent, and the columns an update may change.
INSERT_SHARE, UPDATE_SHARE, DELETE_SHARE = 60, 30, 10
MUTABLE_FIELDS = ("quantity_produced", "units_sold", "current_stock_on_shelf", "unit_cost")
UPDATE_LOW, UPDATE_SPAN = 0.8, 0.4

#: Draw streams of the feed.
_PICK_OPERATION, _PICK_TARGET, _PICK_FACTOR = 11, 12, 13


def percent() -> Column:
    """The draw of a seeded row that decides its operation."""
    return draws.below(_PICK_OPERATION, 100)


def change_operation(drawn: Column) -> Column:
    """UPDATE or DELETE of a row that is no INSERT."""
    return F.when(drawn < INSERT_SHARE + UPDATE_SHARE, F.lit(OperationType.UPDATE.value)).otherwise(
        F.lit(OperationType.DELETE.value))


def operation_of() -> Column:
    """INSERT, UPDATE or DELETE of a seeded row by weight."""
    return F.when(percent() < INSERT_SHARE, F.lit(OperationType.INSERT.value)).otherwise(change_operation(percent()))


def _as_number(df: DataFrame, name: str) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        return numbers.parse_float(value)
    return value.cast("double")


def _numbers_as_doubles(df: DataFrame) -> DataFrame:
    """The columns an update may scale, in the type the scaled values have."""
    numeric = [n for n in MUTABLE_FIELDS if n in df.columns and isinstance(df.schema[n].dataType, T.NumericType)]
    return df.withColumns({n: F.col(n).cast("double") for n in numeric}) if numeric else df


def _mutate(df: DataFrame) -> DataFrame:
    """On updates, scale the first usable number by 0.8 to 1.2, to two decimals."""
    names = [n for n in MUTABLE_FIELDS if n in df.columns]
    factor = F.lit(UPDATE_LOW) + draws.uniform(_PICK_FACTOR) * F.lit(UPDATE_SPAN)
    changed, earlier = {}, F.lit(False)
    for name in names:
        number = _as_number(df, name)
        chosen = (F.col("_op") == OperationType.UPDATE.value) & ~earlier & number.isNotNull()
        scaled = numbers.half_even(number * factor, 2)
        if isinstance(df.schema[name].dataType, T.StringType):
            changed[name] = F.when(chosen, scaled.cast("string")).otherwise(F.col(f"`{name}`"))
        else:
            changed[name] = F.when(chosen, scaled).otherwise(number)
        earlier = earlier | number.isNotNull()
    return df.withColumns(changed) if changed else df


def change_feed(
    new_rows: DataFrame,
    existing: DataFrame | None,
    source_id: str,
    started_at: str,
    rate: float,
    scenario: str = "steady",
    first_offset: int = 0,
    existing_count: int | None = None,
) -> DataFrame:
    """One event per new row: the row itself as an INSERT, or a change of an existing row.

    Both inputs carry dense row numbers in ``_row``. The changed row is drawn
    uniformly by number, so the join is on evenly spread unique numbers; a number
    that no existing row has fails the job, so no event is lost. Lineage
    columns of existing rows are dropped, so the event's own envelope counts.
    Event ``i`` happens ``i / rate`` seconds after the start.
    """
    total = 0
    if existing is not None:
        total = existing.count() if existing_count is None else existing_count
    insert = OperationType.INSERT.value
    payload = [n for n in new_rows.columns if not n.startswith("_")]
    numbered = new_rows.withColumn(OFFSET, F.col(ROW) - 1 + first_offset)
    if total == 0:  # nothing to change yet, so everything is new
        events = _numbers_as_doubles(numbered.select(OFFSET, F.lit(insert).alias("_op"), *payload))
        return _enveloped(events, source_id, started_at, rate, scenario)
    drawn = draws.seeded(numbered, OFFSET)
    inserts = drawn.where(percent() < INSERT_SHARE).select(OFFSET, F.lit(insert).alias("_op"), *payload)
    aimed = drawn.where(percent() >= INSERT_SHARE).select(
        OFFSET, draws.SEED, (draws.below(_PICK_TARGET, total) + 1).alias(ROW))
    kept = existing.select(
        ROW, F.lit(True).alias("_found"), *[F.col(f"`{n}`") for n in existing.columns if not n.startswith("_")])
    missing = F.raise_error(F.lit("The existing rows are not numbered 1, 2, 3 without gaps.")).cast("boolean")
    changed = aimed.join(kept, ROW, "left").where(F.coalesce("_found", missing)).drop(ROW, "_found")
    changed = changed.withColumn("_op", change_operation(percent()))
    events = _numbers_as_doubles(inserts).unionByName(draws.unseeded(_mutate(changed)), allowMissingColumns=True)
    return _enveloped(events, source_id, started_at, rate, scenario)


def snapshot_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What turned one state of a table into the next: ``_op``, the row, and ``_digest``, which tells events apart.

    States are compared as multisets of rows: equal rows of both cancel out in one
    aggregation that combines before its shuffle, so neither a frequent key nor many
    equal rows meet in one task, and only rows that changed go on. A key with
    exactly one row less and one row more was updated; all other rows less are
    deletes and all rows more are inserts, those without a key too. Deletes carry the row
    as it was.
    """
    names = [n for n in after.columns if not n.startswith("_")]
    absent = [n for n in names if n not in before.columns]
    old = before.withColumns({n: F.lit(None).cast(after.schema[n].dataType) for n in absent}) if absent else before
    columns = [F.col(f"`{n}`") for n in names]
    signed = old.select(*columns, F.lit(-1).alias("_n")).unionByName(after.select(*columns, F.lit(1).alias("_n")))
    changed = signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    keyed, keyless = changed.where(F.col(key).isNotNull()), changed.where(F.col(key).isNull())
    pairs = keyed.groupBy(key).agg(
        F.sum(F.abs("_n")).alias("_rows"), F.sum("_n").alias("_balance"), F.max_by(F.struct(*columns), "_n").alias("_row_now"))
    updated = pairs.where("_rows = 2 AND _balance = 0 AND _row_now IS NOT NULL")
    single = keyed.join(updated.select(key), key, "left_anti").select(*columns, "_n").unionByName(keyless)
    copies = single.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int"))))
    insert, update, delete = OperationType.INSERT.value, OperationType.UPDATE.value, OperationType.DELETE.value
    events = copies.select(F.when(F.col("_n") > 0, insert).otherwise(delete).alias("_op"), "_copy", *columns).unionByName(
        updated.select(F.lit(update).alias("_op"), F.lit(1).alias("_copy"), "_row_now.*"))
    texts = [F.coalesce(c.cast("string"), F.lit("~")) for c in columns]
    return events.withColumn("_digest", F.md5(F.concat_ws("|", "_op", F.col("_copy").cast("string"), *texts).cast("binary"))).drop("_copy")


def dense_offsets(events: DataFrame, digest: str = "_digest", first_offset: int = 0, path: str | None = None) -> DataFrame:
    """Number events in the order of their digests, without a gap and without a sort of the whole.

    Digests spread evenly, so their first three digits deal the events to 4096 parts
    of about one size. The events are written once to ``path`` (a new one in the shared folder by
    default), each part in one file and in order; so a row's place in its file gives its place in its part, the sum of
    the parts before it is a list of at most 4096 numbers, and whatever reads the
    numbered events does not compute them again.
    """
    spark, path = events.sparkSession, path or scratch_path(events.sparkSession, "events")
    dealt = events.withColumn("_part", F.substr(digest, F.lit(1), F.lit(3)))
    dealt.repartition("_part").sortWithinPartitions("_part", digest).write.option("maxRecordsPerFile", 0).parquet(path)
    placed = spark.read.schema(dealt.schema).parquet(path).withColumn("_place", F.col("_metadata.row_index"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first")).select(
        "_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    numbered = placed.join(F.broadcast(starts), "_part")
    return numbered.withColumn(OFFSET, F.col("_start") + F.col("_place") + first_offset).drop("_part", "_place", "_start", digest)


def snapshot_feed(
    before: DataFrame, after: DataFrame, key: str, source_id: str, started_at: str, rate: float,
    scenario: str = "steady", first_offset: int = 0, path: str | None = None,
) -> DataFrame:
    """The change feed between two states of a table; event ``i`` happens ``i / rate`` seconds after the start.

    The states are compared once; the events found stand at ``path``, and the feed reads them.
    """
    numbered = dense_offsets(snapshot_changes(before, after, key), first_offset=first_offset, path=path)
    payload = [F.col(f"`{n}`") for n in numbered.columns if not n.startswith("_")]
    return _enveloped(_numbers_as_doubles(numbered.select(OFFSET, "_op", *payload)), source_id, started_at, rate, scenario)


def _enveloped(events: DataFrame, source_id: str, started_at: str, rate: float, scenario: str) -> DataFrame:
    start = F.unix_micros(times.moment_literal(started_at))
    moment = F.timestamp_micros(start + F.floor(F.col(OFFSET) * F.lit(1_000_000.0 / rate)).cast("bigint"))
    stamped = events.withColumn("_at", times.iso_utc(moment))
    at, op = F.col("_at"), F.col("_op")
    meta = envelope.lineage(
        source_id, dataset_for(source_id), [F.lit(scenario), F.col(OFFSET)], op,
        at, F.lit(None).cast("string"), at)
    payload = [F.col(f"`{n}`") for n in events.columns if not n.startswith("_")]
    return envelope.wrap(stamped, meta, [
        *payload,
        op.alias("_cdc_op"),
        F.when(op == OperationType.UPDATE.value, at).alias("_updated_at"),
        F.when(op == OperationType.DELETE.value, at).alias("_deleted_at"),
        F.col(OFFSET),
    ])


def after_offset(log: DataFrame, last: int | None, upto: int | None = None) -> DataFrame:
    """Log-based: every event past the committed offset, of any operation."""
    found = log if last is None else log.where(F.col(OFFSET) > last)
    return found if upto is None else found.where(F.col(OFFSET) <= upto)


def triggered(log: DataFrame) -> DataFrame:
    """Trigger-based: updates and deletes, the first of each event id."""
    changes = log.where(F.col(OPERATION).isin(OperationType.UPDATE.value, OperationType.DELETE.value))
    return dedup.keep_first(changes, F.coalesce("_event_id", F.lit("")), [OFFSET])


def after_watermark(log: DataFrame, watermark: str | None, upto: str | None = None) -> DataFrame:
    """Timestamp-based: events ingested strictly after the watermark.

    Ingestion times are canonical UTC text, whose order is the order in time, so
    the comparison reaches the file statistics.
    """
    found = log if watermark is None else log.where(F.col("_ingestion_timestamp") > watermark)
    return found if upto is None else found.where(F.col("_ingestion_timestamp") <= upto)


def operation_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(OPERATION).agg(F.count(F.lit(1)).alias("events"))
