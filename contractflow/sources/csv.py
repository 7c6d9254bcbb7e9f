"""CSV files as numbered records: split-wise, whatever header each file has, with quoted line breaks.

The files are read as lines of text in splits. One pass over the lines gives each
split's size and each file's header; records are then parsed with the header of
their own file, all headers in the same scan, and get the split's offset plus the
place within it as their number.

With quoted line breaks a split may begin inside a quoted value. The first pass
then counts each split's quotes and, for both cases, its record starts; the sums
of the quotes before tell which case holds. A task joins the lines of the records
that begin and end in its split. What crosses a split's end is handed on as
pieces, two a split at most, which are put together by their order, so no file has
to be in one task. A quote that is never closed makes one record of the rest of its
file, as in any reader of this format.
"""

from __future__ import annotations

import csv as plain_csv
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contractflow.operators.contracts import MALFORMED
from contractflow.operators.rows import ROW
from contractflow.session import scratch_path

#: Splits up to which their list is handed to every task; beyond it lines are sorted by split.
SPLITS_SENT = 100_000
#: Bytes of text that one task joins to records, in however many splits.
TASK_BYTES = 32 << 20
#: Different headers one source may have.
HEADERS = 256

_COMPLETE, _HEAD, _THROUGH, _OPEN = range(4)


class HeaderError(Exception):
    """A file whose header can't be used."""


def _lines(spark: SparkSession, path: str, line_break: str | None) -> DataFrame:
    reader = spark.read if line_break is None else spark.read.option("lineSep", line_break)
    scan = reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    # Lines without anything in them are no records, but they may be part of a quoted value.
    kept = scan if line_break else scan.where(F.trim("value") != "")
    return kept.withColumn("_at", F.monotonically_increasing_id())


def _placed(splits: DataFrame) -> DataFrame:
    """Each split's ``_shift``, the records before it in all files without their headers, and its file's header."""
    inside = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("_file").agg(
        F.min("_start").alias("_head"), (F.sum("size") - 1).alias("records"), F.min_by("first", "_start").alias("header"))
    # One row a file, so this window runs over the file list and not over data.
    before = Window.orderBy(F.length("_file"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_before", F.coalesce(F.sum("records").over(before), F.lit(0)))
    within = splits.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(files, "_file").withColumn("_shift", F.col("_before") + F.col("_within") - 1)


def _names(header: str) -> list[str]:
    names = next(plain_csv.reader([header.removeprefix("﻿")], strict=False), [])
    filled = [n or f"_c{i}" for i, n in enumerate(names)]
    return [f"{n}{i}" if filled.count(n) > 1 else n for i, n in enumerate(filled)]


def _parsed(records: DataFrame, headers: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns of all headers by name; those a record's own header lacks are NULL and named in no way."""
    options = {"mode": "PERMISSIVE", "quote": '"', "escape": '"', "columnNameOfCorruptRecord": MALFORMED}
    listed = {h: _names(h) for h in headers}
    union = list(dict.fromkeys(n for h in headers for n in listed[h]))
    if not union:
        return records.select(ROW), []
    # Each record is parsed once, as the struct of its own header; taken apart in the same step it would be parsed once a column.
    parsed, cells = {}, {n: [] for n in (*union, MALFORMED)}
    for number, (header, names) in enumerate(listed.items()):
        schema = ", ".join(f"`{n}` STRING" for n in (*names, MALFORMED))
        parsed[f"_p{number}"] = F.when(F.col("header") == header, F.from_csv("value", schema, options))
        for n in (*names, MALFORMED):
            cells[n].append(F.col(f"_p{number}").getField(n))
    structs = records.select(*[c.alias(n) for n, c in parsed.items()], ROW)
    return structs.select(*[(own[0] if len(own) == 1 else F.coalesce(*own)).alias(n) for n, own in cells.items()], ROW), union


def records(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, list[str]]:
    """The records of all files as text columns with ``_malformed`` and ``_row``, and the names that headers gave."""
    found, splits = _joined(spark, path) if multi_line else _single(spark, path)
    headers = [r["header"] for r in splits.select("header").distinct().limit(HEADERS + 1).collect()]
    if len(headers) > HEADERS:
        raise HeaderError(f"More than {HEADERS} different headers in {path}")
    if None in headers:
        raise HeaderError(f"A header in {path} has a quote that is not closed")
    return _parsed(found, headers)


def _kept(frame: DataFrame, label: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _sent(splits: DataFrame) -> DataFrame:
    """The split list, for the join: lines then stay in their tasks as long as it is short."""
    return F.broadcast(splits) if splits.count() <= SPLITS_SENT else splits


def _single(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = _lines(spark, path, None)
    # Counted without their texts, which would have to be sorted; the first lines are looked up by their place.
    sizes = _kept(lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("size"), F.min("_at").alias("_base")), "sizes")
    heads = sizes.groupBy("_file").agg(F.min_by("_base", "_start").alias("_at"))
    firsts = lines.join(_sent(heads), ["_file", "_at"]).select("_file", F.col("_at").alias("_base"), F.col("value").alias("first"))
    splits = _kept(_placed(sizes.join(firsts, ["_file", "_base"], "left")), "splits")
    numbered = lines.join(_sent(splits).select("_file", "_start", "_shift", "_base", "_head", "header"), ["_file", "_start"])
    is_header = (F.col("_start") == F.col("_head")) & (F.col("_at") == F.col("_base"))
    return numbered.where(~is_header).select("value", "header", (F.col("_at") - F.col("_base") + 1 + F.col("_shift")).alias(ROW)), splits


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """Runs of lines of one split."""
    keys = list(zip(batch.column("_file").to_pylist(), batch.column("_start").to_pylist()))
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield keys[start], start, i
            start = i


def _quotes(batch: pa.RecordBatch) -> list[int]:
    return pc.count_substring(batch.column("value"), '"').to_pylist()


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each split's quotes, its record starts if it begins outside quotes and inside, and its first record."""
    names = ["_file", "_start", "quotes", "outside", "inside", "first"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    key, odd, starts, first, done, total = None, 0, [0, 0], [], False, 0
    for batch in batches:
        values, quotes = batch.column("value").to_pylist(), _quotes(batch)
        for new, begin, end in _segments(batch):
            if new != key:
                if key is not None:
                    yield out([(*key, total, *starts, "\n".join(first).removesuffix("\r") if done else None)])
                key, odd, starts, first, done, total = new, 0, [0, 0], [], False, 0
            for i in range(begin, end):
                if values[i].strip():
                    starts[odd] += 1
                if not done and (first or values[i].strip()):
                    first.append(values[i])
                odd ^= quotes[i] & 1
                total += quotes[i]
                done |= bool(first) and not odd
    if key is not None:
        yield out([(*key, total, *starts, "\n".join(first).removesuffix("\r") if done else None)])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(split, place, kind, text): records whole, and the pieces of those that cross the split's ends."""
    names, types = ["_file", "_start", "place", "kind", "value"], [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    key, odd, place, parts, kind, rows = None, 0, 0, [], _COMPLETE, []

    def ended():
        """What is left at a split's end goes on in the next one."""
        if parts:
            rows.append((*key, place, _THROUGH if kind == _HEAD else _OPEN, "\n".join(parts)))

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        values, quotes, begun = batch.column("value").to_pylist(), _quotes(batch), batch.column("begun").to_pylist()
        for new, begin, end in _segments(batch):
            if new != key:
                ended()
                key, odd, place, parts = new, begun[begin], 0, []
                kind = _HEAD if odd else _COMPLETE
            for i in range(begin, end):
                if not odd and not values[i].strip() and not parts:
                    continue
                if not odd and not parts:
                    place += 1
                    kind = _COMPLETE
                parts.append(values[i])
                odd ^= quotes[i] & 1
                if not odd:
                    rows.append((*key, place, kind, "\n".join(parts)))
                    parts = []
        if rows:
            yield out()
            rows = []
    if key is not None:
        ended()
    if rows:
        yield out()


def _packed(spark: SparkSession, lines: DataFrame, path: str) -> DataFrame:
    """The same splits in fewer tasks: small splits would cost more to start than to read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    length = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    return lines.coalesce(max(4 * spark.sparkContext.defaultParallelism, length // TASK_BYTES))


def _joined(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = _packed(spark, _lines(spark, path, "\n"), path)
    measured = _kept(lines.select("value", "_file", "_start").mapInArrow(
        _measure, "_file string, _start long, quotes long, outside long, inside long, first string"), "measured")
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    begun = measured.withColumn("begun", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)).cast("int"))
    splits = _kept(_placed(begun.withColumn("size", F.when(F.col("begun") == 0, F.col("outside")).otherwise(F.col("inside")))), "splits")
    known = splits.select("_file", "_start", "begun")
    if splits.count() <= SPLITS_SENT:
        ordered = lines.join(F.broadcast(known), ["_file", "_start"])  # keeps the lines where and as they are
    else:
        ordered = lines.join(known, ["_file", "_start"]).repartition("_file", "_start").sortWithinPartitions("_file", "_start", "_at")
    found = _kept(ordered.select("value", "_file", "_start", "begun").mapInArrow(
        _assemble, "_file string, _start long, place long, kind int, value string"), "records")
    whole = found.where(f"kind = {_COMPLETE}").select("_file", "_start", "place", "value")
    # A record that crosses ends opens in one split and goes on through the heads of the next ones.
    crossing = found.where(f"kind <> {_COMPLETE}")
    order = Window.partitionBy("_file").orderBy("_start", F.col("kind") == _OPEN)
    chained = crossing.withColumn("chain", F.count_if(F.col("kind") == _OPEN).over(order))
    step = F.struct("_start", F.col("kind") != _OPEN, "value")
    chains = chained.groupBy("_file", "chain").agg(
        F.min_by("_start", step).alias("_start"), F.min_by("place", step).alias("place"),
        F.array_join(F.transform(F.sort_array(F.collect_list(step)), lambda s: s["value"]), "\n").alias("value"))
    both = whole.unionByName(chains.select("_file", "_start", "place", "value")).join(
        _sent(splits).select("_file", "_start", "_shift", "_head", "header"), ["_file", "_start"])
    is_header = (F.col("_start") == F.col("_head")) & (F.col("place") == 1)
    text = F.regexp_replace("value", "\r$", "")
    return both.where(~is_header).select(text.alias("value"), "header", (F.col("place") + F.col("_shift")).alias(ROW)), splits
