"""File readers and writers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contractflow.model import SOURCES
from contractflow.operators.contracts import MALFORMED
from contractflow.operators.rows import ROW
from contractflow.sources import csv


class LoadError(Exception):
    """A source that is missing, empty or unreadable."""


#: Codec of the Parquet that jobs write. Half of a row is ids in hexadecimal digits, which the default leaves as they are.
CODEC = "zstd"


@dataclass(frozen=True)
class Storage:
    """Where a run writes. The areas do not overlap."""

    root: str

    def area(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def good(self, source_id: str, suffix: str = "") -> str:
        return f"{self.area('ingested')}/{source_id}{_tail(suffix)}.parquet"

    def quarantine(self, source_id: str, suffix: str = "") -> str:
        return f"{self.area('quarantine')}/{source_id}{_tail(suffix)}_quarantine.parquet"

    def audit(self, source_id: str, suffix: str = "") -> str:
        return f"{self.area('detail_logs')}/{source_id}{_tail(suffix)}_record_log.jsonl"

    def record_lines(self, source_id: str, suffix: str = "") -> str:
        return f"{self.area('detail_logs')}/{source_id}{_tail(suffix)}_record_lines.txt"

    def micro_batch(self, source_id: str) -> str:
        return f"{self.area('micro_batch')}/{source_id}_microbatch.parquet"

    def change_log(self, source_id: str, scenario: str) -> str:
        return f"{self.area('cdc_log')}/{source_id}_{scenario}_cdc.parquet"

    def claims(self, source_id: str, scenario: str) -> str:
        return f"{self.area('checkpoints')}/claims_{source_id}_{scenario}"

    def extracted(self, source_id: str, strategy: str, scenario: str) -> str:
        return f"{self.area('ingested')}/{source_id}_{strategy}_cdc_{scenario}.parquet"

    def checkpoint(self, strategy: str, source_id: str, scenario: str) -> str:
        return f"{self.area('checkpoints')}/{strategy}_{source_id}_{scenario}.json"

    def stream(self, name: str) -> str:
        return f"{self.area('stream_buffer')}/{name}"

    def stream_quarantine(self, name: str) -> str:
        return f"{self.area('quarantine')}/{name}_quarantine"

    def stream_files(self, name: str) -> str:
        return f"{self.area('stream_files')}/{name}"

    def stream_carry(self, name: str) -> str:
        return f"{self.area('checkpoints')}/carry_{name}"

    def stream_seen(self, name: str) -> str:
        return f"{self.area('checkpoints')}/seen_{name}"

    def landed(self, source_id: str) -> str:
        return f"{self.area('checkpoints')}/landed_{source_id}"

    def stream_progress(self, name: str) -> str:
        return f"{self.area('telemetry')}_streams/{name}"

    def telemetry(self) -> str:
        return self.area("telemetry")

    def areas(self) -> dict[str, str]:
        names = ("ingested", "quarantine", "cdc_log", "micro_batch", "stream_buffer", "checkpoints", "detail_logs")
        return {name: self.area(name) for name in names}


def _tail(suffix: str) -> str:
    return f"_{suffix}" if suffix else ""


def _summary(spark: SparkSession, path: str):
    """Length and file count below a path, None where it does not exist."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getContentSummary(target) if system.exists(target) else None


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _length(spark: SparkSession, path: str) -> int:
    """Bytes below a path, -1 where it does not exist."""
    found = _summary(spark, path)
    return -1 if found is None else found.getLength()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def data_files(spark: SparkSession, path: str) -> int:
    """Files of a finished table, not counting the success marker."""
    found = _summary(spark, path)
    return 0 if found is None else max(found.getFileCount() - 1, 0)


#: File and split of a row.
FILE, START = "_file", "_start"


def _with_text_rows(scan: DataFrame) -> DataFrame:
    placed = scan.withColumns({FILE: F.col("_metadata.file_path"), START: F.col("_metadata.file_block_start")})
    return number_splits(placed).select(*scan.columns, ROW)


def number_splits(scan: DataFrame) -> DataFrame:
    """Add ``_row`` numbers in file order to rows of text files that know their file and split.

    A text split has no row positions, so each split is counted first (no column
    is parsed for that) and the row number is the split's offset plus the
    position within it. Both passes read the same splits.
    """
    placed = scan.withColumn("_at", F.monotonically_increasing_id())
    splits = placed.groupBy(FILE, START).agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_base"))
    # One row per split, so this window runs over the split list and not over data.
    before = Window.orderBy(F.length(FILE), FILE, START).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        FILE, START,
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_base") + 1).alias("_shift"))
    return (
        placed.join(offsets, [FILE, START])
        .withColumn(ROW, F.col("_at") + F.col("_shift"))
        .select(*scan.columns, ROW)
    )


# Cell texts that stand for a missing value.
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False,
    na_words: tuple[str, ...] = NA_WORDS,
) -> DataFrame:
    """Rows of one or more CSV files with a header, numbered in file order.

    Columns are found by their name in the header, in whatever order: those of
    ``schema`` come first, further ones follow as text, and ones that no file has stay
    absent. Files may have different headers: each is read by its own, and what it
    lacks is a missing value. Quotes
    are doubled inside quotes. ``na_words`` are missing values. A row with another
    number of fields than its header keeps its text in ``_malformed``, which
    quarantines it. Quoted line breaks need ``multi_line``; such files are split like
    others (see ``sources.csv``).
    """
    length = _length(spark, path)
    if length < 0:
        raise LoadError(f"File not found: {path}")
    if length == 0:
        raise LoadError(f"Empty CSV file: {path}")
    try:
        scan, names = csv.records(spark, path, multi_line)
    except (AnalysisException, csv.HeaderError) as error:
        raise LoadError(f"Error loading CSV: {error}") from error
    if not names:
        raise LoadError(f"Empty CSV file: {path}")
    declared = {f.name: f.dataType for f in schema.fields}
    wanted = [n for n in declared if n in names] + [n for n in names if n not in declared]

    def cell(name: str) -> Column:
        text = F.when(~F.col(f"`{name}`").isin(*na_words), F.col(f"`{name}`"))
        return text.cast(declared.get(name, T.StringType())).alias(name)

    return scan.select(*map(cell, wanted), MALFORMED, ROW)


def read_source_csv(spark: SparkSession, path: str, source_id: str, multi_line: bool = False) -> DataFrame:
    """A registered source from CSV, every column as text (see the contract's per-value typing)."""
    return read_csv(spark, path, SOURCES[source_id].raw_schema(), multi_line)


def read_parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is nothing yet, or only what a first writer has not finished."""
    try:
        return spark.read.parquet(path) if _length(spark, path) > 0 else None
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None


# The landed shape of a weather response.
WEATHER_SCHEMA = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("main", T.StructType([
        T.StructField("temp", T.DoubleType()),
        T.StructField("humidity", T.LongType()),
    ])),
    T.StructField("weather", T.ArrayType(T.StructType([T.StructField("description", T.StringType())]))),
    T.StructField("timestamp", T.StringType()),
])


def landed_payloads(spark: SparkSession, folder: str, most_files: int) -> DataFrame:
    """A stream of the weather responses that land in a folder, flat, with their file and split.

    A line that is no JSON keeps its text in ``_malformed``, which quarantines it.
    """
    if _length(spark, folder) < 0:
        raise LoadError(f"Folder not found: {folder}")
    schema = T.StructType([*WEATHER_SCHEMA.fields, T.StructField(MALFORMED, T.StringType())])
    stream = (
        spark.readStream.schema(schema).option("columnNameOfCorruptRecord", MALFORMED)
        .option("maxFilesPerTrigger", most_files).json(folder))
    placed = stream.withColumns({FILE: F.col("_metadata.file_path"), START: F.col("_metadata.file_block_start")})
    return flatten_weather(placed, also=(MALFORMED, FILE, START))


def read_weather_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed weather responses as flat, numbered rows."""
    if _length(spark, path) < 0:
        raise LoadError(f"File not found: {path}")
    return flatten_weather(_with_text_rows(spark.read.schema(WEATHER_SCHEMA).json(path)), also=(ROW,))


def flatten_weather(payloads: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``main.temp``, ``main.humidity`` and the first ``weather`` entry as plain columns."""
    return payloads.select(
        *also,
        "city",
        F.col("main.temp").alias("temperature"),
        F.col("main.humidity").alias("humidity"),
        F.get(F.col("weather"), F.lit(0))["description"].alias("weather_description"),
        "timestamp",
    )
