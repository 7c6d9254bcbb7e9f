"""Row numbers in file order, and slices of them.

Numbering rows with a window over the whole table would put every row into one
task, and sorting only to number is a full shuffle. Parquet already knows the
position of each row in its file, so a row number is the file's offset plus
that position: one metadata-sized aggregate and no shuffle of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contractflow.session import scratch_path

ROW, BATCH = "_row", "batch_id"

def _file_sizes(scan: DataFrame) -> DataFrame:
    """Rows of every file and how many come before it; reads no column of the data."""
    sizes = (
        scan.select(F.col("_metadata.file_path").alias("_file"))
        .groupBy("_file").agg(F.count(F.lit(1)).alias("_size"))
    )
    # One row per file, so this window runs over the file list and not over data.
    # Shorter names first keeps part-99999 before part-100000.
    before = Window.orderBy(F.length("_file"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_file", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))


def scan_with_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """A Parquet scan with ``_row``: 1, 2, 3 … over the files in path order."""
    scan = spark.read.parquet(*paths)
    if len(scan._jdf.inputFiles()) <= 1:  # the length only; the names stay in the JVM
        return scan.withColumn(ROW, F.col("_metadata.row_index") + 1)
    positions = scan.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    return (
        positions.join(_file_sizes(scan).select("_file", "_offset"), "_file")
        .withColumn(ROW, F.col("_offset") + F.col("_at") + 1)
        .drop("_file", "_at", "_offset")
    )


def scan_first_rows(spark: SparkSession, count: int, *paths: str) -> DataFrame:
    """As ``scan_with_rows``, for jobs that need only the first rows: later files are not opened.

    The files named to the driver hold at least one of the ``count`` rows each.
    """
    scan = spark.read.parquet(*paths)
    if len(scan._jdf.inputFiles()) <= 1:
        return scan_with_rows(spark, *paths).where(F.col(ROW) <= count)
    wanted = _file_sizes(scan).where((F.col("_offset") < count) & (F.col("_size") > 0))
    needed = [row["_file"] for row in wanted.select("_file").collect()]
    if not needed:
        return scan_with_rows(spark, *paths)
    # Files that are left out all come later, so the numbers stay the same.
    return scan_with_rows(spark, *needed).where(F.col(ROW) <= count)


def slice_number(batch_size: int, row: str = ROW) -> Column:
    """Consecutive slices of ``batch_size`` rows, numbered from 1."""
    return F.expr(f"(`{row}` - 1) div {int(batch_size)} + 1")


def with_slices(df: DataFrame, batch_size: int = 500, max_batches: int | None = None, row: str = ROW) -> DataFrame:
    """Add the slice number; all slices are kept unless ``max_batches`` asks for the first ones only.

    Each slice numbers its own rows from 1, as it is a job of its own.
    """
    kept = df if max_batches is None else df.where(F.col(row) <= batch_size * max_batches)
    return kept.withColumn(BATCH, slice_number(batch_size, row)).withColumn(
        "_slice_row", F.pmod(F.col(row) - 1, F.lit(batch_size)) + 1)


def number_by_order(df: DataFrame, order: list[str], label: str = "numbered") -> DataFrame:
    """Number the rows of any DataFrame 1, 2, 3 … in the given order.

    The sorted rows are written to the shared folder, so the range bounds are drawn
    once and the positions cannot move; the written files then number themselves.
    Rows that tie in the order are spread by an extra sort key.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    (
        spread.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
        .drop("_tie").write.parquet(path)
    )
    return scan_with_rows(spark, path)
