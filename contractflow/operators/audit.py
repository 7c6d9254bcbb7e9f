"""Per-row audit entries, log lines and storage summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.functions.text import NONE_TEXT
from contractflow.model import DataContract
from contractflow.operators.contracts import (
    ACCEPTED, COERCED, COERCIONS, DUPLICATE, ERROR, QUARANTINE, REJECT, STATUS, VIOLATIONS)
from contractflow.operators.normalize import CHANGES
from contractflow.operators.rows import ROW

KEY = "_key"


def _row_number(df: DataFrame, row: str) -> Column:
    """The row number, NULL for rows that are identified by columns of their own."""
    return F.col(row) if row in df.columns else F.lit(None).cast("bigint")


def record_key(df: DataFrame, key_field: str | None, row: str = ROW) -> Column:
    """The key as it arrived; ``None`` for a NULL, ``row_n`` where there is no key column."""
    if key_field and key_field in df.columns:
        return F.coalesce(F.col(f"`{key_field}`").cast("string"), F.lit(NONE_TEXT))
    return F.concat(F.lit("row_"), F.col(row).cast("string"))


def audit_rows(judged: DataFrame, row: str = ROW, also: tuple[str, ...] = ()) -> DataFrame:
    """``row, key, status`` and the messages where the status has some."""
    status = F.col(STATUS)
    return judged.where(status != ERROR).select(
        *also,
        _row_number(judged, row).alias("row"),
        F.col(KEY).alias("key"),
        status.alias("status"),
        F.when(status.isin(QUARANTINE, REJECT), F.col(VIOLATIONS)).alias("violations"),
        F.when(status == COERCED, F.col(COERCIONS)).alias("coercions"),
    )


def audit_json(audit: DataFrame) -> DataFrame:
    """One JSON text per audit row; absent fields are left out."""
    fields = ("row", "key", "status", "violations", "coercions")
    return audit.select(F.to_json(F.struct(*fields)).alias("entry"))


def _listed(messages: Column, shown: int | None, more: str) -> Column:
    if shown is None:
        return F.array_join(messages, " | ")
    extra = F.size(messages) - shown
    tail = F.when(extra > 0, F.concat(F.lit(f"{more}(+"), extra.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(messages, 1, shown), " | "), tail)


def record_lines(judged: DataFrame, source_id: str, contract: DataContract | None, row: str = ROW,
                 changes_shown: int | None = 3, violations_shown: int | None = 5) -> DataFrame:
    """The log line of every row: status, key, policy, changes, violations.

    The display form shows so many changes and violations and counts the others;
    None shows all.
    """
    status, changes = F.col(STATUS), F.col(CHANGES)
    contract_id = contract.contract_id if contract else "no_contract"
    policy = contract.policy.value if contract else "n/a"
    head = F.concat(
        F.lit("["), status, F.lit(f"] source={source_id} | row="),
        F.coalesce(_row_number(judged, row).cast("string"), F.lit(NONE_TEXT)),
        F.lit(" | key="), F.col(KEY))
    def rest(messages: Column, shown: int | None, words: str) -> Column:
        return F.when(F.size(messages) > shown, F.lit(words)).otherwise(F.lit("")) if shown is not None else F.lit("")

    extra_changes = rest(changes, changes_shown, " more)")
    summary = F.concat(
        F.lit("norm_changes="), F.size(changes).cast("string"),
        F.when(F.size(changes) > 0, F.concat(F.lit(" | "), _listed(changes, changes_shown, " "), extra_changes))
        .otherwise(F.lit("")),
    )
    about = F.lit(f" | contract={contract_id} | policy={policy}")
    violations = F.col(VIOLATIONS)
    extra_violations = rest(violations, violations_shown, " more violations)")
    line = (
        F.when(status.isin(*ACCEPTED), F.concat(head, about, F.lit(" | "), summary))
        .when(status == DUPLICATE, F.concat(head, F.lit(" | reason=dedup_key_already_seen | skipped=True")))
        .otherwise(F.concat(
            head, about, F.lit(" | violations=["), _listed(violations, violations_shown, " ... "), extra_violations,
            F.lit("] | "), summary))
    )
    return judged.where(status != ERROR).select(
        _row_number(judged, row).alias("row"), status.alias("status"), line.alias("line"))


def storage_audit(spark: SparkSession, areas: dict[str, str]) -> DataFrame:
    """Files and kilobytes per area, and a TOTAL row. Areas must not overlap.

    Only names and lengths are read. An area that does not exist is left out.
    """
    parts = []
    for area, path in areas.items():
        if not path_exists(spark, path):
            continue
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        parts.append(listing.select(F.lit(area).alias("area"), "length"))
    if not parts:
        return spark.createDataFrame([("TOTAL", 0, 0.0)], "area string, files bigint, kilobytes double")
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part)
    return (
        files.rollup("area")
        .agg(F.count(F.lit(1)).alias("files"), F.bround(F.sum("length") / 1024, 1).alias("kilobytes"))
        .withColumn("area", F.coalesce("area", F.lit("TOTAL")))
    )


def file_row_counts(spark: SparkSession, area: str, path: str) -> DataFrame:
    """Rows of every Parquet file below a path, from a scan that reads no column."""
    scan = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return (
        scan.select(F.col("_metadata.file_path").alias("file"))
        .groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(area).alias("area"), "file", "rows")
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
