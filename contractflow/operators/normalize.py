"""Record normalization: NULLs, identifiers, timestamps, imputation, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contractflow.functions import text, times
from contractflow.model import LEGACY, MANUFACTURING

# Columns each rule applies to, in the order changes are reported.
ID_FIELDS = ("product_id", "article_id", "production_batch_id", "old_product_code")
TIME_FIELDS = ("mfg_timestamp", "sale_timestamp", "timestamp", "historical_timestamp")

CHANGES, CHANGE_COUNT = "_changes", "_n_changes"


def null_canonical(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")) for n in floats}) if floats else df


class _Step:
    """New column values together with the changes they report.

    ``first`` holds values that several later expressions use; they are computed
    in a projection of their own, once per row.
    """

    def __init__(self) -> None:
        self.first: dict[str, Column] = {}
        self.values: dict[str, Column] = {}
        self.changes: list[tuple[Column, Column]] = []


def _uppercase(df: DataFrame, step: _Step) -> None:
    for name in ID_FIELDS:
        if name not in df.columns or not isinstance(df.schema[name].dataType, T.StringType):
            continue
        value, upper = F.col(name), F.col(f"_upper_{name}")
        step.first[f"_upper_{name}"] = F.upper(value)
        step.values[name] = upper
        step.changes.append((
            F.coalesce(value != upper, F.lit(False)),
            F.concat(F.lit(f"NORMALIZE | field={name} | '"), value, F.lit("' → '"), upper,
                     F.lit("' | reason=uppercase_policy")),
        ))


def _utc_timestamps(df: DataFrame, step: _Step) -> None:
    for name in TIME_FIELDS:
        if name not in df.columns:
            continue
        value = F.col(f"`{name}`")
        data_type = df.schema[name].dataType
        if isinstance(data_type, T.StringType):
            moment = times.parse_timestamp(value)
        elif isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            moment = value.cast("timestamp")
        else:
            continue
        shown, iso = value.cast("string"), F.col(f"_iso_{name}")
        step.first[f"_moment_{name}"] = moment
        step.first[f"_iso_{name}"] = times.iso_utc(F.col(f"_moment_{name}"))
        step.values[name] = F.coalesce(iso, shown)
        failed = iso.isNull() & value.isNotNull()
        step.changes.append((
            failed | F.coalesce(iso != shown, F.lit(False)),
            F.when(failed, F.concat(
                F.lit(f"NORMALIZE | field={name} | parse_error='Unknown datetime string format, unable to parse: "),
                shown, F.lit(", at position 0' | value_kept='"), shown, F.lit("'"),
            )).otherwise(F.concat(
                F.lit(f"NORMALIZE | field={name} | '"), shown, F.lit("' → '"), iso, F.lit("' | reason=iso8601_utc"))),
        ))


def _impute(df: DataFrame, step: _Step) -> None:
    known = "defect_count" in df.columns
    value = F.col("defect_count") if known else F.lit(None).cast("double")
    data_type = df.schema["defect_count"].dataType if known else T.DoubleType()
    zero = F.lit("0.0") if isinstance(data_type, T.StringType) else F.lit(0).cast(data_type)
    step.values["defect_count"] = F.coalesce(value, zero)
    step.changes.append((
        value.isNull(),
        F.lit("IMPUTE | field=defect_count | null → 0.0 | reason=manufacturing_imputation_policy"),
    ))


def _migration_change(upper: Column) -> tuple[Column, Column]:
    return F.lit(True), F.concat(
        F.lit("SCHEMA_MIGRATE | old_product_code → product_id | value='"),
        F.coalesce(upper, F.lit(text.NONE_TEXT)), F.lit("'"))


def migrate_legacy(df: DataFrame) -> DataFrame:
    """``old_product_code`` becomes ``product_id``, at the end of the row."""
    if "old_product_code" not in df.columns:
        return df
    kept = [F.col(f"`{n}`") for n in df.columns if n not in ("old_product_code", "product_id")]
    return df.select(*kept, F.col("old_product_code").alias("product_id"))


def normalize(df: DataFrame, source_id: str) -> DataFrame:
    """All rules for one source, with the ordered list of changes of every row."""
    clean = null_canonical(df)
    step = _Step()
    _uppercase(clean, step)
    _utc_timestamps(clean, step)
    if source_id == MANUFACTURING:
        _impute(clean, step)
    migrates = source_id == LEGACY and "old_product_code" in clean.columns
    if migrates:
        step.changes.append(_migration_change(F.col("_upper_old_product_code")))
    count = sum((F.when(flag, F.lit(1)).otherwise(F.lit(0)) for flag, _ in step.changes), F.lit(0))
    moments = {n: c for n, c in step.first.items() if not n.startswith("_iso_")}
    texts = {n: c for n, c in step.first.items() if n.startswith("_iso_")}
    ready = clean.withColumns(moments) if moments else clean
    ready = ready.withColumns(texts) if texts else ready
    changed = ready.withColumns({
        **step.values,
        CHANGES: text.optional_items(*step.changes),
        CHANGE_COUNT: count,
    }).drop(*step.first)
    if not migrates:
        return changed
    moved = migrate_legacy(changed)
    tail = [CHANGES, CHANGE_COUNT]
    return moved.select(*[n for n in moved.columns if n not in tail], *tail)
