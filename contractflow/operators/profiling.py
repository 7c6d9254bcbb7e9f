"""Column profiles: kind, value frequencies, spread, time range, NULL share."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contractflow.functions import times
from contractflow.operators.contracts import payload_columns
from contractflow.operators.normalize import null_canonical

CONSTANT, TIMESTAMP, NUMERIC, CATEGORICAL = "constant", "timestamp", "numeric", "categorical"

# More distinct numbers than this is a numeric column; names that mean time.
DISTINCT_LIMIT = 20
TIME_WORDS = ("timestamp", "date", "period")

#: An estimate above this cannot belong to a column with at most DISTINCT_LIMIT values.
_CLEARLY_MANY = 200

PROFILE_SCHEMA = (
    "column string, kind string, rows bigint, present bigint, null_rate double, "
    "mean double, std double, min double, max double"
)


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    kind: str
    rows: int
    present: int
    mean: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None
    #: Estimated number of distinct values of a categorical column.
    about: int = 0
    #: (value, count), most frequent first; only for columns with few values.
    values: tuple[tuple[str, int], ...] = ()
    #: The ranks each value covers (see ``cumulative``); only for columns with many values.
    domain: DataFrame | None = field(default=None, compare=False, repr=False)

    @property
    def null_rate(self) -> float:
        return (self.rows - self.present) / self.rows if self.rows else 0.0


def _is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def _is_moment(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _may_be_time(field: T.StructField) -> bool:
    """By type or by name; a number is never a time."""
    named = any(word in field.name.lower() for word in TIME_WORDS)
    return _is_moment(field.dataType) or (named and not _is_number(field.dataType))


def _epoch_micros(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    moment = times.parse_timestamp(value) if isinstance(field.dataType, T.StringType) else value.cast("timestamp")
    return F.unix_micros(moment)


def profile(df: DataFrame, columns: list[str] | None = None) -> list[ColumnProfile]:
    """Profile all columns in one pass over the data, and a second for doubtful numbers.

    The first pass returns one row, whatever the data size. Distinct values are
    only estimated there, because counting them exactly would shuffle every value
    of every column; columns whose estimate is near the limit hold so few values
    that the exact count of the second pass combines on the map side.
    """
    names = columns or payload_columns(df)
    data = null_canonical(df.select(*[F.col(f"`{n}`") for n in names]))
    fields = data.schema.fields
    wanted: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        value = F.col(f"`{field.name}`")
        wanted.append(F.count(value).alias(f"present_{i}"))
        wanted.append(F.approx_count_distinct(value).alias(f"about_{i}"))
        if _is_number(field.dataType):
            number = value.cast("double")
            wanted += [
                F.avg(number).alias(f"mean_{i}"), F.stddev_samp(number).alias(f"std_{i}"),
                F.min(number).alias(f"min_{i}"), F.max(number).alias(f"max_{i}"),
            ]
        elif _may_be_time(field):
            micros = _epoch_micros(field)
            wanted += [F.min(micros).alias(f"min_{i}"), F.max(micros).alias(f"max_{i}")]
    first = data.agg(*wanted).first()

    doubtful = [i for i, f in enumerate(fields) if _is_number(f.dataType) and 0 < first[f"about_{i}"] <= _CLEARLY_MANY]
    exact = {}
    if doubtful:
        second = data.agg(*[F.count_distinct(f"`{fields[i].name}`").alias(f"n_{i}") for i in doubtful]).first()
        exact = {i: second[f"n_{i}"] for i in doubtful}

    found = []
    for i, field in enumerate(fields):
        rows, present = first["rows"], first[f"present_{i}"]
        if present == 0:
            found.append(ColumnProfile(field.name, CONSTANT, rows, 0))
        elif _may_be_time(field) and first[f"min_{i}"] is not None:
            found.append(ColumnProfile(
                field.name, TIMESTAMP, rows, present, min=first[f"min_{i}"] / 1e6, max=first[f"max_{i}"] / 1e6))
        elif _is_number(field.dataType) and exact.get(i, _CLEARLY_MANY) > DISTINCT_LIMIT:
            found.append(ColumnProfile(
                field.name, NUMERIC, rows, present, first[f"mean_{i}"], first[f"std_{i}"],
                first[f"min_{i}"], first[f"max_{i}"]))
        else:
            found.append(ColumnProfile(field.name, CATEGORICAL, rows, present, about=first[f"about_{i}"]))
    return found


def profile_table(df: DataFrame, profiles: list[ColumnProfile] | None = None) -> DataFrame:
    """One row per column."""
    profiles = profiles if profiles is not None else profile(df)
    rows = [(p.name, p.kind, p.rows, p.present, p.null_rate, p.mean, p.std, p.min, p.max) for p in profiles]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def value_frequencies(df: DataFrame, profiles: list[ColumnProfile]) -> DataFrame:
    """Value, count and probability of every categorical column, in one shuffle.

    Each row is turned into one (column, value) pair per column and counted with
    map-side combining, so frequent values do not gather in one task.
    """
    chosen = [p for p in profiles if p.kind == CATEGORICAL]
    spark = df.sparkSession
    if not chosen:
        return spark.createDataFrame([], "column string, value string, count bigint, probability double, null_rate double")
    data = null_canonical(df.select(*[F.col(f"`{p.name}`") for p in chosen]))
    pairs = data.select(F.explode(F.array(*[
        F.struct(F.lit(p.name).alias("column"), F.col(f"`{p.name}`").cast("string").alias("value"))
        for p in chosen])).alias("pair")).select("pair.*").where(F.col("value").isNotNull())
    counted = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    present, null_rate = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    for p in chosen:
        present = F.when(F.col("column") == p.name, F.lit(p.present)).otherwise(present)
        null_rate = F.when(F.col("column") == p.name, F.lit(p.null_rate)).otherwise(null_rate)
    return counted.select(
        "column", "value", "count", (F.col("count") / present).alias("probability"), null_rate.alias("null_rate"))


def cumulative(counted: DataFrame) -> DataFrame:
    """(column, value, count, low): the first of the ``count`` ranks that each value covers, frequent ones first.

    Equally frequent values go by digest. The sum before a value has two levels: cells of
    one column, count and first three digits of the digest are summed, and a value
    adds its place within its cell. So no task orders all values of a column,
    however many of them occur once.
    """
    digest = F.md5(F.col("value").cast("binary"))
    dealt = counted.select("column", "value", "count", digest.alias("_digest"), F.substr(digest, F.lit(1), F.lit(3)).alias("_part"))
    cell = ["column", "count", "_part"]
    before = Window.partitionBy("column").orderBy(F.desc("count"), "_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = dealt.groupBy(*cell).agg(F.count(F.lit(1)).alias("_many")).withColumn(
        "_start", F.coalesce(F.sum(F.col("count") * F.col("_many")).over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("_digest", "value"))
    return dealt.withColumn("_place", place).join(cells.drop("_many"), cell).select(
        "column", "value", "count", (F.col("_start") + (F.col("_place") - 1) * F.col("count")).alias("low"))


def with_domains(df: DataFrame, profiles: list[ColumnProfile], limit: int = 64) -> list[ColumnProfile]:
    """Attach the values of categorical columns and their frequencies.

    Those of at most ``limit`` values are listed, so a draw is an expression of the plan; the
    others have a table of the ranks each value covers. Both give a rank the same
    value, so the limit decides the plan alone.
    Only columns whose estimate allows it are counted for the lists, all in one job.
    """
    near = [p for p in profiles if p.kind == CATEGORICAL and p.about <= 2 * limit]
    listed: dict[str, list[tuple[str, int]]] = {p.name: [] for p in near}
    if near:
        bound = 4 * limit * len(near)
        counted = value_frequencies(df, near).select("column", "value", "count").limit(bound + 1).collect()
        for row in counted if len(counted) <= bound else ():
            listed[row["column"]].append((row["value"], row["count"]))

    def attached(p: ColumnProfile) -> ColumnProfile:
        values = listed.get(p.name, ())
        if p.kind != CATEGORICAL or not p.present:
            return p
        if 0 < len(values) <= limit:
            return replace(p, values=tuple(sorted(values, key=lambda v: (-v[1], hashlib.md5(v[0].encode()).hexdigest(), v[0]))))
        return replace(p, domain=cumulative(value_frequencies(df, [p])))

    return [attached(p) for p in profiles]
