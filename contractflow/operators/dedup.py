"""First-wins deduplication that survives a key holding a third of all rows.

A window over the key would bring every copy of a hot key into one task. Here the
first row of each key is found by an aggregate, which combines on the map side,
so a hot key costs one row per map task. Rows are then flagged by joining on the
row identity, which is unique and therefore evenly spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contractflow.functions.text import first_filled
from contractflow.operators.rows import ROW

DUP = "_dup"


def dedup_key(df: DataFrame, key: str) -> Column:
    """The key, else the product id, else NULL; empty text counts as absent."""
    candidates = [F.col(f"`{n}`").cast("string") for n in dict.fromkeys((key, "product_id")) if n in df.columns]
    return first_filled(*candidates) if candidates else F.lit(None).cast("string")


def first_rows(df: DataFrame, key: Column, identity: list[str], within: list[str] = ()) -> DataFrame:
    """The identity of the first row of every key (per ``within`` group)."""
    keyed = df.select(*within, *identity, key.alias("_k")).where(F.col("_k").isNotNull())
    grouped = keyed.groupBy(*within, "_k")
    if identity == [ROW]:
        return grouped.agg(F.min(identity[0]).alias(identity[0])).select(identity[0])
    return grouped.agg(F.min(F.struct(*identity)).alias("_first")).select("_first.*")


def mark_duplicates(
    df: DataFrame, key: str | Column, identity: list[str] | None = None, within: list[str] = (),
) -> DataFrame:
    """Flag every row but the first of its key; rows without a key are never flagged.

    ``identity`` columns must identify a row and their order is the row order; they
    may be NULL.
    """
    key = dedup_key(df, key) if isinstance(key, str) else key
    joined = with_first(df, first_rows(df, key, identity or [ROW], list(within)), identity or [ROW])
    return flag_duplicates(joined, key)


FIRST = "_is_first"


def with_first(df: DataFrame, firsts: DataFrame, identity: list[str]) -> DataFrame:
    """Rows with ``_is_first``: true for those in ``firsts``, else NULL."""
    if identity == [ROW]:
        return df.join(firsts.withColumn(FIRST, F.lit(True)), ROW, "left").select(*df.columns, FIRST)
    named = firsts.select(*[F.col(n).alias(f"_first_{n}") for n in identity], F.lit(True).alias(FIRST))
    same = [F.col(n).eqNullSafe(F.col(f"_first_{n}")) for n in identity]
    return df.join(named, same, "left").select(*df.columns, FIRST)


def flag_duplicates(df: DataFrame, key: Column) -> DataFrame:
    """``_is_first`` as the flag of duplicates, behind the other columns."""
    names = [n for n in df.columns if n != FIRST]
    return df.withColumn(DUP, F.col(FIRST).isNull() & key.isNotNull()).select(*names, DUP)


def keep_first(
    df: DataFrame, key: str | Column, order: list[str] | None = None, within: list[str] = (),
) -> DataFrame:
    """Only the first row of every key, in one shuffle.

    Spark applies the ``rn = 1`` limit before the shuffle too, so each map task
    sends at most one row per key. A row without a key forms a group of its own.
    ``order`` columns must identify a row.
    """
    order = order or [ROW]
    key = dedup_key(df, key) if isinstance(key, str) else key
    alone = F.when(key.isNull(), F.struct(*order))
    window = Window.partitionBy(*within, key, alone).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")


def duplicate_counts(df: DataFrame, key: str, within: list[str] = ()) -> DataFrame:
    """Rows, rows dropped as duplicates, and the share dropped.

    Counting needs no row order: per key all rows but one are dropped.
    """
    value = dedup_key(df, key)
    sizes = df.groupBy(*within, value.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    dropped = F.when(F.col("_k").isNotNull(), F.col("_n") - 1).otherwise(F.lit(0))
    totals = sizes.groupBy(*within).agg(
        F.sum("_n").alias("rows"), F.sum(dropped).alias("duplicates"))
    return totals.withColumn("duplicate_rate", F.bround(F.col("duplicates") / F.col("rows"), 6))
