"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.session import scratch_path

#: A word is a run of anything but these six characters; ``bytes.split()`` cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 500) -> SparkSession:
    """Keep Arrow batches small: their rows hold whole texts, and one worker's memory is limited."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage without a single copy on one executor's disk, computes
    what several later plans read only once, and gives joins two plain scans, so
    that adaptive execution may split a hot key on either side.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """Whole rows in the struct ``doc``, so that columns an operator adds can't clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def salted_join(many: DataFrame, few: DataFrame, key: str, spread: Column, salts: int = 16) -> DataFrame:
    """Inner join of many rows a key with one row a key, where one key may hold a third of ``many``.

    Rows of ``many`` go to one of ``salts`` places by ``spread``; each row of ``few`` goes to all.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
