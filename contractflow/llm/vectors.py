"""Reading vectors, and dealing them out as blocks for a search of many queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries are the rows whose id this number divides.
EVERY = 20


def usable(column: str) -> Column:
    """True for a vector without null, NaN or infinite components."""
    inside = F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & inside, F.lit(False))


def usable_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector of doubles, dim) of the usable rows that have an id."""
    return (
        table.where(usable(vector) & F.col(vec_id).isNotNull())
        .select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"),
                F.size(vector).alias("dim")))


def queries_of(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """The query rows with a number ``qno`` of their own; a query repeated exactly is answered once."""
    asked = vectors.where(F.col("vec_id") % every == 0).distinct()
    return asked.withColumn("qno", F.xxhash64("vec_id", "vector"))


def block(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def every_block(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def matrix(table: pa.Table, name: str, dim: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = table[name].combine_chunks()
    values = column.flatten() if len(column) else pa.array([], column.type.value_type)
    return values.to_numpy(zero_copy_only=False).reshape(len(column), dim)
