"""Exact top-k search by distributed histogram selection.

Vectors are turned into integers, so scores are integers. Every pass scores all
candidates against all queries, block by block, and counts each query's scores
in equal bins from the highest down. The counts are summed over all blocks; the
bin that holds the k-th score becomes the next pass's range, until bins are one
score wide and the k-th score is known exactly. The last pass keeps the scores
above it and, of those equal to it, as many with the smallest ids as are missing.

A block reports bins only down to its own k-th score, below which the k-th score
of all blocks can't lie; so a query costs at most k rows a block and pass.
Queries and candidates are dealt to a grid of blocks of bounded size, hence no
task's memory grows with the input.

**Defined results.** Vectors that are null, or hold a null, NaN or infinite
component, and rows without an id take no part. Only vectors of equal length are
compared. A query's own rows (those with its id) are no candidates for it. Rows
repeated under one id are separate candidates; exactly repeated queries are
answered once. Scores are exact; beyond 2^61 in size they are cut there. With
fewer than k candidates all are returned. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contractflow.llm import vectors as V
from contractflow.llm.common import staged

BINS = 128
QUERY_BLOCK = 512
BLOCK = 8192
LIMIT = 1 << 61


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` with those of ``b``."""
    top = [max(1, int(np.abs(x.astype(np.float64)).max(initial=0))) for x in (a, b)]
    if top[0] * top[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top[0] * top[1] * a.shape[1] < LIMIT:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


def _scored(left: pa.Table, right: pa.Table):
    """Scores of a block's queries (rows) and candidates; a query's own id is masked."""
    dim = int(left["dim"][0].as_py())
    asked, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
    found = scores(V.matrix(left, "vector", dim), V.matrix(right, "vector", dim))
    return asked, ids, found, asked[:, None] != ids[None, :]


def _grid(queries: DataFrame, candidates: DataFrame, deal: tuple[int, int]):
    keys = ["dim", "qb", "cb"]
    rows = queries.withColumns({"qb": V.block("vec_id", deal[0]), "cb": V.every_block(deal[1])})
    cells = candidates.withColumn("cb", V.block("vec_id", deal[1])).withColumn("qb", V.every_block(deal[0]))
    return rows.groupBy(*keys).cogroup(cells.groupBy(*keys))


def top_k(table: DataFrame, k: int = 20, scale: float = 64.0, every: int = V.EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` best candidates."""
    whole = V.usable_vectors(table).withColumn(
        "vector", F.transform("vector", lambda x: F.floor(F.lit(scale) * x)))
    candidates = staged(whole, "vectors")
    queries = staged(V.queries_of(candidates, every), "queries")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows, longest = candidates.agg(F.count(F.lit(1)), F.max(norm)).first()
    asked, longest_query = queries.agg(F.count(F.lit(1)), F.max(norm)).first()
    high = min(LIMIT, math.ceil((longest or 0) * (longest_query or 0) * (1 + 1e-9)) + 1)
    deal = (max(1, -(-asked // QUERY_BLOCK)), max(1, -(-rows // BLOCK)))
    width, span = 1, BINS
    while span < 2 * high + 1:
        width, span = width * BINS, span * BINS

    state = queries.select("qno", F.lit(high).cast("long").alias("high"), F.lit(0).cast("long").alias("above"),
                           F.lit(False).alias("all"))
    while width:
        state = staged(_narrowed(_counted(queries.join(state, "qno"), candidates, deal, k, width), state, k, width), "narrowed")
        width = 0 if width == 1 else width // BINS
    return _selected(queries.join(state, "qno"), candidates, deal, k)


def _counted(queries: DataFrame, candidates: DataFrame, deal, k: int, width: int) -> DataFrame:
    """(qno, bin, n): counts of scores in the bins below ``high``, summed over all blocks."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({x: pa.array([], pa.int64()) for x in ("qno", "bin", "n")})
        if not left.num_rows or not right.num_rows:
            return empty
        _, _, found, other = _scored(left, right)
        below = left["high"].to_numpy()[:, None] - found
        bins = below // width
        inside = other & (below >= 0) & (bins < BINS)
        row = np.nonzero(inside)[0]
        counts = np.bincount(row * BINS + bins[inside], minlength=len(found) * BINS).reshape(-1, BINS)
        wanted = k - left["above"].to_numpy()[:, None]
        row, at = np.nonzero((counts > 0) & (counts.cumsum(axis=1) - counts < wanted))
        return pa.table({"qno": pa.array(left["qno"].to_numpy()[row]), "bin": pa.array(at, pa.int64()),
                         "n": pa.array(counts[row, at], pa.int64())})

    found = _grid(queries, candidates, deal).applyInArrow(count, "qno long, bin long, n long")
    return found.groupBy("qno", "bin").agg(F.sum("n").alias("n"))


def _narrowed(counted: DataFrame, state: DataFrame, k: int, width: int) -> DataFrame:
    """The range that holds the k-th score: the highest bin by which k scores are counted."""
    order = Window.partitionBy("qno").orderBy("bin")
    passed = counted.join(state.select("qno", "above"), "qno").withColumn("upto", F.col("above") + F.sum("n").over(order))
    kth = passed.where("upto >= %d" % k).groupBy("qno").agg(F.min(F.struct("bin", "upto", "n")).alias("at"))
    reached = F.col("at").isNotNull()
    return state.join(kth, "qno", "left").select(
        "qno", F.when(reached, F.col("high") - F.col("at.bin") * width).otherwise(F.col("high")).alias("high"),
        F.when(reached, F.col("at.upto") - F.col("at.n")).otherwise(F.col("above")).alias("above"),
        (F.col("all") | ~reached).alias("all"))


def _selected(queries: DataFrame, candidates: DataFrame, deal, k: int) -> DataFrame:
    """All scores above the k-th, and those equal to it with the smallest ids."""

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("qno", "query_id", "vec_id", "score")
        if not left.num_rows or not right.num_rows:
            return pa.table({x: pa.array([], pa.int64()) for x in names})
        asked, ids, found, other = _scored(left, right)
        kth, everything = left["high"].to_numpy()[:, None], left["all"].to_numpy(zero_copy_only=False)[:, None]
        row, at = np.nonzero(other & (everything | (found >= kth)))
        order = np.lexsort((ids[at], -found[row, at], row))
        row, at = row[order], at[order]
        start = np.searchsorted(row, row)  # of many equal scores no more than k a query leave the block
        row, at = (x[np.arange(len(row)) - start < k] for x in (row, at))
        return pa.table(dict(zip(names, (
            pa.array(left["qno"].to_numpy()[row]), pa.array(asked[row]), pa.array(ids[at]), pa.array(found[row, at])))))

    best = _grid(queries, candidates, deal).applyInArrow(choose, "qno long, query_id long, vec_id long, score long")
    return ranked(best, k)


def ranked(best: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ties to the smaller id."""
    order = Window.partitionBy("qno").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
