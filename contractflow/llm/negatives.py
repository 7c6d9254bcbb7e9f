"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Vectors become integers. They are dealt to shards of bounded size, and each shard
is written once as a row of flat arrays: ids, labels, components, and for every
dimension the rows in ascending order. An anchor reads a dimension's list from
its high end where its own component is positive and from its low end where it is
negative, all lists side by side. Every row met for the first time is scored at
once by random access; no unseen row can score more than the threshold, which is
the sum of the anchor's components times the last values read.

Anchors go round the shards in broadcast blocks of bounded size, twice. The first
round finds each anchor's positives: it stops in a shard once the threshold is
strictly below the score of the last positive held. The positives give the
windows of allowed negative scores. The second round keeps each window's best
rows of other labels and stops once the threshold is strictly below every
window's k-th score, or below its lower end while it holds fewer. What a task
holds is carried from shard to shard, so later shards stop earlier. Only what
tasks hold at their end is shuffled, a few rows an anchor and task.

**Defined results.** Rows with a null id, label or vector, or with a null, NaN or
infinite component take no part. Only vectors of equal length are compared. Rows
with the anchor's id are no candidates for it, whatever their label; rows
repeated under another id are separate candidates. Exactly repeated anchors are
answered once. Scores are exact; a component or score that does not fit 63 bits
is an error. Windows of negative positive scores are empty. Empty tables give no
rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contractflow.llm import vectors as V
from contractflow.llm.common import staged, union_all
from contractflow.session import scratch_path

#: Bytes of a shard's arrays on average.
SHARD_BYTES = 6 << 20
#: Bytes of anchors in one broadcast, on average.
ROUND_BYTES = 4 << 20
#: Lists are read this deep first, then four times as deep at each step.
DEPTH = 4
INDEX = "dim int, shard int, ids binary, labels binary, vectors binary, orders binary"


def labelled_integers(table: DataFrame, scale: float, relabel_every: int, classes: int) -> DataFrame:
    """(vec_id, label, vector, dim) of the rows that take part."""
    scaled = F.transform("vector", lambda x: F.when(F.abs(x * scale) < 2.0 ** 63, F.floor(x * scale)).otherwise(
        F.raise_error(F.lit("A scaled component does not fit 63 bits.")).cast("long")))
    moved = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    rows = table.where(V.usable("embedding") & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"))
    return rows.select("vec_id", moved.alias("label"), scaled.alias("vector"), F.size("vector").alias("dim"))


def _index(rows: DataFrame, total: int, width: int) -> DataFrame:
    """One row a shard: ids, labels, components, and each dimension's rows in ascending order."""

    def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        dim = int(key[0].as_py())
        at = np.argsort(group["vec_id"].to_numpy(), kind="stable")
        x = V.matrix(group, "vector", dim).astype(np.int64)[at]
        orders = np.argsort(x.T, axis=1, kind="stable").astype(np.int32)
        parts = [group["vec_id"].to_numpy()[at], group["label"].to_numpy()[at], x, orders]
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
                         **{n: pa.array([np.ascontiguousarray(p).tobytes()], pa.binary())
                            for n, p in zip(("ids", "labels", "vectors", "orders"), parts)}})

    shards = max(1, -(-total * width // SHARD_BYTES))
    dealt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")  # repeats part
    return staged(rows.withColumn("shard", dealt).repartition(shards, "dim", "shard")
                  .groupBy("dim", "shard").applyInArrow(build, INDEX), "lists")


class Shard:
    """A row of the index, with components in the smallest type that holds every product sum."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, vectors: bytes, orders: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.whole = np.frombuffer(vectors, np.int64).reshape(len(self.ids), dim)
        self.order = np.frombuffer(orders, np.int32).reshape(dim, len(self.ids))
        self.top = max(1, int(np.abs(self.whole.astype(np.float64)).max(initial=0)))
        self.cast: dict[type, np.ndarray] = {}

    def components(self, anchor_top: int):
        size = self.top * anchor_top * max(1, self.whole.shape[1])
        kind = np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else object
        if kind not in self.cast:
            self.cast[kind] = self.whole.astype(kind)
        return self.cast[kind]

    def walk(self, anchor: np.ndarray, enough) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) as sorted access meets them, until ``enough(threshold)`` or all rows are met."""
        n, lists = len(self.ids), np.flatnonzero(anchor)
        x = self.components(max(1, int(np.abs(anchor.astype(np.float64)).max(initial=0))))
        anchor = anchor.astype(x.dtype)
        if not len(lists):  # every score is zero, and so is the threshold
            yield np.arange(n), np.zeros(n, np.int64)
            return
        up, down = lists[anchor[lists] < 0], lists[anchor[lists] > 0]
        seen, start, stop = np.zeros(n, bool), 0, min(DEPTH, n)
        while start < n:
            before = seen.copy()
            seen[self.order[up, start:stop].ravel()] = True
            seen[self.order[down, n - stop:n - start].ravel()] = True
            new = np.flatnonzero(seen & ~before)
            yield new, x[new] @ anchor
            if len(new) and seen.all():
                return
            last_up, last_down = self.order[up, stop - 1], self.order[down, n - stop]
            if enough(int((anchor[up] * x[last_up, up]).sum()) + int((anchor[down] * x[last_down, down]).sum())):
                return
            start, stop = stop, min(4 * stop, n)


def _fitting(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and len(scores) and max(map(abs, scores)) >= 1 << 63:
        raise OverflowError("A score does not fit 63 bits.")
    return scores.astype(np.int64)


class Best:
    """The k best (score, id) seen so far, higher scores first, ties to the smaller id."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.scores = self.ids = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.high is not None:
            inside = (scores >= self.low) & (scores <= self.high)
            scores, ids = scores[inside], ids[inside]
        if len(self.ids) == self.k:
            good = scores >= self.scores[-1]
            scores, ids = scores[good], ids[good]
        if len(ids):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            at = np.lexsort((ids, -scores))[:self.k]
            self.scores, self.ids = scores[at], ids[at]

    def done(self, threshold: int) -> bool:
        """No unseen row, none above the threshold, can enter any more."""
        if len(self.ids) == self.k:
            return threshold < self.scores[-1]
        return self.low is not None and threshold < self.low


def _shards(batches) -> Iterator[tuple[int, Shard]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row["dim"], Shard(row["dim"], *(row[n] for n in ("ids", "labels", "vectors", "orders")))


def _search(batches, sent, bests, same: bool):
    """Pass all shards of a task by all anchors of a broadcast, and yield what is held at the end."""
    anchors = sent.value
    held = [bests(a) for a in anchors]
    for dim, shard in _shards(batches):
        for anchor, best in zip(anchors, held):
            if anchor["dim"] != dim or not best:
                continue
            for rows, scores in shard.walk(anchor["vector"], lambda t: all(b.done(t) for b in best)):
                fit = (shard.labels[rows] == anchor["label"]) == same
                fit &= shard.ids[rows] != anchor["vec_id"]
                scores, ids = _fitting(scores[fit]), shard.ids[rows[fit]]
                for b in best:
                    b.add(scores, ids)
    rows = [(i, n, b.ids, b.scores) for i, best in enumerate(held) for n, b in enumerate(best) if len(b.ids)]
    for start in range(0, len(rows), 4096):
        part = rows[start:start + 4096]
        sizes = [len(r[2]) for r in part]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([r[0] for r in part], sizes), pa.int64()), pa.array(np.repeat([r[1] for r in part], sizes), pa.int64()),
             pa.array(np.concatenate([r[2] for r in part])), pa.array(np.concatenate([r[3] for r in part]))],
            ["anchor", "part", "vec_id", "score"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "part").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: float = 256.0, anchors_every: int = 50, relabel_every: int = 7, classes: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor and each of its best ``positives`` rows of its label, the best
    ``negatives`` rows of other labels whose score lies between ``low`` and ``high``
    per cent of the positive's.
    """
    spark = table.sparkSession
    rows = staged(labelled_integers(table, scale, relabel_every, classes), "integers")
    asked = staged(rows.where(F.col("vec_id") % anchors_every == 0).distinct(), "anchors")
    total, widest = rows.agg(F.count(F.lit(1)), F.max("dim")).first()
    index = _index(rows, total, 16 + 12 * (widest or 0))
    rounds = max(1, -(-asked.count() * 8 * ((widest or 0) + 3) // ROUND_BYTES))
    found_schema, parts = "anchor long, part long, vec_id long, score long", []
    for number in range(rounds):
        block = asked.where(F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(rounds)) == number).toArrow().to_pylist()
        for anchor in block:
            anchor["vector"] = np.array(anchor["vector"], np.int64)
        sent = spark.sparkContext.broadcast(block)
        search = partial(_search, sent=sent, bests=lambda a: [Best(positives)], same=True)
        for r in _merged(index.mapInArrow(search, found_schema), positives).toArrow().to_pylist():
            block[r["anchor"]].setdefault("positives", []).append((r["rank"], r["vec_id"], r["score"]))
        for anchor in block:
            anchor["positives"] = sorted(anchor.get("positives", []))
        windows = spark.sparkContext.broadcast(block)
        parts.append(staged(_windows(index, windows, negatives, low, high, found_schema), "negatives"))
        sent.unpersist()
        windows.unpersist()
    return union_all(parts)


def _windows(index: DataFrame, sent, negatives: int, low: int, high: int, schema: str) -> DataFrame:
    """The second round, with the positives' ids and scores taken from the broadcast."""

    def bests(anchor) -> list[Best]:
        return [Best(negatives, -(-low * score // 100), high * score // 100) for _, _, score in anchor["positives"]]

    def named(batches):
        for batch in batches:
            columns = batch.to_pydict()
            anchors = [sent.value[i] for i in columns["anchor"]]
            chosen = [a["positives"][p] for a, p in zip(anchors, columns["part"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a["vec_id"] for a in anchors], pa.int64()), pa.array([p[1] for p in chosen], pa.int64()),
                 batch.column("rank"), batch.column("vec_id"), pa.array([p[2] for p in chosen], pa.int64()), batch.column("score")],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    found = _merged(index.mapInArrow(partial(_search, sent=sent, bests=bests, same=False), schema), negatives)
    return found.select("anchor", "part", "vec_id", "score", "rank").mapInArrow(
        named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
