"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic and ordered by a hash of the text. The smallest
capacity at which a greedy walk over the ordered group sizes needs no more than
the wanted shards is found by binary search, and the order is cut there.

The groups never come to the driver. It holds cells: ranges of the hash with
their summed size. Taking cells as atoms gives capacities that surely suffice,
taking them as fluid gives capacities that surely don't; the cells in which a cut
may fall are split again by one more pass over the (hash, size) rows until both
answers agree and every cut lies between single groups. The number of cells that
the driver holds depends on the shards, not on the rows.

Where the greedy walk leaves room (one group can be larger than an even share),
a cut is moved forward to the even share of what is left, as far as the capacity
allows, so that the other shards come out near equal as well.

**Defined results.** A null text has size 1 and no bytes (CRC 0); all null texts
are one group, apart from empty ones. Equal texts always share a shard, however
many they are; with fewer groups than shards some shards stay empty. Slots are
numbered from 0 without gaps. Repeated rows each get a row and a slot. An empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contractflow.llm.common import staged

FIRST_BITS = 14
CHILDREN = 1024
SLOT_CELLS = 4096


class Cells:
    """Ordered cells: first and last hash and summed size of each."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        self.rows = sorted(rows)
        self.ends = [0, *accumulate(size for _, _, size in self.rows)]
        self.total = self.ends[-1]

    def atomic(self, i: int) -> bool:
        return self.rows[i][0] == self.rows[i][1]

    def whole(self, start: int, capacity: int) -> int:
        """The first cell that no longer fits a shard begun at cell ``start``."""
        return bisect.bisect_right(self.ends, self.ends[start] + capacity) - 1

    def fluid(self, start: int, capacity: int) -> int:
        """As far as a shard begun at byte ``start`` may reach if cells can be cut anywhere but groups can't."""
        end = min(self.total, start + capacity)
        i = bisect.bisect_left(self.ends, end) - 1
        if i >= 0 and self.ends[i + 1] != end and self.atomic(i):
            end = self.ends[i]
        return end

    def surely(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = self.whole(at, capacity)
        return at == len(self.rows)

    def maybe(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = self.fluid(at, capacity)
        return at == self.total


def _smallest(holds, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle + 1, high)
    return low


def _even_cuts(cells: Cells, capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """First cell of each shard after the first, and the cells that decided on a cut."""
    count = len(cells.rows)
    latest = [count]  # latest[k]: where the last k shards must begin at the latest... counted from the end
    for _ in range(shards - 1):
        start = bisect.bisect_left(cells.ends, cells.ends[latest[-1]] - capacity)
        latest.append(start)
    cuts, deciding, at = [], set(), 0
    for left in range(shards - 1, 0, -1):
        furthest = cells.whole(at, capacity)
        share = -(-(cells.total - cells.ends[at]) // (left + 1))
        even = bisect.bisect_left(cells.ends, cells.ends[at] + share)
        # of the boundaries around the even share the nearer one
        if even > at + 1 and cells.ends[even] - cells.ends[at] - share > cells.ends[at] + share - cells.ends[even - 1]:
            even -= 1
        at = min(furthest, max(even, latest[left]))
        deciding |= {i for i in (at - 1, at, even - 1, even, furthest, latest[left] - 1) if 0 <= i < count}
        cuts.append(at)
    return cuts, deciding


def _unsure(cells: Cells, low: int, high: int, shards: int) -> set[int]:
    """Cells in which a greedy cut may fall at some capacity from ``low`` to ``high``.

    Cells larger than ``low`` come first, by themselves: there are few, and until
    they are split nothing is known of what lies behind them.
    """
    found = {i for i, row in enumerate(cells.rows) if row[2] > low and not cells.atomic(i)}
    if found:
        return found
    behind = ahead = 0
    for _ in range(shards):
        behind = cells.whole(behind, low)
        ahead = cells.fluid(ahead, high)
        found |= set(range(behind, min(len(cells.rows), bisect.bisect_left(cells.ends, ahead) + 1)))
    return found


def minimax_cuts(sizes: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the first hash of every shard after the first.

    ``sizes`` has the columns ``hash`` and ``size``; rows of one hash are one group.
    """
    summed = [F.min("hash").alias("low"), F.max("hash").alias("high"), F.sum("size").alias("size")]
    first = sizes.groupBy(F.shiftright("hash", 64 - FIRST_BITS).alias("cell")).agg(*summed)
    cells = Cells([(r["low"], r["high"], r["size"]) for r in first.collect()])
    while cells.rows:
        biggest = max((size for low, high, size in cells.rows if low == high), default=1)
        low = _smallest(lambda c: cells.maybe(c, shards), max(biggest, -(-cells.total // shards)), cells.total)
        high = _smallest(lambda c: cells.surely(c, shards), low, cells.total)
        if low < high:
            split = _unsure(cells, low, high, shards)
            cuts = []
        else:
            cuts, split = _even_cuts(cells, high, shards)
        wanted = sorted(i for i in split if not cells.atomic(i))
        if not wanted:
            if low < high:  # every cell a greedy cut could reach is a group: the whole-cell answer is exact
                cuts, _ = _even_cuts(cells, high, shards)
            return high, [cells.rows[i][0] for i in cuts if i < len(cells.rows)]
        rest = [row for i, row in enumerate(cells.rows) if i not in set(wanted)]
        parts = _split(sizes, [cells.rows[i][:2] for i in wanted]).groupBy("cell", "child").agg(*summed)
        cells = Cells(rest + [(r["low"], r["high"], r["size"]) for r in parts.collect()])
    return 0, []


def _split(sizes: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows of the given hash ranges with the range's number and one of its equal parts."""
    lows, highs = (np.array(x, dtype=np.int64) for x in zip(*ranges))

    def part(batches):
        for batch in batches:
            hashes = batch.column(0).to_numpy()
            at = np.searchsorted(lows, hashes, side="right") - 1
            inside = (at >= 0) & (hashes <= highs[at])
            at, hashes = at[inside], hashes[inside]
            steps = (highs - lows).view(np.uint64) // np.uint64(CHILDREN) + np.uint64(1)
            child = (hashes - lows[at]).view(np.uint64) // steps[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int64)), pa.array(child.astype(np.int64)), pa.array(hashes),
                 batch.column(1).filter(pa.array(inside))], ["cell", "child", "hash", "size"])

    return sizes.select("hash", "size").mapInArrow(part, "cell long, child long, hash long, size long")


def with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without putting a shard, or a group of copies, into one task."""
    cell = rows.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(SLOT_CELLS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cell.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_rows"))
        .select("shard", "_cell", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy("shard", "_cell").orderBy("doc_id", "hash")
    return (
        cell.withColumn("_at", F.row_number().over(inside)).join(offsets, ["shard", "_cell"])
        .withColumn("slot", F.col("_offset") + F.col("_at") - 1).drop("_cell", "_at", "_offset"))


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, hash, shard, slot) for every row of ``docs``."""
    rows = staged(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), "text").alias("hash")), "sizes")
    _, cuts = minimax_cuts(rows, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("hash") >= F.lit(cut)).cast("int")
    return with_slots(rows.withColumn("shard", shard))
