"""Importance resampling towards a target by bit-sliced sums of bucket gains.

Features, runs of words, fall into hash buckets. The whole corpus and the target
texts are counted by bucket, which gives each bucket a gain: the log ratio of its
smoothed shares, as a whole number. A document's weight is the sum of the gains of
its features.

The sum is taken over bit planes. A document's bucket counts become planes of one
bit a bucket, plane j holding bit j of every count; the gains become planes in two's
complement, whose top plane counts negative. The weight is the sum over all pairs
of planes of the bits that both have set, times the two planes' powers of two.
Popcounts and powers of two make it exact for any length of text.

Each score is the weight plus Gumbel noise drawn from the id, so the highest scores
are a sample without replacement in proportion to the weights' exponentials. Ranks
come from a range sort of whole-number rows; texts are never shuffled, and the
driver holds one count a bucket.

**Defined results.** A null text, or one without words, has no features and weight
zero. Repeated rows each count and each take part. A row without an id draws the
noise of an empty id and comes last among equal scores; equal rows are ranked in
any order. Documents with too few words are weighed and never drawn. An empty
target leaves every bucket the smoothed share. An empty corpus gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractflow.llm.common import staged
from contractflow.operators.rows import ROW, number_by_order

BUCKETS = 10_000
#: Words whose buckets a task remembers.
HELD = 200_000

#: Bytes of a word are digits, letters (lower-cased) and all beyond ASCII; the rest separates.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


class Features:
    """Word and bucket counts of texts."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.seen: dict[bytes, int] = {}

    def _bucket(self, feature: bytes) -> int:
        at = self.seen.get(feature)
        if at is None:
            if len(self.seen) >= HELD:
                self.seen.clear()
            at = self.seen[feature] = zlib.crc32(feature) % self.buckets
        return at

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        """(number of words, the bucket of each feature)."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
        found = list(map(self._bucket, words))
        for n in range(2, self.longest + 1):
            found += [self._bucket(b" ".join(run)) for run in zip(*[words[i:] for i in range(n)])]
        return len(words), np.array(found, np.int64)


def bucket_totals(texts: DataFrame, column: str, longest: int, buckets: int) -> list[int]:
    """How often each bucket occurs in all texts."""

    def count(batches):
        features, totals = Features(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                totals += np.bincount(features(text)[1], minlength=buckets)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at])], ["bucket", "n"])

    found = texts.select(column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = [0] * buckets
    for row in found.toArrow().to_pylist():  # one row a bucket
        totals[row["bucket"]] = row["n"]
    return totals


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Each bucket's gain: 1000 times the log of target share to corpus share, rounded down."""
    buckets, s, t = len(corpus), sum(corpus), sum(target)
    return np.array([
        math.floor(1000 * math.log((1.0 + b) * (s + buckets) / ((1.0 + a) * (t + buckets)))) for a, b in zip(corpus, target)], np.int64)


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes, lowest first, of whole numbers: one row of 64-bit words a plane."""
    width = -(-len(values) // 64) * 8
    packed = np.zeros((bits, width), np.uint8)
    for j in range(bits):
        row = np.packbits((values >> j & 1).astype(np.uint8), bitorder="little")
        packed[j, :len(row)] = row
    return packed.view(np.uint64)


class Gains:
    """Gain planes in two's complement, and their powers of two; the top plane's is negative."""

    def __init__(self, values: np.ndarray):
        bits = int(np.abs(values).max(initial=0)).bit_length() + 1
        self.planes = planes(values, bits)
        self.powers = [1 << k for k in range(bits - 1)] + [-(1 << bits - 1)]

    def weight(self, counts: np.ndarray) -> int:
        """The exact sum of counts times gains."""
        total = 0
        for j, plane in enumerate(planes(counts, int(counts.max(initial=0)).bit_length())):
            common = np.bitwise_count(self.planes & plane).sum(axis=1, dtype=np.int64)
            total += sum(int(n) * power for n, power in zip(common, self.powers)) << j
        return total


def weighed(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of ``docs``."""
    values = gains(bucket_totals(docs, "text", longest, buckets), bucket_totals(target, "text", longest, buckets))

    def weigh(batches):
        features, table = Features(longest, buckets), Gains(values)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words, found = features(text)
                rows.append((words, len(found), table.weight(np.bincount(found, minlength=buckets))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))],
                ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024,
             longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank); rank is null for documents that are not drawn."""
    drawn = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256),
                            F.lit(1), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = staged(weighed(docs, target, longest, buckets).withColumn("score", F.col("weight") + noise), "weights")
    able = scored.where(F.col("n_words") >= least_words)
    quota = percent * able.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    numbered = number_by_order(able.select(*columns), [F.desc("score"), F.asc_nulls_last("doc_id")], "ranked")
    ranked = numbered.select(*columns, F.when(F.col(ROW) <= quota, F.col(ROW)).cast("long").alias("rank"))
    rest = scored.where(F.col("n_words") < least_words)
    return ranked.unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
