"""Mixing sources to target weights by subset-sum budget fitting.

**Targets.** Sources in code point order (null last) weigh 1, 2, 3, repeating,
and share the words of the whole corpus; no target passes ``most`` times its
source's words, and what is cut off goes to the others by weight.

**Fit.** Every source first takes all its documents as often as its target
allows. What is left of the target is a subset-sum problem over documents counted
by exact length. With few different choices all sums are formed. Otherwise each
length gives an even share of its documents, short of the budget by at least twice
the longest document, and a bounded knapsack finds the fullest sum of the rest. It
sees one row for each different length, never the documents. The wanted number of
each length is then drawn from the documents by a seeded hash.

**Defined results.** A null text has no words. Documents without words take none
and are kept once. Repeated rows are separate documents; equal ones are
interchangeable. A source without words has target 0, and so has everything if
no document has words. An empty table gives no rows. Other columns are carried
along untouched, whatever their names.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contractflow.llm.common import WORD, packed, staged
from contractflow.operators.rows import ROW, number_by_order

SEED = 20_240
#: Times a document may be taken at most.
MOST = 3
WEIGHTS = (1, 2, 3)
#: Words left to the knapsack: so many, or four times the longest document, ...
WINDOW = 32_768
#: ... and never more than this, which bounds its tables to about 120 MB.
CELLS = 1 << 24
#: Up to so many choices of documents are formed one by one, however long the documents are.
FEW = 1 << 16
#: A length's documents are drawn from so many hash buckets, so that no task ranks all copies of one text.
BUCKETS = 1024


def fullest_of_few(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """As ``fullest_sum``, over a table of the sums that exist instead of all up to the budget."""
    sums: dict[int, tuple[int, ...]] = {0: ()}
    for length, count in zip(lengths, counts):
        sums = {total + many * length: (*given, many) for many in range(count, -1, -1) for total, given in sums.items()
                if total + many * length <= budget}
    return list(sums[max(sums)])


def fullest_sum(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """Bounded knapsack: how many of each length give the largest sum within ``budget``."""
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    chosen = np.full(budget + 1, -1, np.int32)
    parts: list[tuple[int, int]] = []  # (which length, how many): each count in powers of two
    top = 0  # no sum beyond it is reached yet
    for which, (length, count) in enumerate(zip(lengths, counts)):
        step = 1
        while count > 0 and not reached[budget]:
            many = min(step, count)
            count, step = count - many, step * 2
            size = many * length
            if size > budget:
                break
            upto = min(top, budget - size) + 1
            fresh = reached[:upto] & ~reached[size:size + upto]
            chosen[size:size + upto][fresh] = len(parts)
            reached[size:size + upto] |= fresh
            top = max(top, size + upto - 1)
            parts.append((which, many))
    taken, left = [0] * len(lengths), int(np.nonzero(reached)[0][-1])
    while left:
        which, many = parts[chosen[left]]
        taken[which] += many
        left -= many * lengths[which]
    return taken


def fit_budget(
    lengths: list[int], counts: list[int], budget: int, seed: int, window: int = WINDOW, few: int = FEW, cells: int = CELLS,
) -> list[int]:
    """How many documents of each length to take so that their words come to ``budget`` as nearly as possible."""
    total = sum(a * b for a, b in zip(lengths, counts))
    budget = max(0, min(budget, total))
    if not budget:
        return [0] * len(lengths)
    choices = 1
    for count in counts:
        choices *= count + 1
        if choices > few:
            break
    else:
        return fullest_of_few(lengths, counts, budget)
    window = min(max(window, 4 * max(lengths)), max(window, cells))
    even = max(0, budget - window // 2)
    taken = [count * even // total for count in counts]
    left = budget - sum(a * b for a, b in zip(lengths, taken))
    order = list(range(len(lengths)))
    random.Random(seed).shuffle(order)
    while left > window:  # shares rounded down leave up to one document of each length
        moved = False
        for i in order:
            if taken[i] < counts[i] and lengths[i] <= left and left > window:
                taken[i] += 1
                left -= lengths[i]
                moved = True
        if not moved:
            break
    spare = [i for i in sorted(range(len(lengths)), key=lengths.__getitem__) if taken[i] < counts[i] and lengths[i] <= left]
    if left <= window:
        for i, more in zip(spare, fullest_sum([lengths[i] for i in spare], [counts[i] - taken[i] for i in spare], left)):
            taken[i] += more
    return taken


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, number, source_size, target, rounds, rest): one row for each source of ``sizes``."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = number_by_order(sums.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col(ROW) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = staged(
        numbered.select("source", F.col(ROW).alias("number"), "source_size", weight.cast("double").alias("weight")),
        "sources")
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total or 0) / (weights or 1), None
    while True:  # each round is one sum over the sources; it ends when no further source is at its limit
        at_limit = most * F.col("source_size") < F.lit(level) * F.col("weight")
        limited, size, rest = sources.agg(
            F.count(F.when(at_limit, 1)), F.sum(F.when(at_limit, most * F.col("source_size"))),
            F.sum(F.when(~at_limit, F.col("weight")))).first()
        if limited == full or not rest:
            break
        full, level = limited, (total - (size or 0)) / rest
    target = F.least(most * F.col("source_size").cast("double"), F.lit(float(level)) * F.col("weight"))
    rounds = F.when(F.col("source_size") > 0, F.least(F.floor(target / F.col("source_size")), F.lit(most))).otherwise(1)
    return sources.select(
        "source", "number", "source_size", target.alias("target"), rounds.cast("long").alias("rounds"),
        F.when(F.col("source_size") > 0, F.round(target - rounds * F.col("source_size"))).otherwise(0)
        .cast("long").alias("rest"))


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc, doc_id, source, _mix): whole rows, with their words and the seeded hash that draws a document."""
    words = F.coalesce(F.regexp_count("doc.text", F.lit(WORD)), F.lit(0)).cast("long")
    pick = F.xxhash64(F.lit(seed), "doc.doc_id", "doc.text")
    return packed(docs).select(
        "doc", "doc.doc_id", "doc.source", F.struct(words.alias("size"), pick.alias("pick")).alias("_mix"))


def mix(rows: DataFrame, skinny: DataFrame, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``rows`` (as from ``measured``) with ``_mix`` extended by source_size, target and times.

    ``skinny`` has source, size and pick of the same rows; all statistics come from it.
    """
    targets = staged(source_targets(skinny, most), "targets")
    known = skinny.join(targets.select(F.col("source").alias("_s"), "number", "rest"), F.col("source").eqNullSafe(F.col("_s")))
    known = staged(known.select("number", "rest", "size", F.pmod("pick", F.lit(BUCKETS)).cast("int").alias("bucket")), "lengths")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        number, rest = int(frame["number"].iloc[0]), int(frame["rest"].iloc[0])
        wanted = fit_budget(frame["size"].tolist(), frame["count"].tolist(), rest, seed + number)
        return pd.DataFrame({"number": number, "size": frame["size"].to_numpy(), "wanted": wanted})

    wanted = (
        known.where("size > 0 and rest > 0").groupBy("number", "rest", "size").count()
        .groupBy("number").applyInPandas(fit, "number long, size long, wanted long").where("wanted > 0"))
    before = Window.partitionBy("number", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = known.groupBy("number", "size", "bucket").count().join(wanted, ["number", "size"])
    drawn = counted.select(
        F.col("number").alias("_n"), F.col("size").alias("_size"), F.col("bucket").alias("_bucket"),
        (F.col("wanted") - F.coalesce(F.sum("count").over(before), F.lit(0))).alias("_wanted")).where("_wanted > 0")
    numbered = rows.withColumn("_at", F.struct("_mix.size", F.pmod("_mix.pick", F.lit(BUCKETS)).cast("int").alias("bucket")))
    numbered = numbered.join(
        targets.select(F.col("source").alias("_s"), F.struct("number", "source_size", "target", "rounds").alias("_t")),
        F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    inside = Window.partitionBy("_t.number", "_at.size", "_at.bucket").orderBy("_mix.pick", "doc_id")
    ranked = numbered.withColumn("_rank", F.row_number().over(inside)).join(
        drawn, (F.col("_t.number") == F.col("_n")) & (F.col("_at.size") == F.col("_size"))
        & (F.col("_at.bucket") == F.col("_bucket")), "left")
    extra = (F.col("_rank") <= F.coalesce("_wanted", F.lit(0))).cast("long")
    times = F.when(F.col("_mix.size") > 0, F.col("_t.rounds") + extra).otherwise(1)
    return ranked.withColumn("_mix", F.struct(
        "_mix.size", "_t.source_size", "_t.target", times.alias("times"))).drop(
        "_at", "_t", "_rank", "_n", "_size", "_bucket", "_wanted")


def mix_report(docs: DataFrame, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every row of ``docs``."""
    rows = staged(measured(docs, seed).select("doc_id", "source", "_mix"), "measured")
    mixed = mix(rows, rows.select("source", "_mix.size", "_mix.pick"), most, seed)
    return mixed.select(
        "doc_id", "_mix.size", "_mix.source_size", "_mix.target",
        (F.col("_mix.size") * F.col("_mix.times")).alias("taken"), "source")


def mix_rows(docs: DataFrame, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of the mix, each as often as the mix takes it, with the columns of ``docs``."""
    rows = measured(docs, seed)
    skinny = staged(rows.select("source", "_mix.size", "_mix.pick"), "measured")
    mixed = mix(rows, skinny, most, seed).where("_mix.times > 0")
    return mixed.withColumn("_mix", F.explode(F.array_repeat(F.lit(1), F.col("_mix.times").cast("int")))).select("doc.*")
