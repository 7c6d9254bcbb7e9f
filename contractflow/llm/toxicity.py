"""Toxicity by a classifier chain.

Categories are predicted in a fixed order, and each later linear model also sees
the probabilities of the categories before it. A model must not learn from
probabilities that its predecessors gave to their own training rows, so those are
out-of-fold: each comes from a model that was trained on the other folds.

A text's features are its words, the beginnings of its words (inflected and
compounded forms share them) and its shape (share of symbols, repetition,
length). Of the features of a bounded sample of labelled rows those that tell a
category apart best are kept. The models are logistic regressions; all fits of a
category run side by side, each in a task that holds the bounded sample, and their
coefficients score every whole text. The rejection threshold is the
one that separates the out-of-fold probabilities of the last category best, with
precision counting more than recall.

The label table knows two categories, low quality and toxic; the chain runs from
the first to the second.

**Defined results.** A null text is an empty one. Labels with a null id or a null
category are left out; of labels that contradict each other the higher counts. A
category with no or only one kind of label has its share as everyone's
probability, and with no toxic labels nothing is rejected. Repeated rows each get
a row. An empty table gives no rows. Other columns are not looked at.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractflow.llm.common import packed, staged

SEED = 3
#: Labelled rows that are learned from at most, drawn by a hash of the id.
SAMPLE = 8_000
FEATURES = 4096
FOLDS = 3
#: A feature must occur in so many rows of the sample.
ROWS = 3
PREFIXES = (3, 4, 5, 6, 7)
CATEGORIES = ("low_quality", "toxic")
#: Words whose features a task remembers, and features it counts before it hands them on. A worker that has
#: held much keeps the memory while the JVM works, so both are small.
HELD = 60_000

WORDS = re.compile(r"[^\W_]+")


def word_features(word: str) -> list[str]:
    return [word, *["^" + word[:n] for n in PREFIXES if len(word) >= n]]


def shape_features(text: str, counts: Counter) -> list[str]:
    """Buckets of the share of symbols, of repetition, and of length."""
    total = sum(counts.values())
    letters = sum(len(w) * n for w, n in counts.items())
    symbols = max(0.0, 1 - (letters + total) / max(1, len(text)))
    repeats = 1 - len(counts) / max(1, total)
    return [f"#symbols{min(9, int(10 * symbols))}", f"#repeats{min(9, int(10 * repeats))}",
            f"#length{int(math.log2(1 + total))}"]


def _parts(text: str | None) -> tuple[str, Counter]:
    text = text or ""
    return text, Counter(WORDS.findall(text.lower()))


def features(text: str | None) -> set[str]:
    """All features of a text."""
    text, counts = _parts(text)
    found = {*counts, *shape_features(text, counts)}
    for n in PREFIXES:
        found |= {"^" + word[:n] for word in counts if len(word) >= n}
    return found


def known_features(known):
    """A function from text to the counts of its known features; it remembers words, up to a bound."""
    seen: dict[str, tuple[str, ...]] = {}

    def count(text: str | None) -> Counter:
        text, counts = _parts(text)
        found = Counter(f for f in shape_features(text, counts) if f in known)
        for word, n in counts.items():
            own = seen.get(word)
            if own is None:
                if len(seen) > HELD:
                    seen.clear()
                own = seen[word] = tuple(f for f in word_features(word) if f in known)
            for feature in own:
                found[feature] += n
        return found

    return count


def weight(count: int) -> float:
    return math.log2(1 + count)


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, labels) to partial counts (feature, rows, positive rows of each category)."""
    held = [Counter() for _ in range(1 + len(CATEGORIES))]

    def out():
        rows, *positive = held
        batch = pa.RecordBatch.from_pydict({
            "feature": pa.array(rows, pa.string()), "rows": pa.array(rows.values(), pa.int64()),
            **{f"p{i}": pa.array([c[f] for f in rows], pa.int64()) for i, c in enumerate(positive)}})
        for counter in held:
            counter.clear()
        return batch

    for batch in batches:
        for text, labels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = features(text)
            for counter, counted in zip(held, (1, *labels)):
                if counted:
                    counter.update(found)
            if len(held[0]) > HELD:
                yield out()
    yield out()


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text, labels, fold): at most ``sample`` labelled documents, one row an id."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.array(
        F.max((1 - F.col("quality")).cast("long")), F.max(F.col("toxic").cast("long"))).alias("labels"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    # One text an id, whatever its rows; the first by hash combines before the shuffle.
    texts = found.groupBy("doc_id", "labels").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    rows = texts.select("doc_id", "first.text", "labels")
    return staged(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(FOLDS)).cast("int")), "labelled")


def choose_features(rows: DataFrame, most: int = FEATURES) -> list[str]:
    """The features that tell some category apart best, by the normal score of their shares."""
    counts = rows.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.col("labels")[i]), F.lit(0)) for i in range(len(CATEGORIES))]).first()
    total = counts[0]
    if not total:
        return []
    positives = [f"p{i}" for i in range(len(CATEGORIES))]
    table = rows.select("text", "labels").mapInArrow(
        _label_counts, "feature string, rows long, " + ", ".join(f"{p} long" for p in positives))
    table = table.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("rows", *positives)])
    score = F.lit(0.0)
    for i in range(len(CATEGORIES)):
        share = counts[1 + i] / total
        spread = F.sqrt(F.col("rows") * F.lit(max(share * (1 - share), 1e-9)))
        score = F.greatest(score, F.abs(F.col(f"p{i}") - F.col("rows") * share) / spread)
    best = table.where(F.col("rows") >= ROWS).withColumn("score", score).orderBy(F.desc("score"), "feature").limit(most)
    return sorted(best.select("feature").toArrow()["feature"].to_pylist())


def _with_vectors(rows: DataFrame, names: list[str]) -> DataFrame:
    """(row, fold, labels, at, weight): the sample's known features as index and value lists."""
    sent = rows.sparkSession.sparkContext.broadcast({name: i for i, name in enumerate(names)})

    @F.pandas_udf("at array<int>, weight array<double>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = sent.value
        count = known_features(known)
        for texts in batches:
            rows = [sorted((known[f], weight(n)) for f, n in count(t).items()) for t in texts]
            yield pd.DataFrame({"at": [[i for i, _ in r] for r in rows], "weight": [[w for _, w in r] for r in rows]}, dtype=object)

    return staged(
        rows.select(F.monotonically_increasing_id().alias("row"), "fold", "labels", found("text").alias("found"))
        .select("row", "fold", "labels", "found.*"), "vectors")


def logistic(rows: np.ndarray, at: np.ndarray, weights: np.ndarray, labels: np.ndarray, size: int,
             ridge: float = 2e-3, rounds: int = 60) -> np.ndarray:
    """Coefficients and, last, the intercept of a ridge logistic regression, by limited-memory quasi-Newton steps.

    The inputs are given as (row, feature, value) triples. With one kind of label
    only the intercept differs from zero: it gives the labels' share.
    """
    n = len(labels)
    share = min(max(labels.mean() if n else 0.0, 1e-6), 1 - 1e-6)
    w = np.zeros(size + 1)
    w[-1] = math.log(share / (1 - share))
    if not n or labels.min() == labels.max():
        return w

    def loss(w):
        z = np.bincount(rows, weights * w[at], n) + w[-1]
        error = 1 / (1 + np.exp(-z)) - labels
        slope = np.append(np.bincount(at, weights * error[rows], size) / n + ridge * w[:-1], error.mean())
        return np.logaddexp(0, z).mean() - (labels * z).mean() + ridge / 2 * (w[:-1] ** 2).sum(), slope

    value, slope = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, kept = -slope, []
        for s, y in reversed(steps):
            a = (s @ direction) / (s @ y)
            direction = direction - a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            direction = direction * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(kept)):
            direction = direction + s * (a - (y @ direction) / (s @ y))
        length, fall = 1.0, slope @ direction
        while length > 1e-8:
            further, steeper = loss(w + length * direction)
            if further <= value + 1e-4 * length * fall:
                break
            length /= 2
        else:
            break
        s, y = length * direction, steeper - slope
        if s @ y > 1e-12:
            steps = [*steps[-9:], (s, y)]
        done = value - further < 1e-7
        w, value, slope = w + s, further, steeper
        if done:
            break
    return w


def _fit_all(vectors: DataFrame, category: int, size: int) -> tuple[np.ndarray, DataFrame]:
    """The coefficients fitted on the whole sample, and (row, p): out-of-fold probabilities.

    ``vectors`` has the earlier categories' probabilities as further features. Each
    fit is a task of its own, which holds the bounded sample.
    """

    def fit(group: pa.Table) -> pa.Table:
        # Lists stay flat: an object a row and copies of the triples would double the worker's memory.
        group = group.take(np.argsort(group["row"].to_numpy())).combine_chunks()
        which, folds, labels = group["fit"][0].as_py(), group["fold"].to_numpy(), group["label"].to_numpy().astype(float)
        row, lists = group["row"].to_numpy(), [group[c].chunk(0) for c in ("at", "weight")]
        many = lists[0].value_lengths().to_numpy()
        at, value = (x.flatten().to_numpy() for x in lists)
        del group
        train = folds != which
        use = np.repeat(train, many)
        w = logistic(np.repeat(np.arange(int(train.sum()), dtype=np.int32), many[train]), at[use], value[use], labels[train], size)
        if which < 0:
            row, p, weights = [-1], [None], [w.tolist()]
        else:
            rest = ~train
            z = np.bincount(np.repeat(np.arange(int(rest.sum())), many[rest]), value[~use] * w[at[~use]], int(rest.sum())) + w[-1]
            row, p = row[rest], 1 / (1 + np.exp(-z))
            weights = [None] * len(p)
        return pa.table({"row": pa.array(row, pa.int64()), "p": pa.array(p, pa.float64()),
                         "weights": pa.array(weights, pa.list_(pa.float64()))})

    fits = F.explode(F.array(*[F.lit(i) for i in range(-1, FOLDS)])).alias("fit")
    rows = vectors.select(fits, "row", "fold", "at", "weight", F.col("labels")[category].alias("label"))
    result = staged(rows.groupBy("fit").applyInArrow(fit, "row long, p double, weights array<double>"), "fitted")
    found = result.where("row < 0").select("weights").first()
    weights = np.array(found[0]) if found else logistic(*[np.zeros(0, np.int64)] * 2, np.zeros(0), np.zeros(0), size)
    return weights, result.where("row >= 0").select("row", "p")


class Chain:
    """Per category: coefficients by feature, one for each earlier category, and the intercept."""

    def __init__(self, names: list[str], fits: list[np.ndarray], threshold: float):
        self.threshold = threshold
        self.constants = [float(w[-1]) for w in fits]
        self.earlier = [[float(x) for x in w[len(names):-1]] for w in fits]
        self.weights = {name: tuple(float(w[i]) for w in fits) for i, name in enumerate(names)}

    def scorer(self):
        """A function from text to the categories' probabilities."""
        count = known_features(self.weights)

        def score(text):
            sums = list(self.constants)
            for feature, n in count(text).items():
                value = weight(n)
                for i, w in enumerate(self.weights[feature]):
                    sums[i] += w * value
            given: list[float] = []
            for i, total in enumerate(sums):
                total += sum(w * p for w, p in zip(self.earlier[i], given))
                given.append(1 / (1 + math.exp(-max(-60.0, min(60.0, total)))))
            return given

        return score


def _best_threshold(pairs: list[tuple[float, float]], beta: float = 0.5) -> float:
    """The midpoint between probabilities that has the highest F score, precision weighing more."""
    positives = sum(y for _, y in pairs)
    if not positives:
        return math.inf
    ordered, best, hits = sorted(pairs, reverse=True), (-1.0, 0.5), 0.0
    for taken, (p, y) in enumerate(ordered, 1):
        hits += y
        after = ordered[taken][0] if taken < len(ordered) else 0.0
        if after == p:
            continue
        f = (1 + beta ** 2) * hits / (beta ** 2 * positives + taken)
        best = max(best, (f, (p + after) / 2))
    return best[1]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fit the chain; later categories see out-of-fold probabilities of the earlier ones."""
    rows = labelled_sample(docs, labels, sample)
    names = choose_features(rows)
    vectors, fits, pairs = _with_vectors(rows, names), [], []
    for category in range(len(CATEGORIES)):
        weights, given = _fit_all(vectors, category, len(names) + category)
        fits.append(weights)
        if category < len(CATEGORIES) - 1:
            vectors = staged(vectors.join(given, "row").select(
                "row", "fold", "labels", F.concat("at", F.array(F.lit(len(names) + category))).alias("at"),
                F.concat("weight", F.array("p")).alias("weight")), "chained")
        else:
            judged = vectors.select("row", F.col("labels")[category].cast("double").alias("y")).join(given, "row")
            pairs = [(r["p"], r["y"]) for r in judged.collect()]  # at most the sample
    return Chain(names, fits, _best_threshold(pairs))


def score(docs: DataFrame, chain: Chain, text: str = "text", into: str = "_toxicity") -> DataFrame:
    """``docs`` with a struct of the categories' probabilities and ``rejected`` in the column ``into``."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    columns = list(CATEGORIES)

    @F.pandas_udf(", ".join(f"{c} double" for c in columns))
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        given = sent.value.scorer()
        for texts in batches:
            yield pd.DataFrame([given(t) for t in texts], columns=columns)

    found = docs.withColumn(into, probabilities(F.col(text)))
    return found.withColumn(into, F.col(into).withField("rejected", F.col(f"{into}.{columns[-1]}") > F.lit(chain.threshold)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, low_quality, toxicity, toxic) for every row of ``docs``."""
    found = score(docs.select("doc_id", "text"), learn(docs, labels))
    return found.select(
        "doc_id", F.col("_toxicity.low_quality").alias("low_quality"), F.col("_toxicity.toxic").alias("toxicity"),
        F.col("_toxicity.rejected").alias("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that are not rejected, with the columns of ``docs``."""
    found = score(packed(docs), learn(docs, labels), "doc.text")
    return found.where(~F.col("_toxicity.rejected")).select("doc.*")
