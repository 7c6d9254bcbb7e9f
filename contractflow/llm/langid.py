"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls
back to its longest known character n-grams: those of four characters if any is
known, else of three, two or one; a word with none says nothing. The word scores
of a whole text add up; the prediction is the language with the largest sum, and
its score the posterior probability with equal priors.

The counts are learned from labelled documents, ``PER_LANGUAGE`` of each language
on average, drawn by a hash of the id; words and n-grams kept are bounded too, so
the model that goes to every executor has a bounded size.

**Defined results.** A text that is null or has no letter is ``und`` with score
0, and so is every text if nothing could be learned. Languages that tie go by
code point order. Rows without an id are never learned from nor held out.
Repeated rows each count and each get a prediction. Other columns are not looked
at.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractflow.llm.common import packed, staged, union_all

SEED = 8
UNKNOWN = "und"
#: Documents of a language that are learned from, on average.
PER_LANGUAGE = 1_500
#: Words and n-grams of each length kept: those counted most often, twice at least.
KEPT = {0: 80_000, 4: 60_000, 3: 30_000, 2: 8_000, 1: 2_000}
#: Counts a task holds before it hands them on, and scores of unseen words it remembers. A worker that has
#: held much keeps the memory while the JVM works, so both are small.
HELD = 60_000
SMOOTH = 0.5

LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    return Counter(LETTERS.findall(text.lower()))


def grams(word: str, size: int) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + size] for i in range(len(padded) - size + 1)]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents whose id no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count(batches):
    """(lang, text) to partial counts (lang, word, n)."""
    def out(held):
        rows = [(lang, word, n) for lang, counter in held.items() for word, n in counter.items()]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    held: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        if sum(map(len, held.values())) > HELD:
            yield out(held)
            held = {}
    yield out(held)


class Model:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, languages: list[str], rows: dict[int, list[tuple[str, list[int]]]]):
        self.languages = languages
        self.known: dict[int, dict[str, int]] = {}
        self.logs: dict[int, np.ndarray] = {}
        for size in KEPT:
            found = sorted(rows.get(size, []))
            counts = np.array([n for _, n in found], dtype=np.float64).reshape(len(found), len(languages))
            smooth = counts + SMOOTH
            self.known[size] = {gram: i for i, (gram, _) in enumerate(found)}
            # One more gram stands for all unseen ones, so a lone gram still tells languages apart.
            self.logs[size] = np.log(smooth / (smooth.sum(axis=0) + SMOOTH)) if len(found) else smooth

    def unseen(self, word: str) -> np.ndarray:
        for size in (4, 3, 2, 1):
            known = self.known[size]
            at = [known[g] for g in grams(word, size) if g in known]
            if at:
                return np.add.reduce(self.logs[size].take(at, axis=0)) / len(at)
        return np.zeros(len(self.languages))

    def scorer(self):
        """A function from text to (language, score) that remembers unseen words, up to a bound."""
        base, seen = self.logs[0], {}
        known = self.known[0]
        rows = np.zeros((1024, len(self.languages)))

        def score(text):
            nonlocal rows
            counts = words_of(text) if text is not None and self.languages else {}
            if not any(any(map(str.isalpha, w)) for w in counts):
                return UNKNOWN, 0.0
            if len(seen) > HELD:
                seen.clear()
            at, of, more, many = [], [], [], []
            for word, n in counts.items():
                i = known.get(word)
                if i is not None:
                    at.append(i)
                    of.append(n)
                    continue
                i = seen.get(word)
                if i is None:
                    i = seen[word] = len(seen)
                    if i == len(rows):
                        rows = np.concatenate([rows, np.zeros_like(rows)])
                    rows[i] = self.unseen(word)
                more.append(i)
                many.append(n)
            total = np.array(of, float) @ base[at] if at else np.zeros(len(self.languages))
            if more:
                total = total + np.array(many, float) @ rows[more]
            best = int(total.argmax())
            return self.languages[best], float(1 / np.exp(total - total[best]).sum())

        return score


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = SEED) -> Model:
    """A model from the labelled documents that are not held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    found = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(found)
    if not languages:
        return Model([], {})
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / found[lang]))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)
    words = staged(
        labelled.where(draw).select("lang", "text").mapInArrow(_count, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    pieces = [
        words.select("lang", "n", F.lit(size).alias("size"), F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("word") + 3 - size)),
            lambda i: F.substr(padded, i, F.lit(size)))).alias("gram"))
        for size in (1, 2, 3, 4)]
    counted = union_all([words.select("lang", "n", F.lit(0).alias("size"), F.col("word").alias("gram")), *pieces])
    # One column a language, so that a gram is one row; there are as many as languages were learned.
    table = counted.groupBy("size", "gram").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"l{i}")
                                 for i, lang in enumerate(languages)])
    table = staged(table.where("n > 1"), "grams")
    rows = {}
    for size, most in KEPT.items():
        best = table.where(F.col("size") == size).orderBy(F.desc("n"), "gram").limit(most)
        got = best.select("gram", *[f"l{i}" for i in range(len(languages))]).toArrow().to_pydict()
        rows[size] = list(zip(got["gram"], zip(*[got[f"l{i}"] for i in range(len(languages))])))
    return Model(languages, rows)


def predict(docs: DataFrame, model: Model, text: str = "text", into: str = "_language") -> DataFrame:
    """``docs`` with a struct (lang_pred, score) in the column ``into``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = sent.value.scorer()
        for texts in batches:
            yield pd.DataFrame([score(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn(into, identify(F.col(text)))


def identify_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``, learned from ``docs``."""
    named = predict(docs.select("doc_id", "text"), learn(docs))
    return named.select("doc_id", held_out().alias("held_out"), "_language.lang_pred", "_language.score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose language could be told with a score of ``least`` or more; the columns of ``docs``."""
    named = predict(packed(docs), learn(docs), "doc.text")
    known = (F.col("_language.lang_pred") != UNKNOWN) & (F.col("_language.score") >= least)
    return named.where(known).select("doc.*")
