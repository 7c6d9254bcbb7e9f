"""Class-based n-gram scores of texts: Brown clusters found by distributed exchange.

Words that occur often enough are clustered into classes so that the likelihood of
neighbouring classes is highest; all rarer words, and those never seen, share one
class, and the end of a text is a class of its own. A text's probability is the
product, over its tokens, of the transition from the two classes before to the
token's class and of the token's emission from its class.

**Clustering.** The counts of neighbours are kept as one row a word: how often each
clustered word stands left and right of it, at most ``WORDS`` entries each. In each
round the rows meet the current classes, which are broadcast as one small array;
the class matrix is summed, and every word finds the class in which the likelihood
gains most once it is taken out of its own. Half the words may move in a round,
chosen by a hash, since all see the same matrix. The best round's classes count.
Results don't depend on how rows are dealt to tasks.

**Probabilities.** Transitions are interpolated from three classes to two to one
by Witten and Bell's rule, so all are positive. A clustered word's emission is its
share of its class; in the class of rare words one is added to every count, unseen
words counting as one more word. The model thus sums to one over the words of the
training texts and one unseen word, like the base it is compared with.

**Size.** Counts come from all training texts. What is broadcast is bounded: the
clustered words with class and count, and the cube of class transitions. Rare
words are looked up exactly, by a join of each text's rare words with all counts.

**Defined results.** A null text is an empty one: a lone end. Rows without an id are
never learned from nor held out. Repeated rows each count and each get a score. With
nothing to learn from, every token is the one unseen word, with probability one. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractflow.llm.common import staged

#: Classes, the one of rare words and that of ends included.
CLASSES = 64
#: Words that are clustered: those counted most often, ``LEAST`` times at least.
WORDS, LEAST = 32_768, 3
ROUNDS = 8
#: Different words or pairs a task holds before it hands on their counts.
HELD = 400_000
HELD_PAIRS = 4_000_000
RARE, END = 0, 1
END_WORD = b""


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END_WORD]


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all tokens."""

    def out(held: Counter):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                if len(held) > HELD:
                    yield out(held)
                    held = Counter()
        yield out(held)

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """The clustered words, numbered by count; the number after the last stands for all others."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        self.number = {word: i for i, (word, _) in enumerate(rows)}
        self.counts = np.array([n for _, n in rows], np.int64)

    def __len__(self) -> int:
        return len(self.counts)

    def numbers(self, found: list[bytes]) -> np.ndarray:
        get, other = self.number.get, len(self)
        return np.array([get(w, other) for w in found], np.int64)


def pair_counts(texts: DataFrame, sent) -> DataFrame:
    """(pair, n) of neighbouring tokens: left number times the numbers there are, plus right number."""

    def settled(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        return pairs, np.bincount(where, np.concatenate([n for _, n in parts]), len(pairs)).astype(np.int64)

    def count(batches):
        lexicon = sent.value
        base, held, size, fresh = len(lexicon) + 1, [], 0, 0
        first = lexicon.numbers([END_WORD])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                line = np.concatenate([first, lexicon.numbers(tokens(text))])
                held.append((line[:-1] * base + line[1:], np.ones(len(line) - 1, np.int64)))
                fresh += len(line)
                if fresh > HELD_PAIRS:
                    held = [settled(held)]
                    fresh, size = 0, len(held[0][0])
                    if size > HELD_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "n"])
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in settled(held)], ["pair", "n"])

    return texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


# -- exchange -----------------------------------------------------------------------------

def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """What classes decide of the log likelihood of neighbouring classes."""
    return float(_phi(matrix).sum() - _phi(matrix.sum(0)).sum() - _phi(matrix.sum(1)).sum())


def best_class(matrix: np.ndarray, own: int, left: np.ndarray, right: np.ndarray, self_pairs: float) -> int:
    """The class in which a word's pairs raise the likelihood most; a word stays where no class is better.

    ``left`` and ``right`` count the classes beside the word, without pairs of the word with itself.
    """
    m = matrix.copy()
    m[:, own] -= left
    m[own, :] -= right
    m[own, own] -= self_pairs
    cell = np.diag(m)
    at_left, at_right = np.flatnonzero(left), np.flatnonzero(right)
    into, out = m[at_left, :], m[:, at_right]
    gain = (_phi(into + left[at_left, None]) - _phi(into)).sum(0) + (_phi(out + right[None, at_right]) - _phi(out)).sum(1)
    # The cell of a class with itself takes both sides and the word's own pairs at once.
    gain += _phi(cell + left + right + self_pairs) - _phi(cell + left) - _phi(cell + right) + _phi(cell)
    # The classes beside the word get its pairs back wherever it goes.
    for total, n in ((m.sum(0) + right, left.sum() + self_pairs), (m.sum(1) + left, right.sum() + self_pairs)):
        gain -= _phi(total + n) - _phi(total)
    gain[[RARE, END]] = -np.inf
    best = int(gain.argmax())
    return best if gain[best] > gain[own] + 1e-9 * abs(gain[own]) else own


def _beside(batch: pa.RecordBatch, side: str, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the classes on one side of each word of a batch, and of the word itself there."""
    numbers = batch.column("number").to_numpy()
    at, n = batch.column(side), batch.column(f"{side}_n").flatten().to_numpy().astype(np.float64)
    row = np.repeat(np.arange(len(numbers)), at.value_lengths().to_numpy())
    at = at.flatten().to_numpy()
    counts = np.bincount(row * CLASSES + classes[at], n, len(numbers) * CLASSES).reshape(-1, CLASSES)
    same = at == numbers[row]
    return counts, np.bincount(row[same], n[same], len(numbers))


def _matrix(profiles: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of class pairs: at most the square of the classes comes to the driver."""
    sent = profiles.sparkSession.sparkContext.broadcast(classes)

    def count(batches):
        cells, given = np.zeros((CLASSES, CLASSES)), sent.value
        for batch in batches:
            np.add.at(cells.T, given[batch.column("number").to_numpy()], _beside(batch, "left", given)[0])
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(cells.ravel()[at].astype(np.int64))], ["cell", "n"])

    found = profiles.select("number", "left", "left_n").mapInArrow(count, "cell long, n long")
    cells = np.zeros(CLASSES * CLASSES)
    for row in found.groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        cells[row["cell"]] = row["n"]
    sent.unpersist()
    return cells.reshape(CLASSES, CLASSES)


def _moves(profiles: DataFrame, classes: np.ndarray, matrix: np.ndarray, turn: int) -> list[dict]:
    """New classes of the words that leave theirs: at most one row a clustered word."""
    sent = profiles.sparkSession.sparkContext.broadcast((classes, matrix))

    def move(batches):
        given, cells = sent.value
        for batch in batches:
            numbers = batch.column("number").to_numpy()
            (left, itself), (right, _) = _beside(batch, "left", given), _beside(batch, "right", given)
            own = given[numbers]
            rows = np.arange(len(numbers))
            left[rows, own] -= itself
            right[rows, own] -= itself
            best = np.array([best_class(cells, int(own[i]), left[i], right[i], float(itself[i])) for i in rows], np.int64)
            at = np.flatnonzero(best != own)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[at], pa.int32()), pa.array(best[at], pa.int32())], ["number", "class"])

    fixed = [int(i) for i in np.flatnonzero(np.isin(classes, (RARE, END)))]  # rare words as one, and the end
    able = profiles.where(~F.col("number").isin(fixed) & (F.pmod(F.xxhash64("number", F.lit(turn)), F.lit(2)) == 0))
    found = able.mapInArrow(move, "number int, class int").toArrow().to_pylist()
    sent.unpersist()
    return found


def cluster(texts: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each clustered word, and at the end that of all others."""
    classes = np.append(2 + np.arange(len(lexicon)) % (CLASSES - 2), RARE)
    if END_WORD in lexicon.number:
        classes[lexicon.number[END_WORD]] = END
    if not rounds or len(lexicon) < 2:
        return classes
    sent = texts.sparkSession.sparkContext.broadcast(lexicon)
    base = F.lit(len(lexicon) + 1)
    pairs = staged(pair_counts(texts, sent), "pairs").select(
        F.expr(f"CAST(pair DIV {len(lexicon) + 1} AS INT)").alias("l"), (F.col("pair") % base).cast("int").alias("r"), "n")
    sides = pairs.select(F.col("r").alias("number"), F.struct(F.col("l").alias("at"), "n").alias("left"), F.lit(None).alias("right")).unionByName(
        pairs.select(F.col("l").alias("number"), F.lit(None).alias("left"), F.struct(F.col("r").alias("at"), "n").alias("right")))
    both = sides.groupBy("number").agg(F.collect_list("left").alias("left"), F.collect_list("right").alias("right"))
    profiles = staged(both.select("number", *[
        F.col(f"{side}.{name}").alias(alias) for side in ("left", "right") for name, alias in (("at", side), ("n", f"{side}_n"))]), "profiles")
    kept, most = classes, -np.inf
    for turn in range(rounds + 1):
        matrix = _matrix(profiles, classes)
        reached = likelihood(matrix)
        if reached > most:
            kept, most = classes, reached
        if turn == rounds:
            break
        moved = _moves(profiles, classes, matrix, turn)
        if not moved:
            break
        classes = classes.copy()
        classes[[m["number"] for m in moved]] = [m["class"] for m in moved]
    return kept


# -- the model ----------------------------------------------------------------------------

def transition_counts(texts: DataFrame, sent) -> np.ndarray:
    """Counts of three neighbouring classes; at most the cube of the classes comes to the driver."""

    def count(batches):
        cube, (lexicon, classes) = np.zeros(CLASSES ** 3, np.int64), sent.value
        first = classes[lexicon.numbers([END_WORD])].repeat(2)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(cube, _codes(first, classes[lexicon.numbers(tokens(text))], CLASSES), 1)
        at = np.flatnonzero(cube)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(cube[at])], ["cell", "n"])

    found = texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cube = np.zeros(CLASSES ** 3)
    cube[found["cell"].to_numpy()] = found["n"].to_numpy()
    return cube.reshape(CLASSES, CLASSES, CLASSES)


def _codes(first: np.ndarray, line: np.ndarray, many: int) -> np.ndarray:
    whole = np.concatenate([first, line])
    return (whole[:-2] * many + whole[1:-1]) * many + whole[2:]


def transitions(cube: np.ndarray) -> np.ndarray:
    """Logs of the probability of a class after two others: each level mixed with the one below by its variety."""
    pairs = cube.sum(axis=0)
    single = pairs.sum(axis=0)
    able = single > 0
    able[RARE] = True
    below = np.where(able, single + 1, 0) / (single.sum() + able.sum())
    for level in (pairs, cube):
        variety = np.maximum(1, (level > 0).sum(axis=-1, keepdims=True))
        below = (level + variety * below) / (level.sum(axis=-1, keepdims=True) + variety)
    return np.log10(np.where(able, below, 1.0))


class Model:
    """Clustered words with classes and counts, transitions, and the totals that the other words need."""

    def __init__(self, lexicon: Lexicon, classes: np.ndarray, cube: np.ndarray, total: int, kinds: int):
        self.lexicon, self.classes = lexicon, classes
        self.total, self.kinds, self.many = total, kinds, cube.shape[0]
        self.log_transition = transitions(cube).ravel()
        of_class = np.bincount(classes[:-1], lexicon.counts, self.many)
        self.log_emission = np.append(np.log10(lexicon.counts / of_class[classes[:-1]]), 0.0)
        self.log_count = np.append(np.log10(lexicon.counts + 1.0), 0.0)
        #: What each token's base probability, and each rare token's emission, is divided by.
        self.log_base = float(np.log10(total + kinds + 1))
        self.log_rare = float(np.log10(total - int(lexicon.counts.sum()) + kinds - len(lexicon) + 1))
        self.first = classes[lexicon.numbers([END_WORD])].repeat(2)

    def score(self, text: str | None) -> tuple[int, int, float, float, Counter]:
        """(tokens, rare tokens, base, score, rare words); the last three lack the counts of rare words."""
        found = tokens(text)
        numbers = self.lexicon.numbers(found)
        rare = np.flatnonzero(numbers == len(self.lexicon))
        base = self.log_count[numbers].sum() - len(found) * self.log_base
        codes = _codes(self.first, self.classes[numbers], self.many)
        score = self.log_transition[codes].sum() + self.log_emission[numbers].sum() - len(rare) * self.log_rare
        return len(found), len(rare), float(base), float(score), Counter([found[i] for i in rare])


def learn(texts: DataFrame, words: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model from all of ``texts``, whose word counts are ``words``."""
    spark = texts.sparkSession
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = words.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(WORDS).toArrow().to_pylist()
    lexicon = Lexicon([(bytes(r["word"]), r["n"]) for r in often])
    classes = cluster(texts, lexicon, rounds)
    return Model(lexicon, classes, transition_counts(texts, spark.sparkContext.broadcast((lexicon, classes))), total, kinds)


def score_texts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    The model is learned from the rows whose id's CRC-32 leaves another remainder than 2 modulo 7.
    """
    rows = docs.select("doc_id", "text", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"))
    texts = rows.where(F.col("doc_id").isNotNull() & ~F.col("held_out")).select("text")
    words = staged(word_counts(texts), "words")
    model = learn(texts, words, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        number = (TaskContext.get().partitionId() << 33) - 1  # a row's number, fixed by the written table
        for batch in batches:
            found = [sent.value.score(text) for text in batch.column("text").to_pylist()]
            at = pa.array(range(number + 1, number + 1 + len(found)), pa.int64())
            number += len(found)
            yield pa.RecordBatch.from_arrays(
                [at, batch.column("doc_id"), batch.column("held_out"),
                 *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))),
                 pa.array([list(f[4].keys()) for f in found], pa.list_(pa.binary())),
                 pa.array([list(f[4].values()) for f in found], pa.list_(pa.int64()))],
                ["row", "doc_id", "held_out", "n_tokens", "n_rare", "base", "score", "words", "times"])

    scored = staged(rows.mapInArrow(
        score, "row long, doc_id long, held_out boolean, n_tokens long, n_rare long, base double, score double, "
               "words array<binary>, times array<long>"), "scores")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        "row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    counted = rare.join(words, "word")  # only an unseen word can be hot: adaptive execution splits it, and it meets no row
    looked_up = counted.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("words", "times").join(looked_up, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_tokens") - F.col("n_rare") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
