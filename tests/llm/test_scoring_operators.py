"""Class-based scores, resampling and hard negatives against brute force, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL

from contractflow.llm import classlm, negatives, resampling
from contractflow.llm.common import table
from contractflow.llm.queries import QUERIES


def rows_of(frame):
    return frame.toArrow().to_pylist()


# -- class-based scores ----------------------------------------------------------------------

def lowered_words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text) + [""]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_of(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) by the definition."""
    counts = Counter(w for d, t in rows if d is not None and not held(d) for w in lowered_words(t))
    total, kinds, found = sum(counts.values()), len(counts), []
    for d, t in rows:
        line = lowered_words(t)
        base = sum(math.log10((counts[w] + 1) / (total + 1 * (kinds + 1))) for w in line)
        found.append((d, held(d), len(line), sum(counts[w] > 0 for w in line), total, base))
    return counts, found


def key(row):
    return tuple((v is None, v or 0) for v in row)


def assert_base(rows, result):
    _, expected = base_of(rows)
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    ours = sorted((tuple(r[n] for n in names) for r in result), key=key)
    assert len(ours) == len(expected)
    for a, b in zip(ours, sorted(expected, key=key)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)


def test_base_and_gain_of_the_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(table(spark, SMALL, "documents").select("doc_id", "text"))]
    found = rows_of(QUERIES["op11_class_lm"](spark, SMALL))
    assert_base(docs, found)
    unseen = [r for r in found if r["held_out"]]
    assert unseen and sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_scores_against_brute_force(spark, monkeypatch):
    """Scores from plain counts of classes, the rare words' join included."""
    draw = random.Random(1)
    nouns, verbs = [f"n{i}" for i in range(12)], [f"v{i}" for i in range(12)]
    texts = [" ".join(draw.choice(nouns) + " " + draw.choice(verbs) + (" Rare%d" % draw.randrange(200) if draw.random() < 0.2 else "")
                      for _ in range(30)) for _ in range(80)]
    rows = list(enumerate(texts, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trained = docs.where(classlm.remainder() != 2).select("text")
    model = classlm.learn(trained, classlm.word_counts(trained), rounds=4)
    result = {r["doc_id"]: r for r in rows_of(classlm.score_texts(docs, rounds=4))}
    assert_base(rows, list(result.values()))
    counts, _ = base_of(rows)
    own = {w.decode(): int(c) for (w, i) in model.lexicon.number.items() for c in [model.classes[i]]}
    assert set(own) == {w for w, n in counts.items() if n >= classlm.LEAST}
    assert len({own[n] for n in nouns if n in own} & {own[v] for v in verbs if v in own}) == 0
    of_class, rare = Counter(), {w: n for w, n in counts.items() if w not in own}
    for w, c in own.items():
        of_class[c] += counts[w]

    def emission(w):
        return counts[w] / of_class[own[w]] if w in own else (rare.get(w, 0) + 1) / (sum(rare.values()) + len(rare) + 1)

    # All transitions from one context sum to one, and so do a class's emissions.
    given = model.log_transition.reshape(classlm.CLASSES, classlm.CLASSES, classlm.CLASSES)
    used = sorted({*own.values(), classlm.RARE})
    for context in [(classlm.END, classlm.END), (own[nouns[0]], own[verbs[0]]), (classlm.RARE, classlm.RARE)]:
        assert math.isclose((10 ** given[context][used]).sum(), 1, rel_tol=1e-9)
    assert math.isclose(sum(map(emission, rare)) + emission("never seen"), 1, rel_tol=1e-9)
    for d, text in rows:
        line = [classlm.END, classlm.END, *(own.get(w, classlm.RARE) for w in lowered_words(text))]
        logs = sum(given[a, b, c] for a, b, c in zip(line, line[1:], line[2:]))
        logs += sum(math.log10(emission(w)) for w in lowered_words(text))
        assert math.isclose(result[d]["score"], logs, rel_tol=1e-9)


def test_transitions_are_witten_bell_by_the_book():
    draw = np.random.default_rng(3)
    cube = draw.poisson(0.3, (4, 4, 4)).astype(float)
    found = 10 ** classlm.transitions(cube)
    pairs, single = cube.sum(0), cube.sum((0, 1))
    able = [c for c in range(4) if single[c] > 0 or c == classlm.RARE]
    for a in range(4):
        for b in range(4):
            for c in able:
                one = (single[c] + 1) / (single.sum() + len(able))
                variety = max(1, np.count_nonzero(pairs[b]))
                two = (pairs[b, c] + variety * one) / (pairs[b].sum() + variety)
                variety = max(1, np.count_nonzero(cube[a, b]))
                assert math.isclose(found[a, b, c], (cube[a, b, c] + variety * two) / (cube[a, b].sum() + variety), rel_tol=1e-9)


def test_best_class_against_likelihoods(monkeypatch):
    """The class chosen is the one whose whole likelihood is highest, pairs of a word with itself included."""
    monkeypatch.setattr(classlm, "CLASSES", 6)
    draw = np.random.default_rng(5)
    for _ in range(30):
        pairs = draw.poisson(1.5, (12, 12)) * (draw.random((12, 12)) < 0.5)
        classes = np.append([classlm.RARE, classlm.END], draw.integers(2, 6, 10))

        def matrix(given):
            cells = np.zeros((6, 6))
            np.add.at(cells, (given[:, None].repeat(12, 1), given[None, :].repeat(12, 0)), pairs)
            return cells

        word = int(draw.integers(2, 12))
        rest = np.arange(12) != word
        left = np.bincount(classes[rest], pairs[rest, word], 6)
        right = np.bincount(classes[rest], pairs[word, rest], 6)
        found = classlm.best_class(matrix(classes), int(classes[word]), left, right, float(pairs[word, word]))
        reached = {}
        for c in range(2, 6):
            moved = classes.copy()
            moved[word] = c
            reached[c] = classlm.likelihood(matrix(moved))
        assert math.isclose(reached[found], max(reached.values()), rel_tol=1e-9)


def test_scores_odd_rows(spark, odd_docs, no_docs):
    found = rows_of(classlm.score_texts(odd_docs))
    assert_base([(r["doc_id"], r["text"]) for r in rows_of(odd_docs)], found)
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in found)
    assert {(r["n_tokens"], r["score"]) for r in found if r["doc_id"] in (3, 4)} == {(1, next(r["score"] for r in found if r["doc_id"] == 3))}
    assert classlm.score_texts(no_docs).count() == 0
    unlearned = rows_of(classlm.score_texts(spark.createDataFrame([(None, "a b")], "doc_id long, text string")))
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in unlearned] == [(3, 0, 0, 0.0, 0.0)]


# -- resampling ------------------------------------------------------------------------------

def brute_resample(docs, target, percent, least, longest, buckets):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        runs = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = (Counter(b for x in texts for b in features(x)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        many, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), many])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    quota = percent * len(able) // 100
    drawn = [(*r[:4], i if i <= quota else None) for i, r in enumerate(able, 1)]
    return Counter(drawn + [(*r[:4], None) for r in rows if r[4] < least])


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_against_brute_force(spark, odd_docs, longest):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(odd_docs)]
    target = ["The cat sat", None, "der Hund! und 123"]
    found = rows_of(resampling.resample(odd_docs, spark.createDataFrame([(t,) for t in target], "text string"),
                                        percent=40, least_words=3, longest=longest, buckets=500))
    assert Counter(tuple(r.values()) for r in found) == brute_resample(docs, target, 40, 3, longest, 500)
    assert list(found[0]) == ["doc_id", "n_features", "weight", "score", "rank"]


def test_bit_planes_sum_exactly():
    draw = np.random.default_rng(4)
    for _ in range(20):
        values = draw.integers(-9000, 9000, 777)
        counts = draw.integers(0, 5, 777) * draw.integers(0, 1 << 40, 777)
        assert resampling.Gains(values).weight(counts) == sum(int(a) * int(b) for a, b in zip(values, counts))
    assert resampling.Gains(np.zeros(10, np.int64)).weight(np.arange(10)) == 0


def test_resampling_empty_tables(spark, odd_docs, no_docs):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resample(no_docs, nothing).count() == 0
    found = rows_of(resampling.resample(odd_docs, nothing))
    assert len(found) == odd_docs.count()


# -- hard negatives --------------------------------------------------------------------------

def brute_negatives(rows):
    usable = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, v, y in rows]
    found = []
    for a, label, v in usable:
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, y) for i, y, w in usable if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            inside = [(i, -n) for n, i, y in scored if y != label and 50 * -s <= 100 * -n <= 95 * -s][:3]
            found += [(a, p, r, i, -s, n) for r, (i, n) in enumerate(inside, 1)]
    return Counter(found)


def test_negatives_against_brute_force(spark, monkeypatch):
    """Many shards and several rounds of anchors; ties by the hundred; anchors with zero components."""
    monkeypatch.setattr(negatives, "SHARD_BYTES", 3000)
    monkeypatch.setattr(negatives, "ROUND_BYTES", 200)
    draw = random.Random(6)
    rows = [(i, [draw.choice([0.0, 0.25, 0.25, 1.0, -1.0, draw.random()]) for _ in range(5)], draw.randrange(4)) for i in range(700)]
    rows[50] = (50, [0.0] * 5, 1)
    found = rows_of(negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    assert Counter(tuple(r.values()) for r in found) == brute_negatives(rows)


def test_walk_stops_early_and_meets_all_that_counts():
    draw = np.random.default_rng(7)
    x = draw.integers(-50, 50, (4000, 2)).astype(np.int64)
    shard = negatives.Shard(2, np.arange(4000).tobytes(), np.zeros(4000, np.int64).tobytes(), x.tobytes(),
                            np.argsort(x.T, axis=1, kind="stable").astype(np.int32).tobytes())
    for anchor in (np.array([3, -4]), np.array([0, 7]), np.array([-1, -1])):
        best, met = negatives.Best(5), 0
        for rows, scores in shard.walk(anchor, best.done):
            assert (scores == x[rows] @ anchor).all()
            best.add(scores, shard.ids[rows])
            met += len(rows)
        order = np.lexsort((np.arange(4000), -(x @ anchor)))[:5]
        assert best.ids.tolist() == order.tolist() and met < 4000


def test_negatives_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.75, 0.0], 2), (2, [0.75, 0.0], 2),
            (3, [0.5, 1.0], 3), (4, None, 2), (5, [nan, 1.0], 2), (6, [None, 1.0], 2), (None, [0.75, 0.0], 2), (8, [0.75, 0.0], None),
            (9, [0.75], 2), (10, [], 2), (50, [], 2), (100, [0.0, 0.0], 5), (150, [1e10, 2e10], 6)]
    odd = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "vec_id long, embedding array<float>, label int, vector string, dim int, shard string")
    found = rows_of(negatives.hard_negatives(odd))
    # Anchor 0 is relabelled 2, so its positives are the rows numbered 2, of score 256 * 192; rows 1 are above the window.
    assert Counter(tuple(r.values()) for r in found) == Counter([(0, 2, 1, 3, 49152, 32768)] * 2)
    assert negatives.hard_negatives(odd.limit(0)).count() == 0
    with pytest.raises(Exception, match="63 bits"):
        negatives.hard_negatives(spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int")).count()


def test_negatives_of_repeated_rows(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.75, 0.0], 2), (2, [0.75, 0.0], 2), (3, [0.5, 1.0], 3)]
    found = rows_of(negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    one = [(50, 1, 1, 2, 65536, 49152), (50, 1, 2, 2, 65536, 49152), (50, 1, 3, 3, 65536, 32768)]
    assert Counter(tuple(r.values()) for r in found) == Counter(one * 2)
