"""SimHash, toxicity, pieces, mixing, language and sharding against brute force and on odd input."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

from contractflow.llm import langid, mixing, pieces, sharding, simhash, toxicity
from contractflow.llm.common import table
from contractflow.llm.queries import QUERIES


def rows_of(frame):
    return frame.toArrow().to_pylist()


# -- SimHash ---------------------------------------------------------------------------------

def plain_fingerprint(text):
    words, hashes, at = [], [], None
    for i, c in enumerate((text or "") + " "):
        if c in " \t\n\v\f\r":
            if at is not None:
                words.append("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text[at:i]))
            at = None
        elif at is None:
            at = i
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """doc_id -> smallest doc_id reachable, by comparing all pairs."""
    left, groups = set(range(len(prints))), {}
    while left:
        todo, group = [left.pop()], set()
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in left if (prints[i][1] ^ prints[j][1]).bit_count() <= 3}
            left -= near
            todo += near
        ids = [prints[i][0] for i in group if prints[i][0] is not None]
        for i in group:
            groups[i] = min(ids, default=None)
    return groups


def test_simhash_against_all_pairs(spark):
    found = rows_of(QUERIES["op1_simhash"](spark, SMALL))
    texts = {r["doc_id"]: r["text"] for r in rows_of(table(spark, SMALL, "documents"))}
    prints = [(d, plain_fingerprint(t)) for d, t in texts.items()]
    groups = plain_components(prints)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found} == {
        (d, f"{p:016x}", groups[i]) for i, (d, p) in enumerate(prints)}
    assert len(found) == len(texts)


@pytest.mark.parametrize("spread", [64, 12, 6])
def test_every_link_is_found_whatever_the_trees(spark, spread):
    """Scattered fingerprints, and dense clouds of near ones, with leaves so small that most links cross them."""
    draw = random.Random(spread)
    centers = [draw.getrandbits(64) for _ in range(12)]
    points = sorted({
        c ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(spread // 2 + 1))) for c in centers for _ in range(120)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in points]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fingerprint long"), sample=500, leaf=40)
    found = {r["node"]: r["root"] for r in rows_of(simhash.components(links))}
    brute = plain_components(list(enumerate(points)))
    mine = defaultdict(set)
    for i, (p,) in enumerate(signed):
        mine[found.get(p, p)].add(i)
    theirs = defaultdict(set)
    for i, g in brute.items():
        theirs[g].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_a_long_chain_is_one_component(spark):
    chain = [(i, i + 1) for i in range(300)]
    draw = random.Random(1)
    draw.shuffle(chain)
    found = rows_of(simhash.components(spark.createDataFrame(chain, "a long, b long")))
    assert {r["root"] for r in found} == {0} and len(found) == 300


def test_simhash_odd_rows(odd_docs, no_docs):
    found = rows_of(simhash.near_duplicates(odd_docs))
    assert len(found) == odd_docs.count()
    zero = [r for r in found if r["fingerprint"] == 0]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {3}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = rows_of(kept)
    assert Counter(r["doc_id"] for r in rows)[1] == 1 and 2 not in {r["doc_id"] for r in rows}
    assert len(rows) == len({r["node"] for r in found}) and {r["_hash"] for r in rows} == {"kept"}
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def five_word_sets(docs):
    sets = {}
    for r in rows_of(docs):
        words = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return sets


def similar_pairs(sets):
    """All pairs of Jaccard similarity 0.8 or more that share a shingle."""
    posts, common = defaultdict(list), Counter()
    for d, s in sorted(sets.items()):
        for x in s:
            common.update((e, d) for e in posts[x])
            posts[x].append(d)
    return {(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}


def smallest_of_group(ids, pairs):
    up = {i: i for i in ids}
    for a, b in pairs:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    return {i for i in ids if up[i] == i}


def test_wide_fingerprint_bit_by_bit():
    """The near copies' SimHash: 256 bits, each set if over half of the shingles have it."""
    draw = np.random.default_rng(3)
    for n in (1, 4, 5, 4097):
        hashes = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        got = simhash.wide_fingerprint(hashes)
        one = np.array([simhash.wide_fingerprint(hashes[i:i + 1]).tolist() for i in range(n)], np.uint64)
        assert one[:, 0].tolist() == hashes.tolist()
        for part, b in itertools.product(range(4), range(64)):
            assert int(got[part]) >> b & 1 == (2 * int((one[:, part] >> np.uint64(b) & np.uint64(1)).sum()) > n)
    assert simhash.wide_fingerprint(hashes[:0]).tolist() == [0] * 4


@pytest.mark.parametrize("dense", [0, 400])
def test_wide_fingerprints_link_through_shards_and_balls(spark, dense):
    """Whatever is near and has a byte in common is in one cluster, also where a third of all is near one point."""
    draw = random.Random(dense)

    def near(point, bits):
        return point ^ sum(1 << b for b in draw.sample(range(256), bits))

    points = []
    for _ in range(150):
        centre = draw.getrandbits(256)
        points += [centre, *[near(centre, draw.randrange(1, 90)) for _ in range(4)]]
    middle = draw.getrandbits(256)
    points += [near(middle, draw.randrange(1, 14)) for _ in range(dense)] + [near(middle, draw.randrange(40, 75)) for _ in range(dense // 8)]
    words = np.array([[p >> 64 * i & (1 << 64) - 1 for i in range(4)] for p in points], np.uint64)
    assert bool(simhash.dense_balls(words)) == bool(dense)
    frame = spark.createDataFrame([(i, w.view(np.int64).tolist()) for i, w in enumerate(words)], "node long, print array<long>").repartition(3)
    roots = {r["node"]: r["root"] for r in rows_of(simhash.components(simhash.wide_links(frame, alone=0)))}
    pairs = {(a, b) for (a, p), (b, q) in itertools.combinations(enumerate(points), 2) if (p ^ q).bit_count() <= simhash.NEAR
             and ((p ^ q) % (1 << 64)).bit_count() <= simhash.NEAR_FIRST
             and any((p ^ q) >> 8 * i & 255 == 0 for i in range(32))}
    assert len(pairs) > 300 and all(roots.get(a, a) == roots.get(b, b) for a, b in pairs)
    if not dense:
        ids = range(len(points))
        assert {i for i in ids if roots.get(i, i) == i} == smallest_of_group(ids, pairs)


@pytest.mark.parametrize("dense", [0, 9000])
def test_wide_links_miss_no_near_pair(spark, monkeypatch, dense):
    """All that is near and allowed by size is linked: where no byte is equal, and where the first parts alone differ."""
    monkeypatch.setattr(simhash, "LEAST_BLOCK", 300)
    draw, every = random.Random(dense), (1 << 256) // 255  # one bit of each byte
    points, sizes = [], []
    for i in range(200):
        p, size = draw.getrandbits(256), draw.choice([4, 5, 40, 41, 300])
        one = [p ^ every << draw.randrange(8), p ^ ((1 << 40) - 1), p ^ sum(1 << b for b in draw.sample(range(256), draw.randrange(50, 85)))]
        points += [p, *one]
        sizes += [size, *[draw.randrange(-(-4 * size // 5), 5 * size // 4 + 1) for _ in one]]
    while len(points) < 5000:
        points.append(draw.getrandbits(256))
        sizes.append(draw.choice([1, 3, 4, 5, 40, 41, 50, 300, 2000]))
    middle = draw.getrandbits(256)
    for _ in range(dense):
        points.append(middle ^ sum(1 << b for b in draw.sample(range(256), draw.randrange(1, 12))))
        sizes.append(draw.randrange(95, 105))
    words = np.array([[p >> 64 * i & (1 << 64) - 1 for i in range(4)] for p in points], np.uint64)
    frame = spark.createDataFrame([(i, n, w.view(np.int64).tolist()) for i, (n, w) in enumerate(zip(sizes, words))],
                                  "node long, many int, print array<long>").repartition(3)
    roots = {r["node"]: r["root"] for r in rows_of(simhash.components(simhash.wide_links(frame)))}
    many, pairs = np.array(sizes), set()
    for i in range(5000):
        far = np.bitwise_count(words[i] ^ words[i + 1:5000]).sum(1, dtype=int)
        small, large = np.minimum(many[i], many[i + 1:5000]), np.maximum(many[i], many[i + 1:5000])
        fits = (5 * small >= 4 * large) & (small >= 4) & (far <= np.where(small < 5, simhash.NEAR_SMALL, simhash.NEAR))
        pairs |= {(i, i + 1 + int(j)) for j in np.nonzero(fits)[0]}
    assert len(pairs) > 400 and all(roots.get(a, a) == roots.get(b, b) for a, b in pairs)
    if dense:  # all of the ball and whatever may be near it are one cluster
        assert len({roots.get(i, i) for i in range(5000, len(points))}) == 1
    else:
        assert {i for i in range(5000) if roots.get(i, i) == i} == smallest_of_group(range(5000), pairs)


def test_near_pairs_link_wherever_they_differ(spark):
    """40 bits of the first part, or one bit of every byte among many other fingerprints."""
    draw = random.Random(8)
    for bits, others in (((1 << 40) - 1, 0), ((1 << 256) // 255, 4200)):
        point = draw.getrandbits(256)
        points = [point, point ^ bits, *[draw.getrandbits(256) for _ in range(others)]]
        rows = [(i, 100, np.array([p >> 64 * k & (1 << 64) - 1 for k in range(4)], np.uint64).view(np.int64).tolist()) for i, p in enumerate(points)]
        frame = spark.createDataFrame(rows, "node long, many int, print array<long>")
        assert [(r["a"], r["b"]) for r in rows_of(simhash.wide_links(frame))] == [(1, 0)]


def test_keep_one_compares_what_simhash_links(spark, monkeypatch):
    """Near copies whose fingerprints don't link are never compared, so SimHash brings all candidates."""
    words = [f"w{i}" for i in range(120)]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "end"]))], "doc_id long, text string")
    assert [r["doc_id"] for r in rows_of(simhash.keep_one(frame))] == [1]
    monkeypatch.setattr(simhash, "wide_links", lambda nodes: nodes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    assert {r["doc_id"] for r in rows_of(simhash.keep_one(frame))} == {1, 2}


def test_keep_one_removes_five_word_near_copies(spark):
    """Planted copies with some words changed, on both sides of 0.8, and one large group of them."""
    draw, docs = random.Random(4), []
    for _ in range(60):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([40, 200, 900]))]
        for changes in (0, 1, len(base) // 90, len(base) // 60, len(base) // 45, len(base) // 30):
            copy = list(base)
            for at in draw.sample(range(len(base)), changes):
                copy[at] = f"x{draw.randrange(10**9)}"
            docs.append(" ".join(copy))
    base = [f"v{i}" for i in range(300)]
    for i in range(150):
        copy = list(base)
        copy[draw.randrange(300)] = f"y{i}"
        copy[draw.randrange(300)] = f"z{i}"
        docs.append(" ".join(copy))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    sets = five_word_sets(frame)
    expected = smallest_of_group(sets, similar_pairs(sets))
    assert {r["doc_id"] for r in rows_of(simhash.keep_one(frame))} == expected


def test_keep_one_within_families_around_the_threshold(spark):
    """Sets on all sides of 0.8 around two texts, some alike only by differences they share, and a text all begin with."""
    draw, docs = random.Random(9), []
    for b in range(2):
        base = [f"b{b}w{i}" for i in range(150)]
        docs.append(" ".join(base))
        for i in range(140):
            copy = list(base)
            for at in draw.sample(range(150), draw.randrange(1, 12)):
                copy[at] = f"x{b}-{i}-{at}" if draw.random() < 0.8 else f"common{at}"
            docs.append(" ".join(copy))
        for i in range(12):  # far from the base in the same way
            copy = [f"far{i % 3}-{at}" if at % 9 == i % 3 else w for at, w in enumerate(base)]
            copy[draw.randrange(150)] = f"z{b}-{i}"
            docs.append(" ".join(copy))
    docs += [" ".join([f"b0w{i}" for i in range(60)] + [f"t{j}-{i}" for i in range(draw.randrange(1, 60))]) for j in range(40)]
    draw.shuffle(docs)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    sets = five_word_sets(frame)
    expected = smallest_of_group(sets, similar_pairs(sets))
    assert 30 < len(expected) < 250
    assert {r["doc_id"] for r in rows_of(simhash.keep_one(frame))} == expected


def test_rows_alike_in_id_and_text_keep_the_same_one(spark):
    rows = [(1, "a b c", s, n) for s in "xyz" for n in (3, 1, 2)]
    draw, found = random.Random(3), set()
    for _ in range(3):
        draw.shuffle(rows)
        frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
        found |= {tuple(r) for r in simhash.keep_one(frame).collect()}
    assert found == {(1, "a b c", "x", 1)}


def test_keep_one_on_given_documents(spark):
    docs = table(spark, SMALL, "documents")
    sets = five_word_sets(docs)
    full = {d: s for d, s in sets.items() if s}
    expected = smallest_of_group(full, similar_pairs(full)) | {min(d for d, s in sets.items() if not s)} if len(full) < len(sets) else (
        smallest_of_group(full, similar_pairs(full)))
    assert {r["doc_id"] for r in rows_of(simhash.keep_one(docs))} == expected


# -- sharding --------------------------------------------------------------------------------

def least_capacity(sizes, shards):
    def fits(capacity):
        used, held = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if held + s > capacity:
                used, held = used + 1, 0
            held += s
        return used <= shards
    low, high = 1, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("case", range(8))
def test_minimax_capacity(spark, case):
    draw = random.Random(case)
    span = [1 << 62, 1 << 20, 300, 1 << 62][case % 4]
    groups = {draw.randrange(-span, span): draw.choice([1, 5, draw.randrange(1, 1000), 20_000 if case > 3 else 3]) for _ in range(400)}
    rows = [(h, s) for h, s in groups.items()]
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(rows, "hash long, size long"), 7)
    ordered = sorted(groups.items())
    assert capacity == least_capacity([s for _, s in ordered], 7)
    sums = Counter()
    for h, s in ordered:
        sums[sum(h >= c for c in cuts)] += s
    assert max(sums.values()) == capacity and len(cuts) <= 6


def test_sharding_query(spark):
    found = rows_of(QUERIES["op9_sharding"](spark, SMALL))
    texts = {r["doc_id"]: r["text"] for r in rows_of(table(spark, SMALL, "documents"))}
    shards, by_text = defaultdict(list), defaultdict(set)
    for r in found:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        shards[r["shard"]].append(r["slot"])
        by_text[data].add(r["shard"])
    assert len(found) == len(texts) and all(len(s) == 1 for s in by_text.values())
    assert set(shards) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_sharding_odd_rows(odd_docs, no_docs):
    found = rows_of(sharding.shard_by_bytes(odd_docs, 4))
    assert len(found) == odd_docs.count() and min(r["size"] for r in found) == 1
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_by_bytes(no_docs).count() == 0


# -- mixing ----------------------------------------------------------------------------------

def plain_targets(sizes):
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(ordered)}
    total, open_, target = sum(sizes.values()), set(ordered), {}
    left = total
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def check_mix(docs, found, tolerance=1):
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    target = plain_targets(dict(sizes))
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
    assert all(abs(taken[s] - target[s]) <= tolerance for s in sizes)


def test_mixing_query(spark):
    docs = table(spark, SMALL, "documents")
    found = rows_of(mixing.mix_report(docs))
    assert {r["doc_id"]: r["size"] for r in found} == {r["doc_id"]: len(r["text"].encode().split()) for r in rows_of(docs)}
    check_mix(docs, found, tolerance=60)
    order = lambda rows: sorted((r["doc_id"], r["taken"]) for r in rows)
    assert order(found) == order(rows_of(mixing.mix_report(docs.repartition(5))))


def test_mixing_limits_and_copies(spark):
    """A tiny source reaches three times its words; one text fills most of a source."""
    rows = [(i, "w " * 50, "a") for i in range(400)] + [(1000 + i, "x y z", "b") for i in range(4)] + [
        (2000 + i, "v " * (1 + i % 40), "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_mix(docs, rows_of(mixing.mix_report(docs)), tolerance=50)
    kept = Counter(r["doc_id"] for r in rows_of(mixing.mix_rows(docs)))
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in rows_of(mixing.mix_report(docs))}
    assert all(kept[d] == n for d, n in taken.items()) and kept[1000] == 3


def test_knapsack_is_exact():
    for case in range(200):
        draw = random.Random(case)
        lengths = draw.sample(range(1, 40), draw.randrange(1, 6))
        counts = [draw.randrange(1, 4) for _ in lengths]
        budget = draw.randrange(0, 120)
        taken = mixing.fullest_sum(lengths, counts, budget)
        best = max(s for s in (sum(a * b for a, b in zip(lengths, n)) for n in itertools.product(*[range(c + 1) for c in counts]))
                   if s <= budget)
        assert sum(a * b for a, b in zip(lengths, taken)) == best and all(t <= c for t, c in zip(taken, counts))
        assert sum(a * b for a, b in zip(lengths, mixing.fullest_of_few(lengths, counts, budget))) == best
        for few in (1, mixing.FEW):
            fitted = mixing.fit_budget(lengths, counts, budget, case, window=30, few=few)
            assert all(0 <= t <= c for t, c in zip(fitted, counts))
            assert sum(a * b for a, b in zip(lengths, fitted)) <= budget


def test_budgets_of_long_documents_are_met():
    """Sums that exist are found, whatever the lengths and the seed."""
    for seed in range(6):
        taken = mixing.fit_budget([40_000, 41_000, 50_000, 70_001], [1] * 4, 110_001, seed)
        assert taken == [1, 0, 0, 1]
        draw = random.Random(seed)
        lengths = sorted(draw.sample(range(30_000, 200_000), 40))
        counts = [draw.randrange(1, 9) for _ in lengths]
        wanted = sum(a * draw.randrange(b + 1) for a, b in zip(lengths, counts))
        taken = mixing.fit_budget(lengths, counts, wanted, seed)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert sum(a * b for a, b in zip(lengths, taken)) == wanted


def test_mixing_odd_rows(odd_docs, no_docs):
    found = rows_of(mixing.mix_report(odd_docs))
    assert len(found) == odd_docs.count() and all(r["taken"] == 0 for r in found if r["size"] == 0)
    kept = mixing.mix_rows(odd_docs)
    assert kept.columns == odd_docs.columns and {r["_mix"] for r in rows_of(kept)} == {"kept"}
    assert mixing.mix_report(no_docs).count() == 0 and mixing.mix_rows(no_docs).count() == 0


# -- language --------------------------------------------------------------------------------

def test_language_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r["doc_id"]: r["lang"] for r in rows_of(docs.select("doc_id", "lang"))}
    found = rows_of(QUERIES["op8_language"](spark, "/root/testdata/sf0.01"))
    assert {r["doc_id"]: r["held_out"] for r in found} == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in truth}
    held = [r for r in found if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_unseen_words_fall_back_to_their_longest_known_grams():
    model = langid.Model(["a", "b"], {0: [("known", (9, 1))], 4: [("nown", (1, 9))], 2: [("zz", (9, 1))], 1: [("q", (1, 9))]})
    score = model.scorer()
    assert score("known")[0] == "a" and score("unknown")[0] == "b"
    assert score("zz")[0] == "a" and score("q zq")[0] == "b"
    assert score("%%")[0] == "und" and score(None) == ("und", 0.0)
    assert np.allclose(model.unseen("xyw"), 0)


def test_language_scores_against_brute_force():
    """Random counts of words and grams: log shares by hand, word by word, with the longest known grams of unseen words."""
    draw = random.Random(8)
    words = ["".join(draw.choices("abc", k=draw.randrange(1, 6))) for _ in range(40)]
    tables = {0: {w: [draw.randrange(9), draw.randrange(9)] for w in words[:15]}}
    for size in (1, 2, 3, 4):
        found = {g for w in words for g in langid.grams(w, size)}
        tables[size] = {g: [draw.randrange(9), draw.randrange(9)] for g in sorted(found) if draw.random() < 0.4}
    model = langid.Model(["x", "y"], {size: list(t.items()) for size, t in tables.items()})

    def share(size, gram, at):
        rows = tables[size]
        return math.log((rows[gram][at] + 0.5) / (sum(n[at] for n in rows.values()) + 0.5 * len(rows) + 0.5))

    def of_word(word, at):
        if word in tables[0]:
            return share(0, word, at)
        for size in (4, 3, 2, 1):
            known = [g for g in langid.grams(word, size) if g in tables[size]]
            if known:
                return sum(share(size, g, at) for g in known) / len(known)
        return 0.0

    score = model.scorer()
    for _ in range(50):
        text = " ".join(draw.choices(words, k=draw.randrange(1, 30)))
        sums = [sum(of_word(w, at) for w in text.split()) for at in (0, 1)]
        best = int(sums[1] > sums[0])
        lang, sure = score(text)
        assert lang == "xy"[best] and math.isclose(sure, 1 / sum(math.exp(v - sums[best]) for v in sums), rel_tol=1e-9)


def test_language_odd_rows(odd_docs, no_docs):
    found = rows_of(langid.identify_languages(odd_docs))
    assert len(found) == odd_docs.count() and all(r["held_out"] is not None for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert {by_id[d]["lang_pred"] for d in (3, 4, 5, 6)} == {"und"}
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and {3, 4, 5, 6}.isdisjoint({r["doc_id"] for r in rows_of(kept)})
    assert langid.identify_languages(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in rows_of(langid.identify_languages(unlabelled))} == {("und", 0.0)}


# -- toxicity --------------------------------------------------------------------------------

def test_toxicity_of_unseen_documents(spark):
    """Learned from two thirds of the labels; the others are judged by their labels."""
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    learned = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0)
    chain = toxicity.learn(docs, learned)
    assert chain.earlier[1] and not chain.earlier[0]  # the second model sees the first one's probability
    judged = toxicity.score(docs.join(labels.join(learned, "doc_id", "left_anti"), "doc_id"), chain)
    rows = rows_of(judged.select("toxic", "_toxicity.rejected"))
    hits = sum(r["toxic"] and r["rejected"] for r in rows)
    assert hits >= 0.8 * sum(r["toxic"] for r in rows)
    assert hits >= 0.95 * sum(r["rejected"] for r in rows)


def test_toxicity_odd_rows(odd_docs, no_docs, few_labels):
    found = rows_of(toxicity.toxicity(odd_docs, few_labels))
    assert len(found) == odd_docs.count() and all(0 <= r["toxicity"] <= 1 for r in found)
    kept = toxicity.keep_clean(odd_docs, few_labels.where("false"))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert toxicity.toxicity(no_docs, few_labels).count() == 0


# -- pieces ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.load_pieces())


def all_segmentations(vocabulary, text):
    spelled, known = pieces.marked(text), {}
    for piece, i, _ in pieces.load_pieces()["pieces"]:
        known[piece] = i
    out = {}

    def go(at, ids, weight):
        if at == len(spelled):
            out[tuple(ids)] = weight
            return
        for end in range(at + 1, min(len(spelled), at + 16) + 1):
            if spelled[at:end] in known:
                i = known[spelled[at:end]]
                go(end, [*ids, i], weight + vocabulary.weights[i])
        if spelled[at] not in known:
            some = vocabulary.fallback(ord(spelled[at])).tolist()
            go(at + 1, ids + some, weight + vocabulary.byte_weight * len(some))

    go(0, [], 0.0)
    whole = np.logaddexp.reduce(list(out.values()))
    return {ids: weight - whole for ids, weight in out.items()}


@pytest.mark.parametrize("text", ["the ab", "a\n▁b", "  in  ", "é\U0001f600x"])
def test_samples_follow_the_distribution(vocabulary, text):
    exact, n = all_segmentations(vocabulary, text), 4000
    keys = np.arange(n, dtype=np.uint64) * np.uint64(7919)
    found = pieces.sample_batch(vocabulary, [text] * n, keys, 3)
    ids = [[tuple(s[0].tolist()) for s in row] for row in found]
    assert all(len(set(row)) == len(row) == min(3, len(exact)) for row in ids)
    assert all(abs(s[1] - exact[i]) < 1e-9 for row, some in zip(found, ids) for s, i in zip(row, some))
    assert all(vocabulary.decode(i) == text for row in ids for i in row)
    assert all(a[2] >= b[2] for row in found for a, b in zip(row, row[1:]))
    first = Counter(row[0] for row in ids)
    assert all(abs(first[i] / n - math.exp(p)) < 0.035 for i, p in exact.items())
    second = Counter((row[0], row[1]) for row in ids if len(row) > 1)
    for (a, b), many in second.items():
        assert abs(many / n - math.exp(exact[a]) * math.exp(exact[b]) / (1 - math.exp(exact[a]))) < 0.035
    weighed = np.mean([sum(math.exp(s[1] - s[3]) for s in row) for row in found])
    assert abs(weighed - 1) < 0.05  # inclusion scores make the sample's weights add up to one


def test_windows_and_batches_change_nothing(spark, vocabulary):
    texts = [r["text"] for r in rows_of(table(spark, SMALL, "documents").limit(30))]
    keys = np.arange(len(texts), dtype=np.uint64)
    whole = pieces.sample_batch(vocabulary, texts, keys, 2)
    for cut in (pieces.sample_batch(vocabulary, texts, keys, 2, window=700),
                [pieces.sample_batch(vocabulary, [t], keys[i:i + 1], 2)[0] for i, t in enumerate(texts)]):
        for a, b in zip(whole, cut):
            assert all((x[0] == y[0]).all() and math.isclose(x[1], y[1], abs_tol=1e-9) and math.isclose(x[3], y[3], abs_tol=1e-6)
                       for x, y in zip(a, b))


def test_texts_sampled_together_have_one_window(vocabulary):
    """Each text has a space sign more than characters; a second window would have all lattices built again and again."""
    draw = random.Random(2)
    texts = ["".join(draw.choices("ab c\n", k=draw.randrange(0, 60))) for _ in range(400)] + ["x " * 300, "", "y"]
    ranges = list(pieces.fitting([len(t) for t in texts], 200))
    assert [i for low, high in ranges for i in range(low, high)] == list(range(len(texts))) and not list(pieces.fitting([]))
    assert all(len(pieces.Batch(vocabulary, texts[low:high], 200).cuts) == 2 for low, high in ranges if high - low > 1)


def test_lattices_of_long_chunks_are_exact(vocabulary):
    """Sums near a chunk's end need no logarithms, farther ones do; both give the shares of the plain recursion."""
    for text in ("antidisestablishmentarianism" * 3, "\U0001f600" * 40, "a"):
        chunk = pieces.marked(text)
        lattice, total = pieces.Lattice(vocabulary, [chunk, chunk]), {len(chunk): 0.0}
        assert len(text) == 1 or len(chunk) > vocabulary.near
        for node in range(len(chunk) - 1, -1, -1):
            edges = range(lattice.begin[node], lattice.begin[node + 1])
            weights = [vocabulary.weights[i] if i >= 0 else 4 * vocabulary.byte_weight for i in lattice.piece[edges].tolist()]
            total[node] = float(np.logaddexp.reduce([w + total[int(lattice.target[e])] for w, e in zip(weights, edges)]))
            assert all(math.isclose(lattice.log[e], w + total[int(lattice.target[e])] - total[node], abs_tol=1e-9)
                       for w, e in zip(weights, edges))


def test_walks_may_begin_at_a_chunk(vocabulary):
    """The later part of a text's walk is the same without the part before."""
    texts = ["one two three\nfour five", "six seven", ""]
    batch, base = pieces.Batch(vocabulary, texts), pieces.stream(np.arange(3, dtype=np.uint64), 4, 2, 0)
    whole, _ = batch.walks(base, np.zeros(3, np.int64))
    first = np.array([3, batch.bounds[-1], 0])
    part, bounds = batch.walks(base, first)
    later = whole[1] >= first[batch.row[whole[1]]]
    assert all((a[later] == b).all() for a, b in zip(whole, part)) and 0 < len(part[0]) < len(whole[0])
    assert bounds.tolist() == [0, len(part[0]), len(part[0]), len(part[0])]


def test_pieces_query(spark):
    found = rows_of(QUERIES["op4_pieces"](spark, SMALL))
    assert all(r["round_trip"] and r["log_inclusion"] <= 0 for r in found)
    assert len({(r["doc_id"], r["ids_crc32"]) for r in found}) == len(found)
    assert Counter(r["doc_id"] for r in found).keys() == {r["doc_id"] for r in rows_of(table(spark, SMALL, "documents"))}


def test_pieces_query_returns_the_pieces(spark, vocabulary):
    """The segmentations themselves, with the digests that belong to them."""
    texts = {r["doc_id"]: r["text"] or "" for r in rows_of(table(spark, SMALL, "documents"))}
    for r in rows_of(QUERIES["op4_pieces"](spark, SMALL)):
        ids = np.array(r["ids"], "<u4")
        assert (len(ids), zlib.crc32(ids.tobytes())) == (r["n_pieces"], r["ids_crc32"])
        assert vocabulary.decode(r["ids"]) == texts[r["doc_id"]]


def test_pieces_odd_rows(odd_docs, no_docs, vocabulary):
    found = rows_of(pieces.sample_segmentations(odd_docs, k=2))
    texts = {r["doc_id"]: r["text"] or "" for r in rows_of(odd_docs) if r["doc_id"] is not None}
    assert all(r["round_trip"] for r in found)
    assert all(vocabulary.decode(r["ids"]) == texts[r["doc_id"]] for r in found if r["doc_id"] is not None)
    empty = [r for r in found if r["doc_id"] == 3]
    assert [(r["n_pieces"], r["log_prob"], r["log_inclusion"]) for r in empty] == [(0, 0.0, 0.0)]
    assert pieces.sample_segmentations(no_docs).count() == 0


def test_texts_with_a_single_segmentation(vocabulary):
    """No piece joins their characters, so they have one sample, which is certain, whatever rounding leaves of its rest."""
    texts = ["Ê.", "Ó.", "Íñ.", "Êé.", "Óíó.", "Êç.", *(chr(c) * n for c in range(1, 33) for n in (1, 2))]
    keys = np.arange(len(texts), dtype=np.uint64)
    for text, found in zip(texts, pieces.sample_batch(vocabulary, texts, keys, 2)):
        ways = min(2, len(all_segmentations(vocabulary, text)))
        assert len({tuple(ids) for ids, _, _, _ in found}) == len(found) == ways
        assert all(vocabulary.decode(ids.tolist()) == text for ids, _, _, _ in found)
        if ways == 1:
            assert (found[0][1], found[0][3]) == (0.0, 0.0)


def test_words_with_zero_characters_are_kept_apart(vocabulary):
    texts = ["a\0b a\0c a", "\0 \0\0 \0x"]
    for text, found in zip(texts, pieces.sample_batch(vocabulary, texts, np.arange(2, dtype=np.uint64), 2)):
        assert [vocabulary.decode(ids.tolist()) for ids, _, _, _ in found] == [text] * len(found)


def test_the_sample_of_labels_is_bounded_by_ids(spark):
    """An id that fills both tables counts once."""
    docs = spark.createDataFrame([(i % 50 if i < 100 else 7, f"text {i % 9}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(7 if i % 3 else i % 50, i % 2, i % 2) for i in range(3000)], "doc_id long, quality int, toxic int")
    rows = rows_of(toxicity.labelled_sample(docs, labels, sample=20))
    assert len(rows) == len({r["doc_id"] for r in rows}) == 20
    assert rows_of(toxicity.labelled_sample(docs.repartition(3), labels.repartition(5), sample=20).orderBy("doc_id")) == sorted(
        rows, key=lambda r: r["doc_id"])
