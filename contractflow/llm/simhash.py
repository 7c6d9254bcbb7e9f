"""SimHash near-duplicates: links of near fingerprints found with vantage-point trees.

A text's fingerprint has 64 bits; bit b is set when over half of its shingle
hashes have bit b set. Fingerprints that differ in at most three bits link, and
documents joined by a chain of links form one group.

**Search.** Of two fingerprints that differ in three bits or fewer, one 32-bit
half differs in at most one. So both halves get a vantage-point tree of their
own: a node sends points within ``radius`` of its vantage point left and the
others right, and by the triangle bound a point must also be looked for on the
other side only if its distance is within one of the radius. The trees' leaves
are the shards. Each fingerprint is stored in one leaf of each tree and sent as
a query to those later leaves that its ball overlaps; of two points in different
leaves the earlier one is thus sent to the later one's leaf. Inside a leaf the
same splitting goes on until blocks are small enough to compare directly, on all
64 bits. Every link is found: the sample that shapes the trees decides only how
even the leaves are.

**Groups.** A leaf keeps a spanning forest of the links it finds (at most one row
a fingerprint), so a group of many near copies never becomes all its pairs. The
forests are joined into components with alternating large-star and small-star
rounds, each written to the shared folder.

**Near copies.** ``keep_one``, the pipeline's stage, links documents by the exact
Jaccard similarity of their five-word shingles. At 0.8 two fingerprints differ in
15 % of their bits, far beyond what 64 bits can tell from chance, so here SimHash
has 256 bits, and fingerprints link at 68 or fewer differing bits. Unrelated ones
differ in 128, with a deviation of 8, so nothing short of comparing finds all that
are near; but sets of similarity 0.8 also have sizes within 0.8 of each other, so
fingerprints are dealt into blocks by size, and every two blocks whose sizes allow
it are compared in full. Chains of links are clusters, and only inside them sets
are compared.

**Defined results.** A null or wordless text has fingerprint zero, which links
like any other. Equal fingerprints share a node, so copies cost nothing in the
search. Repeated rows each get a row. A null ``doc_id`` counts for no component
id; a group of only such rows has a null one. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contractflow.llm.common import packed, salted_join, staged

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Fingerprints that shape the trees; the figure bounds what the driver holds.
SAMPLE = 65_536
#: Fingerprints a leaf should hold.
LEAF = 20_000
#: Stored points that are compared directly.
BLOCK = 512
#: Distances computed at once, which bounds a task's memory.
CELLS = 1 << 22
#: Near copies that ``keep_one`` removes: words of a shingle, and similarity of two shingle sets.
WORDS, SIMILAR = 5, 0.8
#: Their fingerprints: 64-bit parts, differing bits up to which two link, and, for key parts, those up to which their first parts may differ.
PARTS, NEAR, NEAR_FIRST = 4, 68, 24
#: Sets of fewer shingles than the first differ in more bits at the same similarity; they link up to the second.
SMALL, NEAR_SMALL = 5, 84
#: What rounding may take from a product of sizes; a set of fewer shingles than this is similar to no other.
SLACK, LEAST_SET = 1e-6, 4
#: Blocks of sizes at most, and the fingerprints a block should hold at least.
SIZE_BLOCKS, LEAST_BLOCK = 64, 2048
#: Rows and columns of distances computed at once, as the processor's cache holds them.
TILE = 64, 4096
#: Fingerprints among which dense balls are looked for, differing bits from a ball's vantage point, a ball's least share.
BALLS, INNER, DENSE = 8192, 32, 1 / 64


def text_fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one whole text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return digest(b" ".join(words), SEED)
    ones, total = np.zeros(64, np.int64), len(words) - size + 1
    for start in range(0, total, 1 << 15):  # a very long text is summed in parts
        part = words[start:start + (1 << 15) + size - 1]
        hashes = np.array(
            [digest(b" ".join(s), SEED) for s in zip(*[part[i:] for i in range(size)])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed 64-bit numbers."""
    return pd.Series(np.array([text_fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def hex_fingerprint(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# -- vantage-point trees ------------------------------------------------------------------

def _halves(points: np.ndarray, half: int) -> np.ndarray:
    return (points >> np.uint64(32 * half)).astype(np.uint32)


def _distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _vantage(points: np.ndarray) -> tuple[int, int] | None:
    """A vantage point and radius that split these points best; None if they can't be split.

    Of a few spread points and their complements the one is taken whose ring of
    distances near the radius, which has to be searched twice, holds fewest points.
    """
    best = None
    for at in range(0, len(points), max(1, len(points) // 6)):
        for vantage in (points[at], ~points[at]):
            d = _distance(points, vantage)
            radius = int(np.median(d))
            left = int((d <= radius).sum())
            if left == len(points):
                radius -= 1
                left = int((d <= radius).sum())
            if not left:
                continue
            smaller = min(left, len(points) - left)
            ring = int(((d == radius) | (d == radius + 1)).sum())
            score = ring - smaller
            if best is None or score < best[0]:
                best = (score, int(vantage), radius)
    return best and best[1:]


class VantageTree:
    """The upper levels of one half's tree, in flat arrays: its leaves are the shards."""

    def __init__(self, sample: np.ndarray, total: int, leaf: int = LEAF):
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, radius, left, right; a leaf is -1 - its number
        self.leaves = 0
        weight = max(1.0, total / max(1, len(sample)))
        self.root = self._build(np.unique(sample) if total <= len(sample) else sample, weight, leaf)

    def _build(self, points: np.ndarray, weight: float, leaf: int) -> int:
        split = _vantage(points) if len(points) * weight > leaf and len(points) > 8 else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        number = len(self.nodes)
        self.nodes.append((split[0], split[1], 0, 0))
        d = _distance(points, np.uint32(split[0]))
        left = self._build(points[d <= split[1]], weight, leaf)
        right = self._build(points[d > split[1]], weight, leaf)
        self.nodes[number] = (*split, left, right)
        return number

    def route(self, points: np.ndarray):
        """(leaf, positions stored there, positions sent there as queries from earlier leaves)."""
        everything = np.arange(len(points))
        stack = [(self.root, everything, everything[:0])]
        while stack:
            node, stored, sent = stack.pop()
            if not len(stored) and not len(sent):
                continue
            if node < 0:
                yield -node - 1, stored, sent
                continue
            vantage, radius, left, right = self.nodes[node]
            d_stored, d_sent = (_distance(points[x], np.uint32(vantage)) for x in (stored, sent))
            stack.append((left, stored[d_stored <= radius], sent[d_sent <= radius + 1]))
            # Leaves are numbered from the left, so only points of the left side are sent over.
            over = stored[d_stored == radius]
            stack.append((right, stored[d_stored > radius], np.concatenate([sent[d_sent >= radius], over])))


def near_pairs(points: np.ndarray, half: int, stored: np.ndarray, sent: np.ndarray, radius: int = RADIUS):
    """Blocks of position pairs within ``radius``: stored with stored, and stored with sent."""
    keys = _halves(points, half)
    stack = [(stored, sent)]
    while stack:
        own, others = stack.pop()
        if not len(own) or len(own) + len(others) < 2:
            continue
        split = _vantage(keys[own[:: max(1, len(own) // 2048)]]) if len(own) > BLOCK else None
        if split is None:
            yield from _compare(points, own, others, radius)
            continue
        vantage, at = np.uint32(split[0]), split[1]
        d_own, d_others = _distance(keys[own], vantage), _distance(keys[others], vantage)
        left, right = own[d_own <= at], own[d_own > at]
        if not len(left) or not len(right):
            yield from _compare(points, own, others, radius)
            continue
        stack.append((left, others[d_others <= at + 1]))
        stack.append((right, np.concatenate([others[d_others >= at], own[d_own == at]])))


def _compare(points, own, others, radius):
    every = np.concatenate([own, others])
    rows = max(1, CELLS // len(every))
    for start in range(0, len(own), rows):
        block = own[start:start + rows]
        a, b = np.nonzero(np.bitwise_count(points[block][:, None] ^ points[every[start + 1:]][None, :]) <= radius)
        a, b = block[a], every[start + 1:][b]
        yield a[a != b], b[a != b]


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the pairs into ``labels``, where every position points to a smaller or equal one."""
    while True:
        x, y = labels[a], labels[b]
        unlike = x != y
        if not unlike.any():
            return
        a, b, x, y = a[unlike], b[unlike], x[unlike], y[unlike]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _forest(points: np.ndarray, half: int, stored: np.ndarray, sent: np.ndarray):
    labels = np.arange(len(points))
    for a, b in near_pairs(points, half, stored, sent):
        join_labels(labels, a, b)
    linked = np.nonzero(labels != np.arange(len(points)))[0]
    return points[linked].view(np.int64), points[labels[linked]].view(np.int64)


def fingerprint_links(prints: DataFrame, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) that connect whatever is connected within three bits.

    ``prints`` has one row for each different ``fingerprint``. The result holds a
    spanning forest of each leaf, so at most one row for each point of a leaf.
    """
    total = prints.count()
    every = max(1, -(-total // sample))
    drawn = prints.where(F.pmod(F.xxhash64("fingerprint", F.lit(SEED)), F.lit(every)) == 0).limit(2 * sample)
    shape = drawn.select("fingerprint").toArrow()["fingerprint"].to_numpy().view(np.uint64)
    trees = [VantageTree(_halves(np.sort(shape), half), total, leaf) for half in (0, 1)]

    def route(batches):
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for half, tree in enumerate(trees):
                for number, stored, sent in tree.route(_halves(points, half)):
                    both = np.concatenate([stored, sent])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(both), 2 * number + half, np.int64)),
                         pa.array(points[both].view(np.int64)), pa.array(np.arange(len(both)) < len(stored))],
                        ["shard", "fingerprint", "stored"])

    def search(group: pa.Table) -> pa.Table:
        points = group["fingerprint"].to_numpy().view(np.uint64)
        own = group["stored"].to_numpy()
        half = int(group["shard"][0].as_py()) % 2
        order = np.lexsort((points, ~own))  # the same rows whatever order they came in
        points, own = points[order], own[order]
        a, b = _forest(points, half, np.nonzero(own)[0], np.nonzero(~own)[0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    routed = prints.select("fingerprint").mapInArrow(route, "shard long, fingerprint long, stored boolean")
    return routed.groupBy("shard").applyInArrow(search, "a long, b long")


# -- components ---------------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root being the smallest node of its component.

    Alternating rounds: each node hands its larger neighbours, then its smaller
    ones, to the smallest it knows. They end when a round changes nothing. Minima
    combine before the shuffle; joins on a node are salted, as one may have a
    third of all links.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    mark = None
    while True:
        seen = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            salted_join(both.where("v > u"), least, "u", F.col("v"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, nearest, "u", F.col("v")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.union(nearest.select("u", F.col("m").alias("v"))).distinct(), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint long, node long, component_id) for every row of ``docs``.

    ``node`` is equal within a group and never null; ``component_id`` is the group's
    smallest ``doc_id``.
    """
    prints = staged(docs.select("doc_id", fingerprint("text").alias("fingerprint")), "fingerprints")
    nodes = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(fingerprint_links(nodes))
    rooted = staged(
        nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
        .select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("node")), "roots")
    firsts = staged(rooted.groupBy("node").agg(F.min("first").alias("component_id")), "groups")
    grouped = staged(rooted.select("fingerprint", "node").join(firsts, "node"), "members")
    return prints.join(grouped, "fingerprint").select("doc_id", "fingerprint", "node", "component_id")


# -- near copies: five-word shingles, similarity of 0.8 ------------------------------------

def _shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The different shingle hashes of a text in order; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array(
        [digest(b" ".join(s), SEED) for s in zip(*[words[i:] for i in range(min(size, len(words)))])], np.uint64))


def wide_fingerprint(hashes: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """SimHash of a set of shingle hashes in 64-bit parts; later parts take the bits of mixed hashes."""
    ones = np.zeros(64 * parts, np.int64)
    steps = np.arange(1, parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for start in range(0, len(hashes), 4096):  # a long text is done in parts
        own = hashes[start:start + 4096, None]
        x = own + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = np.hstack([own, x ^ (x >> np.uint64(31))]).astype("<u8")
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def _signed(texts: pa.Array, size: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Node (a digest of the shingle set), number of shingles and wide fingerprint of each text."""
    node, many, prints = [], [], []
    for text in texts.to_pylist():
        hashes = _shingle_hashes(text, size)
        node.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
        many.append(len(hashes))
        prints.append(wide_fingerprint(hashes).view(np.int64))
    return (pa.array(np.array(node, np.uint64).view(np.int64), pa.int64()), pa.array(many, pa.int32()),
            pa.array(prints, pa.list_(pa.int64())))


def _wide(prints) -> np.ndarray:
    """A column of wide fingerprints as rows of unsigned numbers."""
    column = prints.combine_chunks() if isinstance(prints, pa.ChunkedArray) else prints
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), PARTS)


def _wide_distance(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ others).sum(-1, dtype=np.int16)


def _wide_pairs(points: np.ndarray, radius: int):
    """Blocks of position pairs within ``radius``; the first parts tell most others."""
    first = np.ascontiguousarray(points[:, 0])
    rows = max(1, (CELLS >> 2) // max(1, len(points)))
    for start in range(0, len(points) - 1, rows):
        a, b = np.nonzero(np.bitwise_count(first[start:start + rows, None] ^ first[None, start + 1:]) <= NEAR_FIRST)
        a, b = a + start, b + start + 1
        a, b = a[a < b], b[a < b]
        near = _wide_distance(points[a], points[b]) <= radius
        yield a[near], b[near]


def dense_balls(points: np.ndarray, inner: int = INNER, share: float = DENSE) -> list[int]:
    """Positions of vantage points that have at least this share of all points within ``inner`` of them."""
    left, found, least = np.arange(len(points)), [], max(32, share * len(points))
    while len(left) >= least:
        some = left[:: -(-len(left) // 128)]
        within = np.stack([_wide_distance(points[left], points[i]) <= inner for i in some])
        best = int(within.sum(1).argmax())
        if within[best].sum() < least:
            break
        found.append(int(some[best]))
        left = left[~within[best]]
    return found


def _sized_pairs(points: np.ndarray, many: np.ndarray, own: np.ndarray, others: np.ndarray, radius: int):
    """Blocks of position pairs, one of ``own`` and one of ``others``, that are near and whose sizes allow similarity.

    Both lists are ordered by size; with itself a list is compared from each position on.
    """
    parts, size = np.ascontiguousarray(points.T), many[others]
    small, same = SIMILAR * size - SLACK, own is others
    xor, ones, total = np.empty(TILE, np.uint64), np.empty(TILE, np.uint8), np.empty(TILE, np.uint8)
    for start in range(0, len(own), TILE[0]):
        a = own[start:start + TILE[0]]
        low = start if same else int(np.searchsorted(size, SIMILAR * many[a[0]] - SLACK))
        high = int(np.searchsorted(small, many[a[-1]], side="right"))
        for at in range(low, high, TILE[1]):
            b = others[at:min(at + TILE[1], high)]
            x, n, d = (buffer[:len(a), :len(b)] for buffer in (xor, ones, total))
            for k, part in enumerate(parts):
                np.bitwise_xor(part[a][:, None], part[b][None, :], out=x)
                np.bitwise_count(x, out=n if k else d)
                if k:
                    np.add(d, n, out=d)  # 256 becomes 0, so what is near here is counted again
            hit = np.flatnonzero(d <= max(radius, NEAR_SMALL))
            if len(hit):
                i, j = a[hit // len(b)], b[hit % len(b)]
                limit = np.where(np.minimum(many[i], many[j]) < SMALL, max(radius, NEAR_SMALL), radius)
                near = (_wide_distance(points[i], points[j]) <= limit) & (i != j)
                yield i[near], j[near]


def wide_links(nodes: DataFrame, radius: int = NEAR, alone: int | None = None) -> DataFrame:
    """Links (a, b) that connect all nodes whose wide fingerprints (``print``) are near and whose sizes (``many``) allow similarity.

    Fingerprints are dealt into blocks of equal numbers by size, sets of one size by
    their digests. A group is two blocks (or one with itself) that may hold sets of
    similarity 0.8; it compares all their fingerprints on all bits and returns a
    spanning forest. The blocks' number is bounded, so the shuffle grows with the
    table and the comparisons with its square.

    A large group of near copies would be very many links, so a sample shows the vantage points
    of dense balls. A fingerprint within ``INNER`` of one links to it and goes no
    further; whatever is near such a fingerprint is within ``INNER`` more bits of the
    vantage point, and links to that as well, so this loses no link.

    With ``alone`` given, larger tables are compared by key parts, whatever their sizes (see ``_byte_links``): that
    takes an eighth of all comparisons, but may miss pairs. ``near_copies`` doesn't use it.
    """
    total = nodes.count()
    every = max(1, -(-total // BALLS))
    drawn = nodes.where(F.pmod(F.xxhash64("print", F.lit(SEED)), F.lit(every)) == 0).select("node", "print").limit(2 * BALLS).toArrow()
    order = np.argsort(drawn["node"].to_numpy())
    shape, names = _wide(drawn["print"])[order], drawn["node"].to_numpy()[order]
    found = dense_balls(shape) if len(shape) else []
    balls, centres = shape[found], names[found]
    reach = F.lit(INNER + radius)
    if alone is None:  # sets that may be similar to small ones reach farther
        reach = F.when(SIMILAR * F.col("many") < SMALL - 1 + SLACK, INNER + max(radius, NEAR_SMALL)).otherwise(reach)
        nodes = nodes.where(F.col("many") >= LEAST_SET)

    def claim(batches):
        for batch in batches:
            node, points = batch.column(0).to_numpy(), _wide(batch.column(1))
            for ball, centre in zip(balls, centres):
                near = (_wide_distance(points, ball) <= batch.column(2).to_numpy()) & (node != centre)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[near]), pa.array(np.full(int(near.sum()), centre, np.int64))], ["a", "b"])

    links = _size_links(nodes, total, balls, radius) if alone is None else _byte_links(nodes, total > alone, balls, radius)
    return links.unionByName(nodes.select("node", "print", reach.alias("reach")).mapInArrow(claim, "a long, b long")) if found else links


def _free(points: np.ndarray, balls: np.ndarray) -> np.ndarray:
    """Which of the fingerprints lie in no dense ball."""
    free = np.ones(len(points), bool)
    for ball in balls:
        free &= _wide_distance(points, ball) > INNER
    return free


def _forest_table(node: np.ndarray, pairs) -> pa.Table:
    """A spanning forest of the position pairs: each linked node and the first of its tree."""
    labels = np.arange(len(node))
    for a, b in pairs:
        join_labels(labels, a, b)
    linked = np.nonzero(labels != np.arange(len(node)))[0]
    return pa.table({"a": pa.array(node[linked]), "b": pa.array(node[labels[linked]])})


def _size_links(nodes: DataFrame, total: int, balls: np.ndarray, radius: int) -> DataFrame:
    """Links among the fingerprints outside the balls, by blocks of sizes."""
    blocks = max(1, min(SIZE_BLOCKS, total // LEAST_BLOCK))
    placed = nodes.select(
        "node", "many", "print", (F.col("many") + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / F.lit(1 << 20)).alias("place"))
    cuts = np.array(placed.agg(F.percentile_approx("place", [i / blocks for i in range(1, blocks)], 10_000)).first()[0] or []
                    if blocks > 1 else [], np.float64)
    blocks = len(cuts) + 1
    low, high = np.floor([0, *cuts]), np.floor([*cuts, np.inf])
    pairs = [(a, b) for a in range(blocks) for b in range(a, blocks) if a == b or SIMILAR * low[b] <= high[a] + SLACK]
    groups = [[number for number, pair in enumerate(pairs) if block in pair] for block in range(blocks)]

    def deal(batches):
        for batch in batches:
            free = _free(_wide(batch.column(2)), balls)
            block = np.searchsorted(cuts, batch.column(3).to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(block)], ["node", "many", "print", "block"]).filter(pa.array(free))

    def search(group: pa.Table) -> pa.Table:
        first, second = pairs[group["pair"][0].as_py()]
        order = np.lexsort((group["node"].to_numpy(), group["many"].to_numpy()))  # the same rows whatever order they came in
        node, many, block = (group[c].to_numpy()[order] for c in ("node", "many", "block"))
        own = np.nonzero(block == first)[0]
        others = own if first == second else np.nonzero(block == second)[0]
        return _forest_table(node, _sized_pairs(_wide(group["print"])[order], many, own, others, radius))

    dealt = placed.mapInArrow(deal, "node long, many int, print array<long>, block int")
    chosen = F.array(*[F.array(*map(F.lit, some)) for some in groups])[F.col("block")]
    return dealt.withColumn("pair", F.explode(chosen)).groupBy("pair").applyInArrow(search, "a long, b long")


def _byte_links(nodes: DataFrame, parted: bool, balls: np.ndarray, radius: int) -> DataFrame:
    """Links among the fingerprints outside the balls where a byte is equal and the first parts are near.

    Each fingerprint goes to one shard a byte, by the byte's place and upper half; a shard
    compares what has the whole byte in common and returns a spanning forest.
    """
    bytes_ = range(8 * PARTS) if parted else range(0)

    def route(batches):
        for batch in batches:
            node, points = batch.column(0).to_numpy(), _wide(batch.column(1))
            free = _free(points, balls)
            node, points = node[free], np.ascontiguousarray(points[free])
            keys = points.astype("<u8").view(np.uint8).reshape(len(node), 8 * PARTS)
            ends = pa.array(np.arange(len(node) + 1, dtype=np.int32) * points.shape[1])
            prints = pa.ListArray.from_arrays(ends, pa.array(points.view(np.int64).ravel()))
            for shard in ([16 * at + (keys[:, at] >> 4).astype(np.int32) for at in bytes_] or [np.full(len(node), -1)]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), pa.array(node), prints], ["shard", "node", "print"])

    def search(group: pa.Table) -> pa.Table:
        node, shard = group["node"].to_numpy(), group["shard"][0].as_py()
        order = np.argsort(node)  # the same rows whatever order they came in
        node, points = node[order], _wide(group["print"])[order]
        key = points.astype("<u8").view(np.uint8).reshape(len(node), 8 * PARTS)[:, shard // 16] if shard >= 0 else np.zeros(len(node), np.uint8)
        places = (np.nonzero(key == value)[0] for value in np.unique(key))
        return _forest_table(node, ((own[a], own[b]) for own in places for a, b in _wide_pairs(points[own], radius)))

    return nodes.select("node", "print").mapInArrow(route, "shard int, node long, print array<long>").groupBy("shard").applyInArrow(
        search, "a long, b long")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least the exact Jaccard similarity ``least``."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(common >= F.lit(least) * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def _located(docs: DataFrame) -> DataFrame:
    """Text with what tells one row from another: id, whether it is null, and the text's hash."""
    return docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"),
        F.xxhash64("text").alias("_hash"), "text")


def near_copies(docs: DataFrame, size: int = WORDS, least: float = SIMILAR) -> DataFrame:
    """(node, first, root) of every different shingle set: sets joined by a chain of similar pairs share ``root``.

    ``first`` is the place (``no_id``, ``_id``, ``_hash``) of the set's first row. Candidates are sets whose wide
    fingerprints are in one cluster; every link is then checked on the exact sets. First all sets
    of a cluster are compared with its least and its largest one, so a large group of
    copies costs two pairs a set. Clusters that this leaves in several groups are
    families, which ``_family_links`` joins on what sets differ in.
    """
    schema = "_id long, _none boolean, _hash long, node long, many int, print array<long>"

    def sign(batches):
        for batch in batches:
            node, many, prints = _signed(batch.column(3), size)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], node, many, prints], ["_id", "_none", "_hash", "node", "many", "print"])

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([_shingle_hashes(t, size).view(np.int64) for t in texts])

    prints = staged(_located(docs).mapInArrow(sign, schema), "signatures")
    place = F.struct(F.col("_none").alias("no_id"), "_id", "_hash")
    nodes = staged(prints.groupBy("node").agg(F.min(F.struct(place.alias("first"), "many", "print")).alias("x"))
                   .select("node", "x.first", "x.many", "x.print"), "nodes")
    linked = staged(components(wide_links(nodes)), "linked").select("node", F.col("root").alias("key"))
    clusters = linked.unionByName(linked.select(F.col("key").alias("node"), "key").distinct())  # a root has no row of its own
    keys = staged(nodes.select("node", "many", "first").join(clusters, "node"), "clusters")
    ends = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n"))
    shared = staged(salted_join(keys.select("node", "many", "key"), ends, "key", F.col("node")), "shared")
    sizes = nodes.select(F.col("node").alias("b"), F.col("many").alias("many_b"))
    wanted = staged(keys.select("node", F.col("first.no_id").alias("_none"), "first._id", "first._hash"), "wanted")
    sets = staged(_located(docs).join(wanted, ["_id", "_none", "_hash"]).select("node", "text").dropDuplicates(["node"])
                  .select("node", shingles("text").alias("shingles")), "sets")
    stars = shared.select(F.col("node").alias("a"), "many", F.explode(F.array("low", "high")).alias("b")).where("a <> b").distinct()
    # Sets of too different sizes can't be similar.
    stars = staged(stars.join(sizes, "b").where(F.least("many", "many_b") >= F.lit(least) * F.greatest("many", "many_b")).select("a", "b"), "pairs")
    links = staged(_similar(stars, sets, least), "near")
    placed = staged(shared.join(staged(components(links), "roots"), "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    # Of three sets the stars are all pairs.
    mixed = placed.where("n > 3").groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    members = salted_join(placed, mixed, "key", F.col("node")).select("node", "many", "root", F.col("key").alias("family"))
    links = _family_links(staged(members, "members"), sets, links, least)
    return nodes.select("node", "first").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _family_links(members: DataFrame, sets: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """``links`` and those that connect what is still apart in the families of ``members``.

    A family's core T holds the shingles of more than half its sets; what a set x
    differs in from T is r(x). The symmetric difference of two sets is that of r(x)
    and r(y), so with share = (1 - least) / (1 + least) and a(x) = |r(x)| - share * |x|
    they are similar just when a(x) + a(y) <= 2 * |r(x) & r(y)|. Hence

    - all sets that are similar to any other without common differences are similar
      to the family's hub, the set with the least a;
    - of the others, e(x) counts the differences that another set has too, and no
      set is similar to x where a(x) + a(y) exceeds twice the smaller e;
    - what passes has to share one of its rarest differences: all but as many as
      it needs in common with the hub, less one.

    Near copies around one text differ from it each in their own way, so few sets pass
    the second test, however many the family has. Every pair is checked exactly.
    """
    share, slack = (1 - least) / (1 + least), 1e-6
    items = staged(members.select("family", "node").join(sets, "node").select("family", "node", F.explode("shingles").alias("s")), "items")
    total = members.groupBy("family").agg(F.count(F.lit(1)).alias("m"))
    known = items.groupBy("family", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(total, "family")
    known = staged(known.withColumn("core", F.expr("2 * n > m")).select(
        "family", "s", "core", F.expr("CASE WHEN core THEN m - n ELSE n END").alias("others")), "differences")
    core = known.where("core").groupBy("family").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("others") == 1).alias("t1"))
    place = F.xxhash64("family", "s")
    met = salted_join(items.withColumn("fs", place), known.withColumn("fs", place).withColumnRenamed("family", "f").withColumnRenamed("s", "z"),
                      "fs", F.col("node")).where("family = f AND s = z").select("family", "node", "s", "core", "others")
    met = staged(met, "met")
    own = met.groupBy("node").agg(F.count_if("core").alias("c"), F.count_if(F.expr("core AND others = 1")).alias("c1"),
                                  F.count_if(F.expr("NOT core")).alias("shared"))
    # Differences another set has too: shingles outside the core, and core shingles missing in more sets than this one.
    measured = (
        members.join(own, "node", "left").join(core, "family", "left").na.fill(0, ["c", "c1", "shared", "t", "t1"])
        .withColumn("a", F.expr(f"many + t - 2 * c - {share!r} * many"))
        .withColumn("e", F.expr("shared + (t - c) - (t1 - c1)")))
    measured = staged(measured.select("family", "node", "many", "root", "a", "e"), "measured")
    hubs = measured.groupBy("family").agg(
        F.min(F.struct("a", "node", "root", "e")).alias("hub"), F.max(F.expr("2 * e - a")).alias("reach"))
    at_hub = measured.join(hubs, "family").where(
        f"root <> hub.root AND a + hub.a <= 2 * least(e, hub.e) + {slack} OR root <> hub.root AND a + hub.a <= {slack}")
    near = staged(_similar(at_hub.select(F.col("node").alias("a"), F.col("hub.node").alias("b")), sets, least), "near")
    links = staged(links.unionByName(near), "near")

    roots = staged(components(links), "roots")
    again = measured.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = again.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max(F.struct("n", "root")).alias("top"))
    able = again.join(tops, "family").join(hubs, "family").where(f"a <= reach + {slack} AND hub.a <= 2 * e - a + {slack}").select(
        "family", "node", "many", "root", "a", "e", F.col("top.root").alias("top"),
        F.greatest(F.lit(1), F.ceil((F.col("a") + F.col("hub.a")) / 2 - slack)).alias("needs"))
    able = staged(able, "able")
    open_families = able.where("root <> top").select("family").distinct()
    able = able.join(open_families, "family", "left_semi")
    missing = able.select("family", "node").join(known.where("core AND others > 1").select("family", "s", "others"), "family").join(
        met.where("core").select("node", "s"), ["node", "s"], "left_anti").select("family", "node", "s", "others", F.lit(True).alias("lacks"))
    extra = met.where("NOT core").join(able.select("node"), "node", "left_semi").select("family", "node", "s", "others", F.lit(False).alias("lacks"))
    order = Window.partitionBy("node").orderBy("others", "s", "lacks")
    prefix = missing.unionByName(extra).withColumn("at", F.row_number().over(order)).join(able.drop("family"), "node").where("at <= e - needs + 1")
    prefix = staged(prefix.select("family", "s", "lacks", "node", "many", "root", "a", "e", "top"), "prefix")
    few = prefix.where("root <> top").withColumn("few", F.lit(True)).alias("x")
    met_again = few.join(prefix.alias("y"), ["family", "s", "lacks"]).where(
        f"x.root <> y.root AND (y.root = x.top OR x.node < y.node) AND x.a + y.a <= 2 * least(x.e, y.e) + {slack} "
        f"AND least(x.many, y.many) >= {least!r} * greatest(x.many, y.many)")
    crossed = staged(met_again.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "pairs")
    return links.unionByName(staged(_similar(crossed, sets, least), "near"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with the columns of ``docs``.

    It is the row with the smallest ``doc_id`` (nulls last); rows that share it are
    told apart by a hash of the text, and of equal rows one stays. Rows link when
    their five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    kept = (
        near_copies(docs).groupBy("root").agg(F.min("first").alias("first"))
        .select("first._id", F.col("first.no_id").alias("_none"), "first._hash").distinct())
    marked = packed(docs).select(
        "doc", F.coalesce("doc.doc_id", F.lit(0)).alias("_id"), F.col("doc.doc_id").isNull().alias("_none"),
        F.xxhash64("doc.text").alias("_hash"))
    chosen = marked.join(kept, ["_id", "_none", "_hash"], "left_semi")
    # Rows that share id and text but differ elsewhere: the least one by all columns, whatever order they come in.
    least = F.to_json(F.col("doc").dropFields("text"))
    return chosen.groupBy("_id", "_none", "_hash").agg(F.min_by("doc", least).alias("doc")).select("doc.*")
