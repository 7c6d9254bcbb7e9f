"""Approximate nearest neighbours: one navigable small-world graph per shard.

Vectors are dealt to shards by their norm's band and a hash of their id, so that the
norms of a shard differ by a factor of 16 at most. Each shard's different vectors
form a hierarchical graph: nodes are ordered by level, so layer l is simply the
first ``layers[l]`` nodes, and its links are one flat array of fixed width. A
shard's graph is one row of the index table, written to the shared folder. Blocks
of queries then visit every shard; the shards' finds are merged with exact scores.

Inner products are searched as distances: each vector gets one more component
that brings it to the longest norm of its shard, which leaves the order by inner
product as it is. Within a band that component stays small enough for single
precision, however far the table's norms lie apart. Nodes are inserted in batches; a batch searches the graph built
so far and its own members, takes diverse neighbours (a candidate nearer to a
chosen neighbour than to the node is passed over), and links back.

**Defined results.** Vectors that are null, zero, or hold a null, NaN or infinite
component, and rows without an id take no part. Only vectors of equal length are
compared. A query's own rows (those with its id) are no candidates. Equal vectors
share a node that knows all their ids, so copies can't crowd the graph. Exactly
repeated queries are answered once. Scores are inner products in double
precision, summed in component order. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractflow.llm import vectors as V
from contractflow.llm.common import staged
from contractflow.llm.topk import ranked

#: Links of a node in the upper layers; the lowest has twice as many.
LINKS = 16
#: Candidates kept while a node is inserted, and while a query is answered.
BUILD, SEARCH = 64, 96
#: Vectors of a shard at most (on average), and shards at least, which keeps small tables parallel.
SHARD, SHARDS = 32_768, 12
#: A band covers norms between two powers of two this many exponents apart; doubles have about 530 such bands.
BAND = 4
QUERY_BLOCK = 4096
BATCH = 256
EXPAND = 4

INDEX = ("shard int, dim int, ids array<long>, copies array<int>, vectors array<double>, layers array<int>, "
         "links array<int>")


def _distances(points: np.ndarray, squares: np.ndarray, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances, less the query's own square, of each query to its row of nodes; -1 is no node."""
    found = squares[at] - 2 * np.einsum("bkd,bd->bk", points[at], asked)
    return np.where(at < 0, np.inf, found)


def _keep(nodes: np.ndarray, far: np.ndarray, more: np.ndarray, more_far: np.ndarray, width: int, *flags):
    """The ``width`` nearest of both, each node once, in order of distance."""
    every, dist = np.concatenate([nodes, more], 1), np.concatenate([far, more_far], 1)
    order = np.lexsort((every, dist), axis=1)
    every, dist = np.take_along_axis(every, order, 1), np.take_along_axis(dist, order, 1)
    dist[:, 1:][(every[:, 1:] == every[:, :-1])] = np.inf
    again = np.argsort(dist, axis=1, kind="stable")[:, :width]
    order = np.take_along_axis(order, again, 1)
    return (np.take_along_axis(every, again, 1), np.take_along_axis(dist, again, 1),
            *(np.take_along_axis(np.concatenate([f, np.zeros(more.shape, bool)], 1), order, 1) for f in flags))


def beam(points, squares, links, asked, start, width: int):
    """Best-first search of many queries at once: (nodes, distances), nearest first, -1 where none."""
    rows = np.arange(len(asked))[:, None]
    seen = np.zeros((len(asked), len(links) + 1), bool)
    seen[rows, start] = True
    nodes, far, done = _keep(
        start[:, :0], np.zeros((len(asked), 0)), start, _distances(points, squares, asked, start), width,
        np.zeros((len(asked), 0), bool))
    active = np.arange(len(asked))
    while len(active):
        open_ = ~done[active] & (far[active] < np.inf)
        going = open_.any(axis=1)
        active, open_ = active[going], open_[going]
        if not len(active):
            break
        turn = np.cumsum(open_, axis=1)
        chosen = open_ & (turn <= EXPAND)
        done[active] |= chosen
        slot = np.argsort(~chosen, axis=1, kind="stable")[:, :EXPAND]
        real = np.take_along_axis(chosen, slot, 1)
        from_ = np.where(real, np.take_along_axis(nodes[active], slot, 1), -1)
        near = np.where(from_[:, :, None] < 0, -1, links[from_]).reshape(len(active), -1)
        near[seen[active[:, None], near]] = -1
        seen[active[:, None], near] = True
        seen[:, -1] = False
        nodes[active], far[active], done[active] = _keep(
            nodes[active], far[active], near, _distances(points, squares, asked[active], near), width, done[active])
    return nodes, far


def _entries(start: np.ndarray, width: int) -> np.ndarray:
    """Start nodes padded with "none" to the beam's width."""
    if start.shape[1] >= width:
        return start[:, :width]
    return np.concatenate([start, np.full((len(start), width - start.shape[1]), -1)], 1)


def diverse(points, squares, asked, nodes, far, count: int) -> np.ndarray:
    """Up to ``count`` neighbours of each row's candidates (nearest first); -1 fills the rest."""
    vectors = points[nodes]
    between = squares[nodes][:, :, None] + squares[nodes][:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    own = far + (asked * asked).sum(axis=1)[:, None]
    free = np.isfinite(far)
    chosen = np.full((len(nodes), count), -1)
    rows = np.arange(len(nodes))
    passed = np.zeros(nodes.shape, bool)
    for slot in range(count):
        pick = free.argmax(axis=1)
        some = free[rows, pick]
        if not some.any():
            break
        chosen[some, slot] = nodes[rows, pick][some]
        free[rows, pick] = False
        blocked = free & (between[rows, pick] < own) & some[:, None]
        passed |= blocked
        free &= ~blocked
    for slot in range(count):  # places left over go to the nearest that were passed over
        need = chosen[:, slot] < 0
        if not need.any() or not passed[need].any():
            continue
        pick = passed.argmax(axis=1)
        some = need & passed[rows, pick]
        chosen[some, slot] = nodes[rows, pick][some]
        passed[rows, pick] = False
    return chosen


def _link_back(points, squares, links, fresh: np.ndarray, chosen: np.ndarray) -> None:
    """Add the new nodes to their neighbours' links; a full list is thinned to diverse ones."""
    source, target = np.repeat(fresh, chosen.shape[1]), chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    touched, first, many = np.unique(target, return_index=True, return_counts=True)
    width = links.shape[1]
    place = np.arange(len(target)) - np.repeat(first, many)
    for low in range(0, len(touched), BATCH):
        some = slice(low, low + BATCH)
        nodes, most = touched[some], int(many[some].max())
        inside = (target >= nodes[0]) & (target <= nodes[-1])
        more = np.full((len(nodes), most), -1)
        more[np.searchsorted(nodes, target[inside]), place[inside]] = source[inside]
        every = np.concatenate([links[nodes], more], 1)
        far = _distances(points, squares, points[nodes], every)
        order = np.argsort(far, axis=1, kind="stable")
        every, far = np.take_along_axis(every, order, 1), np.take_along_axis(far, order, 1)
        full = (every >= 0).sum(axis=1) > width
        kept = every[:, :width].copy()
        if full.any():
            cut = min(every.shape[1], 3 * width)
            kept[full] = diverse(points, squares, points[nodes][full], every[full][:, :cut], far[full][:, :cut], width)
        links[nodes] = kept


class Graph:
    """The layers of one shard; ``points`` are in node order."""

    def __init__(self, points: np.ndarray, layers: list[int], links: list[np.ndarray] | None = None):
        self.points, self.layers = points, layers
        self.squares = np.append((points * points).sum(axis=1), np.float32(0))
        self.points = np.concatenate([points, np.zeros((1, points.shape[1]), points.dtype)])  # node -1: none
        self.links = links if links is not None else []

    def _descend(self, asked: np.ndarray, upto: int) -> np.ndarray:
        """Start nodes for the layer below the ``upto`` highest ones."""
        top = self.layers[-1] if upto else min(self.layers[-1], LINKS)
        far = self.squares[:top] - 2 * asked @ self.points[:top].T
        nodes = np.argsort(far, axis=1, kind="stable")[:, :EXPAND]
        for links in self.links[1:upto]:
            nodes, _ = beam(self.points, self.squares, links, asked, _entries(nodes, 2 * EXPAND), 2 * EXPAND)
            nodes = nodes[:, :EXPAND]
        return nodes

    def build(self) -> Graph:
        """Layers from the highest down; each starts with the nodes of the layer above it."""
        for depth, size in enumerate(reversed(self.layers)):
            width = 2 * LINKS if depth == len(self.layers) - 1 else LINKS
            links, at = np.full((size, width), -1, np.int32), 0
            while at < size:
                upto = min(size, at + min(BATCH, max(64, at)))
                fresh = np.arange(at, upto)
                asked = self.points[fresh]
                nodes, far = np.full((len(fresh), 0), -1), np.full((len(fresh), 0), np.inf)
                if at:
                    start = self._descend(asked, depth)
                    start = np.where(start < at, start, -1)
                    start = np.concatenate([start, np.zeros((len(fresh), 1), start.dtype)], 1)
                    nodes, far = beam(self.points, self.squares, links[:at], asked, _entries(start, BUILD), BUILD)
                peers = np.broadcast_to(fresh, (len(fresh), len(fresh))).copy()
                np.fill_diagonal(peers, -1)
                near = _distances(self.points, self.squares, asked, peers)
                nodes, far = _keep(nodes, far, peers, near, BUILD)
                chosen = diverse(self.points, self.squares, asked, nodes, far, LINKS)
                links[fresh, :LINKS] = chosen
                _link_back(self.points, self.squares, links, fresh, chosen)
                at = upto
            self.links.append(links)
        return self

    def search(self, asked: np.ndarray, width: int) -> np.ndarray:
        start = self._descend(asked, len(self.links) - 1) if len(self.links) > 1 else self._descend(asked, 1)
        return beam(self.points, self.squares, self.links[-1], asked, _entries(start, width), width)[0]


def _levels(count: int) -> list[int]:
    """Nodes of each layer from the lowest: each a sixteenth of the one below."""
    layers = [count]
    while layers[-1] > 4 * LINKS:
        layers.append(layers[-1] // LINKS)
    return layers


def build_shard(group: pa.Table) -> pa.Table:
    """One index row: the graph of a shard's vectors in flat arrays."""
    dim = int(group["dim"][0].as_py())
    ids, rows = group["vec_id"].to_numpy(), V.matrix(group, "vector", dim)
    order = np.lexsort((ids,))
    ids, rows = ids[order], rows[order]
    different, which = np.unique(rows, axis=0, return_inverse=True)
    which = which.ravel()
    # Nodes in an order that has nothing to do with their place, so that every layer is a fair sample.
    node = np.random.default_rng(len(different)).permutation(len(different))
    place = np.empty(len(node), np.int64)
    place[node] = np.arange(len(node))
    different, which = different[node], place[which]
    order = np.lexsort((ids, which))
    graph = Graph(_lifted(different), _levels(len(different))).build()
    return pa.table({
        "shard": pa.array([group["shard"][0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()),
        "ids": pa.array([ids[order]], pa.list_(pa.int64())),
        "copies": pa.array([np.bincount(which, minlength=len(different)).astype(np.int32)], pa.list_(pa.int32())),
        "vectors": pa.array([different.ravel()], pa.list_(pa.float64())),
        "layers": pa.array([graph.layers], pa.list_(pa.int32())),
        "links": pa.array([np.concatenate([x.ravel() for x in graph.links])], pa.list_(pa.int32()))})


def _lifted(rows: np.ndarray) -> np.ndarray:
    """Vectors scaled to norms of at most one, with the component that brings each to exactly one."""
    rows = rows / (np.abs(rows).max(initial=0) or 1.0)  # squares neither overflow nor vanish
    norms = np.sqrt((rows * rows).sum(axis=1))
    longest = norms.max(initial=0) or 1.0
    lift = np.sqrt(np.maximum(0, 1 - (norms / longest) ** 2))
    return np.concatenate([rows / longest, lift[:, None]], 1).astype(np.float32)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy()


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added in component order."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def search_shard(k: int, width: int):
    def search(queries: pa.Table, index: pa.Table) -> pa.Table:
        names, kinds = ("qno", "query_id", "vec_id", "score"), (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        if not queries.num_rows or not index.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        dim, layers = int(index["dim"][0].as_py()), _flat(index, "layers").tolist()
        vectors = _flat(index, "vectors").reshape(-1, dim)
        flat, links, at = _flat(index, "links"), [], 0
        for depth, size in enumerate(reversed(layers)):
            wide = 2 * LINKS if depth == len(layers) - 1 else LINKS
            links.append(flat[at:at + size * wide].reshape(size, wide))
            at += size * wide
        graph = Graph(_lifted(vectors), layers, links)
        ids, copies = _flat(index, "ids"), _flat(index, "copies")
        first = np.concatenate([[0], np.cumsum(copies)])
        asked_all, qno, own = V.matrix(queries, "vector", dim), queries["qno"].to_numpy(), queries["vec_id"].to_numpy()
        out = []
        for low in range(0, len(asked_all), BATCH):
            asked = asked_all[low:low + BATCH]
            even = asked / np.abs(asked).max(axis=1, keepdims=True)
            even = even / np.sqrt((even * even).sum(axis=1, keepdims=True))
            nodes = graph.search(np.concatenate([even, np.zeros((len(even), 1))], 1).astype(np.float32), width)
            row, slot = np.nonzero(nodes >= 0)
            node = nodes[row, slot]
            score = inner_products(asked[row], vectors[node])
            many = np.minimum(copies[node], k + 1)  # no more copies of one vector can be among the best
            pick = np.repeat(np.arange(len(row)), many)
            nth = np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many)
            found, row, score = ids[first[node[pick]] + nth], row[pick], score[pick]
            other = found != own[low + row]
            found, row, score = found[other], row[other], score[other]
            order = np.lexsort((found, -score, row))
            found, row, score = found[order], row[order], score[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((qno[low + row[best]], own[low + row[best]], found[best], score[best]))
        return pa.table({n: pa.array(np.concatenate([x[i] for x in out]), t) for i, (n, t) in enumerate(zip(names, kinds))})

    return search


def norm_band(vector: str) -> Column:
    """The band of a vector's norm; norms around one are in the middle of theirs."""
    def exponent(largest: Column) -> Column:
        squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + (x / largest) * (x / largest))
        return F.log2(largest) + F.log2(squares) / 2

    # Bound as a lambda's variable, the largest component is found once a vector and not once a component.
    found = F.transform(F.array(F.array_max(F.transform(vector, F.abs))), exponent)[0]
    return F.floor(found / BAND + 0.5).cast("int")


def shards_of_bands(rows: dict[int, int]) -> tuple[Column, int]:
    """The shard of a row with ``band`` and ``vec_id``, and how many shards there are, for so many rows a band."""
    total, first, places = sum(rows.values()), 0, []
    for band, count in sorted(rows.items()):
        own = max(-(-count // SHARD), -(-count * SHARDS // total))
        places += [F.lit(band), F.struct(F.lit(first).alias("first"), F.lit(own).alias("own"))]
        first += own
    place = F.create_map(*places)[F.col("band")]
    return (place["first"] + F.pmod(F.xxhash64("vec_id"), place["own"])).cast("int"), first


def build_index(vectors: DataFrame, shard: Column) -> DataFrame:
    """The index table: one row for each shard and vector length."""
    dealt = vectors.withColumn("shard", shard).drop("band")
    return staged(dealt.groupBy("shard", "dim").applyInArrow(build_shard, INDEX), "hnsw")


def nearest(table: DataFrame, k: int = 20, every: int = V.EVERY, width: int = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` nearest found."""
    vectors = V.usable_vectors(table).where(F.exists("vector", lambda x: x != 0))
    banded = vectors.withColumn("band", norm_band("vector"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).collect()
    if not sizes:
        return ranked(vectors.select(
            F.col("vec_id").alias("qno"), F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")), k)
    shard, shards = shards_of_bands({band: rows for band, rows, _ in sizes})  # a row for each band
    blocks = max(1, -(-sum(asked for _, _, asked in sizes) // QUERY_BLOCK))
    index = build_index(banded, shard).withColumn("qb", V.every_block(blocks))
    queries = V.queries_of(vectors, every).withColumns({"qb": V.block("vec_id", blocks), "shard": V.every_block(shards)})
    keys = ["shard", "dim", "qb"]
    found = queries.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(
        search_shard(k, width), "qno long, query_id long, vec_id long, score double")
    return ranked(found, k)
