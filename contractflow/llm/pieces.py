"""Sampled subword segmentations by Gumbel top-k without replacement, and decoding.

All ways to cut a text into vocabulary pieces form a lattice. A segmentation's
probability is the product of its pieces' weights over the sum for all
segmentations. Adding Gumbel noise to the log probabilities and taking the k
largest is sampling k different segmentations without replacement; the noise need
not be drawn for each of them, because the maximum over any set of segmentations
is again a Gumbel variable, placed at the log of the set's total probability.

**Search.** Best-first over sets of segmentations that share a beginning, with
the set's noisy maximum as an exact bound (backward sums over the lattice give
each set's total). A set splits into those that go on with the piece its maximum
takes, which inherit the maximum, and the rest, whose maximum is drawn below it.
So the first segmentation is one walk from start to end, and leaves a rest at each
step; the best rest is opened next, and walked to its end in turn. The maximum
that would be opened after the k-th segmentation is the threshold from which
inclusion scores follow: the log probability that a segmentation's noise passes it.

**Lattices.** No piece crosses certain places (before a space, around a line
feed, if the vocabulary is so), so a text's lattice is a row of small ones, one
for each chunk. A batch of texts builds that of each different chunk once, with
array operations over all their characters, and all chunks are walked together.
A very long text is cut into windows of chunks, so only one window's lattices are
held at a time.

The vocabulary is read from a SentencePiece file on the driver. Its pieces are
ordered by merge rank; ``weight ~ 1 / (rank + 2)^power``. Characters without a
piece become their UTF-8 bytes. Draws are a hash of the seed, the row's key and
the place in the text: the same on every run, whatever the batches.

**Defined results.** A null or empty text has one segmentation, with no pieces
and log probability 0. A text with fewer than k segmentations gives them all,
with inclusion 0 (certain). Rows with equal keys and texts draw the same. Decoding
restores the text exactly, also where it holds the space sign of the vocabulary.
Other columns are not looked at.
"""

import bisect
import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 4
SPACE = "▁"
#: Stands for a space sign in the text; a lone surrogate, which no text holds.
LITERAL = "\udfff"
#: Characters whose lattices are held at once.
WINDOW = 500_000
#: Draws are at least 2^-54, so no noise is higher than this.
NOISE = 54 * math.log(2)
#: Steps of a path whose rests are drawn at first.
FIRST = 100

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of the splitmix kind."""
    x = (x ^ (x >> np.uint64(30))) * _M1  # arrays wrap around
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1."""
    return (mixed(x) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54


def one_uniform(x: int) -> float:
    """``uniform`` of a single number."""
    x &= (1 << 64) - 1
    x = (x ^ x >> 30) * int(_M1) & (1 << 64) - 1
    x = (x ^ x >> 27) * int(_M2) & (1 << 64) - 1
    return ((x ^ x >> 31) >> 11) * 2.0 ** -53 + 2.0 ** -54


def at(base: np.ndarray, place: np.ndarray) -> np.ndarray:
    return base + (place.astype(np.uint64) + np.uint64(1)) * GOLDEN


def stream(keys: np.ndarray, seed: int, kind: int, number: int) -> np.ndarray:
    """Base of each row's draws of one kind for one sample."""
    return mixed(at(mixed(at(keys, np.array([seed]))), np.array([1000 * kind + number])))


def load_pieces(model: str = MODEL) -> dict:
    """What the executors need of a vocabulary; its size is that of the vocabulary."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    count = sp.get_piece_size()
    usual = [i for i in range(count) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ranks = {i: -sp.get_score(i) for i in usual}
    last = max((r for r in ranks.values() if r < 1e8), default=0) + 1
    return {
        "pieces": [(sp.id_to_piece(i), i, min(ranks[i], last)) for i in usual],
        "bytes": [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], "last": last, "count": count}


class Vocabulary:
    """A trie over the pieces in flat tables, and the pieces' log weights and bytes."""

    def __init__(self, loaded: dict, power: float = 1.0):
        count = loaded["count"]
        self.weights = np.full(count, -np.inf)
        self.text: list[bytes] = [b""] * count
        children: list[dict[str, int]] = [{}]
        terminal = [-1]
        for piece, i, rank in loaded["pieces"]:
            self.weights[i] = -power * math.log(rank + 2)
            self.text[i] = piece.replace(SPACE, " ").encode("utf-8")
            node = 0
            for c in piece:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    terminal.append(-1)
                node = children[node][c]
            terminal[node] = i
        self.bytes = np.array(loaded["bytes"])
        for b, i in enumerate(loaded["bytes"]):
            self.weights[i], self.text[i] = -power * math.log(loaded["last"] + 2), bytes([b])
        self.weights -= np.logaddexp.reduce(self.weights)
        self.byte_weight = float(self.weights[self.bytes[0]])
        #: Characters whose total weight, four least pieces each, is a double without loss.
        self.near = int(600 / (4 * -min(self.byte_weight, float(self.weights[np.isfinite(self.weights)].min()))))
        self.terminal = np.array(terminal, np.int32)
        self.first = np.full(0x110000, -1, np.int32)
        for c, node in children[0].items():
            self.first[ord(c)] = node
        later = sorted({c for kids in children[1:] for c in kids})
        self.kind = np.zeros(0x110000, np.int16 if len(later) < 32_000 else np.int32)
        for n, c in enumerate(later, 1):
            self.kind[ord(c)] = n
        inner = [n for n, kids in enumerate(children) if kids and n]
        self.row = np.zeros(len(children), np.int32)
        self.table = np.full((len(inner) + 1, len(later) + 1), -1, np.int32)
        for r, n in enumerate(inner, 1):
            self.row[n] = r
            for c, kid in children[n].items():
                self.table[r, self.kind[ord(c)]] = kid
        names = [p for p, _, _ in loaded["pieces"]]
        spaced = not any(SPACE in p.lstrip(SPACE) for p in names)
        lines = not any("\n" in p for p in names)
        stop = "\n" if lines else ""
        self.chunks = re.compile(
            (r"\n|" if lines else "") + f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" if spaced else
            (r"\n|[^\n]+" if lines else r"(?s).+"))

    def fallback(self, code: int) -> np.ndarray:
        """Byte pieces of a character that has no piece of its own."""
        c = SPACE if chr(code) == LITERAL else chr(code)
        return self.bytes[list(c.encode("utf-8", "surrogatepass"))]

    def expand(self, pieces: np.ndarray) -> np.ndarray:
        """Ids of a path; negative entries are characters that fall back to bytes."""
        low = np.nonzero(pieces < 0)[0]
        if not len(low):
            return pieces
        parts, done = [], 0
        for i in low:
            parts += [pieces[done:i], self.fallback(-1 - int(pieces[i]))]
            done = i + 1
        return np.concatenate([*parts, pieces[done:]])

    def spell(self, ids) -> bytes:
        """The text of a sequence of ids in UTF-8."""
        return b"".join(map(self.text.__getitem__, ids))[1:]

    def decode(self, ids) -> str:
        """The text of a sequence of ids."""
        return self.spell(ids).decode("utf-8", "surrogatepass")


def marked(text: str) -> str:
    """The text as pieces spell it: spaces as space signs, and one before the start."""
    return SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE) if text else ""


class Lattice:
    """Lattices of many chunks side by side: nodes are places between characters, edges pieces."""

    def __init__(self, vocabulary: Vocabulary, chunks: list[str]):
        v = vocabulary
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(lengths)
        chunk = np.repeat(np.arange(len(chunks)), lengths)
        stop = ends[chunk]
        place, state, size, found = np.arange(len(codes)), v.first[codes], 1, []
        alone = np.ones(len(codes), bool)
        kinds = np.append(v.kind[codes], 0)
        kinds[ends - lengths] = 0  # no piece goes on into the next chunk
        while True:
            live = np.nonzero(state >= 0)[0]
            if not len(live):
                break
            place, state = place[live], state[live]
            piece = v.terminal[state]
            hit = np.nonzero(piece >= 0)[0]
            found.append((place[hit], np.full(len(hit), size), piece[hit]))
            if size == 1:
                alone[place[hit]] = False
            state = v.table[v.row[state], kinds[place + size]]
            size += 1
        other = np.nonzero(alone)[0]
        found.append((other, np.ones(len(other), np.int64), np.where(
            codes[other] < 128, v.bytes[np.minimum(codes[other], 127)], -1 - codes[other])))
        source, size, piece = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(source, kind="stable")
        source, size, self.piece = source[order], size[order], piece[order].astype(np.int32)
        self.source = (source + chunk[source]).astype(np.int32)
        self.target = (self.source + size).astype(np.int32)
        self.first = ends - lengths + np.arange(len(chunks))
        self.last = self.first + lengths
        nodes = len(codes) + len(chunks)
        weight = np.where(self.piece >= 0, v.weights[np.maximum(self.piece, 0)], 0.0)
        for code in np.unique(-1 - self.piece[self.piece < 0]):
            weight[self.piece == -1 - code] = v.byte_weight * len(v.fallback(int(code)))
        counts = np.bincount(self.source, minlength=nodes)
        self.begin = np.concatenate([[0], np.cumsum(counts)])
        # Backward sums, by distance to the chunk's end: all edges of a distance lead to smaller ones.
        back = np.ones(nodes)
        left = (stop - np.arange(len(codes)))[source]
        by = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(left))])
        from_, target, value = self.source[by], self.target[by], weight[by]
        starts = np.concatenate([[0], np.nonzero(np.diff(from_))[0] + 1]) if len(by) else by
        from_, turns = from_[starts], np.searchsorted(starts, cuts)
        # Near the end no sum can leave the range of doubles, so they need no logarithms.
        near = min(len(cuts) - 2, v.near)
        weigh = np.exp(value[:cuts[near + 1]])
        for d in range(1, len(cuts) - 1):
            low, high, some = cuts[d], cuts[d + 1], slice(turns[d], turns[d + 1])
            if d == near + 1:
                back = np.log(back)
            if low == high:
                continue
            begin = starts[some] - low
            if d <= near:
                back[from_[some]] = np.add.reduceat(weigh[low:high] * back[target[low:high]], begin)
                continue
            logs = value[low:high] + back[target[low:high]]
            top = np.maximum.reduceat(logs, begin)
            total = np.add.reduceat(np.exp(logs - np.repeat(top, np.diff(np.append(begin, high - low)))), begin)
            back[from_[some]] = top + np.log(total)
        if len(cuts) - 2 <= near:
            back = np.log(back)
        self.log = weight + back[self.target] - np.repeat(back, counts)
        self.log[self.begin[:-1][counts == 1]] = 0.0  # the only way on leaves no rest, however its sums were rounded
        self.share = np.exp(self.log)
        summed = np.cumsum(self.share)
        self.upto = summed - np.repeat(np.concatenate([[0.0], summed])[self.begin[:-1]], counts)
        self.upto[self.begin[1:] - 1] = 2.0  # a node's last edge takes what rounding leaves

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by its share."""
        edge = self.begin[node]
        over = np.nonzero(u >= self.upto[edge])[0]
        while len(over):
            edge[over] += 1
            over = over[u[over] >= self.upto[edge[over]]]
        return edge

    def walk(self, chunk: np.ndarray, base: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A path through each chunk: all edges in order, and how many each has."""
        node, end, who = self.first[chunk], self.last[chunk], np.arange(len(chunk))
        shift = place - node
        steps = []
        while len(who):
            edge = self.pick(node, uniform(at(base[who], shift[who] + node)))
            steps.append((who, edge))
            node = self.target[edge]
            going = node != end[who]
            who, node = who[going], node[going]
        many = np.zeros(len(chunk), np.int64)
        for who, _ in steps:
            many[who] += 1
        path, start = np.empty(int(many.sum()), np.int64), np.cumsum(many) - many
        for step, (who, edge) in enumerate(steps):
            path[start[who] + step] = edge
        return path, many


class Batch:
    """Texts that are sampled together; their chunks in one row, cut into windows."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str], window: int = WINDOW):
        self.vocabulary = vocabulary
        words, self.bounds = [], [0]
        for text in texts:
            words += vocabulary.chunks.findall(marked(text))
            self.bounds.append(len(words))
        if any(SPACE in text or "\0" in text for text in texts):  # only a dict keeps words with surrogates or zeros apart
            numbers: dict[str, int] = {}
            self.which = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
            self.different = np.array(list(numbers), dtype=object)
        else:
            self.which, self.different = pd.factorize(np.array(words, dtype=object))
        sizes = np.fromiter(map(len, self.different), np.int64, len(self.different))[self.which]
        ends = np.cumsum(sizes)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        starts = ends - sizes
        self.place = starts - starts[np.array(self.bounds)[self.row]] if len(words) else starts
        self.cuts = [0]
        while self.cuts[-1] < len(words):
            low = self.cuts[-1]
            self.cuts.append(max(low + 1, int(np.searchsorted(ends, starts[low] + window, side="right"))))
        self.held: tuple[int, Lattice, np.ndarray] | None = None

    def lattice(self, window: int) -> tuple[Lattice, np.ndarray]:
        """A window's lattices, and which of them each of its chunks has."""
        if self.held is None or self.held[0] != window:
            self.held = None
            if len(self.cuts) == 2:
                self.held = window, Lattice(self.vocabulary, list(self.different)), self.which
            else:
                own, which = np.unique(self.which[self.cuts[window]:self.cuts[window + 1]], return_inverse=True)
                self.held = window, Lattice(self.vocabulary, self.different[own].tolist()), which
        return self.held[1:]

    def walks(self, base: np.ndarray, first: np.ndarray):
        """One path of every text from its chunk ``first`` on: (edge, chunk, log share, share, piece) of all steps, and the texts' bounds."""
        parts = []
        for window, (low, high) in enumerate(zip(self.cuts, self.cuts[1:])):
            chunk = np.arange(low, high)
            chunk = chunk[chunk >= first[self.row[low:high]]]
            if not len(chunk):
                continue
            lattice, which = self.lattice(window)
            edge, many = lattice.walk(which[chunk - low], base[self.row[chunk]], self.place[chunk])
            parts.append((edge, np.repeat(chunk, many), lattice.log[edge], lattice.share[edge], lattice.piece[edge]))
        steps = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
        return steps, np.searchsorted(steps[1], self.bounds)

    def other(self, chunk: int, node_edge: int, used: list[int], u: float, base: int):
        """Another edge at the node of ``node_edge`` and a walk on to the chunk's end; what is left of the node's share."""
        window = bisect.bisect_right(self.cuts, chunk) - 1
        lattice, which = self.lattice(window)
        low, high = lattice.begin[lattice.source[node_edge]], lattice.begin[lattice.source[node_edge] + 1]
        free = [e for e in range(low, high) if e not in used]
        shares = np.cumsum(lattice.share[free])
        edge = free[min(int(np.searchsorted(shares, u * shares[-1], side="right")), len(free) - 1)]
        path, c = [edge], which[chunk - self.cuts[window]]
        shift, node, last = int(self.place[chunk] - lattice.first[c]), int(lattice.target[edge]), int(lattice.last[c])
        while node != last:
            draw, step = one_uniform(base + (shift + node + 1) * int(GOLDEN)), int(lattice.begin[node])
            while draw >= lattice.upto[step]:
                step += 1
            path.append(step)
            node = int(lattice.target[step])
        rest = [e for e in free if e != edge]
        left = float(np.logaddexp.reduce(lattice.log[rest])) if rest else -math.inf
        return np.array(path), lattice.log[path], lattice.share[path], lattice.piece[path], left


def _below(limit: float, place, u):
    """A Gumbel variable at ``place`` (a log weight), given that it is below ``limit``."""
    return -np.logaddexp(-limit, np.log(-np.log(u)) - place)


def sample_batch(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, k: int, seed: int = SEED,
                 window: int = WINDOW) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its k segmentations: (ids, log probability, noisy log probability, log inclusion)."""
    batch = Batch(vocabulary, texts, window)
    roots = -np.log(-np.log(uniform(stream(keys, seed, 0, 0))))
    done: list[list] = [[] for _ in texts]
    heaps: list[list] = [[] for _ in texts]

    rests = [stream(keys, seed, 1, number) for number in range(k)]
    turns = [uniform(at(stream(keys, seed, kind, 0)[:, None], np.arange(k)[None, :])) for kind in (3, 4)]

    def leave_rests(paths: list[tuple], number: int):
        """Queue the best rests along the steps of paths: (row, path, first step, limit).

        A draw lies at most ``NOISE`` above its place, and places fall along the
        path; so the steps after the first ones matter only if the k best rests
        of those don't yet lie higher than that. The steps of all paths are drawn together.
        """
        highs: list = [None] * len(paths)
        todo = [(i, start, min(len(path[2]), start + FIRST)) for i, (_, path, start, _) in enumerate(paths)]
        while todo:
            many = np.array([end - begin for _, begin, end in todo])
            upto = np.cumsum(many)
            step = np.arange(upto[-1]) + np.repeat(np.array([begin for _, begin, _ in todo]) - (upto - many), many)
            base = np.repeat(rests[number][[paths[i][0] for i, _, _ in todo]], many)
            limit = np.repeat(np.array([paths[i][3] for i, _, _ in todo]), many)
            total = np.concatenate([paths[i][1][5][begin:end] for i, begin, end in todo])
            share = np.concatenate([paths[i][1][3][begin:end] for i, begin, end in todo])
            with np.errstate(divide="ignore"):
                drawn = _below(limit, total + np.log1p(-np.minimum(share, 1.0)), uniform(at(base, step)))
            again = []
            for (i, _, end), part in zip(todo, np.split(drawn, upto[:-1])):
                high = highs[i] = part if highs[i] is None else np.concatenate([highs[i], part])
                _, path, start, _ = paths[i]
                if end == len(path[2]):
                    continue
                kth = np.partition(high, -k)[-k] if len(high) >= k else -math.inf
                if not path[5][end] + NOISE < kth:
                    again.append((i, end, min(len(path[2]), start + 4 * (end - start))))
            todo = again
        for (row, path, start, _), high in zip(paths, highs):
            few = np.argpartition(-high, k)[:k] if len(high) > k else np.arange(len(high))
            for i in few[np.isfinite(high[few])]:
                heapq.heappush(heaps[row], (-float(high[i]), number, int(start + i), [int(path[0][start + i])]))

    for number in range(k):
        base = stream(keys, seed, 2, number)
        first = np.zeros(len(texts), np.int64)
        if number:  # a path is walked behind the chunk where it leaves the one before; a text without rests has none
            for row, heap in enumerate(heaps):
                first[row] = done[row][heap[0][1]][0][1][heap[0][2]] + 1 if heap else batch.bounds[-1]
        (edge, chunk, log, share, piece), bounds = batch.walks(base, first)
        paths = []
        for row in range(len(texts)):
            low, high = bounds[row], bounds[row + 1]
            fresh = [x[low:high] for x in (edge, chunk, log, share, piece)]
            if number == 0:
                path, start, limit = fresh, 0, float(roots[row])
            else:
                if not heaps[row]:
                    continue
                top, origin, start, used = heapq.heappop(heaps[row])
                old, limit = done[row][origin][0], -top
                here = int(old[1][start])
                walk, logs, shares, ids, left = batch.other(
                    here, int(old[0][start]), used, float(turns[0][row, number]), int(base[row]))
                if left > -math.inf:
                    rest = float(_below(limit, float(old[5][start]) + left, float(turns[1][row, number])))
                    if math.isfinite(rest):
                        heapq.heappush(heaps[row], (-rest, origin, start, [*used, int(walk[0])]))
                new = (walk, np.full(len(walk), here), logs, shares, ids)
                path = [np.concatenate([a[:start], b, c]) for a, b, c in zip(old, new, fresh)]
            path.append(np.concatenate([[0.0], np.cumsum(path[2])]))
            begin = start if number == 0 else start + 1
            paths.append((row, path, begin, limit))
            done[row].append((path, limit))
        leave_rests(paths, number)
    results = []
    for row in range(len(texts)):
        threshold = -heaps[row][0][0] if heaps[row] else -math.inf
        found = []
        for path, noisy in done[row]:
            log = float(path[5][-1])
            over = log - threshold
            inclusion = 0.0 if over > 30 else over if over < -30 else math.log(-math.expm1(-math.exp(over)))
            found.append((vocabulary.expand(path[4]), log, noisy, inclusion))
        results.append(found)
    return results


def fitting(sizes: list[int], window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of texts that fill one window each, with the space sign before every text; a longer text is alone."""
    low = held = 0
    for i, size in enumerate(sizes):
        if i > low and held + size + 1 > window:
            yield low, i
            low = i
            held = 0
        held += size + 1
    if sizes:
        yield low, len(sizes)


RESULT = ("doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, "
          "log_inclusion double, round_trip boolean")


def sample_segmentations(docs: DataFrame, k: int = 2, model: str = MODEL, seed: int = SEED, power: float = 1.0,
                         with_ids: bool = True, window: int = WINDOW) -> DataFrame:
    """k different segmentations of every text: a row for each, numbered from 1 by falling noise.

    Columns: doc_id, sample, n_pieces, ids_crc32 (of the ids as little-endian 32-bit
    numbers), log_prob, perturbed, log_inclusion, round_trip (whether decoding gives
    the text back), and the ids themselves unless they aren't wanted. ``window`` is the
    number of characters whose lattices a worker holds at once; results don't depend on it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(model))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for batch in batches:
            if vocabulary is None:
                vocabulary = Vocabulary(sent.value, power)
            ids, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64), batch.column(2)
            for low, high in fitting(pa.compute.utf8_length(texts).fill_null(0).to_pylist(), window):
                own = [t or "" for t in texts[low:high].to_pylist()]
                rows, paths = [], []
                for doc_id, text, found in zip(ids[low:high], own, sample_batch(vocabulary, own, keys[low:high], k, seed, window)):
                    data = text.encode("utf-8", "surrogatepass")
                    for number, (pieces, log, noisy, inclusion) in enumerate(found, 1):
                        listed = pieces.tolist()
                        row = (doc_id, number, len(listed), zlib.crc32(pieces.astype("<u4").tobytes()), log, noisy,
                               inclusion, vocabulary.spell(listed) == data)
                        rows.append(row)
                        paths.append(pieces)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(paths).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [c.split()[0] for c in RESULT.split(", ")] + (["ids"] if with_ids else [])
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("key"), "text")
    return keyed.mapInArrow(sample, RESULT + (", ids array<int>" if with_ids else ""))
