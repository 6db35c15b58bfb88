"""SimHash near-dedup over blocks of bits or vantage-point trees.

Each document has four 64-bit fingerprints: two SimHashes of its words by frequency and two of its
set of words. Two documents are near copies if, in one of the first two, at most RADIUS bits differ,
and in the 128 bits of the set at most SET_RADIUS.

Pairs are found exactly, by one of two searches. Up to BLOCK_RADIUS it goes by the sets, in which
unlike texts differ most: fingerprints that near must agree in one of some pieces of their bits and
all but agree round it, so each is sent to a shard for each piece, and compared within it with those
that all but agree (see Piece). The rows sent are SET_RADIUS + 1 for each fingerprint, however many.

With a greater set_radius pieces are too short to tell texts apart, and it goes by the first two
fingerprints. The top of a vantage-point tree, built on the driver over a bounded sample, splits the space of fingerprints by Hamming distance into shards; each fingerprint lives in one
shard and is sent as a query to each later shard that its ball of RADIUS overlaps, by the triangle
bound |d(q, v) - r|. Which vantage points are drawn changes the balance of the shards and nothing
else. The number of shards follows from the memory of a task, as rows sent grow with it (see Plan). A shard builds its own tree over what lives there, streams the queries past it and prunes
branches by the same bound. Pairs join documents into groups, of which the least doc_id stays.

Equal fingerprints are one point, so thousands of copies cost as one. A shard reports a spanning
forest of its pairs and not all of them: the groups are the same, and a group of m documents gives
fewer than m edges for each shard it lies in.

Cases: words are runs of letters and digits in any script, without regard to case in Latin scripts;
a run of over LONG_WORD bytes counts by its overlapping triples of characters. Null texts, texts
without any word, and documents without doc_id are compared with nothing and stay. Texts are taken
whole. A doc_id may be of any type with an order. Rows are grouped by their texts, also where they share a doc_id: `near_copies` names a doc_id
if one of its rows goes, and `drop_near_copies` drops just that row. A row whose doc_id is the least
of its group stays, so repeated rows do. On a tie in a bit of the SimHash the bit is 0. An empty table gives an
empty result. Only the named columns are read; `drop_near_copies` passes all columns on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, named, store, text_chunks
from .kernels import Texts, hashes, mix, runs, split_long

RADIUS = 8
SET_RADIUS = 24
LONG_WORD = 64
#: Fingerprints drawn to place the vantage points of the shared top of the tree.
SAMPLE = 20_000
#: Least number of shards; points that a shard's tree may hold (some 100 bytes each); rows that one task may ask it about.
SHARDS, SHARD_POINTS, TASK_ROWS = 24, 2_000_000, 4_000_000
LEAF = 128
#: Greatest set_radius for the search by pieces; bits of a piece that name its shard, at most; rows of a task, about; points that are compared with their neighbours at a time, about.
BLOCK_RADIUS, PIECE_BITS, PIECE_ROWS, BUCKET = 31, 6, 200_000, 48

_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("A") : ord("Z") + 1] = _WORD[ord("a") : ord("z") + 1] = True
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _lowered(data: np.ndarray) -> np.ndarray:
    """ASCII letters and the letters of the Latin-1 block in lower case."""
    low = _LOWER[data]
    if len(low):
        after = np.zeros(len(low), dtype=bool)
        after[1:] = low[:-1] == 0xC3
        low[after & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)] += 32
    return low


def _majority(features: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """SimHash of each run of features.

    Bits are counted eight to a word, each in a byte of its own, over stretches that a byte can count.
    """
    stretches = -(-count // 255)
    at = np.cumsum(stretches) - stretches
    first = np.repeat(start - at * 255, stretches) + np.arange(stretches.sum()) * 255
    ones, one = np.empty((len(first), 8, 8), np.uint8), np.empty_like(features)
    for k in range(8):
        np.right_shift(features, np.uint64(k), out=one)
        np.bitwise_and(one, np.uint64(0x0101010101010101), out=one)
        ones[:, :, 7 - k] = np.add.reduceat(one, first).view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(ones.reshape(-1, 64), at, axis=0, dtype=np.int32)
    return np.packbits(total * 2 > count[:, None], axis=1).view(np.uint64).ravel()


def fingerprints(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have words, their fingerprints as rows of four)."""
    data = _lowered(texts.data)
    w, joined = split_long(texts, runs(texts, _WORD[data]), LONG_WORD)
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros((0, 4), np.uint64)
    h = hashes(data, w)
    with np.errstate(over="ignore"):
        if joined.any():
            third = joined & np.append(joined[1:], False)
            h[third] = mix(h[third] + np.uint64(3) * np.roll(h, -1)[third] + np.uint64(7) * np.roll(h, -2)[third])
        start = np.flatnonzero(np.append(True, w.doc[1:] != w.doc[:-1]))
        doc, count = w.doc[start], np.diff(np.append(start, len(w.doc)))
        low = np.uint64((1 << 44) - 1)
        own = np.sort((np.searchsorted(doc, w.doc).astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        own = own[np.append(True, own[1:] != own[:-1])]
        of = own >> np.uint64(44)
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        distinct = np.diff(np.append(first, len(own)))
        word = mix((own & low) + np.uint64(1))
        columns = [
            _majority(h, start, count),
            _majority(mix(h + np.uint64(0x9E3779B97F4A7C15)), start, count),
            _majority(word, first, distinct),
            _majority(mix(word + np.uint64(0x9E3779B97F4A7C15)), first, distinct),
        ]
    return doc, np.stack(columns, axis=1)


class Tree:
    """A vantage-point tree over fingerprints, searched by many queries at once."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.compared = 0
        self.nodes: list[tuple] = []
        self._rng = np.random.default_rng(7)
        self.root = self._build(np.arange(len(points)))

    def _build(self, own: np.ndarray) -> int:
        """Nodes are (points) or (vantage point, radius, inner node, outer node)."""
        if len(own) > self.leaf:
            tries = self._rng.choice(own, size=min(4, len(own)), replace=False)
            some = own if len(own) <= 512 else self._rng.choice(own, size=512, replace=False)
            spread = [np.bitwise_count(self.points[some] ^ self.points[v]).astype(np.int64).var() for v in tries]
            vantage = self.points[tries[int(np.argmax(spread))]]
            d = np.bitwise_count(self.points[own] ^ vantage)
            radius = int(np.median(d))
            inner = d <= radius
            if inner.all():
                radius = int(d.max()) - 1
                inner = d <= radius
            if inner.any():
                left, right = self._build(own[inner]), self._build(own[~inner])
                self.nodes.append((vantage, radius, left, right))
                return len(self.nodes) - 1
        self.nodes.append((own,))
        return len(self.nodes) - 1

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (query, point) indices at a distance of at most radius, in parts."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            at, q = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                for i in range(0, len(q), 512):
                    part = q[i : i + 512]
                    near = np.bitwise_count(queries[part, None] ^ self.points[node[0]][None, :]) <= radius
                    self.compared += near.size
                    x, y = np.nonzero(near)
                    if len(x):
                        yield part[x], node[0][y]
                continue
            d = np.bitwise_count(queries[q] ^ node[0]).astype(np.int16)
            self.compared += len(q)
            for side, child in ((d <= node[1] + radius, node[2]), (d > node[1] - radius, node[3])):
                if side.any():
                    todo.append((child, q[side]))


class Shards:
    """The top of a tree: which shards a fingerprint may have partners in."""

    def __init__(self, sample: np.ndarray, count: int):
        tree = Tree(sample, leaf=max(1, len(sample) // count))
        self.nodes, self.root = tree.nodes, tree.root
        leaves = [i for i, node in enumerate(self.nodes) if len(node) == 1]
        self.number = {at: k for k, at in enumerate(leaves)}
        self.nodes = [node if len(node) > 1 else () for node in self.nodes]

    def __len__(self) -> int:
        return len(self.number)

    def spread(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, shard, 1 if it goes there as a query): its home, and the later shards within radius."""
        index, shard, home = [], [], np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), dtype=bool))]
        while todo:
            at, q, inside = todo.pop()
            if at in self.number:
                home[q[inside]] = self.number[at]
                index.append(q)
                shard.append(np.full(len(q), self.number[at]))
                continue
            vantage, r, left, right = self.nodes[at]
            d = np.bitwise_count(points[q] ^ vantage).astype(np.int16)
            for side, child, own in ((d <= r + radius, left, d <= r), (d > r - radius, right, d > r)):
                if side.any():
                    todo.append((child, q[side], (inside & own)[side]))
        i, s = np.concatenate(index), np.concatenate(shard)
        keep = s >= home[i]
        i, s = i[keep], s[keep]
        return i, s, (s > home[i]).astype(np.int8)


class Plan:
    """Which tasks the search is split into: shards of one tree over a fingerprint, each in slices by what is asked.

    How many rows a point is sent as grows with the number of shards, so that follows from the memory
    of a task alone: at least `shards`, and more only where a shard would hold over SHARD_POINTS. A
    shard that many rows are sent to has several slices: each holds all its points, and answers for
    its share of what is asked.
    """

    def __init__(self, sample: np.ndarray, total: int, radius: int, shards: int = SHARDS, first: int = 0):
        sample = np.unique(sample)
        self.shards = Shards(sample, max(shards, -(-total // SHARD_POINTS)))
        i, s, _ = self.shards.spread(sample, radius)
        self.sent = len(i) / max(1, len(sample))
        rows = np.bincount(s, minlength=len(self.shards)) * (total / max(1, len(sample)))
        self.slices = np.maximum(1, np.ceil(rows / TASK_ROWS)).astype(np.int64)
        self.first = first + np.concatenate(([0], np.cumsum(self.slices)[:-1]))
        self.end = first + int(self.slices.sum())

    def place(self, points: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, task, 1 if it only asks there)."""
        i, s, asks = self.shards.spread(points, radius)
        own = np.flatnonzero(asks == 0)
        times = self.slices[s[own]]
        slot = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        other = np.flatnonzero(asks)
        task = np.concatenate((self.first[np.repeat(s[own], times)] + slot, self.first[s[other]] + node[i[other]] % self.slices[s[other]]))
        return np.concatenate((np.repeat(i[own], times), i[other])), task, np.concatenate((np.zeros(len(slot), np.int8), np.ones(len(other), np.int8)))

    def slice_of(self) -> list[tuple[int, int]]:
        """(slice, slices of its shard) of each task."""
        return [(k, int(n)) for n in self.slices for k in range(n)]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, as the least index of each group, with a and b joined in pairs."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while not (label == (up := label[label])).all():
            label = up


class Search:
    """The search within one slice of a shard: points first, then queries in batches; edges of a spanning forest."""

    def __init__(self, rows: np.ndarray, sets: np.ndarray, node: np.ndarray, radius: int, set_radius: int, part: tuple[int, int] = (0, 1)):
        self.sets, self.node, self.radius, self.set_radius = sets, node, radius, set_radius
        self.tree = Tree(rows)
        self.label = np.arange(len(rows))
        own = np.flatnonzero(node % part[1] == part[0])  # the other slices ask for the others
        for a, b in self._near(rows[own], sets[own], own):
            self.label = _joined(self.label, a, b)

    def _near(self, rows: np.ndarray, sets: np.ndarray, own: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs near in both fingerprints; if own says which points the rows are, as points and only those not joined yet."""
        for first in range(0, len(rows), 1 << 16):
            for at, b in self.tree.within(rows[first : first + (1 << 16)], self.radius):
                at = at + first
                a = at
                if own is not None:
                    a = own[at]
                    apart = self.label[a] != self.label[b]
                    at, a, b = at[apart], a[apart], b[apart]
                if len(a):
                    near = np.bitwise_count(sets[at] ^ self.sets[b]).sum(axis=1, dtype=np.int64) <= self.set_radius
                    if near.any():
                        yield a[near], b[near]

    def query(self, rows: np.ndarray, sets: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An edge for each query that has a partner here."""
        one = np.full(len(rows), -1, dtype=np.int64)
        for a, b in self._near(rows, sets, None):
            fresh = one[a] < 0
            one[a[fresh]] = b[fresh]
            self.label = _joined(self.label, one[a], b)
        found = np.flatnonzero(one >= 0)
        return node[found], self.node[one[found]]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.node[own], self.node[self.label[own]]


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, set fingerprints and nodes of a batch."""
    get = lambda name: b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
    return get("f").view(np.uint64), np.stack([get("s0"), get("s1")], axis=1).view(np.uint64), get("node")


def _search(batches: Iterator[pa.RecordBatch], radius: int, set_radius: int, slices: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """One partition: for each task in it its points, then its queries."""
    batch = lambda e: pa.RecordBatch.from_arrays([pa.array(e[0], pa.int64()), pa.array(e[1], pa.int64())], ["a", "b"])
    task, points, search = None, [], None

    def begin() -> Search:
        return Search(*[np.concatenate(x) for x in zip(*points)], radius, set_radius, slices[task])

    for whole in batches:
        kind = whole.column(0).to_numpy() * 2 + whole.column(1).to_numpy()
        borders = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])).tolist() + [len(kind)]
        for i, j in zip(borders, borders[1:]):
            at, asks = divmod(int(kind[i]), 2)
            if at != task:
                if points or search:
                    yield batch((search or begin()).edges())
                task, points, search = at, [], None
            part = _columns(whole.slice(i, j - i))
            if not asks:
                points.append(part)
            elif points or search:
                if search is None:
                    search, points = begin(), []
                yield batch(search.query(*part))
    if points or search:
        yield batch((search or begin()).edges())

class Piece:
    """A piece of the bits of one half of the set fingerprints, in a block of pieces side by side.

    Fingerprints within set_radius differ by at most set_radius // 2 bits in the first half, or by
    fewer than the other set_radius - set_radius // 2 in the second. A half that differs by at most n bits is cut into n + 1
    pieces, and those into blocks: one block has fewer differing bits than pieces, and so a piece
    without any. Whoever shares a piece meets in its shard; there only those are compared whose other
    bits of the block differ by at most `errors`.
    """

    def __init__(self, half: int, most: int, block: tuple[int, int], low: int, high: int, errors: int, first: int):
        self.half, self.most, self.errors, self.first = half, most, errors, first
        self.block, self.low, self.bits = block, low, min(high - low, PIECE_BITS)
        self.end = first + (1 << self.bits)
        self.rest = block[1] - block[0] - self.bits

    def shard(self, half: np.ndarray) -> np.ndarray:
        return self.first + ((half >> np.uint64(self.low)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def others(self, half: np.ndarray, bits: int) -> np.ndarray:
        """The lowest bits of the block without those of the shard."""
        below = self.low - self.block[0]
        under = (half >> np.uint64(self.block[0])) & np.uint64((1 << below) - 1)
        above = (half >> np.uint64(self.low + self.bits - 1) >> np.uint64(1)) << np.uint64(below) if below < 64 else np.uint64(0)
        return ((under | above) & np.uint64((1 << bits) - 1)).astype(np.int64)


def pieces(set_radius: int) -> list[Piece]:
    found: list[Piece] = []
    for half, most in enumerate((set_radius // 2, set_radius - 1 - set_radius // 2)):
        n = most + 1
        sizes = [3] * (n // 3) + [n % 3] * (n % 3 > 0)
        if n > 3 and n % 3 == 1:
            sizes[-2:] = [4]
        at = 0
        for size in sizes:
            cuts = [64 * k // n for k in range(at, at + size + 1)]
            for low, high in zip(cuts, cuts[1:]):
                found.append(Piece(half, most, (cuts[0], cuts[-1]), low, high, size - 1, found[-1].end if found else 0))
            at += size
    return found


class PieceSearch:
    """The search within one shard of a piece: edges of a spanning forest."""

    def __init__(self, piece: Piece, tops: np.ndarray, sets: np.ndarray, node: np.ndarray, radius: int, set_radius: int):
        n = len(node)
        bits = min(piece.rest, max(0, int(np.log2(max(1, n) / BUCKET))))
        self.bits = bits if bits > piece.errors else 0
        key = piece.others(sets[piece.half], self.bits)
        order = np.argsort(key, kind="stable")
        self.tops, self.sets, self.node = tops[:, order], sets[:, order], node[order]
        self.radius, self.set_radius, self.compared = radius, set_radius, 0
        self.label = np.arange(n)
        self._found: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0
        self._compare(piece, np.bincount(key, minlength=1 << self.bits))
        self._join()

    def _compare(self, piece: Piece, count: np.ndarray) -> None:
        half, start = self.sets[piece.half], np.concatenate(([0], np.cumsum(count)))
        signs = np.arange(1, 1 << self.bits)
        signs = signs[np.bitwise_count(signs) <= piece.errors]
        x, k, at = np.empty(1 << 16, np.uint64), np.empty(1 << 16, np.uint8), np.zeros(1 << 16, bool)
        eights, each = at.view(np.uint64), np.arange(8)
        held, waiting = [], 0
        for own in np.flatnonzero(count).tolist():
            first, last = int(start[own]), int(start[own + 1])
            by = own ^ signs
            by = by[by > own]  # a pair of buckets meets once
            by = by[count[by] > 0]
            many = count[by]
            other = np.arange(first, last + int(many.sum()))
            other[last - first :] += np.repeat(start[by] - last - np.cumsum(many) + many, many)
            theirs = half[other]
            for p in range(0, len(other), 1 << 16):
                part, places = theirs[p : p + (1 << 16)], other[p : p + (1 << 16)]
                step = max(1, (1 << 16) // len(part))
                for i in range(first, last, step):
                    j = min(last, i + step)
                    size = (j - i) * len(part)
                    np.bitwise_xor(half[i:j, None], part[None, :], out=x[:size].reshape(j - i, -1))
                    np.bitwise_count(x[:size], out=k[:size])
                    np.less_equal(k[:size], piece.most, out=at[:size])
                    at[size : -(-size // 8) * 8] = False
                    self.compared += size
                    some = np.flatnonzero(eights[: -(-size // 8)])
                    if not len(some):
                        continue
                    near = (some[:, None] * 8 + each).ravel()
                    a, b = np.divmod(near[at[near]], len(part))
                    held.append((a + i, places[b]))
                    waiting += len(a)
                    if waiting > 1 << 14:
                        self._take(*map(np.concatenate, zip(*held)))
                        held, waiting = [], 0
        if held:
            self._take(*map(np.concatenate, zip(*held)))

    def _take(self, a: np.ndarray, b: np.ndarray) -> None:
        fresh = (a < b) & (self.label[a] != self.label[b])
        a, b = a[fresh], b[fresh]
        if not len(a):
            return
        near = np.bitwise_count(self.sets[:, a] ^ self.sets[:, b]).sum(axis=0, dtype=np.int64) <= self.set_radius
        near &= (np.bitwise_count(self.tops[:, a] ^ self.tops[:, b]) <= self.radius).any(axis=0)
        if near.any():
            self._found.append((a[near], b[near]))
            self._size += int(near.sum())
            if self._size > 1 << 14:
                self._join()

    def _join(self) -> None:
        if self._found:
            self.label = _joined(self.label, *map(np.concatenate, zip(*self._found)))
            self._found, self._size = [], 0

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.node[own], self.node[self.label[own]]


def _by_pieces(points: DataFrame, total: int, radius: int, set_radius: int, shards: int) -> DataFrame:
    own = pieces(set_radius)
    tasks = max(shards, -(-total * len(own) // PIECE_ROWS))
    of_shard = np.repeat(np.arange(len(own)), [p.end - p.first for p in own])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            halves = [b.column(k).to_numpy().view(np.uint64) for k in (3, 4)]
            for p in own:
                shard = p.shard(halves[p.half])
                yield pa.RecordBatch.from_arrays([pa.array(shard % tasks, pa.int32()), pa.array(shard, pa.int32()), *b.columns], ["task", "shard", "node", "t0", "t1", "s0", "s1"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns[1:]] for b in batches if b.num_rows]
        if not held:
            return
        shard, node, *prints = (np.concatenate(x) for x in zip(*held))
        del held
        order = np.argsort(shard, kind="stable")
        borders = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1)).tolist()
        for i, j in zip(borders, borders[1:]):
            at = order[i:j]
            t0, t1, s0, s1 = (x[at].view(np.uint64) for x in prints)
            a, b = PieceSearch(own[of_shard[shard[at[0]]]], np.stack([t0, t1]), np.stack([s0, s1]), node[at], radius, set_radius).edges()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sent = points.select("node", "t0", "t1", "s0", "s1").mapInArrow(spread, "task int, shard int, node bigint, t0 bigint, t1 bigint, s0 bigint, s1 bigint")
    return sent.repartitionById(tasks, F.col("task")).mapInArrow(search, "a bigint, b bigint")


def near_edges(points: DataFrame, radius: int = RADIUS, set_radius: int = SET_RADIUS, shards: int = SHARDS) -> DataFrame:
    """(a, b): edges that join the near copies among points (node, t0, t1, s0, s1)."""
    total = points.count()
    if not total:
        return points.select(F.col("node").alias("a"), F.col("node").alias("b"))
    if set_radius <= BLOCK_RADIUS:
        return _by_pieces(points, total, radius, set_radius, shards)
    sample = points.select("t0", "t1").sample(min(1.0, 1.5 * SAMPLE / total), 11).limit(SAMPLE).toPandas()
    if not len(sample):
        sample = points.select("t0", "t1").limit(SAMPLE).toPandas()
    one = Plan(sample["t0"].to_numpy().view(np.uint64), total, radius, shards)
    plans = [one, Plan(sample["t1"].to_numpy().view(np.uint64), total, radius, shards, one.end)]
    slices = [x for plan in plans for x in plan.slice_of()]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                for t, plan in enumerate(plans):
                    f = b.column(1 + t)
                    i, task, asks = plan.place(f.to_numpy().view(np.uint64), b.column(0).to_numpy(), radius)
                    pick = pa.array(i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(task, pa.int32()), pa.array(asks, pa.int8()), b.column(0).take(pick), f.take(pick), b.column(3).take(pick), b.column(4).take(pick)],
                        ["task", "asks", "node", "f", "s0", "s1"],
                    )

    sent = points.select("node", "t0", "t1", "s0", "s1").mapInArrow(spread, "task int, asks tinyint, node bigint, f bigint, s0 bigint, s1 bigint")
    placed = sent.repartitionById(len(slices), F.col("task")).sortWithinPartitions("task", "asks")
    return placed.mapInArrow(lambda batches: _search(batches, radius, set_radius, slices), "a bigint, b bigint")


def groups_of(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of an undirected graph but the roots, the least node of its component.

    Large-star and small-star steps in turn, until they change nothing.
    """
    star = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(star)
    while before[0]:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        star = cut(small.select("e.u", "e.v").where("u != v").distinct())
        after = mark(star)
        if after == before:
            break
        before = after
    return star.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _gone(df: DataFrame, id_col: str, text_col: str, radius: int, set_radius: int, shards: int) -> DataFrame:
    """(id, digest, duplicate_of): for each row that goes its doc_id, the digest of its text, and the doc_id that stays."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            doc, f = fingerprints(Texts.of(b.column(1)))
            pick = pa.array(doc)
            signed = [pa.array(f[:, k].view(np.int64)) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(2).take(pick), *signed], ["id", "digest", "t0", "t1", "s0", "s1"])

    rows = df.select(named(id_col).alias("id"), named(text_col).alias("text"), F.xxhash64(named(text_col)).alias("digest")).where("id IS NOT NULL AND text IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    prints = store(rows.mapInArrow(sign, f"id {kind}, digest bigint, t0 bigint, t1 bigint, s0 bigint, s1 bigint"))
    key = ["t0", "t1", "s0", "s1"]
    points = cut(prints.groupBy(key).agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    root = groups_of(near_edges(points, radius, set_radius, shards))
    member = root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
    first = member.join(points.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("first"))
    known = points.join(member.join(first, "root").select("node", "first"), "node", "left").select(*key, F.coalesce("first", "least").alias("duplicate_of"))
    return prints.join(known, key).select("id", "digest", "duplicate_of").where("id != duplicate_of")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, set_radius: int = SET_RADIUS, shards: int = SHARDS) -> DataFrame:
    """(doc_id, duplicate_of) for each document that goes, with the one of its group that stays."""
    gone = _gone(df, id_col, text_col, radius, set_radius, shards)
    return gone.groupBy(F.col("id").alias("doc_id")).agg(F.min("duplicate_of").alias("duplicate_of"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, set_radius: int = SET_RADIUS) -> DataFrame:
    """The rows of df that stay, with its columns."""
    gone = _gone(df, id_col, text_col, radius, set_radius, SHARDS).select(F.col("id").alias("__gone"), F.col("digest").alias("__text"))
    rows = df.select(F.struct(*map(named, df.columns)).alias("row"))  # in a struct no name can clash
    text = F.col("row").getField(text_col)
    return rows.join(gone, (F.col("row").getField(id_col) == F.col("__gone")) & (F.xxhash64(text) == F.col("__text")), "left_anti").select("row.*")
