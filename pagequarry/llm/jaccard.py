"""Near-duplicate classes by an exact Jaccard join of word shingles, with count vectors.

Two sets with a similarity of 3/4 share one of the first n / 4 + 1 shingles of each in any common
order, so only documents under one such shingle are compared; shingles that many documents have
come last in that order. Linked sets are of similar size: sizes are cut into bands, and only sets of
one band or of two neighbouring bands are compared. Shingles are also hashed into groups, and the
counts per group are a point; the overlap of two sets is at most the sum of the smaller counts.
Documents under a shingle are first held against the one before them and the first of their band,
which joins groups of copies in linear work. Where a shingle still holds several classes, an R-tree
of the points finds the pairs that are left: its boxes keep the greatest counts and the smallest
set, which bounds the overlap with everything inside; a few documents are compared without a tree.
Shingles that belong to one large class are searched together, not one by one. Every surviving pair is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.components import components
from pagequarry.llm.filters import filter_words, known_to, place_of
from pagequarry.llm.words import chunks, expand, find_words, mixed, releasing, shingles, text_buffer
from pagequarry.session import materialise

SHINGLE = 5
# 100 * intersection >= PERCENT * union makes a link.
PERCENT = 75
# A shingle in this share of the documents, and in so many, is common: it comes late in the order of
# shingles, and is known to all tasks. Of more than MOST_COMMON such shingles the rarer ones count as
# rare. What is not common meets under one key in as many documents as it has.
COMMON_SHARE = 1e-6
LEAST_COMMON, MOST_COMMON = 16, 1 << 20
# Shingles a task counts at a time, and the count from which it passes one on. The counts only
# choose the order, so small ones may be lost.
COUNTED, LEAST_COUNT = 1 << 22, 3
# Dimensions of the tree, rows of a leaf, leaves under a node.
DIMENSIONS, LEAF, FANOUT = 32, 32, 16
# Groups of the smallest sets.
LEAST_GROUPS = 256
# The high bits of a node are the band of its size, the others a hash.
HASH_BITS, BANDS = 57, 63
# A count that did not fit.
UNBOUNDED = 1 << 40
# Bytes of texts whose shingles are held at a time.
TEXT_BYTES = 1 << 20
# Rows of one class that are searched in one task, and the rows of a cell that needs no tree.
BLOCK, FEW = 4096, 64
# Places of a filter of common shingles, by the high bits of their hashes.
KNOWN_BITS = 22
# Counts that are compared at a time.
COMPARED = 1 << 20
# Prefix keys that a task sends at a time, and about how many a task receives.
KEYS = 1 << 20


class Sets(NamedTuple):
    """The sorted distinct shingles of several texts, one after another, and the first of each text."""

    values: np.ndarray
    firsts: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.firsts)

    def take(self, rows: np.ndarray) -> Sets:
        sizes = self.sizes[rows]
        return Sets(self.values[expand(self.firsts[rows], sizes)[1]], np.append(0, np.cumsum(sizes)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Sets:
    """The shingles of every text; one for all words where these are too few."""
    words = find_words(data, offsets, lower=True)
    counts = np.diff(words.firsts)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    firsts = np.append(0, np.cumsum(sizes))
    every = np.append(shingles(words.hashes, SHINGLE), np.zeros(min(SHINGLE - 1, len(words.hashes)), np.uint64))
    values = every[expand(words.firsts[:-1], sizes)[1]]
    for n in np.flatnonzero((counts > 0) & (counts < SHINGLE)).tolist():
        values[firsts[n]] = shingles(words.hashes[words.firsts[n] : words.firsts[n + 1]], int(counts[n]))[0]
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[firsts[:-1][sizes > 0]] = True
    return Sets(values[fresh], np.append(0, np.cumsum(fresh))[firsts])


@cache
def band_edges() -> np.ndarray:
    """The least size of every band; a set that links with one of a band is at most one band away."""
    edges = [1]
    while len(edges) < BANDS:
        edges.append(100 * edges[-1] // PERCENT + 1)
    return np.array(edges)


def signatures(sets: Sets) -> np.ndarray:
    """The band of each set's size, and under it a hash of the set."""
    sizes = sets.sizes
    sums = np.append(np.uint64(0), np.cumsum(mixed(sets.values ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
    totals = sums[sets.firsts[1:]] - sums[sets.firsts[:-1]]
    own = mixed(totals + sizes.astype(np.uint64)) >> np.uint64(64 - HASH_BITS)
    return np.searchsorted(band_edges(), sizes, "right") << HASH_BITS | own.view(np.int64)


def unseen(nodes: np.ndarray, sizes: np.ndarray, seen: set[int]) -> np.ndarray:
    """The places of the nodes that were not seen yet, which are from now on; of sets that hold anything."""
    fresh = []
    for n in np.flatnonzero(sizes).tolist():
        node = int(nodes[n])
        if node not in seen:
            seen.add(node)
            fresh.append(n)
    return np.array(fresh, np.int64)


def band(node: str) -> Column:
    return F.shiftright(node, HASH_BITS)


def groups_of(sizes: np.ndarray) -> np.ndarray:
    """A power of two of groups, a quarter as many as shingles at least."""
    return np.maximum(LEAST_GROUPS, 1 << np.frexp(sizes // 4)[1].astype(np.int64))


def count_vectors(sets: Sets, groups: int) -> np.ndarray:
    """Shingles per group, a row for each set."""
    rows = len(sets.firsts) - 1
    place = np.repeat(np.arange(rows) * groups, sets.sizes) + (sets.values & np.uint64(groups - 1)).astype(np.int64)
    return np.bincount(place, minlength=rows * groups).reshape(rows, groups)


def count_vector(shingle_set: np.ndarray) -> np.ndarray:
    size = len(shingle_set)
    return count_vectors(Sets(shingle_set, np.array([0, size])), int(groups_of(np.array([size]))[0]))[0]


def folded(vectors: np.ndarray, groups: int) -> np.ndarray:
    own = vectors.shape[-1]
    return vectors.reshape(*vectors.shape[:-1], own // groups, groups).sum(axis=-2) if own > groups else vectors


def _halves(vectors: np.ndarray) -> np.ndarray:
    """Four bits a group; what does not fit is read as more than any overlap."""
    small = np.minimum(vectors, 15).astype(np.uint8)
    return small[..., ::2] | small[..., 1::2] << np.uint8(4)


def packed(vector: np.ndarray) -> bytes:
    return _halves(vector).tobytes()


def packed_sets(sets: Sets) -> list[bytes]:
    """The packed count vector of every set."""
    groups, out = groups_of(sets.sizes), [b""] * (len(sets.firsts) - 1)
    for number in np.unique(groups).tolist():
        rows = np.flatnonzero(groups == number)
        for at in range(0, len(rows), max(1, COMPARED // number)):
            some = rows[at : at + max(1, COMPARED // number)]
            for n, vector in zip(some.tolist(), _halves(count_vectors(sets.take(some), number))):
                out[n] = vector.tobytes()
    return out


def unpacked(value: bytes | np.ndarray) -> np.ndarray:
    pairs = np.frombuffer(value, np.uint8) if isinstance(value, bytes) else value
    counts = np.empty((*pairs.shape[:-1], 2 * pairs.shape[-1]), np.int64)
    counts[..., ::2], counts[..., 1::2] = pairs & 15, pairs >> 4
    counts[counts == 15] = UNBOUNDED
    return counts


class Vectors:
    """A column of packed count vectors; rows are handed out unpacked."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        self.starts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.groups = 2 * np.diff(self.starts)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        """Rows that have the same number of groups."""
        size = int(self.groups[rows[0]]) // 2
        return unpacked(self.data[self.starts[rows][:, None] + np.arange(size)])

    def points(self, groups: int) -> np.ndarray:
        out = np.empty((len(self.groups), groups), np.int64)
        for number in np.unique(self.groups).tolist():
            rows, step = np.flatnonzero(self.groups == number), max(1, COMPARED // number)
            for at in range(0, len(rows), step):
                out[rows[at : at + step]] = folded(self[rows[at : at + step]], groups)
        return out


def late_places(values: np.ndarray, common: np.ndarray, places: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How late each shingle comes; 0 for those that are not common."""
    late = np.zeros(len(values), np.int64)
    maybe = np.flatnonzero(known[values >> np.uint64(64 - KNOWN_BITS)])
    at = np.searchsorted(common, values[maybe])
    at[at == len(common)] = 0
    same = common[at] == values[maybe] if len(maybe) else np.zeros(0, bool)
    late[maybe[same]] = places[at[same]]
    return late


def prefixes(sets: Sets, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set in the common order, rare before common and then by hash, with
    the number of their set."""
    sizes = sets.sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    taken = np.where(sizes > 0, sizes - -(-PERCENT * sizes // 100) + 1, 0)
    early = late == 0
    before = np.append(0, np.cumsum(early))
    rare = np.diff(before[sets.firsts])
    keep = early & (before[:-1] - before[sets.firsts[:-1]][owner] < taken[owner])
    missing = np.maximum(taken - rare, 0)
    rest = np.flatnonzero(~early & (missing[owner] > 0))
    rest = rest[np.lexsort((sets.values[rest], late[rest], owner[rest]))]
    own = owner[rest]
    keep[rest[np.arange(len(rest)) - np.searchsorted(own, own) < missing[own]]] = True
    return owner[keep], sets.values[keep]


def overlap_needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least intersection of linked sets of sizes n and m."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def may_link(n: np.ndarray, one: np.ndarray, m: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether count vectors of sets of sizes n and m allow a link, of one pair or a row for each."""
    groups = min(one.shape[-1], two.shape[-1])
    return np.minimum(folded(one, groups), folded(two, groups)).sum(axis=-1) >= overlap_needed(n, m)


def may_links(n: np.ndarray, one: Vectors, m: np.ndarray, two: Vectors, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (row a of one, row b of two) may be links."""
    good = np.zeros(len(a), bool)
    kinds, kind = np.unique(np.stack([one.groups[a], two.groups[b]]), axis=1, return_inverse=True)
    for number, widest in enumerate(kinds.max(axis=0).tolist() if len(a) else []):
        rows, step = np.flatnonzero(kind == number), max(1, COMPARED // widest)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            good[some] = may_link(n[a[some]], one[a[some]], m[b[some]], two[b[some]])
    return good


class CountTree:
    """A two-level R-tree of count vectors, packed by median splits."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order, leaves, todo = np.arange(len(points)), [], [(0, len(points))]
        while todo:
            first, last = todo.pop()
            if last - first <= LEAF:
                leaves.append((first, last))
                continue
            rows = order[first:last]
            spread = np.ptp(points[rows], axis=0)
            key = sizes[rows] if np.ptp(sizes[rows]) > spread.max() else points[rows, spread.argmax()]
            middle = (last - first) // 2
            order[first:last] = rows[np.argpartition(key, middle)]
            todo += [(first + middle, last), (first, first + middle)]
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.firsts = np.array([a for a, _ in leaves] + [len(points)])
        starts = self.firsts[:-1]
        self.high = np.maximum.reduceat(self.points, starts)
        self.least, self.most = np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts)
        above = np.arange(0, len(starts), FANOUT)
        self.above = np.append(above, len(starts))
        self.high_above = np.maximum.reduceat(self.high, above)
        self.least_above, self.most_above = np.minimum.reduceat(self.least, above), np.maximum.reduceat(self.most, above)

    def search(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) whose count vectors allow a link."""
        queries = np.repeat(np.arange(len(points)), len(self.above) - 1)
        nodes = np.tile(np.arange(len(self.above) - 1), len(points))
        queries, nodes = self._kept(points, sizes, queries, nodes, self.high_above, self.least_above, self.most_above)
        owner, leaves = expand(self.above[nodes], np.diff(self.above)[nodes])
        queries, leaves = self._kept(points, sizes, queries[owner], leaves, self.high, self.least, self.most)
        owner, rows = expand(self.firsts[leaves], np.diff(self.firsts)[leaves])
        queries, rows = self._kept(points, sizes, queries[owner], rows, self.points, self.sizes, self.sizes)
        return queries, self.order[rows]

    @staticmethod
    def _kept(points: np.ndarray, sizes: np.ndarray, queries: np.ndarray, boxes: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = np.zeros(len(queries), bool)
        for first in range(0, len(queries), 1 << 16):
            q, b = queries[first : first + (1 << 16)], boxes[first : first + (1 << 16)]
            n = sizes[q]
            reach = np.minimum(points[q], high[b]).sum(axis=1)
            smallest = np.maximum(least[b], -(-PERCENT * n // 100))
            good[first : first + (1 << 16)] = (reach >= overlap_needed(n, smallest)) & (100 * most[b] >= PERCENT * n) & (PERCENT * least[b] <= 100 * n)
        return queries[good], boxes[good]


def _common(counted: DataFrame, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common shingles in order of hash, how late each comes, and a filter of their high bits."""
    least = max(LEAST_COMMON, COMMON_SHARE * documents)
    often = materialise(counted.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.lit(least)), "common-shingles")
    # The least count above which there are not too many.
    total = 0
    for row in often.groupBy("n").count().orderBy(F.desc("n")).collect():
        total += row["count"]
        if total > MOST_COMMON:
            often = often.filter(F.col("n") > row["n"])
            break
    found = often.toArrow()
    names = found.column("shingle").to_numpy().view(np.uint64)
    places = np.floor(np.log2(np.maximum(found.column("n").to_numpy(), 1))).astype(np.int64)
    order = np.argsort(names)
    known = np.zeros(1 << KNOWN_BITS, bool)
    known[names >> np.uint64(64 - KNOWN_BITS)] = True
    return names[order], places[order], known


FEATURES = "doc_id bigint, n_shingles bigint, node bigint, vector binary, shingle bigint, n bigint"


def _features(docs: DataFrame) -> DataFrame:
    """Size and signature of every set; its point where a task sees a set for the first time. Beside
    these, in rows of their own, shingles and how often a task has seen them."""
    empty = lambda kind, rows: pa.nulls(rows, kind)
    names = ["doc_id", "n_shingles", "node", "vector", "shingle", "n"]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def counts() -> pa.RecordBatch:
            every = np.concatenate([*held, np.zeros(0, np.uint64)])
            held.clear()
            every.sort()
            ends = np.flatnonzero(np.append(every[1:] != every[:-1], len(every) > 0))
            times = np.diff(ends, prepend=-1)
            often = times >= LEAST_COUNT
            shingle, n = every[ends[often]].view(np.int64), times[often]
            arrays = [*(empty(pa.int64(), len(n)) for _ in range(3)), empty(pa.binary(), len(n)), pa.array(shingle), pa.array(n)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in chunks(offsets, TEXT_BYTES):
                sets = shingle_sets(data, offsets[first : last + 1])
                nodes = signatures(sets)
                fresh = unseen(nodes, sets.sizes, seen)
                vectors = np.full(last - first, None, object)
                vectors[fresh] = packed_sets(sets.take(fresh))
                arrays = [batch.column(0).slice(first, last - first), pa.array(sets.sizes), pa.array(nodes), pa.array(vectors, pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, *(empty(pa.int64(), last - first) for _ in range(2))], names)
                held.append(sets.values)
                size += len(sets.values)
                if size > COUNTED:
                    yield counts()
                    size = 0
        yield counts()

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES)


def _prefix_keys(docs: DataFrame, common: Broadcast, parts: int) -> DataFrame:
    """Keys and nodes of the prefix of every set, once per task that sees it, packed: a row holds what a
    task has found for one of the parts. Texts are cut a second time for these rather than written
    with them: they are by far the most that the join moves."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            key, node = (np.concatenate(c) for c in zip(*held))
            held.clear()
            part = (key % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            key, node, part = key[order], node[order], part[order]
            firsts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            bounds = list(zip(firsts.tolist(), [*firsts[1:].tolist(), len(part)]))
            columns = ([c[a:b].tobytes() for a, b in bounds] for c in (key, node))
            return pa.RecordBatch.from_arrays([pa.array(part[firsts]), *(pa.array(c, pa.binary()) for c in columns)], ["part", "keys", "nodes"])

        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for first, last in chunks(offsets, TEXT_BYTES):
                sets = shingle_sets(data, offsets[first : last + 1])
                nodes = signatures(sets)
                fresh = unseen(nodes, sets.sizes, seen)
                sets = sets.take(fresh)
                owner, keys = prefixes(sets, late_places(sets.values, *common.value))
                held.append((keys, nodes[fresh][owner]))
                size += len(keys)
                if size > KEYS:
                    yield rows()
                    size = 0
        if held:
            yield rows()

    return docs.select("text").mapInArrow(run, "part int, keys binary, nodes binary")


def _shared_keys(keyed: DataFrame, parts: int) -> DataFrame:
    """The keys with another node of theirs in the same or the next band: (key, node), each with the
    first node of its key and band, and the one before it. Nodes of a key come by band, so the nearest
    in size is next to each. A task holds the keys of its part, of which there are as many parts as needed."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(b"".join(batch.column(c).to_pylist()) for c in ("keys", "nodes")) for batch in batches]
        key, node = (np.frombuffer(b"".join(c), np.int64) for c in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
        held.clear()
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        order = order[np.append(same, False) | np.append(False, same)] if len(order) else order
        order = order[np.lexsort((node[order], key[order]))]
        key, node = key[order], node[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[fresh], node[fresh]
        same, away = key[1:] == key[:-1], np.diff(node >> HASH_BITS)
        near = np.append(same & (away <= 1), False)  # whether one comes after it
        after = np.append(False, near[:-1])[: len(key)]
        start = np.append(True, ~same | (away > 0))[: len(key)]
        leader = node[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))] if len(key) else node
        before = np.where(after, np.append(0, node[:-1])[: len(key)], node)
        kept = near[: len(key)] | after
        for at in range(0, len(key), KEYS):
            rows = [pa.array(c[at : at + KEYS][kept[at : at + KEYS]]) for c in (key, node, leader, before)]
            yield pa.RecordBatch.from_arrays(rows, ["key", "node", "leader", "before"])

    return keyed.repartitionById(parts, F.col("part")).mapInArrow(run, "key bigint, node bigint, leader bigint, before bigint")


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and count vectors allow a link."""
    side = lambda n: nodes.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("vector").alias(f"vector_{n}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    near = joined.filter(F.lit(100) * F.least("size_a", "size_b") >= F.lit(PERCENT) * F.greatest("size_a", "size_b"))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
            row = np.arange(batch.num_rows)
            good = pa.array(may_links(n, Vectors(batch.column("vector_a")), m, Vectors(batch.column("vector_b")), row, row))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    return near.mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, shingles) of the documents with these ids, and of few others."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_words(ids, "doc_id"))
    word, bit = place_of("doc_id")
    rows = docs.select(word.alias("word"), bit.alias("bit"), "text")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            word, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wanted = pa.array((shared.value[word] >> bit & 1).astype(bool))
            data, offsets = text_buffer(batch.column(2).filter(wanted))
            for first, last in chunks(offsets, TEXT_BYTES):
                sets = shingle_sets(data, offsets[first : last + 1])
                nodes = signatures(sets)
                fresh = unseen(nodes, sets.sizes, seen)
                sets = sets.take(fresh)
                lists = pa.ListArray.from_arrays(pa.array(sets.firsts, pa.int32()), pa.array(sets.values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[fresh]), lists], ["node", "shingles"])

    return rows.mapInArrow(run, "node bigint, shingles array<bigint>")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that are links, decided on the whole sets."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(docs, nodes.join(ends, "node").select("doc_id"))
    side = lambda n: sets.select(F.col("node").alias(n), F.col("shingles").alias(f"set_{n}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    both = joined.select("a", "b", F.size("set_a").alias("n"), F.size("set_b").alias("m"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))
    return both.filter(F.col("common") * 100 >= (F.col("n") + F.col("m") - F.col("common")) * PERCENT).select("a", "b")


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows to compare, gathered under the main class of their shingles and cut into blocks.

    The main class of a shingle is the one with most rows there. All shingles with one main class
    are taken together, each node once; `asks` marks the nodes of other classes. They are taken by
    pairs of neighbouring bands, so that each node is in two of these. There, blocks of nodes that
    ask meet the blocks of the main class, which do not meet one another, and each other.
    """
    per = rows.groupBy("key", "class").count()
    main = per.groupBy("key").agg(F.max_by("class", F.struct("count", "class")).alias("main"), F.sum("count").alias("total"), F.count("*").alias("classes"))
    # Two nodes have been held against each other already.
    main = main.filter("classes > 1 and total > 2").select("key", "main")
    members = rows.join(main, "key").select("main", "node", "class").distinct().withColumn("asks", F.col("class") != F.col("main"))
    members = members.withColumn("upper", F.explode(F.array(band("node"), band("node") + 1)))
    blocks = lambda one: F.ceil(F.sum(F.col("asks").cast("int") if one else (~F.col("asks")).cast("int")) / BLOCK).cast("int")
    parts = members.groupBy("main", "upper").agg(blocks(False).alias("in_main"), blocks(True).alias("in_rest"), F.min("class").alias("one"), F.max("class").alias("other"), F.max(band("node")).alias("highest"))
    parts = parts.filter("in_rest > 0 and one <> other and highest = upper").drop("one", "other", "highest")
    placed = members.join(parts, ["main", "upper"])
    own = F.pmod(F.xxhash64("node"), F.when(F.col("asks"), F.col("in_rest")).otherwise(F.col("in_main"))).cast("int")
    placed = placed.withColumn("own", own)
    # Cells (i, j): a block i of the other nodes with block j of them, or with block -1 - j of the main class.
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    with_rest = F.transform(span(F.col("in_rest")), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    with_main = F.transform(span(F.col("in_main")), lambda j: F.struct(F.col("own").alias("i"), (-1 - j).alias("j")))
    of_main = F.transform(span(F.col("in_rest")), lambda i: F.struct(i.alias("i"), (-1 - F.col("own")).alias("j")))
    cells = F.when(F.col("asks"), F.concat(with_rest, with_main)).otherwise(of_main)
    return placed.select("main", "upper", "node", "class", "asks", F.explode(cells).alias("cell"))


def _left_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of different classes that share a shingle and that the tree lets through."""
    cells = _blocks(rows).select(F.xxhash64("main", "upper", "cell.i", "cell.j").alias("cell"), "node", "class", "asks", (band("node") == F.col("upper")).alias("high"))
    full = cells.join(nodes.select("node", "size", "vector"), "node")

    def met(points: np.ndarray, size: np.ndarray, firsts: np.ndarray, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (a row that asks, another of its cell): all of a cell of few rows, else those that its tree lets through."""
        counts = np.diff(firsts)
        few = np.flatnonzero(np.repeat(counts <= FEW, counts) & asks)
        cell = np.searchsorted(firsts, few, "right") - 1
        step = max(1, COMPARED // FEW // DIMENSIONS)
        for at in range(0, len(few), step):
            owner, rows = expand(firsts[cell[at : at + step]], counts[cell[at : at + step]])
            yield CountTree._kept(points, size, few[at : at + step][owner], rows, points, size, size)
        for first, last in zip(firsts[:-1][counts > FEW].tolist(), firsts[1:][counts > FEW].tolist()):
            who = np.flatnonzero(asks[first:last])
            queries, rows = CountTree(points[first:last], size[first:last]).search(points[first:last][who], size[first:last][who])
            yield first + who[queries], first + rows

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell = None

        def pairs() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if not whole.num_rows:
                return
            cells, node, label, asks, high, size = (whole.column(c).to_numpy() for c in ("cell", "node", "class", "asks", "high", "size"))
            vectors = Vectors(whole.column("vector").combine_chunks())
            firsts = np.append(np.flatnonzero(np.append(True, cells[1:] != cells[:-1])), len(cells))
            for queries, found in met(vectors.points(DIMENSIONS), size, firsts, asks):
                # Two nodes of the lower band meet where it is the upper one.
                keep = (label[queries] != label[found]) & (~asks[found] | (node[queries] < node[found])) & (high[queries] | high[found])
                queries, found = queries[keep], found[keep]
                good = may_links(size, vectors, size, vectors, queries, found)
                a, b = node[queries[good]], node[found[good]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        # Cells come whole, as many as a batch holds.
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy()
            start = int(np.searchsorted(cells, cells[-1]))
            if start or (held and cell != cells[-1]):
                held.append(batch.slice(0, start))
                yield from pairs()
            held.append(batch.slice(start))
            cell = cells[-1]
        if held:
            yield from pairs()

    ordered = full.repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Words are runs of anything but space and 0x09 to 0x0D, with A to Z in lower case. A set has the
    distinct runs of five words; fewer words are one shingle together; a null or empty text has
    none and is linked with nothing. component_id is the smallest doc_id that links reach, null
    where no reached document has an id; a document without words is its own. Repeated rows are
    copies of each other; no rows give no rows. Equal 64-bit hashes are taken as equal shingles, and
    equal 57-bit hashes within a band of sizes as equal sets. Only doc_id and text are read.
    """
    docs = docs.select("doc_id", "text")
    counted = materialise(_features(docs), "shingle-features")
    features = counted.filter("shingle is null").select("doc_id", "n_shingles", "node", "vector")
    fresh = features.filter("vector is not null")
    nodes = materialise(fresh.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"), F.max("vector").alias("vector")), "shingle-nodes")
    common = docs.sparkSession.sparkContext.broadcast(_common(counted.filter("shingle is not null").select("shingle", "n"), features.count()))
    keys = features.agg(F.coalesce(F.sum(F.expr(f"n_shingles * {100 - PERCENT} div 100 + 1")), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys // KEYS))
    keyed = materialise(_shared_keys(_prefix_keys(docs, common, parts), parts), "shingle-keys")
    common.unpersist()
    near = keyed.select(F.col("node").alias("a"), F.explode(F.array("leader", "before")).alias("b")).filter("a <> b")
    near = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tested = materialise(_bounded(near, nodes), "near-pairs")
    links = materialise(_verified(tested, nodes, docs), "near-links")
    roots = components(links)
    label = F.coalesce("b", "node").alias("class")
    rows = keyed.select("key", "node").join(roots.withColumnRenamed("a", "node"), "node", "left").select("key", "node", label)
    left = materialise(_left_pairs(rows, nodes).join(tested, ["a", "b"], "left_anti"), "left-pairs")
    more = materialise(_verified(left, nodes, docs), "left-links")
    roots = components(links.unionByName(more))
    placed = features.select("doc_id", "n_shingles", "node").join(roots.withColumnRenamed("a", "node"), "node", "left").select("doc_id", "n_shingles", label)
    least = placed.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")).filter("members > 1")
    own: Column = F.coalesce("least", "doc_id")
    return placed.join(least, "class", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, own).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that have the smallest doc_id of their class.

    Rows without an id stay; rows of one id stay or go together. Only rows that a filter of fixed
    size takes for removed ones are shuffled.
    """
    name = "gone" + "_" * max(map(len, docs.columns))  # like no column of docs
    gone = materialise(classes(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "near-copies")
    maybe = known_to(gone, name, "doc_id")
    kept = docs.filter(maybe).join(gone, F.col("doc_id") == F.col(name), "left_anti")
    return docs.filter(~maybe).unionByName(kept)
