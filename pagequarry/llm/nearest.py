"""Exact inner-product top-k with a KD-tree per shard of vectors.

A task reads its vectors shard by shard. Each shard becomes a tree of median splits with a tight
box around every leaf. A query visits the leaves in the order of the largest score their box
allows, and stops when no box can reach the k-th score it has already, which it carries from shard
to shard. Queries are sent in blocks of bounded size; each task returns k rows per query at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.session import materialise

K = 5
SCALE = 256
SHARD_ROWS = 8192
LEAF_ROWS = 128
# What a scaled component is held within.
LARGEST = np.finfo(np.float64).max
# Bytes of query vectors that are sent at a time.
BLOCK_BYTES = 16 << 20


def whole_vectors(ids: pa.Array, vectors: pa.Array, scale: int = SCALE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and floor(scale * x), by dimension; rows without an id or with a component that is
    missing or not finite are left out."""
    lists = vectors.cast(pa.large_list(vectors.type.value_type)) if not pa.types.is_large_list(vectors.type) else vectors
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64) if len(lists.values) else np.zeros(0)
    there = ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(offsets)
    found = {}
    for size in np.unique(sizes[there]):
        rows = np.flatnonzero(there & (sizes == size))
        matrix = values[offsets[rows][:, None] + np.arange(size)]
        good = np.isfinite(matrix).all(axis=1)
        with np.errstate(over="ignore"):
            scaled = np.floor(scale * matrix[good])
        found[int(size)] = numbers[rows[good]], np.clip(scaled, -LARGEST, LARGEST)
    return found


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all rows of b."""
    largest = max(1.0, float(np.abs(a).max(initial=0))) * max(1.0, float(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if largest < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
    return np.array(exact, np.int64).reshape(len(a), len(b))


class Tree:
    """Leaves of a median-split tree: row ranges of `ids` and `vectors`, and tight boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order, leaves, todo = np.arange(len(ids)), [], [(0, len(ids))]
        while todo:
            first, last = todo.pop()
            rows = order[first:last]
            spread = np.ptp(vectors[rows], axis=0) if last - first > LEAF_ROWS and vectors.shape[1] else np.zeros(1)
            if last - first <= LEAF_ROWS or not spread.max():
                leaves += [(at, min(at + LEAF_ROWS, last)) for at in range(first, last, LEAF_ROWS)]
                continue
            middle = (last - first) // 2
            order[first:last] = rows[np.argpartition(vectors[rows, spread.argmax()], middle)]
            todo += [(first, first + middle), (first + middle, last)]
        self.ids, self.vectors, self.leaves = ids[order], vectors[order], leaves
        self.low = np.array([self.vectors[a:b].min(axis=0) for a, b in leaves])
        self.high = np.array([self.vectors[a:b].max(axis=0) for a, b in leaves])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest score that each leaf's box allows each query."""
        above, below = np.maximum(queries, 0), np.minimum(queries, 0)
        with np.errstate(over="ignore", invalid="ignore"):
            reach = above @ self.high.T + below @ self.low.T
            size = above @ np.abs(self.high).T - below @ np.abs(self.low).T
        # Beyond what doubles hold exactly, terms may cancel: the slack follows their sizes.
        reach = reach + 1e-12 * size if not size.max(initial=0) < 2.0**53 else reach
        return np.where(np.isnan(reach), np.inf, reach)


class Best:
    """The k best rows so far of every query; ties go to the smaller id."""

    def __init__(self, count: int, k: int) -> None:
        self.k = k
        self.scores = np.full((count, k), np.iinfo(np.int64).min)
        self.ids = np.full((count, k), np.iinfo(np.int64).max)
        self.held = np.zeros((count, k), bool)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray) -> None:
        every = np.concatenate([self.scores[rows], scores], axis=1)
        names = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        held = np.concatenate([self.held[rows], allowed], axis=1)
        best = np.lexsort((names, -every.astype(np.float64) if np.abs(every[held]).max(initial=0) < 2**53 else ~every, ~held))[:, : self.k]
        take = lambda x: np.take_along_axis(x, best, axis=1)
        self.scores[rows], self.ids[rows], self.held[rows] = take(every), take(names), take(held)

    def kth(self) -> np.ndarray:
        return np.where(self.held[:, -1], self.scores[:, -1].astype(np.float64), -np.inf)


def search_shard(tree: Tree, numbers: np.ndarray, queries: np.ndarray, best: Best) -> None:
    """Best-first: in each round every query that may still gain visits its next leaf."""
    bounds = tree.bounds(queries)
    order = np.argsort(-bounds, axis=1)
    alive = np.arange(len(queries))
    for step in range(len(tree.leaves)):
        leaf = order[alive, step]
        alive = alive[bounds[alive, leaf] >= best.kth()[alive]]
        if not len(alive):
            return
        leaf = order[alive, step]
        for k in np.unique(leaf):
            a, b = tree.leaves[k]
            rows = alive[leaf == k]
            ids = tree.ids[a:b]
            best.offer(rows, ids, _product(queries[rows], tree.vectors[a:b]), ids != numbers[rows][:, None])


def _search(vectors: DataFrame, shared: Broadcast, k: int, scale: int) -> DataFrame:
    """The k best rows of each task for queries by dimension, which `shared` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = {size: Best(len(ids), k) for size, (ids, _) in asked.items()}
        for batch in batches:
            for first in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(first, SHARD_ROWS)
                for size, (ids, rows) in whole_vectors(part.column(0), part.column(1), scale).items():
                    if size in asked and len(ids):
                        search_shard(Tree(ids, rows), *asked[size], best[size])
        for size, (numbers, _) in asked.items():
            at, place = np.nonzero(best[size].held)
            columns = [numbers[at], at + (size << 32), best[size].ids[at, place], best[size].scores[at, place]]
            for first in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[first : first + 50_000]) for c in columns], ["query_id", "_query", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id bigint, _query bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, asked: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for every row that `asked` selects.

    Components become floor(scale * x), held within the range of doubles; scores are exact integers,
    held within 64 bits. A vector
    that is null or holds a null or non-finite component, and a row without an id, takes no part;
    vectors are compared with those of their own length. A query is never compared with rows of its
    own id. Repeated candidate rows are all ranked; a repeated query row is answered once, and two
    vectors under one query id are two queries. No rows give no rows.
    """
    rows = vectors.select("vec_id", "embedding")
    queries = materialise(rows.filter(asked & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).dropDuplicates(), "top-k-queries")
    held = queries.agg(F.sum(8 * F.size("embedding") + 16)).first()[0] or 0
    blocks = max(1, -(-held // BLOCK_BYTES))
    found = None
    for block in range(blocks):
        table = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        sent = whole_vectors(_flat(table.column(0)), _flat(table.column(1)), scale) if table.num_rows else {}
        shared = vectors.sparkSession.sparkContext.broadcast(sent)
        part = _search(rows, shared, k, scale).withColumn("_query", F.struct(F.lit(block), "_query"))
        if blocks > 1:  # one block of queries alive at a time
            part = materialise(part, "top-k-found")
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id", "_query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if not isinstance(column, pa.Array) else column
