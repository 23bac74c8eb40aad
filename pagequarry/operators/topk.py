"""Exact cosine top-k of a batch of query vectors against a table of vectors.

No pair of a query and a chunk ever becomes a row. Tasks score Arrow batches of chunks
against a matrix of queries and emit only the best k per query; one window then merges
these partial lists. There are two ways to bring queries and chunks together:

* shipped: a query side of checked size goes to every task, the chunks are not shuffled;
* in cells: a larger query side is cut into blocks and the chunks into slices by the hash of their id,
  so that no group fills one slice. Blocks and slices meet by a shuffle; the driver sees counts only.
  A task holds the queries of its block and reads the slice batch by batch. Rounds of blocks run one
  after another, and the chunks are computed once for all of them.

Ranking is by (similarity descending, id ascending) on scores summed left to right in double
precision, or in any order where integers make every sum exact, so the result does not depend on batches, blocks or the linear algebra library.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.config import MAX_BROADCAST_ROWS, MAX_SHIPPED_BYTES
from pagequarry.session import broadcast_if_small, materialise, scratch_path

# The least bytes of vectors of a slice of the chunks.
CELL_CHUNK_BYTES = 4 * 1024 * 1024
# Blocks of queries of one round; more come only where a block would pass what may be shipped.
MOST_BLOCKS = 16
# The most bytes that the queries of a block take in a task, beside blocks of scores.
BLOCK_BYTES = 96 * 1024 * 1024
# Most group values pushed down to the chunk scan as an IN list.
MAX_PUSHED_GROUPS = 1_000

# Pairs that are scored at once, and queries of these: a block of scores is of bounded size whatever
# the number of queries and rows.
_SCORES_PER_STEP, _QUERIES_PER_STEP = 4_000_000, 2_048
_PAIRS_PER_STEP = 4_096
# Stands for "no score" inside a task: below every cosine, above the excluded pairs at -inf.
_NO_LENGTH = -2.0
_LOWEST = -3.0


def matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    """A list<float> column as a float32 matrix, without copying where Arrow allows it."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if vectors.null_count or flat.size != len(vectors) * dimension:
        raise ValueError(f"every vector must have {dimension} dimensions")
    return flat.astype(np.float32, copy=False).reshape(len(vectors), dimension)


def _summed(products: np.ndarray) -> np.ndarray:
    """Row sums, strictly left to right."""
    return np.add.accumulate(products, axis=1)[:, -1]


def whole(rows: np.ndarray) -> bool:
    """Whether inner products of such rows are exact in double precision, in whatever order they are summed:
    components are integers and lengths below 2**26, and no sum of products is above a product of lengths."""
    return bool((rows == np.rint(rows)).all() and (np.einsum("ij,ij->i", rows, rows, dtype=np.float64) < 2.0**52).all())


def unit_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which rows have no usable length."""
    lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))
    none = ~(np.isfinite(lengths) & (lengths > 0))
    scale = np.where(none, 1.0, lengths)
    with np.errstate(invalid="ignore"):
        return (rows / scale[:, None]).astype(np.float32), none


class Rows:
    """A float32 matrix of which only the components that are not zero are held; rows are handed out whole."""

    def __init__(self, width: int, ends: np.ndarray, column: np.ndarray, value: np.ndarray) -> None:
        self.shape = (len(ends) - 1, width)
        self.ends, self.column, self.value = ends, column, value

    @classmethod
    def of(cls, rows: np.ndarray) -> Rows:
        row, column = np.nonzero(rows)
        ends = np.searchsorted(row, np.arange(len(rows) + 1))
        return cls(rows.shape[1], ends, column.astype(np.int32), rows[row, column].astype(np.float32))

    @classmethod
    def stacked(cls, parts: list[Rows]) -> Rows:
        before = np.cumsum([0, *(len(part.value) for part in parts)])
        ends = np.concatenate([part.ends[:-1] + n for part, n in zip(parts, before)] + [before[-1:]])
        return cls(parts[0].shape[1], ends, *(np.concatenate([getattr(part, name) for part in parts]) for name in ("column", "value")))

    def __len__(self) -> int:
        return self.shape[0]

    def _places(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all components of some rows, the place of the row among them and their own place."""
        sizes = self.ends[chosen + 1] - self.ends[chosen]
        row = np.repeat(np.arange(len(chosen)), sizes)
        return row, np.arange(len(row)) + np.repeat(self.ends[chosen] - (np.cumsum(sizes) - sizes), sizes)

    def __getitem__(self, chosen: np.ndarray) -> np.ndarray:
        row, place = self._places(chosen)
        out = np.zeros((len(chosen), self.shape[1]), np.float32)
        out[row, self.column[place]] = self.value[place]
        return out

    def like(self, chosen: np.ndarray, matrix: np.ndarray | None = None) -> Rows:
        """Some rows, with the values that a matrix has where they have components."""
        row, place = self._places(chosen)
        column = self.column[place]
        value = self.value[place] if matrix is None else matrix[row, column]
        return Rows(self.shape[1], np.searchsorted(row, np.arange(len(chosen) + 1)), column, value)

    def key(self, n: int) -> bytes:
        """Equal for equal rows, and for these only."""
        mine = slice(self.ends[n], self.ends[n + 1])
        return len(self.column[mine]).to_bytes(8) + self.column[mine].tobytes() + self.value[mine].tobytes()


class VectorTable:
    """Vectors to score against, with an estimate for screening and the exact score."""

    def __init__(self, rows: np.ndarray | Rows) -> None:
        self.rows = rows
        self.none = np.zeros(len(rows), bool)
        self.squared = np.zeros(len(rows))
        units, self.whole = [], True
        for at in range(0, len(rows), _PAIRS_PER_STEP):
            chosen = np.arange(at, min(at + _PAIRS_PER_STEP, len(rows)))
            part = rows[chosen]
            unit, self.none[chosen] = unit_rows(part)
            units.append(rows.like(chosen, unit) if isinstance(rows, Rows) else unit)
            self.squared[chosen] = _summed(part.astype(np.float64) ** 2)
            self.whole = self.whole and whole(part)
        if not units:
            self.unit = rows
        else:
            self.unit = Rows.stacked(units) if isinstance(rows, Rows) else np.concatenate(units)
        # Bound on the error of a single-precision inner product of unit vectors.
        self.slack = 4.0 * (rows.shape[1] + 8) * 2.0**-24

    def estimate(self, chosen: np.ndarray, unit: np.ndarray, none: np.ndarray) -> np.ndarray:
        scores = self.unit[chosen] @ unit.T
        scores[self.none[chosen], :] = _NO_LENGTH
        scores[:, none] = _NO_LENGTH
        return scores

    def exact(self, mine: np.ndarray, rows: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        out = np.empty(len(mine))
        integers = self.whole and whole(rows[np.unique(theirs)])
        inner_of = (lambda a, b: np.einsum("ij,ij->i", a, b)) if integers else (lambda a, b: _summed(a * b))
        for at in range(0, len(mine), _PAIRS_PER_STEP):
            own = mine[at : at + _PAIRS_PER_STEP]
            other = rows[theirs[at : at + _PAIRS_PER_STEP]].astype(np.float64)
            inner = inner_of(self.rows[own].astype(np.float64), other)
            squared = self.squared[own] * inner_of(other, other)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.clip(inner / np.sqrt(squared), -1.0, 1.0)
            valid = np.isfinite(squared) & (squared > 0)
            out[at : at + _PAIRS_PER_STEP] = np.where(valid, score, _NO_LENGTH)
        return out


def _distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    packed = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * rows.itemsize)))
    _, first, place = np.unique(packed.ravel(), return_index=True, return_inverse=True)
    return first, place


class Leaders:
    """The best k (score, id) per query seen so far, best first."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self._held = np.zeros(queries, np.int64)
        self._score = np.empty((queries, k), np.float64)
        self._id = np.empty((queries, k), np.int64)
        # What a score has to reach.
        self.floor = np.full(queries, -np.inf)

    def _filled(self) -> np.ndarray:
        return np.arange(self.k) < self._held[:, None]

    @property
    def query(self) -> np.ndarray:
        return np.repeat(np.arange(len(self._held)), self._held)

    @property
    def score(self) -> np.ndarray:
        return self._score[self._filled()]

    @property
    def id(self) -> np.ndarray:
        return self._id[self._filled()]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Costs what the queries that have new rows hold, whatever all others do."""
        touched = np.unique(query)
        filled = np.arange(self.k) < self._held[touched][:, None]
        query = np.concatenate([np.repeat(touched, self._held[touched]), query])
        score = np.concatenate([self._score[touched][filled], score])
        ids = np.concatenate([self._id[touched][filled], ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(query)]).astype(np.int64)
        place = np.arange(len(query)) - np.repeat(starts, sizes)
        keep = place < self.k
        self._score[query[keep], place[keep]] = score[keep]
        self._id[query[keep], place[keep]] = ids[keep]
        self._held[touched] = np.minimum(sizes, self.k)
        full = place == self.k - 1
        self.floor[query[full]] = score[full]


@dataclass
class QuerySide:
    """The queries of one task, with the groups and the row filter that each one is bound to."""

    ids: pa.Array
    vectors: np.ndarray | Rows
    groups: pa.Array | None = None
    only: pa.Array | None = None
    table: VectorTable = field(init=False)

    def __post_init__(self) -> None:
        # Queries that ask the same thing are answered once and written out for each.
        count = len(self.ids)
        only = self.only if self.only is not None else pa.nulls(count, pa.int64())
        limited, value = only.is_valid().to_numpy(zero_copy_only=False), only.fill_null(0).to_numpy()
        if self.groups is not None:
            bound = self.groups.is_valid().to_numpy(zero_copy_only=False)
            listed, owner = pc.fill_null(self.groups.flatten(), -(1 << 63)).to_numpy(), pc.list_parent_indices(self.groups).to_numpy()
            ends = np.searchsorted(owner, np.arange(count + 1))
        else:
            bound, listed, ends = np.zeros(count, bool), np.empty(0, np.int64), np.zeros(count + 1, np.int64)
        seen: dict[bytes, int] = {}
        firsts, owners = [], []
        for n in range(count):
            parts = (listed[ends[n] : ends[n + 1]], np.array([bound[n], limited[n], value[n]], np.int64))
            vector = self.vectors.key(n) if isinstance(self.vectors, Rows) else self.vectors[n].tobytes()
            key = hashlib.blake2b(b"".join([vector, *(part.tobytes() for part in parts)]), digest_size=20).digest()
            place = seen.setdefault(key, len(firsts))
            if place == len(firsts):
                firsts.append(n)
            owners.append(place)
        self.asked_by = np.argsort(owners, kind="stable")
        self.asked_count = np.bincount(owners, minlength=len(firsts)).astype(np.int64)
        self.asked_start = np.cumsum(self.asked_count) - self.asked_count
        firsts = np.array(firsts, np.int64)
        self.table = VectorTable(self.vectors.like(firsts) if isinstance(self.vectors, Rows) else self.vectors[firsts])
        self.filtered, self.filter = limited[firsts], value[firsts]
        self.everywhere = np.flatnonzero(~bound[firsts])
        # The places of the queries of every group, one after another.
        sizes = np.diff(ends)[firsts]
        place = np.repeat(np.arange(len(firsts), dtype=np.int32), sizes)
        group = listed[np.repeat(ends[firsts], sizes) + np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        order = np.lexsort((place, group))
        group, place = group[order], place[order]
        fresh = np.r_[True, (group[1:] != group[:-1]) | (place[1:] != place[:-1])] if len(group) else np.empty(0, bool)
        self.group_places = place[fresh]
        values, starts = np.unique(group[fresh], return_index=True)
        self.by_group = {v: (a, b) for v, a, b in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), int(fresh.sum())])}

    def parts(self, groups: np.ndarray | None) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
        """Which rows of a batch meet which queries."""
        if len(self.everywhere):
            yield None, self.everywhere
        if groups is None or not self.by_group:
            return
        order = np.argsort(groups, kind="stable")
        values, starts = np.unique(groups[order], return_index=True)
        for value, rows in zip(values.tolist(), np.split(order, starts[1:])):
            if value in self.by_group:
                first, last = self.by_group[value]
                yield rows, self.group_places[first:last].astype(np.int64)

    def scan(self, leaders: Leaders, rows: np.ndarray, ids: np.ndarray,
             groups: np.ndarray | None, only: np.ndarray | None) -> None:
        unit, none = unit_rows(rows)
        for picked, queries in self.parts(groups):
            picked = np.arange(len(rows)) if picked is None else picked
            for first in range(0, len(queries), _QUERIES_PER_STEP):
                asked = queries[first : first + _QUERIES_PER_STEP]
                step = max(256, _SCORES_PER_STEP // len(asked))
                for at in range(0, len(picked), step):
                    block = picked[at : at + step]
                    self._score(leaders, asked, block, rows, unit[block], none[block], ids, only)

    def _score(self, leaders, queries, block, rows, unit, none, ids, only) -> None:
        scores = self.table.estimate(queries, unit, none)
        if only is not None and self.filtered[queries].any():
            meets = self.filter[queries][:, None] == only[block][None, :]
            scores[~(meets | ~self.filtered[queries][:, None])] = -np.inf
        slack, k = self.table.slack, leaders.k
        floor = np.maximum(leaders.floor[queries] - slack, _LOWEST).astype(np.float32)
        hits = np.flatnonzero(scores >= floor[:, None])
        if len(block) > k and len(hits) > 4 * k * len(queries):
            kth = np.partition(scores, len(block) - k, axis=1)[:, len(block) - k] - 2 * slack
            hits = np.flatnonzero(scores >= np.maximum(floor, kth.astype(np.float32))[:, None])
        if not len(hits):
            return
        query, row = np.divmod(hits, len(block))
        query, row = queries[query], block[row]
        if len(query) > 4 * k * len(queries):
            # Many copies of one vector: score each distinct vector once.
            used, place = np.unique(row, return_inverse=True)
            first, same = _distinct_rows(rows[used])
            pair, back = np.unique(same[place] * len(self.table.rows) + query, return_inverse=True)
            vector, asked = np.divmod(pair, len(self.table.rows))
            exact = self.table.exact(asked, rows, used[first[vector]])[back]
        else:
            exact = self.table.exact(query, rows, row)
        leaders.add(query, exact, ids[row])

    def written(self, leaders: Leaders, schema: pa.Schema) -> pa.Table:
        times = self.asked_count[leaders.query]
        line = np.repeat(np.arange(len(times)), times)
        within = np.arange(len(line)) - np.repeat(np.cumsum(times) - times, times)
        who = self.asked_by[self.asked_start[leaders.query][line] + within]
        score = leaders.score[line]
        columns = [
            self.ids.take(pa.array(who)),
            pa.array(leaders.id[line]),
            pa.array(score, mask=score == _NO_LENGTH),
        ]
        return pa.Table.from_arrays(
            [c.cast(f.type) for c, f in zip(columns, schema)], schema=schema
        )


def _query_side(table: pa.Table, vectors: Rows, grouped: bool) -> QuerySide:
    table = table.combine_chunks()
    column = lambda name: table.column(name).combine_chunks()
    sparse = 4 * len(vectors.value) <= len(vectors) * vectors.shape[1]
    return QuerySide(
        ids=column("query_id"),
        vectors=vectors if sparse else vectors[np.arange(len(vectors))],
        groups=column("groups") if grouped else None,
        only=column("only"),
    )


def _keys(batch: pa.RecordBatch, name: str) -> np.ndarray | None:
    return batch.column(name).to_numpy() if name in batch.schema.names else None


def _scan_batch(side: QuerySide, leaders: Leaders, batch: pa.RecordBatch, dimension: int) -> None:
    if not batch.num_rows:
        return
    side.scan(
        leaders,
        matrix(batch.column("embedding"), dimension),
        _keys(batch, "id"),
        _keys(batch, "group"),
        _keys(batch, "only"),
    )


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StringType):
        return pa.string()
    if isinstance(kind, T.IntegerType):
        return pa.int32()
    if isinstance(kind, T.LongType):
        return pa.int64()
    raise ValueError("query_id must be an integer or a string")


def best_per_query(scored: DataFrame, k: int) -> DataFrame:
    """Keep and rank the k best rows per query; rows without a score come last, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    dimension: int,
    *,
    group: str | None = None,
    only: str | None = None,
    max_shipped_bytes: int = MAX_SHIPPED_BYTES,
    cell_chunks: int | None = None,
    cell_queries: int | None = None,
) -> DataFrame:
    """The k nearest chunks of each query: query_id, rank, id, similarity.

    `chunks` has id and embedding. `queries` has query_id and embedding and may have `groups`
    (array of bigint: meet only chunks whose `group` column is among them; NULL means every
    chunk) and `only` (bigint: meet only chunks whose `only` column is equal; NULL means every
    chunk). Both restrictions apply before the limit.

    A query side of more than `max_shipped_bytes` meets the chunks in cells: blocks of `cell_queries`
    queries or more, by slices of `cell_chunks` chunks or more.
    """
    names = queries.columns
    optional = lambda name, kind: (
        F.col(name).cast(kind) if name in names else F.lit(None).cast(kind)
    ).alias(name)
    asked = queries.select(
        "query_id",
        F.col("embedding").cast("array<float>").alias("embedding"),
        optional("groups", "array<bigint>"),
        optional("only", "bigint"),
    )
    held = [F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>")]
    if group:
        held.append(F.coalesce(F.col(group).cast("bigint"), F.lit(-(1 << 62))).alias("group"))
    if only:
        held.append(F.coalesce(F.col(only).cast("bigint"), F.lit(-(1 << 62))).alias("only"))
    kind = queries.schema["query_id"].dataType
    output = T.StructType(
        [
            T.StructField("query_id", kind),
            T.StructField("id", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    arrow_output = pa.schema(
        [("query_id", _arrow_type(kind)), ("id", pa.int64()), ("similarity", pa.float64())]
    )
    # One more row than may be shipped tells whether the whole side fits.
    room = max_shipped_bytes // (4 * dimension + 64)
    head = asked.limit(room + 1)
    count, listed = head.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size("groups"), F.lit(0))), F.lit(0))).first()
    if count <= room and count * (4 * dimension + 64) + 8 * listed <= max_shipped_bytes:
        partial = _shipped(chunks, held, head.toArrow(), k, dimension, group, output, arrow_output)
        ranked = best_per_query(partial, k)
        small = count * k <= MAX_BROADCAST_ROWS
    else:
        cell_chunks = cell_chunks or max(1, CELL_CHUNK_BYTES // (4 * dimension))
        partial = _in_cells(chunks, held, asked, k, dimension, group, output, arrow_output, cell_chunks, cell_queries)
        ranked = best_per_query(partial, k)
        small = False
    result = ranked.select("query_id", "rank", "id", "similarity")
    return F.broadcast(result) if small else result


def _shipped(chunks, held, head, k, dimension, group, output, arrow_output) -> DataFrame:
    """The best rows of every task."""
    groups = head.column("groups").to_pylist()
    if group and all(value is not None for value in groups):
        wanted = sorted({value for part in groups for value in part})
        if len(wanted) <= MAX_PUSHED_GROUPS:
            chunks = chunks.filter(F.col(group).isin(wanted))
        elif len(wanted) <= MAX_BROADCAST_ROWS:
            keys = chunks.sparkSession.createDataFrame(pa.table({group: pa.array(wanted, pa.int64())}))
            chunks = chunks.join(F.broadcast(keys), group, "left_semi")
    payload = chunks.sparkSession.sparkContext.broadcast(head)
    grouped = group is not None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = payload.value
        vectors = Rows.of(matrix(asked.column("embedding").combine_chunks(), dimension))
        side = _query_side(asked.drop_columns("embedding"), vectors, grouped)
        leaders = Leaders(len(side.table.rows), k)
        for batch in batches:
            _scan_batch(side, leaders, batch, dimension)
        yield from side.written(leaders, arrow_output).to_batches(max_chunksize=10_000)

    return chunks.select(*held).mapInArrow(score, output)


def _in_cells(chunks, held, asked, k, dimension, group, output, arrow_output, cell_chunks, cell_queries) -> DataFrame:
    """The best rows of every cell, a block of queries and a slice of the chunks, written one round of
    blocks after another.

    Queries are placed in the order of their groups, so that a block touches few groups, and cut by
    position, so that a group or a repeated query fills as many blocks as it needs. Blocks hold
    `cell_queries` queries, or as many as take BLOCK_BYTES in a task by the components that are not
    zero; where these are more than MOST_BLOCKS blocks, they hold more, up to those bytes. A chunk goes
    only to the blocks that ask for its group, so that few blocks mean few copies of the chunks.
    """
    spark = chunks.sparkSession
    cores = spark.sparkContext.defaultParallelism
    kept = materialise(asked.withColumn("first", F.array_min("groups")), "asked").withColumn("row", F.monotonically_increasing_id())
    table = materialise(chunks.select(*held), "held")  # encoded once, whatever the number of rounds
    filled = F.coalesce(F.size(F.filter("embedding", lambda x: x != 0)), F.lit(0))
    count, listed, filled = kept.agg(
        F.count("*"), F.coalesce(F.sum(F.greatest(F.size("groups"), F.lit(0))), F.lit(0)), F.coalesce(F.sum(filled), F.lit(0))
    ).first()
    # Of a component its place, value and scaled value; of a query its id, its best k and their floor. A
    # block that is denser than the others takes eight times BLOCK_BYTES at most.
    each = min(12 * filled // max(1, count), 8 * dimension) + 128 + 16 * k + 24 * (listed // max(1, count))
    fitting = max(1, min(BLOCK_BYTES // each, BLOCK_BYTES * 8 // (12 * dimension)))
    blocks = max(1, -(-count // min(fitting, max(cell_queries or fitting, -(-count // MOST_BLOCKS)))))
    dealt = kept.repartitionByRange(blocks, "first", "row").drop("first", "row").withColumn("block", F.spark_partition_id())
    dealt = materialise(dealt, "query-blocks")
    a_round = min(blocks, MOST_BLOCKS)
    slices = max(1, min(-(-table.count() // cell_chunks), -(-2 * cores // a_round)))

    everywhere = dealt.filter(F.col("groups").isNull()) if group else dealt
    open_blocks = materialise(everywhere.select("block").distinct(), "open-blocks")
    copies = table.crossJoin(F.broadcast(open_blocks))  # a row per block
    if group:
        wanted = dealt.select("block", F.explode("groups").alias("group")).distinct().join(F.broadcast(open_blocks), "block", "left_anti")
        wanted = materialise(wanted, "wanted-groups")
        copies = copies.unionByName(table.join(broadcast_if_small(wanted), "group"))
    place = lambda number: (F.col("block") * slices + number).cast("int").alias("cell")
    queries = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    asks = queries.select(place(F.col("slice")), F.lit(0).alias("side"), "query_id", "embedding", "groups", "only", "block")
    names = [name for name in table.columns if name != "embedding"]
    hold = copies.select(
        place(F.pmod(F.xxhash64("id"), F.lit(slices))), F.lit(1).alias("side"), "embedding", "block",
        *[F.col(name).alias(f"held_{name}") for name in names],
    )
    both = asks.unionByName(hold, allowMissingColumns=True)
    grouped = group is not None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asking, vectors, side, leaders = None, [], [], None, None
        for batch in batches:
            own = batch.column("cell").to_numpy().astype(np.int64) * 2 + batch.column("side").to_numpy()
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
            for first, last in zip(starts, [*starts[1:], len(own)]):
                part, (number, held_side) = batch.slice(first, last - first), divmod(int(own[first]), 2)
                if number != cell:
                    if side is not None:
                        yield from side.written(leaders, arrow_output).to_batches(max_chunksize=10_000)
                    cell, asking, vectors, side = number, [], [], None
                if not held_side:
                    asking.append(part.select(["query_id", "groups", "only"]))
                    vectors.append(Rows.of(matrix(part.column("embedding"), dimension)))
                    continue
                if side is None:
                    side = _query_side(pa.Table.from_batches(asking), Rows.stacked(vectors), grouped)
                    asking, vectors = [], []
                    leaders = Leaders(len(side.table.rows), k)
                part = part.select(["embedding", *[f"held_{name}" for name in names]]).rename_columns(["embedding", *names])
                _scan_batch(side, leaders, part, dimension)
        if side is not None:
            yield from side.written(leaders, arrow_output).to_batches(max_chunksize=10_000)

    target = scratch_path(spark, "rounds")
    spark.createDataFrame([], output).write.parquet(f"{target}/round=-1")
    for first in range(0, blocks, a_round):
        now = both.filter(F.col("block").between(first, first + a_round - 1)).drop("block")
        placed = now.repartitionById(a_round * slices, F.col("cell") - first * slices).sortWithinPartitions("cell", "side")
        placed.mapInArrow(score, output).write.parquet(f"{target}/round={first}")
    return spark.read.schema(output).parquet(target)
