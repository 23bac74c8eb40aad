"""The prefix tree of conversations, by vertical bitmaps.

Conversations are cut into blocks of consecutive ids. Within a block every (position, turn) has the
bitset of its conversations. A depth-first walk intersects the bitset of a node with the postings of
the next position: each non-empty intersection is a child, its population count the members, and
the conversations without a next turn are the end list. Postings are held for a window of positions
at a time, so a block needs the same memory for conversations of any length.

A node of two blocks is one node of the tree: nodes are named by a hash of their turns, and what
the blocks say of them adds up. So do sums over subtrees: the smallest member of a node owns it, and
every other member of it saves its last text once. The turns that a conversation does not own are
its first ones, so the bytes of these are all that the walk needs to know of other blocks. A second
walk sums them, and the leaves that are owned, over the members of each node.

Only hashes and lengths of turns are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators.joins import join_unique
from pagequarry.session import materialise

# Ids of one block, a multiple of FAMILY; and the positions whose postings are held together.
BLOCK, POSITIONS = 500, 32
# Conversations of one family of ids share a block.
FAMILY = 5
ROOT = b"\0" * 16


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position from 1, turn hash, bytes) of every turn of a conversation with an id.

    Order is by turn, null first; turns of one number come by role, then by hash. A null role or
    text is empty. The hash is of role and text.
    """
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    own = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    hashed = turns.select("conv_id", "turn", "role", F.unhex(F.md5(own)).alias("hash"), F.octet_length("text").cast("bigint").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "hash")
    return hashed.withColumn("position", F.row_number().over(order)).select("conv_id", "position", "hash", "bytes")


def _block(conv_id: Column) -> Column:
    return F.floor((conv_id - conv_id % FAMILY) / BLOCK)


def _walk(turns: dict, frontier: list) -> Iterator[tuple]:
    """Depth-first from every node of the frontier through one window of positions.

    `turns` has, per position, the turn code of every conversation (-1: none), the bitset of every
    code, the hashes and the bytes. Yields (key, parent, depth, bytes above, last bytes, members,
    ends) per node below the frontier, and puts the nodes that reach the end of the window into it.
    """
    todo = frontier[::-1]
    frontier.clear()
    while todo:
        key, parent, depth, above, last, held = todo.pop()
        place = turns.get(depth + 1)
        if place is None:
            frontier.append((key, parent, depth, above, last, held))
            continue
        codes, postings, hashes, sizes = place
        rest, ends, children = held, 0, []
        while rest:
            lowest = (rest & -rest).bit_length() - 1
            code = codes[lowest]
            if code < 0:
                ends |= 1 << lowest
                rest &= rest - 1
                continue
            child = held & postings[code]
            rest &= ~child
            name = hashlib.blake2b(key + hashes[code], digest_size=16).digest()
            children.append((name, key, depth + 1, above + last, sizes[code], child))
        yield key, parent, depth, above, last, held, ends
        todo += children[::-1]


def _bits(held: int, count: int) -> np.ndarray:
    """The numbers of the bits that are set, ascending."""
    if held.bit_count() == 1:
        return np.array([held.bit_length() - 1])
    return np.flatnonzero(np.unpackbits(np.frombuffer(held.to_bytes(-(-count // 8), "little"), np.uint8), bitorder="little"))


def _nodes(tell: Callable, schema: pa.Schema):
    """Runs the walk over blocks; rows come by block and position, and the conversations of a block
    (position 0) before its turns. `tell(node, ids, unowned, leaf)` makes the row of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"block": None}
        out: list[tuple] = []

        def begin(block: int) -> None:
            state.update(block=block, ids=[], extra=[], frontier=None, held=[], upto=0)

        def window() -> dict[int, tuple]:
            """Codes, postings, hashes and bytes of the positions gathered so far."""
            if state["frontier"] is None:
                state["frontier"] = [(ROOT, None, 0, 0, 0, (1 << len(state["ids"])) - 1)]
                state["place"] = {conv: n for n, conv in enumerate(state["ids"])}
            found: dict[int, tuple] = {}
            for position, conv, name, size in state["held"]:
                codes, postings, hashes, sizes, known = found.setdefault(position, ([-1] * len(state["ids"]), [], [], [], {}))
                code = known.setdefault(name, len(known))
                if code == len(postings):
                    postings.append(0)
                    hashes.append(name)
                    sizes.append(size)
                at = state["place"][conv]
                codes[at] = code
                postings[code] |= 1 << at
            state["held"] = []
            return {position: place[:4] for position, place in found.items()}

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            if state["block"] is None:
                return
            turns = window()
            if last:
                # One more position, where nobody has a turn, ends all that is left.
                turns[state["upto"] + 1] = ([-1] * len(state["ids"]), [], [], [])
            for node in _walk(turns, state["frontier"]):
                out.append(tell(node, state["ids"], state["extra"], state["block"]))
                if len(out) >= 4096:
                    yield rows()

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for block, position, conv, name, size, unowned, leaf in zip(*(c.to_pylist() for c in batch.columns)):
                if block != state["block"]:
                    yield from flush(True)
                    begin(block)
                if position == 0:
                    state["ids"].append(conv)
                    state["extra"].append((unowned, leaf))
                    continue
                if position > state["upto"]:
                    if state["held"] and position - state["held"][0][0] >= POSITIONS:
                        yield from flush(False)
                    state["upto"] = position
                state["held"].append((position, conv, name, size))
        yield from flush(True)
        yield rows()

    return run


_FOUND = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("above", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("block", pa.int64()), ("ends", pa.string())])
_SUMS = pa.schema([("key", pa.binary()), ("n_leaves", pa.int64()), ("saved", pa.int64())])


def _found(node: tuple, ids: list[int], extra: list, block: int) -> tuple:
    key, parent, depth, above, last, held, ends = node
    listed = ",".join(str(ids[n]) for n in _bits(ends, len(ids))) if ends else None
    return key, parent, depth, above, last, held.bit_count(), ids[(held & -held).bit_length() - 1], block, listed


def _sums(node: tuple, ids: list[int], extra: list, block: int) -> tuple:
    key, _, _, above, _, held, _ = node
    chosen = [extra[n] for n in _bits(held, len(ids)).tolist()]
    return key, sum(leaf for _, leaf in chosen), sum(unowned - above for unowned, _ in chosen if unowned > above)


def _end_hashes(lists: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, block, ends): the lists of a node are hashed in order of blocks,
    one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if key == now:
                    digest.update(b"," + ends.encode())
                    continue
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["key", "ends_sha256"])

    return lists.repartition("key").sortWithinPartitions("key", "block").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_tree(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the tree of all conversations.

    `turns` has conv_id, position (1, 2, ... without gaps), hash (16 bytes) and bytes, as
    `ordered_turns` makes them; `conversations` has the conv_id of every member, also of those
    without turns, each once. Per distinct sequence of first turns, the root included: conv_id (the
    smallest member), depth, parent_conv_id (the parent's smallest member; null at the root),
    n_convs, n_children, n_leaves (nodes without children in the subtree, itself included),
    saved_tokens (over the subtree: members less one, times the bytes of the last text) and
    ends_sha256 (of the ids of the conversations that end there, ascending, joined by commas).
    Without conversations there are no nodes.
    """
    rows = turns.select(_block(F.col("conv_id")).alias("block"), F.col("position").cast("bigint").alias("position"), "conv_id", "hash", "bytes")
    none = lambda kind: F.lit(None).cast(kind)
    seeds = conversations.select(_block(F.col("conv_id")).alias("block"), F.lit(0).cast("bigint").alias("position"), "conv_id", none("binary").alias("hash"), none("bigint").alias("bytes"))
    placed = materialise(rows.unionByName(seeds), "placed-turns")

    def walked(rows: DataFrame, tell: Callable, schema: pa.Schema) -> DataFrame:
        sent = rows.select("block", "position", "conv_id", "hash", "bytes", "unowned", "leaf")
        ordered = sent.repartition("block").sortWithinPartitions("block", "position", "conv_id")
        kinds = {pa.binary(): "binary", pa.int64(): "bigint", pa.string(): "string"}
        return ordered.mapInArrow(_nodes(tell, schema), ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))

    parts = materialise(walked(placed.withColumns({"unowned": none("bigint"), "leaf": none("bigint")}), _found, _FOUND), "partial-nodes")
    same = lambda *names: [F.first(n).alias(n) for n in names]
    nodes = parts.groupBy("key").agg(*same("parent", "depth", "above", "last"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(children, "key", "left").fillna(0, ["n_children"]), "nodes")

    # What a conversation owns: the deepest turns of it, from the first node it is smallest of.
    owned = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", F.when(F.col("depth") > 0, F.col("above")).otherwise(0).alias("unowned")))["unowned"].alias("unowned"), F.count(F.when(F.col("n_children") == 0, 1)).alias("leaf"))
    total = placed.groupBy("conv_id").agg(F.sum(F.coalesce("bytes", F.lit(0))).alias("unowned"))
    owned = total.withColumnRenamed("unowned", "all").join(owned, "conv_id", "left").select("conv_id", F.coalesce("unowned", "all").alias("unowned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    marked = placed.filter("position = 0").join(owned, "conv_id")
    both = marked.unionByName(placed.filter("position > 0").withColumns({"unowned": none("bigint"), "leaf": none("bigint")}))
    sums = walked(both, _sums, _SUMS).groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    hashes = _end_hashes(parts.filter("ends is not null").select("key", "block", "ends"))
    full = nodes.join(sums, "key").join(hashes, "key", "left")
    full = full.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    above = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = join_unique(full, above, "parent", "left")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """The turns of `ordered_turns`, where conversation c begins with the first h turns of
    conversation c - c % 5, and goes on with its own after its first h; h is crc32(c) % 9."""
    ids = turns.select("conv_id").distinct()
    families = ids.select((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), "conv_id")
    families = families.groupBy("first").agg(F.collect_list("conv_id").alias("ids"))  # 9 ids at most
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % 9
    # A turn goes to its own conversation and, from the first of a family, to the others.
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("position") <= 8)).withColumnRenamed("conv_id", "first")
    shared = heads.join(families, "first").select(F.explode("ids").alias("conv_id"), "position", "hash", "bytes").filter(F.col("position") <= head(F.col("conv_id")))
    own = turns.filter(F.col("position") > head(F.col("conv_id")))
    # Where the first of the family has fewer turns than h, own ones close up.
    counted = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("position") <= 8)).groupBy(F.col("conv_id").alias("first")).agg(F.count("*").alias("given"))
    given = families.join(counted, "first", "left").select(F.explode("ids").alias("conv_id"), F.coalesce("given", F.lit(0)).alias("given"))
    moved = join_unique(own, given, "conv_id").withColumn("position", (F.col("position") - head(F.col("conv_id")) + F.least("given", head(F.col("conv_id")))).cast("int"))
    return shared.unionByName(moved.select(*shared.columns))


def tree_of_rebuilt(conversations: DataFrame) -> DataFrame:
    """The prefix tree of the rebuilt conversations: every conv_id that has a row is a member."""
    turns = materialise(ordered_turns(conversations), "ordered-turns")
    return prefix_tree(rebuilt_turns(turns), turns.select("conv_id").distinct())


_REBUILT_SQL = """
rows as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as position
  from conversations where conv_id is not null
), ids as (
  select distinct conv_id from rows
), heads as (
  select conv_id, conv_id - conv_id % 5 as first, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(conv_id::varchar, '')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 9 as h from ids
), rebuilt as (
  select h.conv_id, 0 as part, r.position, r.role, r.text from heads h join rows r on r.conv_id = h.first and r.position <= h.h
  union all
  select h.conv_id, 1, r.position, r.role, r.text from heads h join rows r on r.conv_id = h.conv_id and r.position > h.h
)
"""

# The prefix of a conversation is named by the hashes of its turns, one after another.
TREE_SQL = f"""
with recursive {_REBUILT_SQL.strip()}, placed as (
  select conv_id, row_number() over (partition by conv_id order by part, position) as depth, md5(strlen(role) || ':' || role || text) as turn, strlen(text) as bytes from rebuilt
), prefixed as (
  select conv_id, depth, bytes, md5(string_agg(turn, ',') over (partition by conv_id order by depth)) as node,
    depth = max(depth) over (partition by conv_id) as final from placed
  union all
  select conv_id, 0, 0, '', not exists (from placed p where p.conv_id = i.conv_id) from ids i
), nodes as (
  select node, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
    coalesce(string_agg(conv_id, ',' order by conv_id) filter (final), '') as ends from prefixed group by node
), links as (
  select distinct c.node, p.node as parent from prefixed c join prefixed p on p.conv_id = c.conv_id and p.depth = c.depth - 1
), family as (
  select n.*, l.parent, (select count(*) from links k where k.parent = n.node) as n_children from nodes n left join links l using (node)
), above as (
  select distinct a.node as top, b.node from prefixed a join prefixed b on a.conv_id = b.conv_id and a.depth <= b.depth
), sums as (
  select top as node, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * bytes) as saved_tokens from above join family using (node) group by top
)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(f.ends) as ends_sha256
from family f join sums s using (node) left join nodes p on p.node = f.parent
"""
