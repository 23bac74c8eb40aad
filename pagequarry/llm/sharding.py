"""Minimax contiguous sharding of groups of equal texts.

Groups are ordered by the hash of their text. The smallest capacity for which greedy filling needs
no more than the given number of shards is found by binary search, and the order is cut there. The
search runs on sums over hash ranges: a range that holds several groups counts as divisible, and
only ranges in which a cut falls are split further, until every cut falls between two groups. The
driver sees a few thousand sums for any number of groups.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.session import materialise

SHARDS = 8
# Bits of the hash that the first sums, and each refinement, resolve.
FIRST_BITS, MORE_BITS = 12, 8
# Rows of a shard are numbered in so many blocks.
SLOT_BLOCKS = 2048


class Range(NamedTuple):
    shift: int
    prefix: int
    size: int
    low: int
    high: int

    @property
    def divisible(self) -> bool:
        return self.low != self.high


def _sums(groups: DataFrame, shift: int) -> list[Range]:
    found = (
        groups.groupBy(F.shiftright("group_hash", shift).alias("prefix"))
        .agg(F.sum("size").alias("size"), F.min("group_hash").alias("low"), F.max("group_hash").alias("high"))
        .collect()
    )
    return [Range(shift, r.prefix, r.size, r.low, r.high) for r in found]


class _Order:
    """Ranges in order, with their running totals."""

    def __init__(self, ranges: list[Range]) -> None:
        self.ranges = sorted(ranges, key=lambda r: r.low)
        self.ends = np.cumsum([r.size for r in self.ranges]).astype(np.int64)
        self.starts = self.ends - np.array([r.size for r in self.ranges], np.int64)
        self.total = int(self.ends[-1])
        self.hit: set[int] = set()

    def down(self, place: int) -> int:
        """The last possible cut at or before a place."""
        if place >= self.total:
            return self.total
        k = int(np.searchsorted(self.ends, place, "right"))
        if self.ranges[k].divisible and place > self.starts[k]:
            self.hit.add(k)
            return place
        return int(self.starts[k])

    def up(self, place: int) -> int:
        """The first possible cut at or after a place."""
        if place <= 0:
            return 0
        k = int(np.searchsorted(self.ends, place, "left"))
        if self.ranges[k].divisible and place < self.ends[k]:
            self.hit.add(k)
            return place
        return int(self.ends[k])

    def fits(self, capacity: int, shards: int) -> bool:
        place = 0
        for _ in range(shards):
            after = self.down(place + capacity)
            if after >= self.total:
                return True
            if after == place:
                return False
            place = after
        return False

    def capacity(self, shards: int) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, shards) else (middle + 1, high)
        return low

    def cuts(self, shards: int) -> list[int]:
        """Cuts under the smallest capacity, each as near to an even share of the rest as it allows."""
        capacity = self.capacity(shards)
        self.hit.clear()
        self.fits(capacity, shards)
        earliest = [self.total]
        for _ in range(shards - 1):
            earliest.append(self.up(earliest[-1] - capacity))
        cuts, place = [], 0
        for left in range(shards - 1, 0, -1):
            least, most = max(place, earliest[left]), self.down(place + capacity)
            ideal = place + (self.total - place) // (left + 1)
            before, after = self.down(ideal), self.up(ideal)
            place = min(max(after if after - ideal < ideal - before else before, least), most)
            cuts.append(place)
        return cuts


def cut_hashes(groups: DataFrame, shards: int = SHARDS) -> list[int]:
    """Hashes at which the second, third, ... shard begins; left out where nothing follows."""
    ranges = _sums(groups, 64 - FIRST_BITS)
    while ranges:
        order = _Order(ranges)
        cuts = order.cuts(shards)
        split = [order.ranges[k] for k in order.hit]
        if not split:
            places = np.searchsorted(order.starts, cuts)
            return [order.ranges[k].low for k in places if k < len(order.ranges)]
        ranges = [r for k, r in enumerate(order.ranges) if k not in order.hit]
        for shift in {r.shift for r in split}:
            inside = F.shiftright("group_hash", shift).isin([r.prefix for r in split if r.shift == shift])
            ranges += _sums(groups.filter(inside), max(0, shift - MORE_BITS))
    return []


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Documents with equal texts stay together; a null text counts as an empty one and has size 1.
    Sizes of the shards are as near to equal as whole groups in this order allow: none is larger
    than the smallest possible largest one. A null doc_id stays null, repeated rows get a slot each,
    and no rows give no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group_hash"),
        ),
        "shard-sizes",
    )
    number = F.lit(0)
    for cut in cut_hashes(rows, shards):
        number = number + (F.col("group_hash") >= F.lit(cut)).cast("int")
    placed = rows.withColumn("shard", number).withColumn("_block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BLOCKS)))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "_block").count().select("shard", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("doc_id", "group_hash"))
    return (
        placed.withColumn("_within", within)
        .join(F.broadcast(offsets), ["shard", "_block"])  # at most shards * SLOT_BLOCKS rows
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_before") + F.col("_within") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
