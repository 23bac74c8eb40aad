import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import sharding


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        used, room = 1, middle
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def check(docs, shards=8):
    rows = sharding.shard(docs, shards).collect()
    inputs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    size = lambda r: len((r.text or "").encode()) + 1
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(((r.doc_id, size(r), zlib.crc32((r.text or "").encode())) for r in inputs), key=str)
    groups, held, place, slots = defaultdict(int), defaultdict(int), defaultdict(set), defaultdict(list)
    for r in inputs:
        groups[r.h] += size(r)
    for r in rows:
        held[r.shard] += r.size
        place[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(len(p) == 1 for p in place.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(held.values()) <= least_capacity([groups[h] for h in sorted(groups)], shards)
    return held


def test_tricky_and_empty(tricky, nothing):
    check(tricky)
    check(tricky, 3)
    assert sharding.shard(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_groups(spark, seed):
    rng = random.Random(seed)
    texts = [f"{rng.random()}" * rng.choice([1, 1, 1, 2, 30]) for _ in range(300)]
    rows = [(n, rng.choice(texts[: rng.choice([1, 300])])) for n in range(900)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rng.choice([2, 8]))


def test_whole_table(spark, folder):
    held = check(spark.read.parquet(f"{folder}/documents.parquet"))
    assert len(held) == 8 and max(held.values()) < 1.2 * min(held.values())


def test_one_group(spark):
    check(spark.createDataFrame([(n, "same") for n in range(20)], "doc_id bigint, text string"))
