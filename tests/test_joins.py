import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import catalog, logs
from pagequarry.operators.joins import heavy_keys, join_unique
from pagequarry.session import fits, row_bytes

WAYS = {"broadcast": {}, "heavy keys broadcast": {"least_heavy": 50, "most_bytes": 200}, "heavy keys salted": {"least_heavy": 50, "most_bytes": 0}, "no heavy key": {"least_heavy": 10**6, "most_bytes": 0}}


def tables(spark):
    rng = random.Random(4)
    keys = ["hot"] * 900 + [None] * 300 + [f"k{rng.randrange(40)}" for _ in range(300)]
    rows = [(k, n % 7 or None, f"v{n}") for n, k in enumerate(keys)] * 2
    keyed = [("hot", 1)] + [(f"k{n}", n) for n in range(0, 60, 2)] + [(None, 5)]
    left = spark.createDataFrame(rows, "name string, `a.b` int, value string").repartition(6)
    return rows, keyed, left, spark.createDataFrame(keyed, "name string, found int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("way", list(WAYS))
def test_ways_agree(spark, how, way):
    rows, keyed, left, right = tables(spark)
    named = {k: v for k, v in keyed if k is not None}
    hit = [(k, a, v, named[k]) for k, a, v in rows if k in named]
    missed = [(k, a, v) for k, a, v in rows if k not in named]
    want = {"inner": hit, "left": hit + [(*m, None) for m in missed], "left_semi": [h[:3] for h in hit], "left_anti": missed}[how]
    got = join_unique(left, right, "name", how, **WAYS[way])
    assert got.columns == ["name", "a.b", "value"] + ["found"] * (how in ("inner", "left"))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_other_joins_are_refused(spark):
    _, _, left, right = tables(spark)
    with pytest.raises(ValueError):
        join_unique(left, right, "name", "right")


def test_empty_sides(spark):
    _, _, left, right = tables(spark)
    assert join_unique(left.limit(0), right, "name", most_bytes=0).count() == 0
    assert join_unique(left, right.limit(0), "name", "left", least_heavy=50, most_bytes=0).count() == left.count()


def test_heavy_keys_are_the_heaviest(spark):
    _, _, left, _ = tables(spark)
    assert heavy_keys(left, ["name"], 500) == [r[0] for r in spark.sql("select xxhash64('hot') union all select xxhash64(cast(null as string))").collect()]


def test_a_heavy_key_is_spread(spark):
    """The rows of a key that holds nearly all are dealt evenly to all shuffle partitions."""
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(50_000).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(1).alias("key"), "id")
        keyed = spark.range(0, 50_000, 2).select(F.col("id").alias("key"), F.lit("x").alias("x")).unionByName(spark.sql("select 1L as key, 'x' as x"))
        joined = join_unique(rows, keyed, "key", most_bytes=0)
        tasks = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(tasks) == 50_000 and max(tasks) < 3 * 50_000 / 24


def test_picker_and_log_with_heavy_keys(spark):
    documents = spark.createDataFrame([(n, f"f{n % 20}", None) for n in range(60)], "id bigint, filename string, uploaded_at timestamp")
    picked = spark.createDataFrame([(n, catalog.ALL_DOCUMENTS if n % 9 else f"f{n % 25}") for n in range(900)], "query_id bigint, filename string")
    plain = Counter(map(tuple, catalog.resolve_names(picked, documents).collect()))
    assert Counter(map(tuple, catalog.resolve_names(picked, documents, most_bytes=0, least_heavy=50).collect())) == plain
    chunks = spark.range(0, 30, 2).select("id", (F.col("id") % 3).alias("document_id"))
    entries = spark.createDataFrame([(n, [7, n % 40, None]) for n in range(300)] + [(300, []), (301, None)], "id bigint, retrieved_chunk_ids array<bigint>")
    plain = Counter(map(tuple, logs.logged_chunks(entries, chunks).collect()))
    assert sum(plain.values()) == 900
    assert Counter(map(tuple, logs.logged_chunks(entries, chunks, most_bytes=0, least_heavy=50).collect())) == plain
    wide = spark.createDataFrame([(n % 2 and 4, n) for n in range(500)], "document_id bigint, chunk_index bigint")
    plain = Counter(map(tuple, catalog.with_document(wide, documents).collect()))
    assert Counter(map(tuple, catalog.with_document(wide, documents, most_bytes=0, least_heavy=50).collect())) == plain


def test_fits_counts_rows_and_bytes(spark):
    names = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("name"), F.array(F.lit(1.0)).alias("v"), F.struct("id").alias("s"))
    size = names.agg(F.sum(row_bytes(names))).first()[0]
    assert 100 * 1072 <= size <= 100 * 1120
    assert fits(names, most_bytes=size) and not fits(names, most_bytes=size - 1) and not fits(names, most=99)
    assert fits(names.limit(0)) and not fits(names.limit(0), most_bytes=0)
