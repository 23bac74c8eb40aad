import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.operators import retrieval
from pagequarry.sources import clustered
from pagequarry.sources.clustered import ClusteredTable, merged_ranges, ranges_of, within, write_clustered


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """20,000 chunks, half of them of document 500."""
    path = str(tmp_path_factory.mktemp("clustered") / "chunks")
    document = F.when(F.col("id") % 2 == 0, 500).otherwise(F.floor(F.col("id") / 20))
    rows = spark.range(20_000).select(document.cast("bigint").alias("document_id"), "id")
    rows = rows.withColumn("content", F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(n)))) for n in range(8)]))
    rows = rows.withColumn("id", F.col("document_id") * (1 << 24) + F.col("id"))
    write_clustered(rows, path, ["document_id", "id"], 40)
    return ClusteredTable(spark, path)


def brute(table, column, values):
    values = {v for v in values if v is not None}
    return sorted(r["id"] for r in table.rows().collect() if r[column] in values)


@pytest.mark.parametrize("values", [[], [None], [3], [3, 3, None, -5, 10**15], [500], [499, 500, 501], list(range(0, 1000, 7)), list(range(-50, 2000))])
def test_fetch_by_document(spark, table, values):
    wanted = spark.createDataFrame([(v,) for v in values], "document_id bigint")
    assert sorted(r["id"] for r in table.fetch("document_id", wanted).collect()) == brute(table, "document_id", values)


@pytest.mark.parametrize("count", [0, 1, 50, 3000])
def test_fetch_by_id(spark, table, count):
    rng = random.Random(count)
    known = [r["id"] for r in table.rows().select("id").collect()]
    values = rng.sample(known, count) + [k + 1 for k in rng.sample(known, count)]
    assert sorted(r["id"] for r in table.fetch("id", spark.createDataFrame([(v,) for v in values], "id bigint")).collect()) == brute(table, "id", values)


def test_a_document_that_holds_half_of_the_rows_has_many_files(table):
    rows = table.index.filter(np.equal(table.index.column("low_document_id").to_numpy(), 500)).column("rows").to_pylist()
    assert len(rows) > 10 and max(table.index.column("rows").to_pylist()) < 3 * 20_000 / 40


def test_few_documents_open_few_files_and_filters_are_pushed(spark, table):
    wanted = spark.createDataFrame([(3,), (4,), (900,)], "document_id bigint")
    near = table.near("document_id", wanted)
    assert 1 <= len(near.inputFiles()) <= 4 < 30 < len(table.rows().inputFiles())
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "document_id" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_text_that_is_read_follows_the_winners(spark, table):
    """More winners than are ever listed, in one stretch of ids: few files are opened."""
    ids = table.rows().filter("document_id between 100 and 300").select("id")
    count = ids.count()
    assert count > retrieval.MOST_LISTED
    ranked = ids.select(F.lit(1).alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.5).alias("similarity"))
    near = table.near("id", ranked)
    assert near.count() < 1.5 * count
    assert len(near.inputFiles()) < 10 < len(table.rows().inputFiles())


@pytest.mark.parametrize("most_read", [100_000, 10])
def test_describe_hits_of_tables_and_clustered_tables(spark, table, monkeypatch, most_read):
    """Any number of winners, one of which wins for most questions."""
    monkeypatch.setattr(retrieval, "MOST_READ", most_read)
    full = table.rows().withColumns({"page_number": F.lit(1), "chunk_index": F.lit(0)})
    hot = full.agg(F.max("id")).first()[0]
    ranked = full.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(hot).alias("id"), F.lit(0.5).alias("similarity"))
    want = sorted((r[0], r[1], r[2]) for r in ranked.join(full, "id").select("query_id", "id", "content").collect())
    for chunks in (full, Paged(table)):
        hits = retrieval.describe_hits(ranked, chunks)
        assert hits.columns == ["query_id", "rank", "id", "document_id", "content", "page_number", "chunk_index", "similarity"]
        assert sorted((r["query_id"], r["id"], r["content"]) for r in hits.collect()) == want


class Paged:
    """The table with the columns that hits show."""

    def __init__(self, table):
        self.table = table

    def near(self, column, wanted):
        return self.table.near(column, wanted).withColumns({"page_number": F.lit(1), "chunk_index": F.lit(0)})


def test_ranges_cover_and_leave_out_the_widest_gaps(spark, monkeypatch):
    rng = np.random.default_rng(2)
    for most in (1, 3, 50):
        low = rng.integers(-(2**62), 2**62, 40)
        high = low + rng.integers(0, 2**58, 40)
        found = merged_ranges(low, high, most)
        assert len(found) <= most and all(any(a <= x and y <= b for a, b in found) for x, y in zip(low.tolist(), high.tolist()))
    assert merged_ranges(np.array([5, 1, 90, 2]), np.array([6, 1, 95, 2]), 2) == [(1, 6), (90, 95)]
    assert merged_ranges(np.array([], np.int64), np.array([], np.int64)) == []
    monkeypatch.setattr(clustered, "MOST_CELLS", 64)
    values = [-(2**63), -5, -4, 2**63 - 1, None, 77]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert ranges_of(frame, "v")[0][0] == -(2**63) and frame.filter(within("v", ranges_of(frame, "v"))).count() == 5
    assert ranges_of(frame.filter("v is null"), "v") == [] and frame.filter(within("v", [])).count() == 0


def test_files_out_of_order_are_refused(spark, tmp_path):
    path = str(tmp_path / "odd")
    write_clustered(spark.range(100).select("id", F.pmod(F.xxhash64("id"), F.lit(100)).alias("other")), path, ["id", "other"], 5)
    with pytest.raises(ValueError, match="order"):
        ClusteredTable(spark, path).near("other", spark.createDataFrame([(1,)], "other bigint"))
