import datetime

import pytest
from pyspark.sql import functions as F

from pagequarry import schemas
from pagequarry.operators import catalog, logs

UTC = datetime.timezone.utc


def uploads(spark, rows):
    """rows of (id, filename, second)"""
    full = [
        (i, name, None, None if second is None else datetime.datetime(2024, 1, 1, 0, 0, second, tzinfo=UTC), 1, "completed")
        for i, name, second in rows
    ]
    return spark.createDataFrame(
        full, "id bigint, filename string, file_path string, uploaded_at timestamp, num_chunks int, status string"
    )


@pytest.mark.parametrize(
    "name, ok",
    [("a.pdf", True), ("A.PDF", True), ("test.txt", False), ("a.pdf.txt", False), ("", False), (None, False), ("pdf", False)],
)
def test_gate(spark, name, ok):
    gated = catalog.gate(spark.createDataFrame([(name,)], "filename string"))
    assert catalog.accepted(gated).count() == int(ok)
    assert [(r["error_code"], r["error"]) for r in catalog.rejected(gated).collect()] == (
        [] if ok else [(400, catalog.ONLY_PDF)]
    )


def test_listing_is_newest_first_with_unknown_times_leading(spark):
    got = catalog.list_documents(uploads(spark, [(1, "a", 1), (2, "b", 3), (3, "c", None), (4, "d", 3)]))
    assert [r["id"] for r in got.collect()] == [3, 4, 2, 1]
    assert got.columns == ["id", "filename", "num_chunks", "status", "uploaded_at"]


def test_name_resolves_to_the_oldest_and_stands_where_the_newest_is(spark):
    table = uploads(spark, [(1, "x", 1), (2, "y", 2), (3, "x", 3)])
    assert [(r["filename"], r["id"]) for r in catalog.document_options(table).collect()] == [
        ("All Documents", None), ("x", 1), ("y", 2),
    ]


def test_a_document_named_like_the_sentinel_takes_its_place(spark):
    table = uploads(spark, [(1, "All Documents", 1), (2, "y", 2)])
    assert [(r["filename"], r["id"]) for r in catalog.document_options(table).collect()] == [
        ("All Documents", 1), ("y", 2),
    ]


def test_empty_catalogue(spark):
    nothing = schemas.empty(spark, "documents")
    assert catalog.list_documents(nothing).collect() == []
    assert [tuple(r)[:2] for r in catalog.document_options(nothing).collect()] == [("All Documents", None)]


def test_point_lookup(spark):
    table = uploads(spark, [(0, "a", 1), (1, "b", 2)])
    assert [r["filename"] for r in catalog.document_by_id(table, 0).collect()] == ["a"]
    assert catalog.document_by_id(table, 99999).count() == 0


def test_delete_removes_exactly_the_chunks_of_the_document(spark):
    table = uploads(spark, [(1, "a", 1), (2, "b", 2)])
    chunks = spark.range(10).select("id", (F.col("id") % 2 + 1).alias("document_id"))
    ids = catalog.small_ids(spark.createDataFrame([(2,), (99999,), (2,)], "document_id bigint"))
    report = {r["document_id"]: r for r in catalog.delete_report(table, ids).collect()}
    assert report[2]["message"] == catalog.DELETED and report[2]["filename"] == "b"
    assert (report[99999]["error_code"], report[99999]["error"]) == (404, "Document with id 99999 not found")
    assert len(report) == 2
    assert [r["id"] for r in catalog.without_documents(table, ids, "id").collect()] == [1]
    assert catalog.without_documents(chunks, ids, "document_id").count() == 5


def test_final_states(spark):
    rows = [(1, [(1, "text")], None), (2, [], None), (3, None, None), (4, None, "broken")]
    schema = "document_id bigint, pages array<struct<page_number:int,text:string>>, extract_error string"
    got = {r["document_id"]: r for r in catalog.finalise(spark.createDataFrame(rows, schema)).collect()}
    states = {n: (r["num_chunks"], r["status"], r["error_code"], r["error"]) for n, r in got.items()}
    assert states == {
        1: (1, "completed", None, None),
        2: (0, "failed", 400, catalog.NO_TEXT),
        3: (0, "failed", 400, catalog.NO_TEXT),
        4: (0, "failed", 500, catalog.PROCESS_FAILED),
    }


def test_stats_of_nothing(spark):
    tables = [schemas.empty(spark, name) for name in ("documents", "chunks", "query_logs")]
    assert logs.stats(*tables).first().asDict() == {
        "total_queries": 0, "avg_latency_ms": 0.0, "total_documents": 0, "total_chunks": 0,
    }


def test_stored_rows_are_checked(spark):
    good = uploads(spark, [(1, "a", 1)])
    assert schemas.conform(good, "documents").count() == 1
    for bad in (
        good.withColumn("filename", F.repeat(F.lit("x"), 256)),
        good.withColumn("status", F.lit("lost")),
        good.withColumn("filename", F.lit(None).cast("string")),
    ):
        with pytest.raises(Exception, match="longer|unknown status|NULL"):
            schemas.conform(bad, "documents").collect()


def test_create_tables_twice(spark):
    spark.sql("create database if not exists bootstrap_check")
    try:
        schemas.create_tables(spark, "bootstrap_check")
        schemas.create_tables(spark, "bootstrap_check")
        assert spark.table("bootstrap_check.chunks").columns == schemas.CHUNKS.fieldNames()
    finally:
        spark.sql("drop database bootstrap_check cascade")


def test_hot_bucket_percentiles(spark):
    """Most of the log in one bucket: exact percentiles from counted values."""
    entries = spark.range(100_000).select(
        "id", (F.col("id") % 101).cast("int").alias("latency_ms"), F.lit(1).alias("token_count"),
        F.lit("m").alias("model_used"), F.lit(datetime.datetime(2024, 1, 1, 5)).alias("created_at"),
    )
    row = logs.rollup(entries).first()
    assert (row["queries"], row["token_sum"], row["p50_latency_ms"], row["p95_latency_ms"]) == (100_000, 100_000, 50.0, 95.0)
