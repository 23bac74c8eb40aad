import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_text import expected_windows

from pagequarry.config import Settings
from pagequarry.operators.chunking import (
    chunk_documents,
    chunk_key,
    chunk_page_rows,
    count_chunks,
    number_chunks,
)
from pagequarry.sources.files import page_rows, split_pages

SMALL = Settings(chunk_size=100, chunk_overlap=20)
PAGES = "document_id bigint, pages array<struct<page_number:int,text:string>>"


def chunks(spark, pages, shape=Settings()):
    """Chunks of one document, from both forms, which must agree."""
    rows = chunk_documents(spark.createDataFrame([(1, pages)], PAGES), shape).collect()
    flat = spark.createDataFrame([(1, *p) for p in pages], "document_id bigint, page_number int, text string")
    other = chunk_page_rows(flat, shape).collect()
    key = lambda row: row["chunk_index"]
    got = [(r["chunk_index"], r["page_number"], r["content"]) for r in sorted(rows, key=key)]
    assert got == [(r["chunk_index"], r["page_number"], r["content"]) for r in sorted(other, key=key)]
    return got


def test_defaults():
    shape = Settings()
    assert (shape.window_chars, shape.overlap_chars, shape.top_k) == (2048, 200, 5)
    with pytest.raises(ValueError):
        Settings(chunk_size=50, chunk_overlap=50)
    with pytest.raises(ValueError):
        Settings(top_k=0)


def test_long_page(spark):
    assert len(chunks(spark, [(1, "A" * 3000)], SMALL)) == 10


def test_two_pages_are_numbered_through(spark):
    got = chunks(spark, [(1, "A" * 2000), (2, "B" * 2000)], SMALL)
    assert [index for index, _, _ in got] == list(range(14))
    assert [page for _, page, _ in got] == [1] * 7 + [2] * 7
    assert not any("A" in content and "B" in content for _, _, content in got)


def test_blank_page_has_no_chunk(spark):
    assert chunks(spark, [(1, "   ")], SMALL) == []
    assert chunks(spark, [(1, "")], SMALL) == []


def test_blank_page_keeps_the_numbers_of_the_others(spark):
    assert chunks(spark, [(1, " x "), (2, " "), (3, "y")]) == [(0, 1, "x"), (1, 3, "y")]


def test_tail_edge(spark):
    got = chunks(spark, [(1, "A" * 1848 + "B" * 200)])
    assert [c for _, _, c in got] == ["A" * 1848 + "B" * 200, "B" * 200]
    assert len(chunks(spark, [(1, "A" * 2047)])) == 1


def test_blank_window_does_not_use_an_index(spark):
    body = "a" * 400 + " " * 900 + "b" * 400
    got = chunks(spark, [(1, body)], SMALL)
    assert [index for index, _, _ in got] == list(range(len(got)))
    raw = [w.strip() for w in expected_windows(body, 400, 80)]
    assert "" in raw and [c for _, _, c in got] == [w for w in raw if w]


def test_windows_are_cut_by_code_point(spark):
    got = chunks(spark, [(1, "🙂" * 500)], SMALL)
    assert [len(c) for _, _, c in got] == [400, 180]


@settings(max_examples=8, deadline=None)
@given(
    documents=st.lists(
        st.lists(st.text(alphabet="xy \n", max_size=120), min_size=1, max_size=6), min_size=1, max_size=8
    )
)
def test_nothing_is_lost_and_indices_are_contiguous(spark, documents):
    shape = Settings(chunk_size=4, chunk_overlap=1)
    rows = [(n, [(p, t) for p, t in enumerate(pages, 1)]) for n, pages in enumerate(documents)]
    table = spark.createDataFrame(rows, PAGES)
    counted = {r["document_id"]: r["num_chunks"] for r in count_chunks(table, shape).collect()}
    found = {n: [] for n in range(len(documents))}
    for row in chunk_documents(table, shape).collect():
        found[row["document_id"]].append(row)
    for n, pages in enumerate(documents):
        mine = sorted(found[n], key=lambda r: r["chunk_index"])
        assert [r["chunk_index"] for r in mine] == list(range(counted[n]))
        for p, body in enumerate(pages, 1):
            expected = [w.strip() for w in expected_windows(body, 16, 4)]
            assert [r["content"] for r in mine if r["page_number"] == p] == [w for w in expected if w]


def test_one_document_with_most_of_the_pages(spark):
    """A document over several numbering blocks is numbered through like any other."""
    big = spark.range(1, 150_001).select(
        F.lit(7).cast("bigint").alias("document_id"), F.col("id").cast("int").alias("page_number"),
        F.when(F.col("id") % 3 == 0, " ").otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("text"),
    )
    rest = spark.range(8, 20).select(
        F.col("id").alias("document_id"), F.lit(1).alias("page_number"), F.lit("only").alias("text")
    )
    got = chunk_page_rows(big.unionByName(rest))
    mine = got.filter("document_id = 7")
    summary = mine.agg(F.count("*"), F.min("chunk_index"), F.max("chunk_index"), F.countDistinct("chunk_index")).first()
    assert tuple(summary) == (100_000, 0, 99_999, 100_000)
    assert mine.filter(F.col("page_number") != F.expr("chunk_index div 2 * 3 + chunk_index % 2 + 1")).count() == 0
    assert got.filter("document_id <> 7 and chunk_index <> 0").count() == 0


def test_consecutive_chunk_ids(spark):
    rows = [(5, 2), (9, 0), (1 << 42, 3), (70_000, 4), ((1 << 42) + 1, 1)]
    got = number_chunks(spark.createDataFrame(rows, "document_id bigint, num_chunks int")).collect()
    assert {r["document_id"]: r["first_chunk_id"] for r in got} == {
        5: 1, 9: 3, 70_000: 3, 1 << 42: 7, (1 << 42) + 1: 10,
    }


def test_chunk_key_orders_and_refuses_overflow(spark):
    rows = spark.createDataFrame([(1, 0), (1, 5), (2, 0)], "d bigint, i int")
    keys = [r[0] for r in rows.select(chunk_key(F.col("d"), F.col("i"))).collect()]
    assert keys == sorted(set(keys))
    with pytest.raises(Exception, match="more than"):
        spark.range(1).select(chunk_key(F.lit(1), F.lit(1 << 24))).collect()
    for wide in (-1, 1 << 39, (1 << 40) + 5):
        with pytest.raises(Exception, match="number_chunks"):
            spark.range(1).select(chunk_key(F.lit(wide), F.lit(0))).collect()


def test_form_feed_pages(spark):
    table = spark.createDataFrame([(1, "a\f\fb")], "document_id bigint, text string")
    pages = table.select(split_pages(F.col("text")).alias("p")).first()["p"]
    assert [(p["page_number"], p["text"]) for p in pages] == [(1, "a"), (3, "b")]
    rows = page_rows(table, "text").orderBy("page_number").collect()
    assert [(r["page_number"], r["text"]) for r in rows] == [(1, "a"), (3, "b")]


PAGES = "document_id bigint, pages array<struct<page_number:int,text:string>>"


def stored(spark, path, ids, parts):
    """Documents in the given order, in so many files."""
    rows = [(i, [(1, "x" * (1 + 700 * (n % 7))), (2, " ")]) for n, i in enumerate(ids)]
    for n in range(parts):
        size = -(-len(rows) // parts)
        spark.createDataFrame(rows[n * size : (n + 1) * size], PAGES).coalesce(1).write.mode("append").parquet(f"{path}/part={n:02}")
    return spark.read.schema(PAGES).parquet(path)


@pytest.mark.parametrize("ids,ordered", [(list(range(5, 500, 3)), True), ([], True), ([1 << 50, 3, 9, 2], False), ([1, 2, 2, 3], False), ([7], True)])
def test_consecutive_ids_in_document_order(spark, tmp_path, ids, ordered):
    from pagequarry.operators.chunking import chunk_in_order

    documents = stored(spark, str(tmp_path / "pages"), ids, 4) if ids else spark.createDataFrame([], PAGES)
    chunks = chunk_in_order(documents, first=10)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    if ids == sorted(set(ids)):
        assert all("Broadcast" in line for line in plan.split("\n") if "Exchange" in line), plan
    got = sorted((r["id"], r["document_id"], r["chunk_index"]) for r in chunks.collect())
    want = sorted((r["document_id"], r["chunk_index"]) for r in chunk_documents(documents).collect())
    if len(set(ids)) == len(ids):
        assert got == [(10 + n, *w) for n, w in enumerate(want)]


def test_documents_that_change_their_task_fail_the_job(spark, tmp_path):
    from pagequarry.operators import chunking

    documents = stored(spark, str(tmp_path / "pages"), list(range(40)), 4)
    found = chunking._tasks(documents, chunking.Settings())
    assert [t["chunks"] for t in found] and sum(t["chunks"] for t in found) == chunk_documents(documents).count()
    chunks = chunking.chunk_in_order(documents)
    real, chunking._tasks = chunking._tasks, lambda *_: [found[0].asDict() | {"last": 5, "first": 0, "rising": True, "task": 0}]
    try:
        with pytest.raises(Exception, match="other tasks"):
            chunking.chunk_in_order(documents).collect()
    finally:
        chunking._tasks = real
    assert chunks.count() > 0


@pytest.mark.parametrize("parts", [4, 40])
def test_files_that_are_read_in_another_order_keep_document_order(spark, tmp_path, parts):
    """Spark reads the largest files first, and several small ones in one task."""
    from pagequarry.operators.chunking import chunk_in_order

    path, ids = str(tmp_path / "pages"), list(range(5, 500, 3))
    size = -(-len(ids) // parts)
    for n in range(parts):  # each file is larger than the one before it
        rows = [(i, [(1, "".join(chr(97 + (i * k * k) % 26) for k in range(50 * (n + 1))))]) for i in ids[n * size : (n + 1) * size]]
        if rows:
            spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(f"{path}/part={n:02}")
    documents = spark.read.schema(PAGES).parquet(path)
    chunks = chunk_in_order(documents, first=10)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert all("Broadcast" in line for line in plan.split("\n") if "Exchange" in line), plan
    got = sorted((r["id"], r["document_id"], r["chunk_index"]) for r in chunks.collect())
    want = sorted((r["document_id"], r["chunk_index"]) for r in chunk_documents(documents).collect())
    assert got == [(10 + n, *w) for n, w in enumerate(want)]
