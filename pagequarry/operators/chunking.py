"""Pages to overlapping chunks, numbered through each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pagequarry.config import Settings
from pagequarry.functions.text import is_blank, strip, windows
from pagequarry.operators.joins import join_unique
from pagequarry.operators.numbering import TASK_BITS, running_total

# A chunk key is the document id followed by this many bits of chunk index.
CHUNK_BITS = 24
DOCUMENT_BITS = 63 - CHUNK_BITS


def keep_text_pages(pages: Column) -> Column:
    """Drop blank pages of a pages array; the others keep their number and exact text."""
    return F.filter(pages, lambda page: ~is_blank(page["text"]))


def page_windows(text: Column, settings: Settings) -> Column:
    """Stripped, non-blank windows of one page."""
    raw = windows(text, settings.window_chars, settings.overlap_chars)
    return F.filter(F.transform(raw, strip), lambda content: content != "")


def chunks_of(pages: Column, settings: Settings) -> Column:
    """All chunks of a pages array, in reading order: array<struct<content, page_number>>."""
    per_page = F.transform(
        pages,
        lambda page: F.transform(
            page_windows(page["text"], settings),
            lambda content: F.struct(
                content.alias("content"), page["page_number"].alias("page_number")
            ),
        ),
    )
    return F.flatten(per_page)


def count_chunks(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents with `num_chunks`; a document without text keeps 0."""
    return documents.withColumn("num_chunks", F.size(chunks_of(F.col("pages"), settings)))


def chunk_documents(
    documents: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per chunk of documents whose pages are an array on the document row.

    Narrow: the array position is the chunk index, so nothing is shuffled and the same plan
    runs on a stream. Columns: document_id, chunk_index, page_number, content, plus `keep`.
    """
    return documents.select(
        "document_id", *keep, F.posexplode(chunks_of(F.col("pages"), settings))
    ).select(
        "document_id",
        F.col("pos").alias("chunk_index"),
        F.col("col.page_number").alias("page_number"),
        F.col("col.content").alias("content"),
        *keep,
    )


def chunk_page_rows(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per chunk of a table with one row per page.

    The text is shuffled once, by document and block of pages, so a document that holds most
    of the pages does not end in one task.
    """
    cut = pages.select(
        "document_id",
        "page_number",
        page_windows(F.col("text"), settings).alias("contents"),
    ).withColumn("num_windows", F.size("contents"))
    numbered = running_total(cut, ["document_id"], "page_number", "num_windows", "first_index")
    return numbered.select(
        "document_id", "page_number", "first_index", F.posexplode("contents")
    ).select(
        "document_id",
        (F.col("first_index") + F.col("pos")).cast("int").alias("chunk_index"),
        "page_number",
        F.col("col").alias("content"),
    )


def number_chunks(documents: DataFrame) -> DataFrame:
    """Add `first_chunk_id`: consecutive chunk ids 1, 2, 3, ... in document order."""
    totals = running_total(documents, [], "document_id", "num_chunks", "_earlier", wide=True)
    return totals.withColumn("first_chunk_id", F.col("_earlier") + 1).drop("_earlier")


# Runs of rising ids that a task may have; each is a row on the driver and in a broadcast table.
MOST_RUNS = 64
_TASKS = "task int, chunks bigint, first bigint, last bigint, rising boolean"


def _tasks(documents: DataFrame, settings: Settings) -> list[Row]:
    """Per task that reads the documents and run of rising ids in it, of which it has one per file or
    so: how many chunks they have, the first and last id. A task of more than MOST_RUNS runs is one
    that is not rising. Only ids and counts leave the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[int]] = []  # chunks, first, last
        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = (batch.column(n).to_numpy().astype(np.int64) for n in range(2))
            total += int(counts.sum())
            starts = np.r_[0, np.flatnonzero(np.diff(ids) <= 0) + 1]
            if len(runs) + len(starts) > MOST_RUNS + 1:
                runs = [[0, int(ids[0]), int(ids[-1])]] * (MOST_RUNS + 1)
                continue
            sums = np.add.reduceat(counts, starts)
            for first, last, size in zip(ids[starts].tolist(), ids[np.r_[starts[1:] - 1, len(ids) - 1]].tolist(), sums.tolist()):
                if runs and runs[-1][2] < first:
                    runs[-1] = [runs[-1][0] + size, runs[-1][1], last]
                else:
                    runs.append([size, first, last])
        rising = len(runs) <= MOST_RUNS
        runs = runs if rising else [[total, runs[0][1], runs[-1][2]]]
        if runs:
            task = TaskContext.get().partitionId()
            columns = [[task] * len(runs), *zip(*runs), [rising] * len(runs)]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], [part.split()[0] for part in _TASKS.split(", ")])

    counted = documents.select(F.col("document_id").cast("bigint"), F.coalesce(F.size(chunks_of(F.col("pages"), settings)), F.lit(0)).cast("bigint").alias("n"))
    return sorted(counted.mapInArrow(run, _TASKS).collect(), key=lambda row: row["task"])  # runs stay in order


def chunk_in_order(
    documents: DataFrame, settings: Settings = Settings(), first: int = 1, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Chunks of documents with consecutive ids `first`, `first` + 1, ... in document order.

    Documents whose files are in the order of their ids, which a counting pass checks, get them from
    one offset per task and file: no text is moved, in whatever order the files are read. Others meet their offsets in a join. `documents` must be
    read from a table, so that both passes have the same tasks; a row that comes up in another task
    fails the job. An id that occurs twice counts as out of order.
    """
    spark = documents.sparkSession
    tasks = _tasks(documents, settings)
    runs = sorted(tasks, key=lambda run: run["first"])
    ordered = all(t["rising"] for t in tasks) and all(a["last"] < b["first"] for a, b in zip(runs, runs[1:]))
    if not ordered:
        counted = number_chunks(count_chunks(documents, settings).select("document_id", "num_chunks"))
        placed = join_unique(documents, counted.select("document_id", "first_chunk_id"), "document_id")
        chunks = chunk_documents(placed, settings, ("first_chunk_id", *keep))
        return chunks.withColumn("id", F.col("first_chunk_id") + F.col("chunk_index") + F.lit(first - 1)).drop("first_chunk_id")
    earlier: dict[int, int] = {}
    inside = []  # chunks of earlier runs of the same task
    for t in tasks:
        inside.append(earlier.get(t["task"], 0))
        earlier[t["task"]] = inside[-1] + t["chunks"]
    before, rows = first, []
    for t, skipped in sorted(zip(tasks, inside), key=lambda pair: pair[0]["first"]):
        rows.append((t["task"], before - skipped, t["first"], t["last"]))
        before += t["chunks"]
    offsets = spark.createDataFrame(rows, "_run_task int, _before bigint, _first bigint, _last bigint")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    chunks = chunk_documents(documents, settings, keep).withColumns({"_task": F.spark_partition_id(), "_place": place})
    moved = F.raise_error(F.lit("documents were read by other tasks than they were counted by"))
    key = F.col("_before") + F.col("_place")
    # A row per task and file: the driver knows each of these anyway. Runs do not overlap.
    own = (F.col("_task") == F.col("_run_task")) & F.col("document_id").between(F.col("_first"), F.col("_last"))
    placed = chunks.join(F.broadcast(offsets), own, "left").withColumn("id", F.coalesce(key, moved.cast("bigint")))
    return placed.drop("_task", "_run_task", "_place", "_before", "_first", "_last")


def chunk_key(document_id: Column, chunk_index: Column) -> Column:
    """A unique chunk id in document and reading order that needs no counting pass.

    For document ids from 0 to 2**39 - 1; `number_chunks` numbers the chunks of any others.
    """
    full = F.raise_error(F.lit(f"a document has more than {1 << CHUNK_BITS} chunks"))
    wide = F.raise_error(F.lit(f"a document id is not between 0 and {(1 << DOCUMENT_BITS) - 1}; use number_chunks"))
    document_id = document_id.cast("bigint")
    key = F.shiftleft(document_id, CHUNK_BITS) + chunk_index
    return (
        F.when(chunk_index >= (1 << CHUNK_BITS), full.cast("bigint"))
        .when(~document_id.between(0, (1 << DOCUMENT_BITS) - 1), wide.cast("bigint"))
        .otherwise(key)
    )


def document_of(key: Column) -> Column:
    """The document id inside a chunk key."""
    return F.shiftright(key, CHUNK_BITS)
