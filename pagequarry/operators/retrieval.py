"""Questions to ranked chunks."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.config import MAX_SHIPPED_BYTES, Settings
from pagequarry.operators.encoding import Encoder
from pagequarry.operators.joins import join_unique
from pagequarry.operators.topk import nearest
from pagequarry.session import materialise, row_bytes
from pagequarry.sources.clustered import ClusteredTable, merged_ranges, ranges_of, within

# Ranked rows whose ids are read at once to plan the fetch, and the most ids that are listed beside
# their ranges.
MOST_READ, MOST_LISTED = 100_000, 1_000
# Fixed value: the message users see.
NOTHING_FOUND = "No relevant content found. Please upload documents first."


def ask_within(queries: DataFrame) -> DataFrame:
    """Turn an optional document_id into the group restriction of the top-k join; 0 is an id."""
    if "document_id" not in queries.columns:
        return queries.withColumn("groups", F.lit(None).cast("array<bigint>"))
    bound = F.when(F.col("document_id").isNotNull(), F.array("document_id"))
    return queries.withColumn("groups", bound.cast("array<bigint>"))


def rank_chunks(
    chunks: DataFrame, queries: DataFrame, settings: Settings = Settings(), **limits: int
) -> DataFrame:
    """query_id, rank, id, similarity of the top-k chunks per query.

    `chunks` needs id, document_id and embedding; `queries` needs query_id and embedding and
    may have document_id, where NULL searches everywhere.
    """
    return nearest(
        chunks,
        ask_within(queries),
        settings.top_k,
        settings.embedding_dimension,
        group="document_id" if "document_id" in queries.columns else None,
        **limits,
    )


def _rows_near(chunks: DataFrame, ranked: DataFrame, ids: np.ndarray | None) -> DataFrame:
    """The chunks in the ranges that the winning ids fill; of few ids, just these."""
    if ids is None:
        return chunks.filter(within("id", ranges_of(ranked.select("id"), "id")))
    rows = chunks.filter(within("id", merged_ranges(ids, ids)))
    return rows.filter(F.col("id").isin(ids.tolist())) if len(ids) <= MOST_LISTED else rows


def describe_hits(ranked: DataFrame, chunks: DataFrame | ClusteredTable, written: bool = False) -> DataFrame:
    """Fetch the text of the winners only.

    The ranked rows are written once, unless the caller has `written` them. The scan for text is
    bound to the ranges of ids that winners fill, so that row groups without a winner are not read;
    of a clustered table only the files that hold winners are opened. What is left is joined. A
    chunk may be among the winners of most questions.
    """
    ranked = ranked if written else materialise(ranked, "ranked")
    head = ranked.select("id", row_bytes(ranked).alias("size")).limit(MOST_READ + 1).toArrow()
    few = head.num_rows <= MOST_READ and (pc.sum(head.column("size")).as_py() or 0) <= MAX_SHIPPED_BYTES
    ids = np.unique(head.column("id").drop_null().to_numpy()) if few else None
    if isinstance(chunks, DataFrame):
        rows = _rows_near(chunks, ranked, ids)
    else:
        rows = chunks.near("id", ranked.select("id").distinct())
    shown = rows.select("id", "document_id", "content", "page_number", "chunk_index")
    joined = F.broadcast(ranked).join(shown, "id") if few else join_unique(ranked, shown, "id")
    return joined.select(
        "query_id", "rank", "id", "document_id", "content", "page_number", "chunk_index", "similarity"
    )


def search(
    chunks: DataFrame, queries: DataFrame, settings: Settings = Settings(), **limits: int
) -> DataFrame:
    """Hits with content. Every chunk is a candidate: no threshold, status check or dedupe."""
    return describe_hits(rank_chunks(chunks, queries, settings, **limits), chunks)


def search_text(
    chunks: DataFrame,
    questions: DataFrame,
    encoder: Encoder,
    settings: Settings = Settings(),
    **limits: int,
) -> DataFrame:
    """Search with question text, encoded by the encoder that made the chunk vectors."""
    queries = questions.withColumn("embedding", encoder(F.col("query")))
    return search(chunks, queries, settings, **limits)


def unanswerable(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries without a single hit, as error rows."""
    return queries.join(hits.select("query_id"), "query_id", "left_anti").select(
        "query_id", F.lit(404).alias("error_code"), F.lit(NOTHING_FOUND).alias("error")
    )
