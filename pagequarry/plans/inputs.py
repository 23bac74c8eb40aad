"""The test tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.sources.tables import scan, spread

# 2024-01-01 00:00:00 UTC, in seconds.
START = 1_704_067_200


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """document_id and a single page that holds the whole text."""
    table = spread(scan(spark, folder, "documents"), "doc_id")
    page = F.struct(F.lit(1).alias("page_number"), F.col("text").alias("text"))
    return table.select(F.col("doc_id").alias("document_id"), F.array(page).alias("pages"))


def catalogue(spark: SparkSession, folder: str, filename=None) -> DataFrame:
    """Uploaded documents, one second apart."""
    name = F.format_string("doc_%d.pdf", "doc_id") if filename is None else filename
    second = F.lit(START) + F.col("doc_id")
    return scan(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        name.alias("filename"),
        F.timestamp_seconds(second).alias("uploaded_at"),
        F.col("n_chars").cast("int").alias("num_chunks"),
        F.when(F.col("lang") == "en", "completed").otherwise("processing").alias("status"),
    )


def conversation_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page: a conversation is a document, a turn is a page."""
    return spread(scan(spark, folder, "conversations"), "conv_id", "turn").select(
        F.col("conv_id").alias("document_id"),
        (F.col("turn") + 1).cast("int").alias("page_number"),
        "text",
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every user turn."""
    return (
        scan(spark, folder, "conversations")
        .filter(F.col("role") == "user")
        .select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    )


def vector_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector as the single chunk of a page; its label is its document."""
    return spread(scan(spark, folder, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("bigint").alias("document_id"),
        F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("content"),
        (F.col("label") + 1).cast("int").alias("page_number"),
        F.lit(0).alias("chunk_index"),
        "embedding",
    )


def vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector as a query; the lower labels search in their own document only."""
    return scan(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("what is near vec "), F.col("vec_id").cast("string")).alias("query"),
        F.when(F.col("label") < 5, F.col("label").cast("bigint")).alias("document_id"),
        "embedding",
    )


def shape_logs(events: DataFrame) -> DataFrame:
    """Events as log rows; works on a stream as well."""
    return events.select(
        F.col("event_id").alias("id"),
        F.format_string("user %d asks about %s with %s, question %d", "user_id", "event_type", "props", "event_id").alias("query"),
        F.col("value").cast("int").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("token_count"),
        F.col("event_type").alias("model_used"),
        F.array(F.col("event_id") % 500, (F.col("event_id") * 7) % 500).alias("retrieved_chunk_ids"),
        F.col("ts").alias("created_at"),
    )


def event_logs(spark: SparkSession, folder: str) -> DataFrame:
    return shape_logs(scan(spark, folder, "events"))
