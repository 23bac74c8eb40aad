"""The document catalogue: gate, registration, listing, names, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.config import Settings
from pagequarry.functions.text import iso_timestamp
from pagequarry.operators.chunking import chunks_of
from pagequarry.schemas import LENGTH_LIMITS
from pagequarry.operators.joins import join_unique
from pagequarry.session import broadcast_if_small
from pagequarry.sources.clustered import ClusteredTable

# The messages users see.
ONLY_PDF = "Only PDF files are supported"
NO_TEXT = "No text could be extracted from PDF"
PROCESS_FAILED = "Failed to process document"
DELETED = "Document deleted successfully"
ALL_DOCUMENTS = "All Documents"

TOO_LONG = "{} is longer than {} characters"


def is_pdf_name(filename: Column) -> Column:
    """Decided by the name alone, in any case; no name is no."""
    return F.coalesce(F.endswith(F.lower(filename), F.lit(".pdf")), F.lit(False))


def gate(files: DataFrame) -> DataFrame:
    """Add error_code and error to files of the wrong type, or with a name or path that does not
    fit the catalogue; accepted files have NULL in both."""
    error = F.when(~is_pdf_name(F.col("filename")), ONLY_PDF)
    for name in ("filename", "file_path"):
        if name in files.columns:
            error = error.when(F.length(name) > LENGTH_LIMITS[name], TOO_LONG.format(name, LENGTH_LIMITS[name]))
    gated = files.withColumn("error", error)
    return gated.withColumn("error_code", F.when(F.col("error").isNotNull(), 400)).select(
        *files.columns, "error_code", "error"
    )


def accepted(gated: DataFrame) -> DataFrame:
    return gated.filter(F.col("error").isNull()).drop("error_code", "error")


def rejected(gated: DataFrame) -> DataFrame:
    return gated.filter(F.col("error").isNotNull())


def finalise(extracted: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Final state of each document from its pages and its extraction error.

    A file that cannot be read or has no text ends as failed with 0 chunks; it stays in the
    catalogue and does not affect the others.
    """
    failed = F.col("extract_error").isNotNull()
    textless = ~failed & (F.coalesce(F.size("pages"), F.lit(0)) == 0)
    return (
        extracted.withColumn("pages", F.when(~failed & ~textless, F.col("pages")))
        .withColumn(
            "num_chunks", F.coalesce(F.size(chunks_of(F.col("pages"), settings)), F.lit(0))
        )
        .withColumn("status", F.when(failed | textless, "failed").otherwise("completed"))
        .withColumn("error_code", F.when(failed, 500).when(textless, 400))
        .withColumn("error", F.when(failed, PROCESS_FAILED).when(textless, NO_TEXT))
    )


def counters() -> list[Column]:
    """What an ingest reports about finalised documents, as aggregates to observe or select."""
    return [
        F.count("*").alias("documents"),
        F.coalesce(F.sum(F.coalesce(F.size("pages"), F.lit(0))), F.lit(0)).alias("pages"),
        F.coalesce(F.sum("num_chunks"), F.lit(0)).alias("chunks"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed"),
    ]


def list_documents(documents: DataFrame) -> DataFrame:
    """Newest first; documents without an upload time lead, as in the source database."""
    return documents.orderBy(F.desc_nulls_first("uploaded_at"), F.desc("id")).select(
        "id", "filename", "num_chunks", "status", iso_timestamp(F.col("uploaded_at")).alias("uploaded_at")
    )


def document_by_id(documents: DataFrame, document_id: int) -> DataFrame:
    return documents.filter(F.col("id") == document_id)


def _named(documents: DataFrame) -> DataFrame:
    """One row per name and one for the sentinel, in no order."""
    spark = documents.sparkSession
    sentinel = spark.range(1).select(
        F.lit(ALL_DOCUMENTS).alias("filename"),
        F.lit(None).cast("bigint").alias("id"),
        F.lit(None).cast(documents.schema["uploaded_at"].dataType).alias("uploaded_at"),
        F.lit(True).alias("_sentinel"),
    )
    listed = documents.select(
        "filename", F.col("id").cast("bigint"), "uploaded_at", F.lit(False).alias("_sentinel")
    )
    upload = F.when(~F.col("_sentinel"), F.struct("uploaded_at", "id"))
    return (
        listed.unionByName(sentinel)
        .groupBy("filename")
        .agg(
            F.min_by("id", upload).alias("id"),
            F.max(upload).alias("_newest"),
            F.max("_sentinel").alias("_sentinel"),
        )
    )


def document_options(documents: DataFrame) -> DataFrame:
    """Choices of the document picker: name, id, in display order.

    The sentinel comes first with no id. Where several uploads share a name, the name stands
    where the newest one is listed and resolves to the oldest. A document that is called like
    the sentinel takes the sentinel's place.
    """
    ordered = _named(documents).orderBy(F.desc("_sentinel"), F.desc_nulls_last("_newest"))
    return ordered.select("filename", "id", F.col("_newest.uploaded_at").alias("last_uploaded_at"))


def resolve_names(questions: DataFrame, documents: DataFrame, **limits: int) -> DataFrame:
    """Replace the picked `filename` of each question by a document_id; NULL searches all.

    Most questions may pick one name, the sentinel as a rule; `limits` are those of `join_unique`.
    """
    options = _named(documents).select("filename", F.col("id").alias("document_id"))
    return join_unique(questions, options, "filename", "left", **limits).drop("filename")


def with_document(chunks: DataFrame, documents: DataFrame, **limits: int) -> DataFrame:
    """Chunks with the name of their document; a document may hold most chunks."""
    named = documents.select(F.col("id").alias("document_id"), "filename")
    return join_unique(chunks, named, "document_id", **limits)


def chunks_of_document(chunks: DataFrame, document_id: int) -> DataFrame:
    """The chunks of one document in reading order."""
    return chunks.filter(F.col("document_id") == document_id).orderBy("chunk_index")


def chunks_of_documents(chunks: ClusteredTable, wanted: DataFrame) -> DataFrame:
    """The chunks of many documents (document_id), from the files and row groups that hold them. In
    files as they are stored, the chunks of a document are in reading order."""
    return chunks.fetch("document_id", wanted)


def small_ids(ids: DataFrame, column: str = "document_id") -> DataFrame:
    """Distinct ids, marked for broadcast only when counting shows that they are few."""
    distinct = ids.select(F.col(column).cast("bigint").alias(column)).distinct()
    return broadcast_if_small(distinct)


def without_documents(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of documents or chunks that survive the deletion of `ids` (document_id)."""
    gone = ids.select(F.col("document_id").alias(key))
    return table.join(gone, key, "left_anti")


def delete_report(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per requested id: a confirmation, or an error where no such document exists."""
    known = documents.select(F.col("id").alias("document_id"), "filename", F.lit(True).alias("_known"))
    found = F.coalesce("_known", F.lit(False))
    missing = F.concat(F.lit("Document with id "), F.col("document_id").cast("string"), F.lit(" not found"))
    return ids.join(known, "document_id", "left").select(
        "document_id",
        "filename",
        F.when(found, DELETED).alias("message"),
        F.when(~found, 404).alias("error_code"),
        F.when(~found, missing).alias("error"),
    )


def status_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("status").agg(F.count("*").alias("documents"))
