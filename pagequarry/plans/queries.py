"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.config import Settings
from pagequarry.functions import display, vectors
from pagequarry.functions.text import iso_timestamp, utc_instant
from pagequarry.operators import ann, answering, catalog, logs, retrieval
from pagequarry.operators.chunking import (
    chunk_documents,
    chunk_in_order,
    chunk_key,
    chunk_page_rows,
    count_chunks,
    document_of,
    number_chunks,
)
from pagequarry.operators.encoding import attach_vectors, embed, lexical_encoder
from pagequarry.operators.joins import join_unique
from pagequarry.operators.topk import nearest
from pagequarry.plans import inputs, lifecycle
from pagequarry.session import broadcast_if_small, materialise, row_bytes, scratch_path
from pagequarry.sources.clustered import ClusteredTable, write_clustered
from pagequarry.sources.files import page_rows
from pagequarry.sources.tables import scan, spread
from pagequarry.streaming import flows

TEXT = Settings()
TURNS = Settings(chunk_size=100, chunk_overlap=20)
VECTORS = Settings(embedding_dimension=64)
ANN_PROBES = 10
CLUSTERED_FILES = 16
# The least rows, and about the bytes, of a file that a stream takes.
LEAST_FILE_ROWS, STREAM_FILE_BYTES = 100, 32 * 1024 * 1024

Query = Callable[[SparkSession, str], DataFrame]


def _shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("similarity", F.round("similarity", 4))


# Chunking


def chunks_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_documents(inputs.text_documents(spark, folder), TEXT)


def chunks_of_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_page_rows(inputs.conversation_pages(spark, folder), TURNS)


def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = count_chunks(inputs.text_documents(spark, folder), TEXT)
    return number_chunks(counted.select("document_id", "num_chunks"))


def chunk_wide_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive chunk ids for document ids beyond the range of chunk keys; texts stay where they
    are read."""
    page = F.struct(F.lit(1).alias("page_number"), F.col("text").alias("text"))
    key = F.col("doc_id") * (1 << 33) + (1 << 40)
    wide = scan(spark, folder, "documents").select(key.alias("document_id"), F.array(page).alias("pages"))
    return chunk_in_order(wide, TEXT).select("id", "document_id", "chunk_index")


def page_split(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose lines are pages."""
    paged = scan(spark, folder, "documents").select(
        F.col("doc_id").alias("document_id"), F.translate("text", "\n", "\f").alias("text")
    )
    return page_rows(paged, "text")


def keyed_chunks(documents: DataFrame) -> DataFrame:
    """Chunks of documents with their ids."""
    return chunk_documents(documents, TEXT).withColumn(
        "id", chunk_key(F.col("document_id"), F.col("chunk_index"))
    )


# Encoding and retrieval


def lexical_encode(spark: SparkSession, folder: str) -> DataFrame:
    """The non-zero vector entries of every chunk."""
    encoded = embed(keyed_chunks(inputs.text_documents(spark, folder)), lexical_encoder())
    return (
        encoded.select("document_id", "chunk_index", F.posexplode("embedding").alias("bucket", "tf"))
        .filter(F.col("tf") > 0)
        .withColumn("tf", F.col("tf").cast("int"))
    )


def lexical_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Search from raw text. The winners, k rows per question, are written once; then only their
    documents are cut again to fetch the text."""
    encoder = lexical_encoder()
    documents = inputs.text_documents(spark, folder)
    queries = inputs.questions(spark, folder).withColumn("embedding", encoder(F.col("query")))
    ranked = retrieval.rank_chunks(embed(keyed_chunks(documents), encoder), queries, TEXT)
    winners = materialise(ranked, "winners")
    winning = winners.select(document_of(F.col("id")).alias("document_id")).distinct()
    held = keyed_chunks(join_unique(documents, winning, "document_id", "left_semi"))
    return retrieval.describe_hits(winners, held, written=True)


def lexical_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = lexical_hits(spark, folder)
    return _shown(hits).select("query_id", "rank", "document_id", "chunk_index", "page_number", "similarity")


def vector_hits(spark: SparkSession, folder: str, bound: bool = False) -> DataFrame:
    queries = inputs.vector_queries(spark, folder)
    chosen = queries if bound else queries.drop("document_id")
    return retrieval.search(inputs.vector_chunks(spark, folder), chosen, VECTORS)


def retrieval_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(vector_hits(spark, folder))


def retrieval_doc_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(vector_hits(spark, folder, bound=True))


def retrieval_no_match(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector asks in the document of twice its label; half of these do not exist."""
    queries = scan(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        (F.col("label") * 2).cast("bigint").alias("document_id"),
        "embedding",
    )
    ranked = retrieval.rank_chunks(inputs.vector_chunks(spark, folder), queries, VECTORS)
    return retrieval.unanswerable(queries, ranked)


def vector_zip(spark: SparkSession, folder: str) -> DataFrame:
    chunks = inputs.vector_chunks(spark, folder)
    paired = attach_vectors(chunks.drop("embedding"), chunks.select("id", "embedding"), ["id"])
    return paired.select("id", "content", F.size("embedding").alias("dimensions"))


def retrieval_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector asks, in rounds of 250; a third of the vectors are one document, and every other
    query is bound to its own."""
    third = F.when(F.col("vec_id") % 3 == 0, 0).otherwise(F.col("label") + 1).cast("bigint")
    table = scan(spark, folder, "embeddings")
    chunks = table.select(F.col("vec_id").alias("id"), third.alias("document_id"), "embedding")
    queries = table.select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 2 == 0, third).alias("document_id"), "embedding")
    limits = {"max_shipped_bytes": 0, "cell_queries": 250, "cell_chunks": 200}
    return _shown(retrieval.rank_chunks(chunks, queries, VECTORS, **limits)).select("query_id", "rank", "id", "similarity")


def clustered_chunks(spark: SparkSession, folder: str) -> ClusteredTable:
    """All chunks of the documents, in sorted files with an index."""
    path = scratch_path(spark, "clustered")
    chunks = keyed_chunks(inputs.text_documents(spark, folder))
    write_clustered(chunks, path, ["document_id", "id"], CLUSTERED_FILES)
    return ClusteredTable(spark, path)


def fetch_winners(spark: SparkSession, folder: str) -> DataFrame:
    """The text of as many winners as there are chunks: chunk i wins for itself and, in rank 2, for
    the chunk of the next document at its place."""
    table = clustered_chunks(spark, folder)
    ids = table.rows().select("id", "document_id", "chunk_index")
    own = ids.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(1.0).alias("similarity"))
    other = chunk_key(F.col("document_id") + 1, F.col("chunk_index"))
    ranked = own.unionByName(ids.select(other.alias("query_id"), F.lit(2).alias("rank"), "id", F.lit(0.5).alias("similarity")))
    return retrieval.describe_hits(ranked, table)


def lookup_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of all documents that are labelled as poor, with what came before in reading
    order; ids that do not exist give nothing."""
    poor = scan(spark, folder, "labels").filter("quality = 0").select(F.col("doc_id").alias("document_id"))
    wanted = poor.unionByName(poor.select((F.col("document_id") + (1 << 30)).alias("document_id")))
    return catalog.chunks_of_documents(clustered_chunks(spark, folder), wanted).select("document_id", "chunk_index", "page_number", "content")


# Answers


def build_context(spark: SparkSession, folder: str) -> DataFrame:
    gathered = answering.gather_hits(vector_hits(spark, folder, bound=True))
    return gathered.select("query_id", answering.context(F.col("hits")).alias("context"))


def build_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: documents to chunks to vectors, every user turn to its prompt."""
    questions = inputs.questions(spark, folder)
    return answering.prepare_prompts(questions, lexical_hits(spark, folder)).select("query_id", "prompt")


def query_sources(spark: SparkSession, folder: str) -> DataFrame:
    gathered = answering.gather_hits(lexical_hits(spark, folder))
    listed = gathered.select("query_id", F.posexplode(answering.sources(F.col("hits"))).alias("pos", "source"))
    return listed.select(
        "query_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("source.id").alias("chunk_id"),
        F.col("source.content").alias("content"),
        F.col("source.page_number").alias("page_number"),
        F.col("source.similarity_score").alias("similarity_score"),
    )


def cited_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Hits by document name and page, the short form of a source."""
    hits = lexical_hits(spark, folder).select("query_id", "rank", "document_id", "page_number", "similarity")
    named = catalog.with_document(hits, inputs.catalogue(spark, folder))
    return named.select(
        "query_id",
        "rank",
        F.col("filename").alias("document"),
        F.col("page_number").alias("page"),
        F.round("similarity", 2).alias("score"),
    )


def counting_responder(prompts: pd.Series, settings: Settings) -> pd.DataFrame:
    """Stands in for a language model: says how much it was given."""
    length = prompts.str.len()
    return pd.DataFrame(
        {
            "answer": "read " + length.astype(str) + " characters",
            "prompt_tokens": length // 4,
            "completion_tokens": 3,
            "model": settings.answer_model,
        }
    )


def answered(spark: SparkSession, folder: str) -> DataFrame:
    questions = inputs.vector_queries(spark, folder).select("query_id", "query")
    prompts = answering.prepare_prompts(questions, vector_hits(spark, folder))
    return answering.answer(prompts, counting_responder, VECTORS)


def answer_queries(spark: SparkSession, folder: str) -> DataFrame:
    reply = ["answer", "prompt_tokens", "completion_tokens", "total_tokens", "model", "error_code", "error"]
    return answered(spark, folder).select("query_id", *[F.col(f"reply.{name}").alias(name) for name in reply])


def picky_responder(prompts: pd.Series, settings: Settings) -> pd.DataFrame:
    """Fails a whole call that holds a question about a vector whose number ends in 7."""
    if prompts.str.contains(r"vec \d*7\n\nAnswer:$").any():
        raise ValueError("not this one")
    return counting_responder(prompts, settings)


def answer_failing(spark: SparkSession, folder: str) -> DataFrame:
    """Answers where every tenth prompt fails its call, sent in calls of 32 or so: no prompt is sent
    more often than halving needs."""
    questions = inputs.vector_queries(spark, folder).select("query_id", "query")
    prompts = answering.prepare_prompts(questions, vector_hits(spark, folder))
    shape = replace(VECTORS, call_tokens=2_000)
    replies = answering.answer(prompts, picky_responder, shape)
    return replies.select("query_id", *[F.col(f"reply.{name}").alias(name) for name in ("answer", "error_code", "error")], (F.col("reply.attempts") <= 12).alias("few_attempts"))


DELAY_MS = 3


def silent_responder(prompts: pd.Series, settings: Settings) -> pd.DataFrame:
    """Has nothing to say about vectors of an even number."""
    said = counting_responder(prompts, settings)
    said.loc[prompts.str.contains(r"vec \d*[02468]\n\nAnswer:$"), "answer"] = None
    return said


def answer_nothing(spark: SparkSession, folder: str) -> DataFrame:
    """An answer without text is an empty answer, and is logged."""
    questions = inputs.vector_queries(spark, folder).select("query_id", "query")
    prompts = answering.prepare_prompts(questions, vector_hits(spark, folder))
    entries = answering.log_rows(answering.responses(answering.answer(prompts, silent_responder, VECTORS)))
    return entries.select("query_id", "answer", "token_count")


def slow_send(asked: dict) -> dict:
    """Stands in for a chat service: waits, and says what it was asked."""
    time.sleep(DELAY_MS / 1000)
    system, user = asked["messages"]
    return {
        "answer": f"{asked['model']} {asked['temperature']} {asked['max_tokens']} {len(system['content'])} {len(user['content'])}",
        "prompt_tokens": 1,
        "completion_tokens": 2,
    }


def answer_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Each question has a latency of its own: its part of the search, set to one second, and the
    time that the service took for its prompt alone."""
    questions = inputs.vector_queries(spark, folder).select("query_id", "query")
    prompts = answering.prepare_prompts(questions, vector_hits(spark, folder)).withColumn("search_us", F.lit(1_000_000))
    entries = answering.log_rows(answering.responses(answering.answer(prompts, answering.chat_responder(slow_send), VECTORS)))
    return entries.select("query_id", "answer", "token_count", F.col("latency_ms").between(1_000 + DELAY_MS, 1_000 + DELAY_MS + 1_000).alias("in_time"))


def log_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Log entries, with a clock that depends on the query only."""
    start = F.timestamp_seconds(F.lit(inputs.START))
    micros = F.lit(inputs.START * 1_000_000) + F.col("query_id") * 1_000_777
    timed = (
        answered(spark, folder)
        .withColumn("started_at", start)
        .withColumn("reply", F.col("reply").withField("finished_us", micros))
    )
    entries = answering.log_rows(answering.responses(timed))
    ids = F.transform("retrieved_chunk_ids", lambda chunk: chunk.cast("string"))
    return entries.withColumn("retrieved_chunk_ids", F.array_join(ids, ","))


# Catalogue


def file_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents named after their language: .pdf, .PDF, .txt and no name."""
    stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    lang = F.col("lang")
    name = (
        F.when(lang == "en", F.concat(stem, F.lit(".pdf")))
        .when(lang == "de", F.concat(stem, F.lit(".PDF")))
        .when(lang == "fr", F.concat(stem, F.lit(".pdf.txt")))
    )
    named = scan(spark, folder, "documents").select(F.col("doc_id").alias("id"), name.alias("filename"))
    return catalog.gate(named)


def gate_long_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names and paths that do not fit, by language: each is an error row, none fails the others."""
    stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    lang = F.col("lang")
    files = scan(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(stem, F.when(lang == "fr", F.repeat(F.lit("x"), 300)).otherwise(""), F.lit(".pdf")).alias("filename"),
        F.concat(F.when(lang == "de", F.repeat(F.lit("/y"), 300)).otherwise("/"), stem).alias("file_path"),
    )
    return catalog.gate(files).select("id", "error_code", "error")


def documents_list(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.list_documents(inputs.catalogue(spark, folder))


def document_options(spark: SparkSession, folder: str) -> DataFrame:
    options = catalog.document_options(inputs.catalogue(spark, folder, F.col("source")))
    return options.withColumn("last_uploaded_at", iso_timestamp(F.col("last_uploaded_at")))


def picked_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every user turn with a picked name: a source, the sentinel, or an unknown name."""
    source = F.concat(F.lit("src"), (F.length("query") % 25).cast("string"))
    name = F.when(F.length("query") % 25 == 0, catalog.ALL_DOCUMENTS).otherwise(source)
    picked = inputs.questions(spark, folder).select("query_id", name.alias("filename"))
    return catalog.resolve_names(picked, inputs.catalogue(spark, folder, F.col("source")))


def picked_mostly_all(spark: SparkSession, folder: str) -> DataFrame:
    """As where neither the names nor the heavy ones may be broadcast, and the sentinel holds most rows."""
    name = F.when(F.length("query") % 9 == 0, F.concat(F.lit("src"), (F.length("query") % 25).cast("string"))).otherwise(catalog.ALL_DOCUMENTS)
    picked = inputs.questions(spark, folder).select("query_id", name.alias("filename"))
    return catalog.resolve_names(picked, inputs.catalogue(spark, folder, F.col("source")), least_heavy=20, most_bytes=0)


def chunk_with_document(spark: SparkSession, folder: str) -> DataFrame:
    chunks = chunks_of_documents(spark, folder).select(
        "document_id", "chunk_index", "page_number", F.length("content").alias("length")
    )
    return catalog.with_document(chunks, inputs.catalogue(spark, folder))


def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    toxic = scan(spark, folder, "labels").filter(F.col("toxic") == 1)
    return catalog.small_ids(toxic.select(F.col("doc_id").alias("document_id")))


def delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of documents and chunks once the toxic documents are deleted."""
    gone = toxic_documents(spark, folder)
    documents = catalog.without_documents(inputs.catalogue(spark, folder), gone, "id")
    chunks = catalog.without_documents(chunks_of_documents(spark, folder), gone, "document_id")
    left = documents.select(
        F.lit("documents").alias("from_table"), F.col("id").alias("document_id"),
        F.lit(None).cast("int").alias("chunk_index"),
    )
    return left.unionByName(chunks.select(F.lit("chunks").alias("from_table"), "document_id", "chunk_index"))


def delete_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for twice each labelled id: about half of these documents do not exist."""
    twice = scan(spark, folder, "labels").select((F.col("doc_id") * 2).alias("document_id"))
    return catalog.delete_report(inputs.catalogue(spark, folder), catalog.small_ids(twice))


def ingested(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which one language has no text and one source cannot be read."""
    table = spread(scan(spark, folder, "documents"), "doc_id")
    text = F.when(F.col("lang") == "de", F.lit(" \n\t")).otherwise(F.col("text"))
    page = F.struct(F.lit(1).alias("page_number"), text.alias("text"))
    pages = F.filter(F.array(page), lambda p: F.btrim(p["text"], F.lit(" \n\t")) != "")
    broken = F.col("source") == "src0"
    extracted = table.select(
        F.col("doc_id").alias("document_id"),
        F.when(~broken, pages).alias("pages"),
        F.when(broken, F.lit("cannot read")).alias("extract_error"),
    )
    return catalog.finalise(extracted, TEXT)


def ingest_status(spark: SparkSession, folder: str) -> DataFrame:
    return ingested(spark, folder).select("document_id", "num_chunks", "status", "error_code", "error")


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.status_counts(ingested(spark, folder))


def ingest_counters(spark: SparkSession, folder: str) -> DataFrame:
    return ingested(spark, folder).agg(*catalog.counters())


# Logs and statistics


def stats(spark: SparkSession, folder: str) -> DataFrame:
    documents = inputs.catalogue(spark, folder)
    return logs.stats(documents, keyed_chunks(inputs.text_documents(spark, folder)), inputs.event_logs(spark, folder))


def stats_empty(spark: SparkSession, folder: str) -> DataFrame:
    """Nothing has been logged with a negative latency, so the average is 0."""
    none = inputs.event_logs(spark, folder).filter(F.col("latency_ms") < 0)
    return logs.stats(inputs.catalogue(spark, folder), inputs.vector_chunks(spark, folder), none)


def logs_recent(spark: SparkSession, folder: str) -> DataFrame:
    return logs.recent(inputs.event_logs(spark, folder))


def log_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return logs.rollup(inputs.event_logs(spark, folder))


def log_dangling(spark: SparkSession, folder: str) -> DataFrame:
    """Logged chunks that are gone once the documents 3 and 4 are deleted."""
    chunks = inputs.vector_chunks(spark, folder).filter(~F.col("document_id").isin(3, 4))
    return logs.dangling(inputs.event_logs(spark, folder), chunks)


def unscored(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of label 0 are zeros here, and every query is bound to its own label: those of label 0
    find rows without a score, in the order of their ids."""
    own = F.transform("embedding", lambda x: F.when(F.col("label") == 0, F.lit(0.0)).otherwise(x).cast("float"))
    table = scan(spark, folder, "embeddings").withColumn("embedding", own)
    chunks = table.select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("document_id"), "embedding")
    queries = chunks.withColumnRenamed("id", "query_id")
    return _shown(retrieval.rank_chunks(chunks, queries, VECTORS)).select("query_id", "rank", "id", "similarity")


def document_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One document of the catalogue."""
    found = catalog.document_by_id(inputs.catalogue(spark, folder), 7)
    return found.select("id", "filename", "num_chunks", "status")


# Display


def presentation_sources(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_hits(spark, folder).select(
        "query_id",
        "rank",
        display.source_heading(F.col("page_number"), F.round("similarity", 4)).alias("heading"),
        display.similarity_label(F.round("similarity", 4)).alias("similarity_label"),
        display.source_preview(F.col("content")).alias("preview"),
    )


def presentation_documents(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.catalogue(spark, folder).select(
        "id",
        display.chunk_label(F.col("num_chunks")).alias("chunk_label"),
        display.status_colour(F.col("status")).alias("colour"),
    )


def presentation_logs(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.event_logs(spark, folder).select(
        "id",
        display.query_preview(F.col("query")).alias("preview"),
        display.answer_caption(F.col("latency_ms"), F.col("token_count"), F.col("model_used")).alias("caption"),
        display.latency_label(F.col("latency_ms")).alias("latency_label"),
    )


# Approximate search


def _lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    chunks = inputs.vector_chunks(spark, folder)
    centroids = materialise(ann.sample_centroids(chunks, VECTORS.ann_lists), "centroids")
    return ann.assign_lists(chunks, centroids, VECTORS.embedding_dimension), centroids


def ann_assign(spark: SparkSession, folder: str) -> DataFrame:
    return _lists(spark, folder)[0].select("id", "list_id")


def ann_list_distance(spark: SparkSession, folder: str) -> DataFrame:
    """How far every vector is from the centre of its list."""
    assigned, centroids = _lists(spark, folder)
    distance = vectors.cosine_distance(F.col("embedding"), F.col("centroid"))
    return assigned.join(broadcast_if_small(centroids, ann.MAX_LISTS), "list_id").select(
        "id", "list_id", F.round(distance, 4).alias("distance")
    )


def ann_sample_probe(spark: SparkSession, folder: str) -> DataFrame:
    assigned, centroids = _lists(spark, folder)
    queries = inputs.vector_queries(spark, folder).drop("document_id")
    return _shown(ann.search_lists(assigned, queries, centroids, ANN_PROBES, VECTORS))


def ann_doc_filter(spark: SparkSession, folder: str) -> DataFrame:
    assigned, centroids = _lists(spark, folder)
    queries = inputs.vector_queries(spark, folder)
    return _shown(ann.search_lists(assigned, queries, centroids, ANN_PROBES, VECTORS))


def ann_sample_recall(spark: SparkSession, folder: str) -> DataFrame:
    assigned, centroids = _lists(spark, folder)
    queries = inputs.vector_queries(spark, folder).drop("document_id")
    found = ann.search_lists(assigned, queries, centroids, ANN_PROBES, VECTORS)
    return ann.recall(found, retrieval.rank_chunks(assigned, queries, VECTORS))


def ann_kmeans_recall(spark: SparkSession, folder: str) -> DataFrame:
    """With every list probed, trained lists lose nothing."""
    chunks = inputs.vector_chunks(spark, folder)
    centroids = ann.kmeans_centroids(chunks, VECTORS.ann_lists)
    assigned = ann.assign_lists(chunks, centroids, VECTORS.embedding_dimension)
    queries = inputs.vector_queries(spark, folder).drop("document_id")
    found = ann.search_lists(assigned, queries, centroids, VECTORS.ann_lists, VECTORS)
    return ann.recall(found, retrieval.rank_chunks(chunks, queries, VECTORS))


def ann_kmeans_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the list of every vector is the one that the top-k join finds closest."""
    chunks = inputs.vector_chunks(spark, folder)
    centroids = ann.kmeans_centroids(chunks, VECTORS.ann_lists)
    assigned = ann.assign_lists(chunks, centroids, VECTORS.embedding_dimension)
    closest = nearest(
        centroids.select(F.col("list_id").cast("bigint").alias("id"), F.col("centroid").alias("embedding")),
        chunks.select(F.col("id").alias("query_id"), "embedding"),
        1,
        VECTORS.embedding_dimension,
    )
    named = closest.select(F.col("query_id").alias("id"), F.col("id").alias("closest"))
    return assigned.join(named, "id").select("id", (F.col("list_id") == F.col("closest")).alias("agrees"))


# Streams


def _follow(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files."""
    # A stream takes a single file only where a pattern names it.
    return flows.follow(spark, f"{folder}/[{table[0]}]{table[1:]}.parquet", "*.parquet", scan(spark, folder, table).schema)


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    page = F.struct(F.lit(1).alias("page_number"), F.col("text").alias("text"))
    documents = _follow(spark, folder, "documents").select(
        F.col("doc_id").alias("document_id"), F.array(page).alias("pages")
    )
    target = scratch_path(spark, "stream-chunks")
    flows.ingest(documents, target, scratch_path(spark, "progress"), TEXT).awaitTermination()
    return spark.read.parquet(target).select("document_id", "chunk_index", "page_number", "content")


def stream_log_append(spark: SparkSession, folder: str) -> DataFrame:
    entries = inputs.shape_logs(_follow(spark, folder, "events"))
    target = scratch_path(spark, "stream-logs")
    flows.append_logs(entries, target, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(target).select(
        "id", "query", "latency_ms", "token_count", "model_used", "created_at"
    )


def stream_stats(spark: SparkSession, folder: str) -> DataFrame:
    entries = inputs.shape_logs(_follow(spark, folder, "events"))
    target = scratch_path(spark, "stream-stats")
    flows.live_stats(entries, target, scratch_path(spark, "progress")).awaitTermination()
    return flows.latest_stats(spark, target)


def _in_files(table: DataFrame, batches: int) -> tuple[str, int]:
    """A copy of a table in files of bounded size, for streams that take an equal part of them at a
    time, and how many files are one part."""
    path = scratch_path(table.sparkSession, "files")
    rows, size = table.agg(F.count("*"), F.coalesce(F.sum(row_bytes(table)), F.lit(0))).first()
    each = max(1, min(-(-size // (batches * STREAM_FILE_BYTES)), rows // (batches * LEAST_FILE_ROWS)))
    table.repartition(batches * each).write.parquet(path)
    return path, each


def stream_model_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics per model from a stream of three batches."""
    table = scan(spark, folder, "events")
    path, files = _in_files(table, 3)
    stream = flows.follow(spark, path, "*.parquet", table.schema, maxFilesPerTrigger=files)
    target = scratch_path(spark, "stream-stats")
    flows.live_stats(inputs.shape_logs(stream), target, scratch_path(spark, "progress"), by="model_used").awaitTermination()
    return flows.latest_stats(spark, target, "model_used")


def stream_counters(spark: SparkSession, folder: str) -> DataFrame:
    """What a stream of two batches says that it has ingested; a third of the texts are blank."""
    text = F.when(F.col("doc_id") % 3 == 0, F.lit(" \n")).otherwise(F.col("text"))
    page = F.struct(F.lit(1).alias("page_number"), text.alias("text"))
    table = scan(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.array(page).alias("pages"))
    path, files = _in_files(table, 2)
    stream = flows.follow(spark, path, "*.parquet", table.schema, maxFilesPerTrigger=files)
    counters = flows.Counters("ingested")
    spark.streams.addListener(counters)
    try:
        flows.ingest(stream, scratch_path(spark, "stream-chunks"), scratch_path(spark, "progress"), TEXT, observed="ingested").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(counters)
    row = {"batches": len(counters.batches), **counters.total()}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{name} bigint" for name in row))


def stream_rollup(spark: SparkSession, folder: str) -> DataFrame:
    entries = inputs.shape_logs(_follow(spark, folder, "events"))
    entries = entries.withColumn("created_at", utc_instant(F.col("created_at")))
    target = scratch_path(spark, "stream-rollup")
    flows.rollup(entries, target, scratch_path(spark, "progress")).awaitTermination()
    buckets = spark.read.parquet(target)
    return buckets.withColumn("bucket_start", iso_timestamp(F.col("bucket_start")))


QUERIES: dict[str, Query] = {
    "retrieval_topk": retrieval_topk,
    "retrieval_doc_filter": retrieval_doc_filter,
    "retrieval_no_match": retrieval_no_match,
    "retrieval_rounds": retrieval_rounds,
    "fetch_winners": fetch_winners,
    "lookup_documents": lookup_documents,
    "vector_zip": vector_zip,
    "chunk_documents": chunks_of_documents,
    "chunk_multipage": chunks_of_conversations,
    "chunk_counts": chunk_counts,
    "page_split": page_split,
    "file_gate": file_gate,
    "gate_long_names": gate_long_names,
    "chunk_wide_ids": chunk_wide_ids,
    "lexical_encode": lexical_encode,
    "lexical_topk": lexical_topk,
    "build_context": build_context,
    "build_prompt": build_prompt,
    "query_sources": query_sources,
    "cited_sources": cited_sources,
    "answer_queries": answer_queries,
    "answer_failing": answer_failing,
    "answer_latency": answer_latency,
    "answer_nothing": answer_nothing,
    "retrieval_unscored": unscored,
    "document_lookup": document_lookup,
    "log_rows": log_rows,
    "documents_list": documents_list,
    "document_options": document_options,
    "picked_documents": picked_documents,
    "picked_mostly_all": picked_mostly_all,
    "chunk_with_document": chunk_with_document,
    "delete_cascade": delete_cascade,
    "delete_missing": delete_missing,
    "ingest_status": ingest_status,
    "status_counts": status_counts,
    "ingest_counters": ingest_counters,
    "stats": stats,
    "stats_empty": stats_empty,
    "logs_recent": logs_recent,
    "log_rollup": log_rollup,
    "log_dangling": log_dangling,
    "presentation_sources": presentation_sources,
    "presentation_documents": presentation_documents,
    "presentation_logs": presentation_logs,
    "ann_assign": ann_assign,
    "ann_list_distance": ann_list_distance,
    "ann_sample_probe": ann_sample_probe,
    "ann_doc_filter": ann_doc_filter,
    "ann_sample_recall": ann_sample_recall,
    "ann_kmeans_recall": ann_kmeans_recall,
    "ann_kmeans_nearest": ann_kmeans_nearest,
    "stream_ingest": stream_ingest,
    "stream_log_append": stream_log_append,
    "stream_stats": stream_stats,
    "stream_rollup": stream_rollup,
    "stream_model_stats": stream_model_stats,
    "stream_counters": stream_counters,
    "life_after_ingest": lifecycle.after_ingest,
    "life_after_repeat": lifecycle.after_repeat,
    "life_after_delete": lifecycle.after_delete,
}
