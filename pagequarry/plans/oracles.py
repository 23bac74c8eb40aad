"""The same results in plain SQL, for an independent engine on the same tables."""

from __future__ import annotations

from pagequarry.config import ANN_LISTS, ANSWER_MAX_TOKENS, ANSWER_MODEL, ANSWER_TEMPERATURE, EMBEDDING_DIMENSION, SYSTEM_PROMPT, TOP_K
from pagequarry.functions.text import WHITESPACE
from pagequarry.operators import answering, catalog, retrieval
from pagequarry.operators.chunking import CHUNK_BITS
from pagequarry.plans.lifecycle import PAGES_A_FILE
from pagequarry.plans.queries import ANN_PROBES, TEXT, TURNS


def _with(*parts: str) -> str:
    return "with " + ", ".join(part.strip() for part in parts) + " "


def _chunks(pages: str, settings) -> str:
    """CTE `chunks` from CTE `pages` (document_id, page_number, text)."""
    size, overlap = settings.window_chars, settings.overlap_chars
    step = size - overlap
    return f"""
    pages as ({pages}),
    cut as (
      select document_id, page_number, w,
             trim(substr(text, w * {step} + 1, {size}), '{WHITESPACE}') as content
      from pages, lateral (
        select unnest(range(0, 1 + greatest(0, (length(text) - {max(overlap, 1)}) // {step}))) as w)),
    chunks as (
      select document_id, (row_number() over (
               partition by document_id order by page_number, w) - 1)::int as chunk_index,
             page_number, content
      from cut where content <> '')"""


DOCUMENT_CHUNKS = _chunks("select doc_id as document_id, 1 as page_number, text from documents", TEXT)
TURN_CHUNKS = _chunks(
    "select conv_id as document_id, (turn + 1)::int as page_number, text from conversations", TURNS
)

QUESTIONS = """
questions as (
  select conv_id || ':' || turn as query_id, text as query from conversations where role = 'user')"""


def _terms(name: str, source: str, key: str, text: str) -> str:
    return f"""
    {name}_words as (
      select {key}, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) as word
      from {source}),
    {name} as (
      select {key}, (('0x' || substr(md5(word), 1, 8))::bigint % {EMBEDDING_DIMENSION})::int as bucket,
             count(*)::int as tf
      from {name}_words where word <> '' group by all)"""


CHUNK_TERMS = _terms("chunk_terms", "chunks", "document_id, chunk_index", "content")
QUESTION_TERMS = _terms("question_terms", "questions", "query_id", "query")

LEXICAL_HITS = _with(DOCUMENT_CHUNKS, QUESTIONS, CHUNK_TERMS, QUESTION_TERMS) + f""",
chunk_norms as (
  select document_id, chunk_index, sum(tf * tf)::bigint as n from chunk_terms group by all),
question_norms as (select query_id, sum(tf * tf)::bigint as n from question_terms group by all),
dots as (
  select q.query_id, c.document_id, c.chunk_index, sum(q.tf * c.tf)::bigint as dot
  from question_terms q join chunk_terms c using (bucket) group by all),
pairs as (
  select q.query_id, c.document_id, c.chunk_index, c.page_number, c.content,
         coalesce(d.dot, 0)::double / sqrt(nullif(qn.n * cn.n, 0)::double) as similarity
  from questions q cross join chunks c
  left join dots d using (query_id, document_id, chunk_index)
  left join question_norms qn using (query_id)
  left join chunk_norms cn using (document_id, chunk_index)),
hits as (
  select *, document_id * {1 << CHUNK_BITS} + chunk_index as id,
         (row_number() over (partition by query_id
           order by similarity desc nulls last, document_id, chunk_index))::int as rank
  from pairs qualify rank <= {TOP_K})
"""


def _vector_hits(bound: str = "true") -> str:
    return f"""
    vector_pairs as (
      select q.vec_id as query_id, c.vec_id as id, c.label::bigint as document_id,
             'vec ' || c.vec_id as content, (c.label + 1)::int as page_number, 0 as chunk_index,
             list_cosine_similarity(c.embedding::double[], q.embedding::double[]) as score
      from embeddings q join embeddings c on {bound}),
    hits as (
      select *, (row_number() over (partition by query_id order by score desc, id))::int as rank
      from vector_pairs qualify rank <= {TOP_K})"""


IN_OWN_DOCUMENT = "(q.label >= 5 or q.label = c.label)"
SHOWN = """select query_id, rank, id, document_id, content, page_number, chunk_index,
  round(score, 4) + 0.0 as similarity from hits"""
RANKED = "select query_id, rank, id, round(score, 4) + 0.0 as similarity from hits"

CONTEXT = """string_agg('[Source ' || rank || ' - Page ' || page_number || ']' || chr(10) || content,
  chr(10) || chr(10) order by rank)"""
PROMPT = f"""'Context:' || chr(10) || {CONTEXT} || chr(10) || chr(10) || 'Question: '
  || any_value(query) || chr(10) || chr(10) || 'Answer:'"""

VECTOR_PROMPTS = f"""
prompts as (
  select query_id, any_value(query) as query, string_agg(id::varchar, ',' order by rank) as ids,
         {PROMPT} as prompt
  from (select *, 'what is near vec ' || query_id as query from hits) group by query_id)"""

# Files of the life cycle: documents are pages, and files of the wrong type are not taken.
UPLOADS = _chunks(
    f"""select doc_id // {PAGES_A_FILE} as document_id, (row_number() over (partition by doc_id // {PAGES_A_FILE} order by doc_id))::int as page_number,
       translate(text, chr(12), ' ') as text from documents""", TEXT
) + f""",
    files as (select distinct doc_id // {PAGES_A_FILE} as document_id from documents where doc_id // {PAGES_A_FILE} % 7 <> 3),
    taken as (
      select 'upload_' || document_id || '.pdf' as filename, document_id, count(content) as stored_chunks, max(chunk_index) as last_place,
             max(page_number) as last_page, sum(length(content))::bigint as characters
      from files left join chunks using (document_id) group by document_id)"""

CATALOGUE = """
catalogue as (
  select doc_id as id, 'doc_' || doc_id || '.pdf' as filename, source,
         timestamp '2024-01-01' + to_seconds(doc_id) as uploaded_at, n_chars::int as num_chunks,
         case when lang = 'en' then 'completed' else 'processing' end as status
  from documents)"""

LOGS = """
logs as (
  select event_id as id,
         'user ' || user_id || ' asks about ' || event_type || ' with ' || props
           || ', question ' || event_id as query,
         trunc(value)::int as latency_ms, (props::json->>'k')::int as token_count,
         event_type as model_used, [event_id % 500, (event_id * 7) % 500] as retrieved_chunk_ids,
         ts as created_at
  from events)"""

OPTIONS = f"""
uploads as (
  select source as filename, min_by(id, uploaded_at) as id, max(uploaded_at) as last_uploaded_at
  from catalogue group by source),
options as (
  select * from uploads union all select '{catalog.ALL_DOCUMENTS}', null, null)"""

INGESTED = _with(DOCUMENT_CHUNKS) + f""",
counts as (select document_id, count(*)::int as n from chunks group by all),
states as (
  select doc_id as document_id, source = 'src0' as broken, lang = 'de' as textless from documents),
ingested as (
  select document_id,
         case when broken or textless then 0 else coalesce(n, 0) end::int as num_chunks,
         case when broken or textless then 'failed' else 'completed' end as status,
         case when broken then 500 when textless then 400 end::int as error_code,
         case when broken then '{catalog.PROCESS_FAILED}' when textless then '{catalog.NO_TEXT}' end
           as error
  from states left join counts using (document_id))
"""

LISTS = f"""
centres as (
  select (row_number() over (order by draw, vec_id) - 1)::int as list_id, embedding as centroid
  from (select vec_id, embedding, md5(vec_id::varchar) as draw from embeddings
        order by draw, vec_id limit {ANN_LISTS})),
placed as (
  select vec_id, list_id, row_number() over (partition by vec_id
    order by list_cosine_similarity(embedding::double[], centroid::double[]) desc, list_id) as place
  from embeddings cross join centres),
assigned as (select vec_id, list_id from placed where place = 1),
probed as (select vec_id, list_id from placed where place <= {ANN_PROBES})"""

def _list_hits(bound: str) -> str:
    return f"""
    candidates as (
      select p.vec_id as query_id, a.vec_id as id from probed p join assigned a using (list_id)),
    hits as (
      select query_id, id,
             list_cosine_similarity(c.embedding::double[], q.embedding::double[]) as score,
             (row_number() over (partition by query_id order by
               list_cosine_similarity(c.embedding::double[], q.embedding::double[]) desc, id))::int as rank
      from candidates join embeddings q on q.vec_id = query_id join embeddings c on c.vec_id = id
      where {bound} qualify rank <= {TOP_K})"""


_ROLLUP = """select {bucket} as bucket_start, model_used,
  count(*)::bigint as queries, round(avg(latency_ms), 2) as avg_latency_ms"""

ORACLES: dict[str, str] = {
    "retrieval_topk": _with(_vector_hits()) + SHOWN,
    "retrieval_doc_filter": _with(_vector_hits(IN_OWN_DOCUMENT)) + SHOWN,
    "retrieval_no_match": f"""
      select vec_id as query_id, 404 as error_code, '{retrieval.NOTHING_FOUND}' as error
      from embeddings q where not exists (select 1 from embeddings c where c.label = q.label * 2)""",
    "retrieval_rounds": f"""
      with placed as (
        select vec_id, embedding::double[] as v, case when vec_id % 3 = 0 then 0 else label + 1 end as doc from embeddings)
      select query_id, rank, id, round(score, 4) + 0.0 as similarity from (
        select q.vec_id as query_id, c.vec_id as id, list_cosine_similarity(c.v, q.v) as score,
               (row_number() over (partition by q.vec_id order by list_cosine_similarity(c.v, q.v) desc, c.vec_id))::int as rank
        from placed q join placed c on q.vec_id % 2 = 1 or q.doc = c.doc qualify rank <= {TOP_K})""",
    "fetch_winners": _with(DOCUMENT_CHUNKS) + f"""
      select unnest([document_id, document_id + 1]) * {1 << CHUNK_BITS} + chunk_index as query_id, unnest([1, 2])::int as rank,
             document_id * {1 << CHUNK_BITS} + chunk_index as id, document_id, content, page_number, chunk_index,
             unnest([1.0, 0.5])::double as similarity from chunks""",
    "lookup_documents": _with(DOCUMENT_CHUNKS) + """
      select document_id, chunk_index, page_number, content from chunks
      where document_id in (select doc_id from labels where quality = 0)""",
    "vector_zip": """
      select vec_id as id, 'vec ' || vec_id as content, len(embedding)::int as dimensions
      from embeddings""",
    "chunk_documents": _with(DOCUMENT_CHUNKS) + "select * from chunks",
    "chunk_multipage": _with(TURN_CHUNKS) + "select * from chunks",
    "chunk_counts": _with(DOCUMENT_CHUNKS) + """
      , counts as (
        select doc_id as document_id, count(content)::int as num_chunks
        from documents left join chunks on doc_id = document_id group by all)
      select *, (1 + coalesce(sum(num_chunks) over (
        order by document_id rows between unbounded preceding and 1 preceding), 0))::bigint
        as first_chunk_id
      from counts""",
    "page_split": f"""
      select document_id, n::int as page_number, pages[n] as text
      from (select doc_id as document_id, string_split(text, chr(10)) as pages from documents),
           lateral (select unnest(range(1, len(pages) + 1)) as n)
      where trim(pages[n], '{WHITESPACE}') <> ''""",
    "file_gate": f"""
      select id, filename, case when ok then null else 400 end::int as error_code,
             case when ok then null else '{catalog.ONLY_PDF}' end as error
      from (select *, coalesce(lower(filename) like '%.pdf', false) as ok
            from (select doc_id as id, 'doc_' || doc_id || case lang when 'en' then '.pdf'
                    when 'de' then '.PDF' when 'fr' then '.pdf.txt' end as filename
                  from documents))""",
    "gate_long_names": """
      select doc_id as id, case when lang in ('fr', 'de') then 400 end::int as error_code,
             case lang when 'fr' then 'filename is longer than 255 characters'
               when 'de' then 'file_path is longer than 512 characters' end as error
      from documents""",
    "chunk_wide_ids": _with(DOCUMENT_CHUNKS) + """
      select row_number() over (order by document_id, chunk_index) as id,
             document_id * 8589934592 + 1099511627776 as document_id, chunk_index from chunks""",
    "lexical_encode": _with(DOCUMENT_CHUNKS, CHUNK_TERMS)
    + "select document_id, chunk_index, bucket, tf from chunk_terms",
    "lexical_topk": LEXICAL_HITS + """
      select query_id, rank, document_id, chunk_index, page_number,
             round(similarity, 4) as similarity from hits""",
    "build_context": _with(_vector_hits(IN_OWN_DOCUMENT))
    + f"select query_id, {CONTEXT} as context from hits group by query_id",
    "build_prompt": LEXICAL_HITS
    + f"""select query_id, {PROMPT} as prompt
          from hits join questions using (query_id) group by query_id""",
    "query_sources": LEXICAL_HITS
    + f"""select query_id, rank, id as chunk_id, left(content, {answering.SOURCE_CHARS}) as content,
            page_number, round(similarity, 4) as similarity_score from hits""",
    "cited_sources": LEXICAL_HITS + """
      select query_id, rank, 'doc_' || document_id || '.pdf' as document, page_number as page,
             round(similarity, 2) as score from hits""",
    "answer_queries": _with(_vector_hits(), VECTOR_PROMPTS) + f"""
      select query_id, 'read ' || length(prompt) || ' characters' as answer,
             (length(prompt) // 4)::int as prompt_tokens, 3 as completion_tokens,
             (length(prompt) // 4 + 3)::int as total_tokens, '{ANSWER_MODEL}' as model,
             null::int as error_code, null::varchar as error
      from prompts""",
    "answer_failing": _with(_vector_hits(), VECTOR_PROMPTS) + """
      select query_id, case when query_id % 10 <> 7 then 'read ' || length(prompt) || ' characters' end as answer,
             case when query_id % 10 = 7 then 400 end::int as error_code,
             case when query_id % 10 = 7 then 'not this one' end as error, true as few_attempts
      from prompts""",
    "answer_latency": _with(_vector_hits(), VECTOR_PROMPTS) + f"""
      select query_id, '{ANSWER_MODEL} {ANSWER_TEMPERATURE} {ANSWER_MAX_TOKENS} {len(SYSTEM_PROMPT)} ' || length(prompt) as answer,
             3 as token_count, true as in_time
      from prompts""",
    "answer_nothing": _with(_vector_hits(), VECTOR_PROMPTS) + """
      select query_id, case when query_id % 2 = 0 then '' else 'read ' || length(prompt) || ' characters' end as answer,
             (length(prompt) // 4 + 3)::int as token_count
      from prompts""",
    "retrieval_unscored": f"""
      select query_id, rank, id, round(score, 4) + 0.0 as similarity from (
        select q.vec_id as query_id, c.vec_id as id,
               case when c.label <> 0 then list_cosine_similarity(c.embedding::double[], q.embedding::double[]) end as score,
               (row_number() over (partition by q.vec_id order by score desc nulls last, c.vec_id))::int as rank
        from embeddings q join embeddings c on q.label = c.label qualify rank <= {TOP_K})""",
    "document_lookup": _with(CATALOGUE) + "select id, filename, num_chunks, status from catalogue where id = 7",
    "log_rows": _with(_vector_hits(), VECTOR_PROMPTS) + f"""
      select query_id, query, 'read ' || length(prompt) || ' characters' as answer,
             ids as retrieved_chunk_ids, (query_id * 1000777 // 1000)::int as latency_ms,
             (length(prompt) // 4 + 3)::int as token_count, '{ANSWER_MODEL}' as model_used
      from prompts""",
    "documents_list": _with(CATALOGUE) + """
      select id, filename, num_chunks, status,
             strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' as uploaded_at
      from catalogue order by catalogue.uploaded_at desc, id desc""",
    "document_options": _with(CATALOGUE, OPTIONS)
    + """select filename, id,
           strftime(last_uploaded_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' as last_uploaded_at
         from options""",
    "picked_documents": _with(CATALOGUE, OPTIONS, QUESTIONS) + f"""
      , picked as (
        select query_id, case when length(query) % 25 = 0 then '{catalog.ALL_DOCUMENTS}'
                         else 'src' || length(query) % 25 end as filename from questions)
      select query_id, id as document_id from picked left join options using (filename)""",
    "picked_mostly_all": _with(CATALOGUE, OPTIONS, QUESTIONS) + f"""
      , picked as (
        select query_id, case when length(query) % 9 = 0 then 'src' || length(query) % 25
                         else '{catalog.ALL_DOCUMENTS}' end as filename from questions)
      select query_id, id as document_id from picked left join options using (filename)""",
    "chunk_with_document": _with(DOCUMENT_CHUNKS, CATALOGUE) + """
      select document_id, filename, chunk_index, page_number, length(content)::int as length
      from chunks join catalogue on id = document_id""",
    "delete_cascade": _with(DOCUMENT_CHUNKS) + """
      , gone as (select doc_id from labels where toxic = 1)
      select 'documents' as from_table, doc_id as document_id, null::int as chunk_index
      from documents where doc_id not in (from gone)
      union all
      select 'chunks', document_id, chunk_index from chunks where document_id not in (from gone)""",
    "delete_missing": _with(CATALOGUE) + f"""
      , wanted as (select distinct doc_id * 2 as document_id from labels)
      select document_id, filename,
             case when id is not null then '{catalog.DELETED}' end as message,
             case when id is null then 404 end::int as error_code,
             case when id is null then 'Document with id ' || document_id || ' not found' end as error
      from wanted left join catalogue on id = document_id""",
    "ingest_status": INGESTED + "select * from ingested",
    "status_counts": INGESTED
    + "select status, count(*)::bigint as documents from ingested group by status",
    "ingest_counters": INGESTED + """
      select count(*)::bigint as documents,
             count(case when status = 'completed' then 1 end)::bigint as pages,
             sum(num_chunks)::bigint as chunks,
             count(case when status = 'failed' then 1 end)::bigint as failed
      from ingested""",
    "stats": _with(DOCUMENT_CHUNKS, LOGS) + """
      select (select count(*) from logs) as total_queries,
             (select round(coalesce(avg(latency_ms), 0), 2) from logs) as avg_latency_ms,
             (select count(*) from documents) as total_documents,
             (select count(*) from chunks) as total_chunks""",
    "stats_empty": _with(LOGS) + """
      select (select count(*) from logs where latency_ms < 0) as total_queries,
             (select round(coalesce(avg(latency_ms), 0), 2) from logs where latency_ms < 0)
               as avg_latency_ms,
             (select count(*) from documents) as total_documents,
             (select count(*) from embeddings) as total_chunks""",
    "logs_recent": _with(LOGS) + """
      select id, query, left(query, 50) || '...' as query_preview, latency_ms, token_count,
             model_used, created_at
      from logs order by created_at desc, id desc""",
    "log_rollup": _with(LOGS)
    + _ROLLUP.format(bucket="date_trunc('day', created_at)::timestamp") + """,
             quantile_cont(latency_ms::double, 0.5) as p50_latency_ms,
             quantile_cont(latency_ms::double, 0.95) as p95_latency_ms,
             sum(token_count)::bigint as token_sum
      from logs group by all""",
    "log_dangling": _with(LOGS) + """
      select log_id, rank, chunk_id
      from (select id as log_id, n::int as rank, retrieved_chunk_ids[n] as chunk_id
            from logs, lateral (select unnest(range(1, len(retrieved_chunk_ids) + 1)) as n))
      where chunk_id not in (select vec_id from embeddings where label not in (3, 4))""",
    "presentation_sources": LEXICAL_HITS + """
      select query_id, rank,
             '**Page ' || page_number || '** (similarity: ' || printf('%.4f', round(similarity, 4)) || ')'
               as heading,
             printf('%.4f', round(similarity, 4)) as similarity_label,
             left(content, 300) || '...' as preview from hits""",
    "presentation_documents": _with(CATALOGUE) + """
      select id, num_chunks || ' chunks' as chunk_label,
             case when status = 'completed' then 'green' else 'orange' end as colour
      from catalogue""",
    "presentation_logs": _with(LOGS) + """
      select id, left(query, 50) || '...' as preview,
             'Latency: ' || latency_ms || 'ms | Tokens: ' || token_count || ' | Model: ' || model_used
               as caption,
             latency_ms || 'ms' as latency_label
      from logs""",
    "ann_assign": _with(LISTS) + "select vec_id as id, list_id from assigned",
    "ann_list_distance": _with(LISTS) + """
      select vec_id as id, list_id, round(1.0 - list_cosine_similarity(
               e.embedding::double[], c.centroid::double[]), 4) + 0.0 as distance
      from assigned join embeddings e using (vec_id) join centres c using (list_id)""",
    "ann_sample_probe": _with(LISTS, _list_hits("true")) + RANKED,
    "ann_doc_filter": _with(LISTS, _list_hits(IN_OWN_DOCUMENT)) + RANKED,
    "ann_sample_recall": _with(LISTS, _list_hits("true")) + f"""
      , exact as (
        select q.vec_id as query_id, c.vec_id as id,
               row_number() over (partition by q.vec_id order by list_cosine_similarity(
                 c.embedding::double[], q.embedding::double[]) desc, c.vec_id) as rank
        from embeddings q cross join embeddings c qualify rank <= {TOP_K})
      select query_id, count(*)::bigint as exact_hits, count(score)::bigint as found_hits,
             round(count(score) / count(*), 4) as recall
      from exact left join hits using (query_id, id) group by query_id""",
    "ann_kmeans_recall": f"""
      select vec_id as query_id, least({TOP_K}, (select count(*) from embeddings)) as exact_hits,
             least({TOP_K}, (select count(*) from embeddings)) as found_hits, 1.0::double as recall
      from embeddings""",
    "ann_kmeans_nearest": "select vec_id as id, true as agrees from embeddings",
    "stream_ingest": _with(DOCUMENT_CHUNKS) + "select * from chunks",
    "stream_log_append": _with(LOGS)
    + "select id, query, latency_ms, token_count, model_used, created_at from logs",
    "stream_stats": _with(LOGS) + """
      select count(*)::bigint as total_queries, round(avg(latency_ms), 2) as avg_latency_ms
      from logs""",
    "stream_model_stats": _with(LOGS) + """
      select model_used, count(*)::bigint as total_queries, round(avg(latency_ms), 2) as avg_latency_ms
      from logs group by model_used""",
    "stream_counters": _with(DOCUMENT_CHUNKS) + """
      , kept as (select * from chunks where document_id % 3 <> 0)
      select 2::bigint as batches, (select count(*) from documents)::bigint as documents,
             (select count(*) from documents)::bigint as pages, (select count(*) from kept)::bigint as chunks,
             (select count(*) from documents where doc_id not in (select document_id from kept))::bigint as without_text""",
    "life_after_ingest": _with(UPLOADS) + """
      select filename, case when stored_chunks > 0 then 'completed' else 'failed' end as status, stored_chunks::int as num_chunks,
             nullif(stored_chunks, 0) as stored_chunks, nullif(stored_chunks, 0) as places, last_place, last_page, characters
      from taken""",
    "life_after_repeat": _with(UPLOADS) + """
      select filename, 2::bigint as documents, nullif(2 * stored_chunks, 0)::bigint as stored_chunks, true as resolves_to_first
      from taken""",
    "life_after_delete": _with(UPLOADS) + """
      select count(*) filter (not gone) as total_documents, (sum(stored_chunks) filter (not gone))::bigint as total_chunks,
             count(*) filter (gone) as fewer_documents, coalesce(sum(stored_chunks) filter (gone), 0)::bigint as fewer_chunks,
             count(*) filter (gone) as deleted, 1 as not_found, 0 as deleted_again, count(*) filter (gone) + 1 as not_found_again
      from (select *, document_id % 3 = 1 as gone from taken)""",
    "stream_rollup": _with(LOGS)
    + _ROLLUP.format(bucket="strftime(date_trunc('day', created_at), '%Y-%m-%dT%H:%M:%S') || '+00:00'")
    + """, sum(token_count)::bigint as token_sum
      from logs
      where date_trunc('day', created_at) + interval 1 day
            <= (select max(created_at) from logs) - interval 1 hour
      group by all""",
}
