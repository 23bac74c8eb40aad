"""SQL for the registered queries of this package that SQL can express."""

from pagequarry.llm.spelling import VARIANTS_SQL
from pagequarry.llm.turns import TREE_SQL
from pagequarry.llm.urls import JUDGE_SQL
from pagequarry.llm.warc import AUDIT_SQL

TOP_K_SQL = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from whole q join whole c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

ORACLES: dict[str, str] = {
    "op5_fixity": AUDIT_SQL,
    "op6_topk": TOP_K_SQL,
    "op11_urls": JUDGE_SQL,
    "op12_turns": TREE_SQL,
    "op13_spelling": VARIANTS_SQL,
}
