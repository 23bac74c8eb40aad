"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import decontaminate, jaccard, language, nearest, packing, pii, secrets, sharding, spelling, substrings, turns, urls, warc
from pagequarry.session import small_batches
from pagequarry.sources.tables import scan

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(scan(spark, folder, "documents"), scan(spark, folder, "benchmark"))


def op2_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(scan(spark, folder, "documents"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(scan(spark, folder, "documents"))


def op4_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(scan(small_batches(spark), folder, "documents"))


def op5_fixity(spark: SparkSession, folder: str) -> DataFrame:
    return warc.audit_pages(spark, folder)


def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.top_k(scan(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(scan(spark, folder, "documents"))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(scan(spark, folder, "documents"))


def op9_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(scan(small_batches(spark), folder, "documents"))


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(scan(spark, folder, "documents"))


def op11_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_pages(scan(spark, folder, "pages"))


def op12_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns.tree_of_rebuilt(scan(spark, folder, "conversations"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.document_variants(scan(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pack": op2_pack,
    "op3_pii": op3_pii,
    "op4_substrings": op4_substrings,
    "op5_fixity": op5_fixity,
    "op6_topk": op6_topk,
    "op7_language": op7_language,
    "op8_secrets": op8_secrets,
    "op9_jaccard": op9_jaccard,
    "op10_shards": op10_shards,
    "op11_urls": op11_urls,
    "op12_turns": op12_turns,
    "op13_spelling": op13_spelling,
}
