"""The corpus pipeline: documents in, packed training sequences out.

Each stage is written under the session's shared folder and read again by the next one. All but the
last return the columns of the documents. Repeated rows are rows of their own to every stage; columns
that a stage does not name pass through it, and no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm import decontaminate, jaccard, language, packing, secrets
from pagequarry.session import materialise, ship_package, small_batches
from pagequarry.sources.tables import scan

# A document whose trigrams are known to no language by this share is not in a known language.
LEAST_KNOWN = 0.3
# Items of fewer words or symbols remove no document.
LEAST_ITEM_WORDS = 2


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; the others go.

    A null text, or one without a letter, is in no language and goes. A null lang teaches nothing.
    """
    small_batches(ship_package(spark))
    return language.known(docs, LEAST_KNOWN)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every class of near duplicates.

    Texts that are null or without words are in classes of their own and stay.
    """
    small_batches(ship_package(spark))
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; a word alone is not evidence of one.

    A null or empty text holds none and stays; without items all documents stay.
    """
    small_batches(ship_package(spark))
    return decontaminate.clean(docs, scan(spark, sf_dir, "benchmark"), least_words=LEAST_ITEM_WORDS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; a null text stays null."""
    small_batches(ship_package(spark))
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of one length; a null text is an empty document."""
    small_batches(ship_package(spark))
    return packing.pack(docs)


STAGES = [
    ("language ID", identified),
    ("n-gram Jaccard join", distinct_texts),
    ("benchmark decontamination", decontaminated),
    ("secret scans", redacted),
    ("packing", packed),
]
# A trained model, an automaton and a tokenizer take part: no SQL can express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
