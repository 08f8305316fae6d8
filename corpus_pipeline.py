"""From raw documents to token digests: quality, near-duplicates, benchmark items, personal data, tokens.

``STAGES`` are run one after the other; each gets what the one before it wrote as Parquet. Stages that end in Python
write their result themselves, in small batches of texts whatever the session's settings are. The first four return
the columns of ``documents``. Rows that are kept keep their ``doc_id``.

Defined cases are those of the operators: documents without words are rejected as junk; of documents linked at
Jaccard 0.8 on 5-word shingles the one of the least id stays; documents that contain 0.8 of a benchmark item's
shingles go; personal data is replaced by marks; null texts have no ids. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quoteflow.llm import decontaminate, ngram_join, pieces, pii, quality
from quoteflow.llm.common import cut, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps."""
    return cut(quality.keep_good(docs), "good")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by marks."""
    return cut(pii.redact(docs), "private")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's count of ids, and digests of the ids and of the text they decode to."""
    return cut(pieces.digests(pieces.piece_ids(docs, decoded=True)), "tokens")


STAGES = [
    ("quality_classifier", good),
    ("ngram_jaccard_join", distinct),
    ("benchmark_decontamination", clean),
    ("pii", private),
    ("sentencepiece", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
