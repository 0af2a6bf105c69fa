"""From raw documents to token ids: filter, deduplicate, decontaminate, redact, encode.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept. All but the last return
the columns of documents. The classifier learns from ``labels``, decontamination from ``benchmark``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm import byte_bpe, decontaminate, near_dedup, quality_model, secrets
from tallymart.llm.common import id_and_text, is_held_out, table
from tallymart.session import materialize


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts. It learns from labelled rows of the whole table."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    taught = id_and_text(table(spark, sf_dir, "documents"))
    weights = quality_model.fit(taught, labels, ~is_held_out(F.col("doc_id")))
    return quality_model.accepted(docs, weights)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8.

    Rows that share an id are one document and stay or go together; rows without id stay.
    """
    groups = near_dedup.near_duplicates(docs, size=5, percent=80)
    gone = materialize(groups.where(~F.col("kept")).select("doc_id").distinct(), "duplicates")
    return docs.join(gone, "doc_id", "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars, if there, follows the text."""
    redacted = secrets.redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether these decode to the text, in place of columns so named."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_column(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode_tokens),
]

# The classifier, MinHash and BPE have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
