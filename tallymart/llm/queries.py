"""The registered queries of the text operators: each over its whole table, as contracted."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm import (
    byte_bpe,
    collocations,
    decontaminate,
    language,
    licenses,
    near_dedup,
    pii,
    quality_model,
    quality_rules,
    repeats,
    secrets,
    wavelet,
    whitening,
)
from tallymart.llm.common import is_held_out, table

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


@_query
def op1_near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, root, "documents"), size=4, percent=80)


@_query
def op2_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, root, "documents"))


@_query
def op3_personal_data(spark: SparkSession, root: str) -> DataFrame:
    return pii.personal_data(table(spark, root, "documents")).drop("span_list")


@_query
def op4_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    held_out = is_held_out(F.col("doc_id"))
    labels = table(spark, root, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality_model.quality_scores(table(spark, root, "documents"), labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@_query
def op5_repeated_bytes(spark: SparkSession, root: str) -> DataFrame:
    return repeats.repeated_bytes(table(spark, root, "documents"))


@_query
def op6_wavelet_tokens(spark: SparkSession, root: str) -> DataFrame:
    shards = wavelet.write_shards(table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.read_shards(shards)


@_query
def op7_secrets(spark: SparkSession, root: str) -> DataFrame:
    return secrets.secret_spans(table(spark, root, "documents"))


@_query
def op8_decontamination(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.leaks(table(spark, root, "documents"), table(spark, root, "benchmark"))


@_query
def op9_language(spark: SparkSession, root: str) -> DataFrame:
    held_out = is_held_out(F.col("doc_id"))
    found = language.identify(table(spark, root, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op10_byte_bpe(spark: SparkSession, root: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.token_digests(table(spark, root, "documents"), path, public_tokenizers.PATTERN)


@_query
def op11_license_scan(spark: SparkSession, root: str) -> DataFrame:
    return licenses.license_scan(table(spark, root, "documents"))


@_query
def op12_phrase_collocations(spark: SparkSession, root: str) -> DataFrame:
    return collocations.collocations(table(spark, root, "documents"))


@_query
def op13_embedding_whitening(spark: SparkSession, root: str) -> DataFrame:
    return whitening.whitened_components(table(spark, root, "embeddings"))
