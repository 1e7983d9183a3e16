"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, jaccard, licences, ngrams, quality, shards, suffixes, topk
from .common import table
from .pieces import piece_digests

#: A limit at which the test tables need several splits as well.
SHARD_BYTES = 64 << 10


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below their source and language, a hundred to a directory."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return licences.scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")).withColumnRenamed("file_id", "doc_id")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.extendible_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scored(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_licences": op2_licences,
    "op3_topk": op3_topk,
    "op4_ngram_join": op4_ngram_join,
    "op5_html": op5_html,
    "op6_quality": op6_quality,
    "op7_shards": op7_shards,
    "op8_ngram_lm": op8_ngram_lm,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLES: dict[str, str] = {"op1_decontaminate": decontaminate.ORACLE, "op3_topk": topk.ORACLE, "op4_ngram_join": jaccard.oracle(4, 85), "op7_shards": shards.oracle(SHARD_BYTES), "op10_suffix_dedup": suffixes.oracle(suffixes.LEAST)}
