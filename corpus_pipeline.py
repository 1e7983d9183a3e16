"""A training-data pipeline over documents: quality, near duplicates, repeated passages, benchmark passages, token ids.

Each stage takes what its predecessor kept. run() writes every stage's result as Parquet into the shared folder and reads it again,
so that a lost executor costs the stage at hand and no more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roomscope.llm import decontaminate, jaccard, pieces, quality, suffixes
from roomscope.llm.common import shared_folder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score below 0.3; the model learns from the labelled rows outside the held-out fold."""
    return quality.keep_good(docs, docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the one of smallest id stays."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def first_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out later copies of strings of 100 bytes; a document of nothing else goes."""
    return suffixes.without_repeats(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of benchmark items; a document that is mostly such passages goes."""
    return decontaminate.cut_passages(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_copies),
    ("repeated_passages", first_passages),
    ("decontamination", no_benchmark),
    ("tokens", token_ids),
]
#: Similarity, suffix arrays and tokens are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{base}/roomscope_stage_{k}_{name}_{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
