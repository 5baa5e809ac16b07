"""A training-corpus pipeline: each stage takes all documents that the stage before has kept.

1. quality: documents that the classifier rejects go. It learns from ``labels``, by doc_id, without the held-out rows.
2. exact_dedup: of equal texts (A-Z lower-cased) the one with the largest doc_id stays.
3. near_dedup: of texts linked by a similarity of 0.8 or more over five-word shingles the one with the smallest doc_id stays.
4. mixing: documents are taken 0, 1 or 2 times, so that sources come near their target weights; a copy is a row of its own.
5. byte_bpe: the ids of each row's text, decoded again, with digests of both.

Nulls in any column, empty texts and extra columns pass as the operators' docstrings say; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, exact_dedup, mixing, near_dedup, quality
from quillspark.llm.common import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs, width=5, per_cent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("byte_bpe", encode)]
#: Neither the classifier nor signatures can be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each stage's rows are written and read again, and go once the next stage's are written."""
    scratch, docs, before = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
