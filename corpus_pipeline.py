"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

Rows go at quality (base rules, symbols, repeated lines, bad hosts), near_dedup (all but the first of
a component) and decontaminate (documents that hold a benchmark passage); suffix_dedup takes repeated
passages out of texts and keeps the rows; pack returns token pieces with their place.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pitlane.llm.common import spool
from pitlane.llm.decontaminate import drop_leaks
from pitlane.llm.host_quality import keep_good
from pitlane.llm.near_dup import keep_one
from pitlane.llm.packing import pack
from pitlane.llm.suffix_dedup import without_repeats


#: Bytes of a passage that may stay only once; passages of fifty words reach it.
PASSAGE = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs, PASSAGE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL has no tokenizer and no packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
