"""The corpus pipeline: five stages over ``documents``.

language ID (documents without a language go), near-duplicates (one of each group
stays), benchmark decontamination (documents with a hit go), mixing to target weights
(documents are repeated or left out at random), sharding (rows get shard and slot).
Each stage's result is written as Parquet in the shared folder and read again.

A language model of stage one is fitted on the documents it is given. Every stage but the
last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, language, mixing, neardup, sharding
from weftline.llm.common import cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: The kernel classifier and the hash splitters have no SQL; tests/llm/test_pipeline.py holds the stages against plain rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
