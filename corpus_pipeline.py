"""Corpus pipeline: stages that each apply one corpus operator to all their predecessor kept.

Every stage takes null ids, missing and empty texts, repeated rows and further
columns as its operator's docstring says, and passes an empty table on as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import decontamination, mixing, sharding, simhash, toxicity
from tabloom.llm.common import reach_workers
from tabloom.session import ensure_checkpoint_dir

SHARDS = 16


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it is fitted on the labelled documents of its input."""
    reach_workers(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    reach_workers(spark)
    return simhash.keep_one(docs, shingle=4, radius=4)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    reach_workers(spark)
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document comes out as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("toxicity", clean),
    ("simhash near-dedup", distinct),
    ("decontamination", unleaked),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Fingerprints and the fitted classifier cannot be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each reading what its predecessor wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
