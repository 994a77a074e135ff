"""A training corpus from `documents`: quality, near duplicates, benchmark passages, mixing, sharding.

Each stage takes what its predecessor kept. Nulls may stand in any column and texts may be empty or very long; rows that
repeat are rows each; an empty table stays empty; columns beside those of documents, whatever their names, are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelspark.llm.common import stage, unstage
from parcelspark.llm.decontam import decontaminate
from parcelspark.llm.mixing import mixed_documents
from parcelspark.llm.neardup import drop_near_duplicates
from parcelspark.llm.quality import quality_scores
from parcelspark.llm.queries import SHARDS, table
from parcelspark.llm.sharding import shard_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good. Null texts are scored as empty ones; equal texts have equal
    scores and stay or go together."""
    return quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, which have four fifths of their shingles in common: the one of the
    least doc_id, a null id last. Texts without words are duplicates of nothing."""
    return drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those without text stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document is taken, the last perhaps in part. Documents without words
    are not taken; a null source is one, the last in order."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, repeats too, with shard and slot; copies of a row lie anywhere, as rows that differ do."""
    return shard_rows(docs, SHARDS)


STAGES = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The classifier is not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the others wrote is deleted when the next one has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
        if before is not None:
            unstage(before)
        before = docs
    return docs
