"""A corpus pipeline of five of the operators: filter by quality, join near duplicates, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. The result
of a stage is written as Parquet and read again as the docs of the next, so every stage starts from stored rows.

Nulls, empty texts, repeated rows, empty tables and extra columns are handled as the operators' docstrings say; extra
columns of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontamination, mixing, ngram_join, quality, sharding
from tessera.llm.common import load, packed, saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.filter_quality(docs, load(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least doc_id."""
    return ngram_join.one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return decontamination.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: rows are left out or repeated."""
    return mixing.take(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its size, shard and slot (in place of columns of those names)."""
    out = sharding.shard(packed(docs.drop("size", "shard", "slot"), "doc_id", "text"))
    return out.select("row.*", F.col("shard_size").alias("size"), F.col("shard_shard").alias("shard"), F.col("shard_slot").alias("slot"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A classifier fit, the components and the refined splitters have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, "stage")
    return docs
