"""A corpus pipeline: five stages over ``documents``, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined cases: null and empty texts are scored like others, are near-duplicates of nothing, hold no passage, and have no words, so the mix takes them only as often as whole epochs do;
very long texts are one record throughout; rows that repeat are copies, of which one stays; other columns of documents stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ploidyne.llm import decontam, minhash, mixing, quality, sharding
from ploidyne.llm.common import new_path, own_prefix


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = f"{own_prefix(docs)}score"
    return quality.classify(docs, model, score).where(F.col(score) >= 0.5).drop(score)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that with the least doc_id."""
    return minhash.near_dedup(docs, 0.8)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat_rows(mixing.mix_sources(docs)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [("quality_classifier", keep_good), ("minhash_near_dedup", keep_one), ("decontamination", keep_clean), ("mixing", mix), ("sharding", shard)]
#: Learned scores, shingle sets and random walks are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
