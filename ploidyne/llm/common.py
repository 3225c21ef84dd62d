"""What the operators share: the plumbing of the library and the table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ploidyne.operators.plumbing import BROADCAST_ROWS, connected_components, cut, cut_counted, cut_small, hot_rows, in_few_parts, join_unskewed, new_path, own_prefix, small_enough

__all__ = ["BROADCAST_ROWS", "connected_components", "cut", "cut_counted", "cut_small", "documents", "hot_rows", "in_few_parts", "join_unskewed", "new_path", "own_prefix", "small_enough"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
