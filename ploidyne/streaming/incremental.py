"""Allele and count batches as streams. The engine is a batch engine; these keep its first aggregates up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def allele_totals(stream: DataFrame, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """A01 over a stream of allele rows. With an event time, by hour, and rows later than ``late`` are dropped."""
    keys = ["snp_id", "CHROM", "POS", "GT"]
    if time:
        stream, keys = stream.withWatermark(time, late), [F.window(time, "1 hour"), *keys]
    return stream.groupBy(*keys).agg(F.sum("AD").alias("AD"), F.sum("DP").alias("DP"))


def cell_counts(stream: DataFrame) -> DataFrame:
    """Sums of (cell, gene, cnt)."""
    return stream.groupBy("cell", "gene").agg(F.sum("cnt").alias("cnt"))


def rerun_on_batches(stream: DataFrame, analyse, checkpoint: str) -> StreamingQuery:
    """Call ``analyse(batch, id)`` on each micro-batch."""
    return stream.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint).outputMode("append").start()
