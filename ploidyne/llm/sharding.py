"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records by seeded hashes into buckets that fit in memory; a bucket lies within one shard, and each shard has as many as its own bytes need. Pass 2 sorts each
bucket by content, so that the order in which Spark delivers rows does not matter, shuffles it by Fisher-Yates with a generator seeded from
the bucket's number, and writes it. A record's slot is the number of records in earlier buckets of its shard plus its
place in the bucket.

The law is ``key``: the shard is the highest of the hashes of (doc_id, shard), so one more shard takes rows only into itself. The
bucket comes from a hash of doc_id and text, so a text of which there are very many copies is spread over all buckets of a shard. Rows that repeat more than REPEATS times, equal in
all columns, are counted, and dealt in lots of REPEATS, each with a bucket of its own choice.

Defined cases: a null doc_id is a value like others; null and empty texts are records of size 1; a very long text is a record like others, and its bucket is larger by it; an empty
table gives an empty result; input columns named shard, grown_shard or slot are replaced, others stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ploidyne.llm.common import cut, documents, new_path, own_prefix, small_enough

SHARDS = 8
SEED = 11
#: Text bytes that a bucket should hold.
BUCKET_BYTES = 16 << 20
#: Rows equal in doc_id and text beyond this number are dealt in lots.
REPEATS = 1000


def shard_of(shards: int, seed: int = SEED, key: str = "doc_id"):
    """Rendezvous hashing: the shard whose hash with the key is highest."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), F.col(key), s).alias("h"), s.alias("s")))
    return F.array_max(scores)["s"]


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation: from the last place down, swap with a place drawn from those not yet fixed."""
    at = list(range(n))
    draws = (np.random.default_rng(seed).random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = draws[i]
        at[i], at[j] = at[j], at[i]
    return np.array(at, np.int64)


def spread_repeats(docs: DataFrame, lot: str, repeats: int) -> DataFrame:
    """``docs`` with the column ``lot``: 0, or the number of the lot for rows that repeat more than ``repeats`` times."""
    own = own_prefix(docs) + "_"
    key = F.xxhash64("doc_id", "text")
    often = docs.groupBy(key.alias(f"{own}k")).agg(F.count(F.lit(1)).alias(f"{own}n")).where(F.col(f"{own}n") > repeats)
    often = cut(often.select(f"{own}k"))
    if often.limit(1).count() == 0:
        return docs.withColumn(lot, F.lit(0).cast("long"))
    keyed = docs.withColumn(f"{own}h", key)
    on, often = F.col(f"{own}h") == F.col(f"{own}k"), small_enough(often)
    # equal rows meet as counts, so the copies of one never meet in a task
    counted = keyed.join(often, on, "left_semi").groupBy(*docs.columns).agg(F.count(F.lit(1)).alias(f"{own}n"))
    lots = counted.withColumn(lot, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(f"{own}n") - 1) / repeats).cast("long"))))
    rows = lots.withColumn(f"{own}i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(repeats).cast("long"), F.col(f"{own}n") - F.col(lot) * repeats))))
    return keyed.join(often, on, "left_anti").withColumn(lot, F.lit(0).cast("long")).select(*docs.columns, lot).unionByName(rows.select(*docs.columns, lot))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, repeats: int = REPEATS) -> DataFrame:
    """``docs`` with shard, grown_shard (with one shard more) and slot (gapless from 0 within a shard)."""
    docs = docs.drop("shard", "grown_shard", "slot")
    own = own_prefix(docs)
    lot, bucket, place, before = (f"{own}{c}" for c in ("lot", "bucket", "place", "before"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    # a row for each shard
    need = {r.s: max(1, -(-r.b // bucket_bytes)) for r in docs.groupBy(shard_of(shards, seed).alias("s")).agg(F.sum(size).alias("b")).collect()}
    buckets = F.element_at(F.array(*[F.lit(need.get(k, 1)) for k in range(shards)]), F.col("shard") + 1)
    marked = spread_repeats(docs, lot, repeats).withColumn("shard", shard_of(shards, seed)).withColumn("grown_shard", shard_of(shards + 1, seed))
    marked = marked.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text", lot), buckets).cast("long")).drop(lot)
    kinds = T.StructType([*marked.schema.fields, T.StructField(place, T.LongType())])

    def permute(key, table):
        number = [k.as_py() for k in key]
        plain = [c for c in table.column_names if pa.types.is_primitive(table.schema.field(c).type) or pa.types.is_string(table.schema.field(c).type) or pa.types.is_large_string(table.schema.field(c).type)]
        order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in sorted(plain, key=lambda c: (c != "doc_id", c))])
        order = order.take(pa.array(fisher_yates(len(order), [seed, *number])))
        return table.take(order).append_column(place, pa.array(np.arange(len(order))))

    # as many partitions as there are buckets, so that a task's share does not grow
    dealt = marked.repartition(max(sum(need.values()), docs.sparkSession.sparkContext.defaultParallelism), "shard", bucket)
    shuffled = dealt.groupBy("shard", bucket).applyInArrow(permute, kinds)
    counts = marked.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = small_enough(cut(counts.withColumn(before, F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")))
    return shuffled.join(offsets, ["shard", bucket]).withColumn("slot", F.col(place) + F.col(before)).select(*docs.columns, "shard", "grown_shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """Write the shards to ``path``, a folder for each, every bucket a run of rows in its slots' order; returns what was written."""
    sharded.write.partitionBy("shard").option("compression", "zstd").mode("overwrite").parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path)


def op2(spark, sf_dir: str) -> DataFrame:
    written = write_shards(shard_documents(documents(spark, sf_dir).select("doc_id", "text")), new_path(spark, "shards"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return written.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))
