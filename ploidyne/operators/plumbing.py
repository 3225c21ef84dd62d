"""Plumbing that all of the library shares: where lineage is cut, size-checked broadcasts, joins without hot keys, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if it was counted and holds at most so many rows of a few longs.
BROADCAST_ROWS = 500_000
#: A key with more rows than this, and more than a HOT_SHARE of all rows, counts as hot. So there are at most 1 / HOT_SHARE hot keys.
HOT_ROWS = 256
HOT_SHARE = 1e-5
#: Files that cut_small() writes for each partition it is read in, at most, if the number of rows is bounded.
FILES = 3


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and the master is local."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    set_ = spark.sparkContext.getCheckpointDir()
    if given:
        if set_ is None:
            spark.sparkContext.setCheckpointDir(given)
        return given
    if set_ is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ploidyne-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that no lost executor makes it run again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_small(df: DataFrame, rows: int = 100_000, most: int | None = None) -> DataFrame:
    """``cut`` for narrow tables: read again in partitions of ``rows`` rows or more, so that unions and scans of many small parts don't multiply tasks.

    ``most``: a number of rows that ``df`` can't exceed, if one is known. Then it is also written in few parts: each file costs a task and, in a local folder, processes
    that the executor starts.
    """
    return cut_counted(df, rows, most)[0]


def cut_counted(df: DataFrame, rows: int = 100_000, most: int | None = None) -> tuple[DataFrame, int]:
    """``cut_small`` and the number of rows, which it counts anyway."""
    df = cut(df if most is None else in_few_parts(df, most, rows))
    n = df.count()
    return df.coalesce(partitions_for(n, rows)), n


def in_few_parts(df: DataFrame, most: int, rows: int = 100_000) -> DataFrame:
    """``df``, which has at most ``most`` rows, in FILES parts at most for each partition that so many rows would be read in."""
    return df.coalesce(FILES * partitions_for(most, rows))


def partitions_for(count: int, rows: int = 100_000) -> int:
    return max(8, -(-count // rows))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it to have at most ``rows`` rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def own_prefix(*frames: DataFrame) -> str:
    """A prefix that no column of ``frames`` has, for columns that a plan needs for itself."""
    prefix = "_own_"
    while any(c.lower().startswith(prefix) for f in frames for c in f.columns):
        prefix += "_"
    return prefix


def hot_rows(total: int) -> int:
    """From more rows than this on a key is hot, in a table of ``total`` rows."""
    return max(HOT_ROWS, int(total * HOT_SHARE))


def join_unskewed(rows: DataFrame, summary: DataFrame, key: str, count: str, hot: int) -> DataFrame:
    """``rows`` joined with ``summary``, which has one row for each ``key`` with the number ``count`` of rows that have it.

    Keys with more than ``hot`` rows are few (the number of rows over ``hot`` at most), so they are broadcast and their rows stay where they are;
    only the others are dealt by key. Rows whose key the summary lacks go.
    """
    few = F.broadcast(summary.where(F.col(count) > hot))
    rest = rows.join(few.select(key), key, "left_anti").join(summary.where(F.col(count) <= hot), key)
    return rows.join(few, key).unionByName(rest)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node reachable.

    Large-star and small-star rounds until nothing changes: each round only takes minima by node and turns each edge into one other, so no
    neighbourhood is gathered in one task and no round has more edges than the one before; repeats among them do no harm and need no
    shuffle of their own. The edges of a hub meet its minimum by broadcast. Each round is written to the shared folder. Null ends and self-loops are dropped.
    ``most``: a number that the edges can't exceed, as in ``cut_small``.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    e, edges_left = cut_counted(e, most=most)
    hot, parts = hot_rows(2 * edges_left), partitions_for(edges_left)
    seen = None
    while True:
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_unskewed(both, low, "u", "n", hot).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        # a node's edge to its least neighbour stays; its other neighbours are tied to that one
        small = join_unskewed(large, low, "u", "n", hot).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # each round adds the partitions of its joins, so they are put together
        e = cut(small.coalesce(parts))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    # converged: every node has one edge to its least node
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
