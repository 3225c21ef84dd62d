"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Every source gets a target number of words. Whole epochs come first; what is left of a target is filled by a weighted sample
without replacement: a document's key is an exponential variate, ``-ln(u) / weight``, and those with the least keys are taken
until their prefix sum of sizes reaches the budget. The key depends on doc_id, text and seed alone, so reruns agree.

A document is taken if half of its words lie within the budget, so those taken of a source are a prefix in the order of (key, doc_id): one boundary for each source
decides. A first pass over the texts writes (source, key, doc_id, size). A source may hold a third of all rows, so its documents are never sorted in one
task: sums by (source, bucket of keys) find the bucket in which the budget ends, and that bucket is cut in buckets again until it holds at
most BUCKET_ROWS documents, or one key alone. Only those are ranked, equal ones as one with their number. A second pass over the texts compares keys
with the boundaries. Where equal rows lie across a boundary, they are numbered by partition, so no task sees all of them.

Defined cases: a null or empty text has size 0 and is never taken by the fractional part; a null source is a source of its own,
last in order; sources without words get target 0; a weight that is null, zero, negative or not a number counts as the least positive one, so such a document comes last; rows that repeat
are drawn one by one in no fixed order among themselves, which gives the same multiset of results; a very long text counts whole, and may pass a budget by half of its words; an empty
table gives an empty result; columns of the input named like the published ones (size, source_size, target, copies, taken) are replaced, others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ploidyne.llm.common import cut, documents, own_prefix, small_enough

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: So many documents are ranked in one window at most, for each source.
BUCKET_ROWS = 20_000
#: Buckets that a range of keys is cut in.
BUCKETS = 1024
LEAST_WEIGHT = 1e-300
WORD = r"[^\x20\x09-\x0D]+"
#: Digits and signs that are rare in prose; their share lowers a document's quality weight.
NOISE = "0123456789*#$%&|<>{}[]=+_~^@\\!"


def quality_weight(text: str = "text"):
    """0.05 to 1: the share of a text's characters that aren't noise."""
    n = F.coalesce(F.length(text), F.lit(0))
    clean = F.coalesce(F.length(F.translate(F.col(text), NOISE, "")), F.lit(0))
    return F.greatest(F.lit(0.05), F.when(n > 0, clean.cast("double") / n).otherwise(F.lit(1.0)))


def uniform(seed: str, doc_id: str = "doc_id", text: str = "text"):
    """A number in (0, 1) with 52 bits of md5(seed, doc_id, md5(text))."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = MAX_EPOCHS) -> DataFrame:
    """Targets from (source, source_size): weights share all words, no target exceeds ``cap`` times its source.

    Capping and sharing the excess again until none is above ends at one water level: source i gets min(cap * size, level * weight).
    Sources are sorted by cap * size / weight; the level is the first at which those that are left can take what is left. From there on levels
    only fall, so it is the greatest of those that fit. The
    table has a row per source, so its windows see as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    below = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(below), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0.0))))
    s = s.withColumn("open_level", F.max(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("open_level") * F.col("w"), F.col("limit"))).alias("target"))


def boundaries(keyed: DataFrame, weights, cap: float, bucket_rows: int) -> DataFrame:
    """A row for each source: source, source_size, target, epochs, and the first of its (key, doc_id) that isn't taken whole: x (null: none), of whose ``c`` equal rows ``m`` are taken.

    ``keyed``: (source, key, doc_id, size).
    """
    sources = source_targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    plan = sources.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    # the range of keys that holds the boundary, and the words of the source before it
    plan = plan.withColumns({"low": F.lit(0.0), "high": F.lit(float("inf")), "before": F.lit(0).cast("long"), "n": F.lit(None).cast("long")})
    plan = cut(plan)
    while True:
        s = small_enough(plan.select(F.col("source").alias("s"), "low", "high", "before", "budget", F.coalesce(F.col("n") > bucket_rows, F.lit(True)).alias("open")).where("open and low < high"))
        inner = keyed.join(s, F.col("source").eqNullSafe(F.col("s"))).where("key >= low and key <= high")
        # an open range is cut as if keys were exponential, others evenly
        share = F.when(F.col("high") == float("inf"), 1 - F.exp(-F.col("key"))).otherwise((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")))
        parts = inner.groupBy("source", F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).cast("int").alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("k0"), F.max("key").alias("k1"), F.first("before").alias("b"), F.first("budget").alias("g"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("upto", F.sum("words").over(upto) + F.col("b"))
        ends = parts.where("upto >= g").groupBy("source").agg(F.min(F.struct("bucket", "k0", "k1", (F.col("upto") - F.col("words")).alias("before"), "rows")).alias("e"))
        ends = ends.withColumnRenamed("source", "s2")
        found = F.col("e").isNotNull()
        plan = plan.join(small_enough(ends), F.col("source").eqNullSafe(F.col("s2")), "left").select(
            "source", "source_size", "target", "epochs", "budget", *[F.when(found, F.col(f"e.{x}")).otherwise(F.col(y)).alias(y) for x, y in (("k0", "low"), ("k1", "high"), ("before", "before"))], F.when(found, F.col("e.rows")).otherwise(F.coalesce("n", F.lit(0))).alias("n"))
        plan = cut(plan)
        if plan.where((F.col("n") > bucket_rows) & (F.col("low") < F.col("high"))).limit(1).count() == 0:
            break
    s = small_enough(plan.where("n > 0").select(F.col("source").alias("s"), "low", "high", "before", "budget"))
    inner = keyed.join(s, F.col("source").eqNullSafe(F.col("s"))).where("key >= low and key <= high")
    ranked = inner.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("c"), F.first("before").alias("b"), F.first("budget").alias("g"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("g") - F.col("b") - (F.sum(F.col("size") * F.col("c")).over(order) - F.col("size") * F.col("c"))
    ranked = ranked.withColumn("m", F.when(F.col("size") == 0, F.col("c")).otherwise(F.greatest(F.lit(0), F.least(F.col("c"), F.floor((room - F.col("size") / 2) / F.col("size")) + 1))))
    first = ranked.where("m < c").groupBy("source").agg(F.min(F.struct("key", "doc_id", "size", "m", "c")).alias("f")).withColumnRenamed("source", "s2")
    last = F.lit(2**63 - 1).cast("long")  # all within the range are taken, none after it
    x = F.when(F.col("budget") <= 0, F.struct(F.lit(-1.0).alias("key"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("size"))).when(F.col("f").isNotNull(), F.struct("f.key", "f.doc_id", "f.size")).when(F.col("n") > 0, F.struct(F.col("high").alias("key"), last.alias("doc_id"), last.alias("size")))
    return cut(plan.join(small_enough(first), F.col("source").eqNullSafe(F.col("s2")), "left").select("source", "source_size", "target", "epochs", x.alias("x"), F.coalesce("f.m", F.lit(0)).cast("long").alias("m"), F.coalesce("f.c", F.lit(0)).cast("long").alias("c")))


def mix_sources(docs: DataFrame, weights=WEIGHTS, cap: float = MAX_EPOCHS, seed: str = SEED, weight=None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with size, source_size, target, copies (how often the mix takes the document) and taken (words: copies * size).

    ``weight``: a column expression of positive quality weights; quality_weight() if None.
    """
    kept = docs.drop("size", "source_size", "target", "copies", "taken")
    names, own = kept.columns, own_prefix(docs)
    w = quality_weight() if weight is None else F.when(F.coalesce(weight > 0, F.lit(False)) & ~F.isnan(weight.cast("double")), weight.cast("double")).otherwise(F.lit(LEAST_WEIGHT))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    parts = {"key": -F.log(uniform(seed)) / w, "id": F.col("doc_id").cast("long"), "size": size}
    keyed = cut(docs.select("source", parts["key"].alias("key"), parts["id"].alias("doc_id"), parts["size"].alias("size")))
    plan = boundaries(keyed, weights, cap, bucket_rows)
    p = lambda c: F.col(f"{own}{c}")
    base = docs.select(*names, *[e.alias(f"{own}{c}") for c, e in parts.items()])
    joined = base.join(small_enough(plan.select(*[F.col(c).alias(f"{own}_{c}") for c in plan.columns])), F.col("source").eqNullSafe(p("_source")), "left")
    here, x = F.struct(p("key").alias("key"), p("id").alias("doc_id"), p("size").alias("size")), p("_x")
    known = F.when(x.isNull() | (here < x), F.lit(1)).when(here > x, F.lit(0)).when(p("_m") == 0, F.lit(0)).when(p("_m") == p("_c"), F.lit(1))
    joined = joined.withColumn(f"{own}one", F.when(p("size") == 0, F.lit(0)).otherwise(known))

    def finished(df: DataFrame) -> DataFrame:
        copies = p("_epochs") + p("one")
        return df.select(*names, p("size").alias("size"), p("_source_size").alias("source_size"), p("_target").alias("target"), copies.alias("copies"), (copies * p("size")).alias("taken"))

    if plan.where("m > 0 and m < c").limit(1).count() == 0:
        return finished(joined)
    # equal rows of which some are taken: numbered within the partitions in which they were written
    equal = cut(joined.where(p("one").isNull())).withColumn(f"{own}part", F.spark_partition_id())
    per = equal.groupBy(f"{own}_source", f"{own}part").agg(F.count(F.lit(1)).alias(f"{own}n"))
    earlier = Window.partitionBy(f"{own}_source").orderBy(f"{own}part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.withColumn(f"{own}start", F.coalesce(F.sum(f"{own}n").over(earlier), F.lit(0))).select(p("_source").alias(f"{own}s"), p("part").alias(f"{own}p"), f"{own}start")
    within = Window.partitionBy(f"{own}_source", f"{own}part").orderBy(f"{own}key")
    equal = equal.withColumn(f"{own}i", F.row_number().over(within)).join(small_enough(starts), p("_source").eqNullSafe(p("s")) & (p("part") == p("p")))
    equal = equal.withColumn(f"{own}one", (p("i") + p("start") <= p("_m")).cast("int"))
    return finished(joined.where(p("one").isNotNull())).unionByName(finished(equal))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it."""
    copy = f"{own_prefix(mixed)}copy"
    return mixed.where("copies > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(copy)).drop(copy)


#: The same law in plain windows.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
         greatest(0.05, CASE WHEN coalesce(length(text), 0) > 0 THEN length(translate(text, '0123456789*#$%&|<>{}[]=+_~^@\!', ''))::DOUBLE / length(text) ELSE 1.0 END) AS q
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(3 * source_size, coalesce(max(CASE WHEN level * w <= 3 * source_size THEN level END) OVER () * w, 3 * source_size)) AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       ((epochs + CASE WHEN size > 0 AND upto - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM p
"""


def op10(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
