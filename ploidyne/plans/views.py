"""Roles of the engine played by the driver's tables: genes, counts, profiles, alleles, posteriors; in Spark, and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def genes(self) -> DataFrame:
        """gene, gene_start, gene_end, CHROM, gene_length."""
        start = (F.col("p_partkey") * 1000).alias("gene_start")
        p = self.table("part").select(F.col("p_partkey").cast("string").alias("gene"), start, (F.col("p_partkey") * 1000 + F.col("p_size") * 1000).alias("gene_end"), F.regexp_extract("p_brand", r"(\d+)", 1).alias("CHROM"))
        return p.withColumn("gene_length", F.col("gene_end") - F.col("gene_start"))

    def counts(self) -> DataFrame:
        """cell, gene, cnt."""
        li = self.table("lineitem")
        return li.groupBy(F.col("l_suppkey").cast("string").alias("cell"), F.col("l_partkey").cast("string").alias("gene")).agg(F.sum(F.col("l_quantity").cast("long")).alias("cnt"))

    def ref(self) -> DataFrame:
        """gene, ref, lambda: shares within a profile."""
        li = self.table("lineitem").select(F.col("l_partkey").cast("string").alias("gene"), F.col("l_returnflag").alias("ref"), F.col("l_quantity").cast("long").alias("q"))
        total = li.groupBy("ref").agg(F.sum("q").alias("t"))
        return li.groupBy("gene", "ref").agg(F.sum("q").alias("q")).join(total, "ref").select("gene", "ref", (F.col("q") / F.col("t")).alias("lambda"))

    def alleles(self) -> DataFrame:
        """cell, snp_id, CHROM, POS, cM, AD, DP, GT, gene."""
        g = self.genes().select("gene", "CHROM")
        li = self.table("lineitem").select(F.col("l_suppkey").cast("string").alias("cell"), F.col("l_partkey").alias("k"), "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_quantity") * F.col("l_discount") * 10).cast("long").alias("a"))
        x = li.join(g, li["k"].cast("string") == g["gene"])
        x = x.withColumn("POS", F.col("k") * 1000 + F.col("l_linenumber") * 137).withColumn("GT", F.when((F.col("k") + F.col("l_linenumber")) % 2 == 0, F.lit("1|0")).otherwise(F.lit("0|1")))
        x = x.groupBy("cell", "CHROM", "POS", "GT", "gene").agg(F.sum(F.least("a", "q")).alias("AD"), F.sum("q").alias("DP"))
        return x.select("cell", F.concat_ws("_", "CHROM", F.col("POS").cast("string")).alias("snp_id"), "CHROM", "POS", (F.col("POS") / 1e6).alias("cM"), "AD", "DP", "GT", "gene")

    def membership(self) -> DataFrame:
        """sample, cell."""
        return self.table("supplier").select((F.col("s_suppkey") % 4).cast("string").alias("sample"), F.col("s_suppkey").cast("string").alias("cell"))

    def states(self) -> DataFrame:
        """sample, CHROM, POS, state, gene, snp_index: orders of a customer, in order, as a chain of states."""
        o = self.table("orders")
        return o.select((F.col("o_custkey") % 50).cast("string").alias("CHROM"), F.col("o_orderkey").alias("POS"), F.col("o_orderstatus").alias("state"), F.col("o_custkey").cast("string").alias("gene"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice").cast("long")).alias("pAD"))

    def segments(self) -> DataFrame:
        """CHROM, seg, seg_start, seg_end, cnv_state, LLR, sample: every seventh gene as a called segment."""
        g = self.genes().where(F.col("gene").cast("long") % 7 == 0)
        k = F.col("gene").cast("long")
        state = F.element_at(F.array(*[F.lit(s) for s in ("neu", "del", "amp", "loh", "bamp")]), (F.floor(k / 7) % 5 + 1).cast("int"))
        return g.select((k % 3).cast("string").alias("sample"), "CHROM", F.concat_ws("_", "CHROM", "gene").alias("seg"), F.col("gene_start").alias("seg_start"), (F.col("gene_end") + 20000).alias("seg_end"), state.alias("cnv_state"), (k % 11).cast("double").alias("LLR"))

    def likelihoods(self) -> DataFrame:
        """cell, CHROM, seg, cnv_state and log-likelihoods l11 ... l00 from allele sums."""
        from ploidyne.operators import posterior

        return posterior.allele_likelihoods(self.cell_alleles())

    def cell_alleles(self) -> DataFrame:
        """cell, CHROM, seg, cnv_state, major, minor, total, MAF: sums by cell and chromosome."""
        kind = F.element_at(F.array(*[F.lit(k) for k in ("amp", "loh", "bamp", "del")]), (F.col("CHROM").cast("int") % 4 + 1).cast("int"))
        major = F.when(F.col("GT") == "1|0", F.col("AD")).otherwise(F.col("DP") - F.col("AD"))
        x = self.alleles().withColumn("seg", F.concat("CHROM", F.lit("a"))).withColumn("cnv_state", kind)
        x = x.groupBy("cell", "CHROM", "seg", "cnv_state").agg(F.sum(major).alias("major"), F.sum("DP").alias("total"))
        return x.withColumn("minor", F.col("total") - F.col("major")).withColumn("MAF", F.try_divide(F.col("major"), F.col("total")))

    def edges(self) -> DataFrame:
        """src, dst, dist: neighbours by number within a label, both ways."""
        e = self.table("embeddings").select("vec_id", "label")
        near = e.withColumn("dst", F.explode(F.array(*[F.col("vec_id") + d for d in (-20, -10, -1, 1, 10, 20)])))
        x = near.join(e.select(F.col("vec_id").alias("dst"), F.col("label").alias("l2")), "dst").where("label = l2 or abs(vec_id - dst) <= 1")
        return x.select(F.col("vec_id").alias("src"), "dst")


#: The same as CTEs, to stand before a query.
SQL = r"""
genes AS (SELECT p_partkey::VARCHAR AS gene, p_partkey * 1000 AS gene_start, p_partkey * 1000 + p_size * 1000 AS gene_end, regexp_extract(p_brand, '(\d+)', 1) AS "CHROM", p_size * 1000 AS gene_length FROM part),
counts AS (SELECT l_suppkey::VARCHAR AS cell, l_partkey::VARCHAR AS gene, sum(trunc(l_quantity)::BIGINT)::BIGINT AS cnt FROM lineitem GROUP BY ALL),
ref0 AS (SELECT l_partkey::VARCHAR AS gene, l_returnflag AS ref, sum(trunc(l_quantity)::BIGINT)::BIGINT AS q FROM lineitem GROUP BY ALL),
refs AS (SELECT gene, ref, q::DOUBLE / sum(q) OVER (PARTITION BY ref) AS lambda FROM ref0),
alleles AS (SELECT cell, "CHROM" || '_' || "POS" AS snp_id, "CHROM", "POS", "POS" / 1e6 AS "cM", "AD", "DP", "GT", gene FROM (
  SELECT l_suppkey::VARCHAR AS cell, g."CHROM", l_partkey * 1000 + l_linenumber * 137 AS "POS", CASE WHEN (l_partkey + l_linenumber) % 2 = 0 THEN '1|0' ELSE '0|1' END AS "GT", gene,
         sum(least(round(l_quantity * l_discount * 10)::BIGINT, trunc(l_quantity)::BIGINT))::BIGINT AS "AD", sum(trunc(l_quantity)::BIGINT)::BIGINT AS "DP"
  FROM lineitem JOIN genes g ON l_partkey::VARCHAR = g.gene GROUP BY ALL)),
membership AS (SELECT (s_suppkey % 4)::VARCHAR AS sample, s_suppkey::VARCHAR AS cell FROM supplier),
states AS (SELECT (o_custkey % 50)::VARCHAR AS "CHROM", o_orderkey AS "POS", o_orderstatus AS state, o_custkey::VARCHAR AS gene, CASE WHEN o_orderkey % 3 <> 0 THEN trunc(o_totalprice)::BIGINT END AS "pAD" FROM orders),
segments AS (SELECT (gene::BIGINT % 3)::VARCHAR AS sample, "CHROM", "CHROM" || '_' || gene AS seg, gene_start AS seg_start, gene_end + 20000 AS seg_end, ['neu','del','amp','loh','bamp'][(gene::BIGINT // 7) % 5 + 1] AS cnv_state, (gene::BIGINT % 11)::DOUBLE AS "LLR" FROM genes WHERE gene::BIGINT % 7 = 0),
cell_alleles AS (SELECT *, total - major AS minor, CASE WHEN total > 0 THEN major::DOUBLE / total END AS "MAF" FROM (
  SELECT cell, "CHROM", "CHROM" || 'a' AS seg, ['amp','loh','bamp','del']["CHROM"::INT % 4 + 1] AS cnv_state, sum(CASE WHEN "GT" = '1|0' THEN "AD" ELSE "DP" - "AD" END)::BIGINT AS major, sum("DP")::BIGINT AS total
  FROM alleles GROUP BY ALL)),
edges AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN (SELECT unnest([-20,-10,-1,1,10,20]) AS d) x ON true JOIN embeddings b ON b.vec_id = a.vec_id + x.d WHERE a.label = b.label OR abs(a.vec_id - b.vec_id) <= 1)
"""
