"""Pseudobulk assembly, for all samples at once: the sample is a key like others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ploidyne.functions.scalars import phased_depth, ratio, switch_prob
from ploidyne.operators.relational import HLA, filter_genes, filter_positions, gene_totals, het_filter, null_repeated_expression
from ploidyne.operators.windows import lag_distance

LN2 = 0.6931471805599453


def fold_changes(x: DataFrame) -> DataFrame:
    """log2 and natural log of observed over expected expression; null where either is zero."""
    r = F.try_divide("lambda_obs", "lambda_ref")
    return x.withColumn("lnFC", F.when(r > 0, F.log(r))).withColumn("logFC", F.col("lnFC") / LN2)


def expression_bulk(counts: DataFrame, membership: DataFrame, ref: DataFrame, genes: DataFrame, hla: bool = True, whole_depth: bool = False) -> DataFrame:
    """By sample and gene: counts, depth, observed and reference expression, fold changes. ``ref``: [sample,] gene, lambda_ref.
    The depth is that of the genes that annotation and reference share, with ``whole_depth`` that of all counts."""
    y = counts.join(membership, "cell").groupBy("sample", "gene").agg(F.sum("cnt").alias("Y_obs"))
    on = ["sample", "gene"] if "sample" in ref.columns else ["gene"]
    x = y.join(ref, on).join(genes.select("gene", "CHROM", "gene_start", "gene_end"), "gene")
    depth = (y if whole_depth else x).groupBy("sample").agg(F.sum("Y_obs").alias("d_obs"))
    x = x.join(depth, "sample").withColumn("lambda_obs", F.try_divide("Y_obs", "d_obs"))
    x = filter_genes_by_sample(x, hla)
    x = fold_changes(x).where("logFC is not null")
    return x.withColumn("gene_index", F.row_number().over(Window.partitionBy("sample", "CHROM").orderBy("gene_start", "gene")) - 1)


def filter_genes_by_sample(x: DataFrame, hla: bool = True) -> DataFrame:
    """P06 within each sample."""
    if hla:
        x = x.where(~((F.col("CHROM") == HLA[0]) & (F.col("gene_start") < HLA[2]) & (F.col("gene_end") > HLA[1])))
    m = x.groupBy("sample").agg(F.avg(F.when(F.col("lambda_ref") > 0, F.col("lambda_ref"))).alias("_mr"), F.avg(F.when(F.col("lambda_obs") > 0, F.col("lambda_obs"))).alias("_mo"))
    return x.join(m, "sample").where("lambda_ref > 0 and ((lambda_ref * 1e6 > 2 and lambda_obs * 1e6 > 2) or lambda_ref > _mr or lambda_obs > _mo)").drop("_mr", "_mo")


def allele_bulk(alleles: DataFrame, membership: DataFrame | None = None, nu: float = 1.0, min_depth: int = 0) -> DataFrame:
    """By sample and SNP: depths, phased ratio, index, distance to the SNP before and switch probability."""
    a = het_filter(alleles)
    a = a.join(membership, "cell") if membership is not None else a.withColumn("sample", F.lit("0"))
    x = a.groupBy("sample", "snp_id", "CHROM", "POS", "cM", "GT", "gene").agg(F.sum("AD").alias("AD"), F.sum("DP").alias("DP"))
    x = x.withColumn("snp_index", F.row_number().over(Window.partitionBy("sample", "CHROM").orderBy("POS", "snp_id")) - 1).where(F.col("DP") >= min_depth)
    x = x.withColumn("AR", ratio("AD", "DP")).withColumn("pAD", phased_depth("GT", "AD", "DP")).withColumn("pBAF", ratio("pAD", "DP"))
    x = x.withColumn("inter_snp_cm", lag_distance("cM", ("sample", "CHROM"), "POS", "snp_id"))
    return x.withColumn("p_s", switch_prob("inter_snp_cm", nu))


def combine_bulk(alleles: DataFrame, expression: DataFrame, hla: bool = True, segments: DataFrame | None = None) -> DataFrame:
    """SNPs and genes in one table; genes without SNPs stand at their start."""
    e = expression.select("sample", "CHROM", "gene", "Y_obs", "d_obs", "lambda_obs", "lambda_ref", "gene_start", "gene_end", "logFC", "lnFC")
    x = alleles.join(e, ["sample", "CHROM", "gene"], "full_outer")
    x = x.withColumn("snp_id", F.coalesce("snp_id", "gene")).withColumn("POS", F.coalesce("POS", "gene_start")).withColumn("p_s", F.coalesce("p_s", F.lit(0.0)))
    x = null_repeated_expression_by_sample(x)
    for c in ("lambda_obs", "logFC", "lnFC"):
        x = x.withColumn(c, F.when(F.col("Y_obs").isNotNull(), F.col(c)))
    if hla:
        x = x.where(~((F.col("CHROM") == HLA[0]) & (F.col("POS") > HLA[1]) & (F.col("POS") < HLA[2])))
    if segments is not None:
        x = filter_positions(x, segments)
    return x.withColumn("snp_index", F.row_number().over(Window.partitionBy("sample", "CHROM").orderBy("POS", "snp_id")) - 1)


def null_repeated_expression_by_sample(x: DataFrame) -> DataFrame:
    """P18 within each sample."""
    first = F.row_number().over(Window.partitionBy("sample", "CHROM", "gene").orderBy("POS", "snp_id")) == 1
    return x.withColumn("Y_obs", F.when(first | F.col("gene").isNull(), F.col("Y_obs")))


def get_bulk(counts, alleles, membership, ref_long, genes, nu: float = 1.0, min_depth: int = 0, hla: bool = True, loh: DataFrame | None = None, segments: DataFrame | None = None) -> DataFrame:
    """Reference fit, expression, alleles and LOH flags of all samples in one pass."""
    from ploidyne.functions.kernels import fit_reference

    weights = fit_reference(gene_totals(counts.join(membership, "cell"), ("sample", "gene")), ref_long)
    ref = ref_long.join(weights, "ref").groupBy("sample", "gene").agg(F.sum(F.col("lambda") * F.col("w")).alias("lambda_ref"))
    e = expression_bulk(counts, membership, ref, genes, hla, whole_depth=True).where("(logFC > -5 and logFC < 5) or Y_obs = 0")
    x = combine_bulk(allele_bulk(alleles, membership, nu, min_depth), e, hla, segments)
    x = x.where("lambda_ref <> 0 or gene is null").join(weights.select("sample", "mse").distinct(), "sample")
    if loh is not None:
        from ploidyne.operators.intervals import point_join

        hit = point_join(x.select("snp_id", "CHROM", "POS").distinct(), loh.select("CHROM", "seg_start", "seg_end"), "seg_start", "seg_end", closed=True).select("snp_id").distinct().withColumn("loh", F.lit(True))
        x = x.join(hit, "snp_id", "left")
    else:
        x = x.withColumn("loh", F.lit(False))
    return x.withColumn("loh", F.coalesce("loh", F.lit(False)))


def preprocess_alleles(ad: DataFrame, dp: DataFrame, snps: DataFrame, phased: DataFrame, genes: DataFrame, marks: DataFrame) -> DataFrame:
    """Matrices (i, j, v) of a pileup and its SNPs (i, snp_id, CHROM, POS, REF, ALT, OTH) with phased genotypes (snp_id, GT): the allele table."""
    from ploidyne.operators.intervals import annotate_genes, interpolate

    x = dp.withColumnRenamed("v", "DP").join(ad.withColumnRenamed("v", "AD"), ["i", "j"], "left").withColumn("AD", F.coalesce("AD", F.lit(0)))
    x = x.join(snps, "i").join(phased.select("snp_id", "GT"), "snp_id", "left")
    depth = x.groupBy("snp_id").agg(F.sum("DP").alias("DP_all"), F.max(F.coalesce("OTH", F.lit(0))).alias("OTH_all")).where("DP_all > 1 and OTH_all = 0").select("snp_id")
    x = x.join(depth, "snp_id", "left_semi").withColumn("AR", ratio("AD", "DP"))
    x = annotate_genes(interpolate(x, marks), genes)
    return x.where("GT in ('1|0', '0|1')").select(F.col("j").cast("string").alias("cell"), "snp_id", "CHROM", "POS", "cM", "REF", "ALT", "AD", "DP", "GT", "gene")


__all__ = ["allele_bulk", "combine_bulk", "expression_bulk", "filter_genes", "get_bulk", "null_repeated_expression", "preprocess_alleles"]
