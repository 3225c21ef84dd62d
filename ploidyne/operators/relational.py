"""Validation, filters, aggregates and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ploidyne.functions.scalars import binary_entropy

HLA = ("6", 28510120, 33480577)
AUTOSOMES = [str(k) for k in range(1, 23)]


def require(df: DataFrame, columns, what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df


def check_alleles(alleles: DataFrame, validate: bool = True) -> DataFrame:
    """Columns, one genotype for each SNP, chr stripped, autosomes only."""
    require(alleles, ("cell", "snp_id", "CHROM", "POS", "cM", "AD", "DP", "GT"), "alleles")
    if validate:
        bad = alleles.where("GT is not null and GT <> ''").groupBy("snp_id").agg(F.countDistinct("GT").alias("n")).where("n > 1").limit(1)
        if bad.count():
            raise ValueError(f"alleles: more than one genotype for {bad.first().snp_id}")
    return alleles.withColumn("CHROM", F.regexp_replace("CHROM", "^chr", "")).where(F.col("CHROM").isin(AUTOSOMES))


def check_reference(ref: DataFrame) -> DataFrame:
    """No nulls, not all integers, genes unique within a profile."""
    r = ref.agg(F.count_if(F.col("lambda").isNull() | F.isnan("lambda")).alias("nulls"), F.every(F.col("lambda") == F.floor("lambda")).alias("whole"), F.count(F.lit(1)).alias("n")).first()
    if r.nulls or r.whole:
        raise ValueError("reference: " + ("null values" if r.nulls else "counts, not proportions"))
    if ref.groupBy("gene", "ref").count().where("count > 1").limit(1).count():
        raise ValueError("reference: duplicate genes")
    return ref


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Later rows of a repeated name get -1, -2, ..."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("_n", n).withColumn(name, F.when(F.col("_n") > 0, F.concat_ws("-", name, F.col("_n").cast("string"))).otherwise(F.col(name))).drop("_n")


def gene_universe(genes: DataFrame, counts: DataFrame, ref: DataFrame) -> DataFrame:
    """Genes that annotation, counts and reference share, with gene_index in the order of the genome."""
    from ploidyne.functions.scalars import chrom_key

    g = genes.join(counts.select("gene").distinct(), "gene", "left_semi").join(ref.select("gene").distinct(), "gene", "left_semi")
    inner = g.withColumn("_r", F.row_number().over(Window.partitionBy("CHROM").orderBy("gene_start", "gene")) - 1)
    sizes = g.groupBy("CHROM").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy(chrom_key("CHROM"), "CHROM").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return inner.join(sizes, "CHROM").withColumn("gene_index", F.col("_r") + F.col("_before")).drop("_r", "_before")


def drop_empty_cells(counts: DataFrame, alleles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells without counts go from both tables."""
    kept = counts.groupBy("cell").agg(F.sum("cnt").alias("t")).where("t > 0").select("cell")
    return counts.join(kept, "cell", "left_semi"), alleles.join(kept, "cell", "left_semi")


def filter_genes(expr: DataFrame, segments: DataFrame | None = None, hla: bool = True) -> DataFrame:
    """Of (gene, CHROM, gene_start, gene_end, lambda_obs, lambda_ref) the genes outside HLA and ``segments`` with enough expression."""
    from ploidyne.operators.intervals import flag_overlap

    x = expr
    if hla:
        x = x.where(~((F.col("CHROM") == HLA[0]) & (F.col("gene_start") < HLA[2]) & (F.col("gene_end") > HLA[1])))
    if segments is not None:
        x = flag_overlap(x, segments, "_cut").where("not _cut").drop("_cut")
    means = x.agg(F.avg(F.when(F.col("lambda_ref") > 0, F.col("lambda_ref"))).alias("_mr"), F.avg(F.when(F.col("lambda_obs") > 0, F.col("lambda_obs"))).alias("_mo"))
    return x.crossJoin(F.broadcast(means)).where("lambda_ref > 0 and ((lambda_ref * 1e6 > 2 and lambda_obs * 1e6 > 2) or lambda_ref > _mr or lambda_obs > _mo)").drop("_mr", "_mo")


def filter_positions(bulk: DataFrame, ranges: DataFrame) -> DataFrame:
    """Markers strictly inside any of ``ranges`` go."""
    from ploidyne.operators.intervals import point_join

    inside = point_join(bulk.select("snp_id", "CHROM", "POS").distinct(), ranges.select("CHROM", "seg_start", "seg_end"), "seg_start", "seg_end", closed=False).select("snp_id").distinct()
    return bulk.join(inside, "snp_id", "left_anti")


def het_filter(alleles: DataFrame, min_depth: int = 0) -> DataFrame:
    """P08."""
    return alleles.where(F.col("GT").isin("1|0", "0|1") & F.col("cM").isNotNull() & (F.col("DP") >= min_depth))


def fold_change_filter(bulk: DataFrame, limit: float = 5.0) -> DataFrame:
    """Finite fold changes within the limit, or zero counts."""
    return bulk.where((F.abs("logFC") < limit) | (F.col("Y_obs") == 0))


def null_repeated_expression(bulk: DataFrame) -> DataFrame:
    """Of a gene's rows only the first keeps the count."""
    first = F.row_number().over(Window.partitionBy("CHROM", "gene").orderBy("POS")) == 1
    return bulk.withColumn("Y_obs", F.when(first | F.col("gene").isNull(), F.col("Y_obs")))


def fixed_segments(segs: DataFrame) -> DataFrame:
    """Given consensus segments as certain: one-hot p_*, LLR infinite but for neutral ones."""
    require(segs, ("CHROM", "seg", "seg_start", "seg_end", "cnv_state"), "segments")
    x = segs.withColumn("seg", F.when(F.col("seg").cast("string").rlike(r"^\d+$"), F.concat_ws("_", "CHROM", "seg")).otherwise(F.col("seg").cast("string")))
    for s in ("loh", "del", "amp", "bamp", "bdel"):
        x = x.withColumn(f"p_{s}", (F.col("cnv_state") == s).cast("double"))
    return x.withColumn("LLR", F.when(F.col("cnv_state") != "neu", F.lit(float("inf")))).withColumn("seg_cons", F.col("seg")).withColumn("cnv_state_post", F.col("cnv_state"))


def loh_segments(segs: DataFrame) -> DataFrame:
    """P15."""
    require(segs, ("CHROM", "seg", "seg_start", "seg_end"), "LOH segments")
    return segs.withColumn("seg", F.when(F.col("seg").cast("string").rlike(r"^\d+$"), F.concat_ws("_", "CHROM", "seg")).otherwise(F.col("seg").cast("string"))).withColumn("loh", F.lit(True))


def posterior_filter(joint: DataFrame, max_entropy: float = 0.5, min_llr: float = 5.0) -> DataFrame:
    """P17."""
    return joint.where((F.col("cnv_state") != "neu") & (F.col("avg_entropy") < max_entropy) & (F.col("LLR") > min_llr))


def plot_states(bulk: DataFrame, min_llr: float = 5.0) -> DataFrame:
    """States to draw: weak calls neutral, clonal LOH as del, phase and level from p_up and the state."""
    llr = F.coalesce("LLR", F.lit(0.0))
    x = bulk.withColumn("LLR", llr).withColumn("state_post", F.when(F.col("loh"), F.lit("del")).when(llr < min_llr, F.lit("neu")).otherwise(F.col("state_post")))
    level = F.when(F.col("state").contains("_2"), F.lit("2")).otherwise(F.lit("1"))
    side = F.when(F.col("p_up") > 0.5, F.lit("up")).otherwise(F.lit("down"))
    return x.withColumn("state_post", F.when(F.col("state_post").isin("amp", "loh", "del"), F.concat_ws("_", "state_post", level, side)).otherwise(F.col("state_post")))


def plot_values(bulk: DataFrame, min_depth: int = 8, limits=(-2.0, 2.0)) -> DataFrame:
    """Long (variable, value): logFC less the baseline, clipped to null, and pHF where the depth allows."""
    fc = F.col("logFC") - F.col("mu") / F.lit(0.6931471805599453)
    x = bulk.withColumn("logFC", F.when(fc.between(*limits), fc)).withColumn("pHF", F.when(F.col("DP") >= min_depth, F.col("pBAF")))
    return x.unpivot(["snp_id", "CHROM", "POS"], ["logFC", "pHF"], "variable", "value")


def allele_totals(alleles: DataFrame, keys=("snp_id", "CHROM", "POS", "cM", "GT", "gene")) -> DataFrame:
    """A01; null genes are a group of their own."""
    return alleles.groupBy(*keys).agg(F.sum("AD").alias("AD"), F.sum("DP").alias("DP"))


def gene_totals(counts: DataFrame, keys=("gene",)) -> DataFrame:
    """Y_obs by gene, d_obs in all, lambda_obs."""
    extra = [k for k in keys if k != "gene"]
    y = counts.groupBy(*keys).agg(F.sum("cnt").alias("Y_obs"))
    d = counts.groupBy(*extra).agg(F.sum("cnt").alias("d_obs"))
    x = y.join(d, extra) if extra else y.crossJoin(F.broadcast(d))
    return x.withColumn("lambda_obs", F.try_divide("Y_obs", "d_obs"))


def segment_summary(bulk: DataFrame, keys=("sample", "CHROM", "seg")) -> DataFrame:
    """Distinct genes, SNPs and extent."""
    return bulk.groupBy(*keys).agg(F.countDistinct("gene").alias("n_genes"), F.count("pAD").alias("n_snps"), F.min("POS").alias("seg_start"), F.max("POS").alias("seg_end"))


def balanced_counts(bulk: DataFrame) -> DataFrame:
    """By (seg, CHROM, sample) SNPs of depth 5 and gene rows; whether any sample has over 50 of both."""
    x = bulk.groupBy("CHROM", "seg", "sample").agg(F.count_if(F.col("DP") >= 5).alias("n_snps"), F.count("gene").alias("n_genes"))
    return x.withColumn("ok", F.bool_or((F.col("n_snps") > 50) & (F.col("n_genes") > 50)).over(Window.partitionBy("CHROM", "seg")))


def mean_by(df: DataFrame, keys, column: str) -> DataFrame:
    """Means by keys, long."""
    return df.groupBy(*keys).agg(F.avg(column).alias(column))


def proportions(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    """Share of each of ``levels``, 0 for missing ones."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return levels.join(n, column, "left").crossJoin(F.broadcast(total)).select(column, (F.coalesce("n", F.lit(0)) / F.col("t")).alias("share"))


def modes(df: DataFrame, keys, column: str) -> DataFrame:
    """All most frequent values."""
    n = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("n")))).where("_r = 1").drop("_r")


def common_argmin(df: DataFrame, group: str, name: str, value: str) -> DataFrame:
    """A10: the name that is least in most groups; the first of equals."""
    best = df.groupBy(group).agg(F.min_by(name, F.struct(value, name)).alias(name))
    return best.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(1)


def argmax_by(df: DataFrame, keys, name: str, value: str) -> DataFrame:
    """The name with the greatest value; the first of equals."""
    low = df.groupBy(*keys).agg(F.max(value).alias("_m"))
    return df.join(low, list(keys)).where(F.col(value) == F.col("_m")).groupBy(*keys).agg(F.min(name).alias(name), F.first("_m").alias(value))


def sorted_list(df: DataFrame, keys, column: str, name: str) -> DataFrame:
    """Distinct values, sorted, as a comma list."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(column)), ",").alias(name))


def mean_entropy(df: DataFrame, p: str = "p_cnv", keys=("seg",)) -> DataFrame:
    """A14."""
    return df.withColumn("avg_entropy", F.avg(binary_entropy(p)).over(Window.partitionBy(*keys)))


def log_sum_exp_by(df: DataFrame, keys, column: str, name: str) -> DataFrame:
    """Two aggregations, the maximum and the scaled sum; -inf for only -inf."""
    top = df.groupBy(*keys).agg(F.max(column).alias("_m"))
    x = df.join(top, list(keys))
    total = x.groupBy(*keys).agg(F.first("_m").alias("_m"), F.sum(F.exp(F.col(column) - F.col("_m"))).alias("_t"))
    return total.select(*keys, F.when(F.abs("_m") == float("inf"), F.col("_m")).otherwise(F.col("_m") + F.log("_t")).alias(name))


def positive_median(df: DataFrame, column: str) -> DataFrame:
    """A16."""
    return df.where(F.col(column) > 0).agg(F.percentile(column, F.lit(0.5)).alias("median"))


def best_reference(counts: DataFrame, ref: DataFrame, min_lambda: float = 2e-6) -> DataFrame:
    """For each cell the profile with the highest Pearson correlation of log1p(CPM), over genes that some profile expresses.

    Zeros count, so the correlation comes from sums over stored counts and the profiles' own sums. A cell or profile that doesn't vary over these
    genes has NaN; of equal correlations the last profile by name is taken. Without such genes there is no row.
    """
    genes = ref.groupBy("gene").agg(F.max("lambda").alias("m")).where(F.col("m") > min_lambda).select("gene")
    r = ref.join(genes, "gene", "left_semi").withColumn("y", F.log1p(F.col("lambda") * 1e6))
    stats = r.groupBy("ref").agg(F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    n = genes.agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("cell").agg(F.sum("cnt").alias("t"))
    x = counts.join(genes, "gene", "left_semi").join(total, "cell").withColumn("x", F.log1p(F.col("cnt") / F.col("t") * 1e6))
    own = x.groupBy("cell").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    both = x.join(r.select("gene", "ref", "y"), "gene").groupBy("cell", "ref").agg(F.sum(F.col("x") * F.col("y")).alias("sxy"))
    # a cell that shares no gene with a profile still has a correlation with it
    grid = total.select("cell").crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(n))
    c = grid.join(own, "cell", "left").join(both, ["cell", "ref"], "left").fillna(0.0, ["sx", "sxx", "sxy"])
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    c = c.withColumn("r", F.coalesce(F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(vx * vy)), F.lit(float("nan"))))
    return c.groupBy("cell").agg(F.max_by("ref", F.struct("r", "ref")).alias("ref"), F.max("r").alias("r"))


def contamination(bulk: DataFrame, min_depth: int = 8) -> DataFrame:
    """Share of homozygous SNPs of enough depth."""
    return bulk.where(F.col("DP") >= min_depth).agg(F.avg(F.col("AR").isin(0.0, 1.0).cast("double")).alias("hom_rate"))


def noise_level(bulk: DataFrame) -> DataFrame:
    """Bands of the expression fit's error."""
    return bulk.select("sample", "mse").distinct().withColumn("noise", F.when(F.col("mse") < 0.5, F.lit("low")).when(F.col("mse") <= 1.5, F.lit("medium")).otherwise(F.lit("high")))


def call_genotypes(pileup: DataFrame) -> DataFrame:
    """Sums over files; het for AR within 0.1 to 0.9, hom_alt for AR 1 and depth 10; others go."""
    s = pileup.groupBy("snp_id", "CHROM", "POS", "REF", "ALT").agg(*[F.sum(c).alias(c) for c in ("AD", "DP", "OTH")]).withColumn("AR", F.try_divide("AD", "DP"))
    s = s.withColumn("GT", F.when(F.col("AR").between(0.1, 0.9), F.lit("0/1")).when((F.col("AR") == 1) & (F.col("DP") >= 10), F.lit("1/1")))
    return s.where("GT is not null")


def snps_per_gene(bulk: DataFrame, min_depth: int = 0) -> DataFrame:
    """A21."""
    return bulk.groupBy("CHROM", "gene").agg(F.count_if(F.col("AD").isNotNull() & (F.col("DP") > min_depth)).alias("n_snps"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Of (i, j, sample, lnFC_i, lnFC_j, p): greatest fold changes, difference, Simes p."""
    w = Window.partitionBy("i", "j").orderBy("p")
    x = pairs.withColumn("_k", F.row_number().over(w))
    return x.groupBy("i", "j").agg(F.max("lnFC_i").alias("lnFC_max_i"), F.max("lnFC_j").alias("lnFC_max_j"), F.abs(F.max("lnFC_i") - F.max("lnFC_j")).alias("delta_max"), (F.count(F.lit(1)) * F.min(F.col("p") / F.col("_k"))).alias("p_simes"))


def pair_up(df: DataFrame, key: str, name: str) -> DataFrame:
    """Unordered pairs of names within a key."""
    a, b = df.select(key, F.col(name).alias("i")), df.select(key, F.col(name).alias("j"))
    return a.join(b, key).where("i < j")


def posterior_matrix(joint: DataFrame, segs: list[str], p_min: float = 1e-10) -> DataFrame:
    """Cells by segments, 0.5 where missing, clamped."""
    wide = joint.groupBy("cell").pivot("seg", segs).agg(F.first("p_cnv"))
    return wide.select("cell", *[F.greatest(F.lit(p_min), F.least(F.lit(1 - p_min), F.coalesce(F.col(f"`{s}`"), F.lit(0.5)))).alias(s) for s in segs])


def posterior_long(joint: DataFrame, p_min: float = 1e-10) -> DataFrame:
    """U05 in long form: each cell with each segment."""
    grid = joint.select("cell").distinct().crossJoin(F.broadcast(joint.select("seg").distinct()))
    return grid.join(joint.select("cell", "seg", "p_cnv"), ["cell", "seg"], "left").withColumn("p_cnv", F.greatest(F.lit(p_min), F.least(F.lit(1 - p_min), F.coalesce("p_cnv", F.lit(0.5)))))


def expand_states(df: DataFrame, kinds=("p", "Z")) -> DataFrame:
    """A row for each state of a multi-allelic segment; seg gets the state, p_cnv and Z_cnv that state's values."""
    many = df.where("n_states > 1").withColumn("_s", F.explode(F.split("cnv_states", ",")))
    for k in kinds:
        pairs = [x for s in ("loh", "del", "amp", "bamp", "bdel") if f"{k}_{s}" in df.columns for x in (F.lit(s), F.col(f"{k}_{s}"))]
        many = many.withColumn(f"{k}_cnv", F.element_at(F.create_map(*pairs), F.col("_s")))
    many = many.withColumn("cnv_state", F.col("_s")).withColumn("seg", F.concat_ws("_", "seg", "_s")).drop("_s")
    return df.where("n_states <= 1 or n_states is null").withColumn("n_states", F.lit(1)).unionByName(many.withColumn("n_states", F.lit(1)))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def stack(frames: list[DataFrame]) -> DataFrame:
    """U01, U09."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by a seeded hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def top_two(df: DataFrame, keys, value: str, name: str) -> DataFrame:
    """The two greatest of each key, ranked."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), name)
    return df.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
