"""Bayesian posterior tables, as column expressions over (cell, segment) rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidyne.functions.scalars import binom_logpmf, first_max_name, log_sum_exp, logistic, phased_depth, safe_ln, seg_label
from ploidyne.operators.plumbing import small_enough
from ploidyne.operators.windows import thin, with_softmax

#: Chance of a read from the major haplotype under each genotype.
ALLELE_P = {"l11": 0.5, "l10": 0.9, "l01": 0.1, "l20": 0.9, "l02": 0.1, "l21": 0.66, "l12": 0.33, "l31": 0.75, "l13": 0.25, "l32": 0.6}
#: Expression fold change under each genotype.
EXPRESSION_PHI = {"l11": 1.0, "l20": 1.0, "l10": 0.5, "l21": 1.5, "l31": 2.0, "l22": 2.0, "l32": 2.5, "l00": 0.25}
STATES = ("loh", "del", "amp", "bamp", "bdel")
LIKELIHOODS = ("l11", "l20", "l10", "l21", "l31", "l22", "l00")


def allele_likelihoods(sums: DataFrame) -> DataFrame:
    """Binomial log-likelihoods of major counts."""
    for name, p in ALLELE_P.items():
        sums = sums.withColumn(name, binom_logpmf("major", "total", p))
    return sums.withColumn("l22", F.col("l11")).withColumn("l00", F.col("l11"))


def compute_posterior(x: DataFrame) -> DataFrame:
    """From log-likelihoods and prior_* the Z of each state, their sums, posteriors and logBF."""
    prior = lambda s, k: safe_ln(F.col(f"prior_{s}") / k)
    z = {"Z_amp": log_sum_exp([F.col("l21") + prior("amp", 4), F.col("l31") + prior("amp", 4)]), "Z_loh": F.col("l20") + prior("loh", 2), "Z_del": F.col("l10") + prior("del", 2), "Z_bamp": F.col("l22") + prior("bamp", 2), "Z_bdel": F.col("l00") + prior("bdel", 2), "Z_n": F.col("l11") + math.log(0.5)}
    x = x.withColumns(z)
    cnv = [F.col(f"Z_{s}") for s in STATES]
    x = x.withColumn("Z", log_sum_exp([F.col("Z_n"), *cnv])).withColumn("Z_cnv", log_sum_exp(cnv))
    x = x.withColumns({f"p_{s}": F.exp(F.col(f"Z_{s}") - F.col("Z")) for s in STATES} | {"p_neu": F.exp(F.col("Z_n") - F.col("Z"))})
    return x.withColumn("logBF", F.col("Z_cnv") - F.col("Z_n")).withColumn("p_cnv", F.exp(F.col("Z_cnv") - F.col("Z")))


def with_priors(x: DataFrame, priors: DataFrame, floor: bool = False) -> DataFrame:
    """prior_* of each segment; with ``floor`` those under 0.05 become 1e-12, as for expression."""
    p = priors.select("seg", *[F.col(f"p_{s}").alias(f"prior_{s}") for s in STATES])
    if floor:
        p = p.withColumns({f"prior_{s}": F.when(F.col(f"prior_{s}") < 0.05, F.lit(1e-12)).otherwise(F.col(f"prior_{s}")) for s in STATES})
    return x.join(p, "seg")


def haplotype_post(bulks: DataFrame, segs: DataFrame, naive: bool = False) -> DataFrame:
    """Which haplotype is major, by SNP of a called segment."""
    called = segs.where("cnv_state <> 'neu'").select("sample", "CHROM", "seg", "cnv_state")
    if called.isEmpty():
        raise ValueError("no segment is called")
    x = bulks.drop("cnv_state").where("pAD is not null").join(called, ["sample", "CHROM", "seg"])
    return x.select("CHROM", "seg", "cnv_state", "snp_id", F.col("haplo_naive" if naive else "haplo_post").alias("haplo"))


def allele_sums(alleles: DataFrame, haplotypes: DataFrame) -> DataFrame:
    """Major and minor counts by (cell, CHROM, seg, cnv_state), over SNPs further apart than 250."""
    x = alleles.join(haplotypes, ["CHROM", "snp_id"])
    x = thin(x.withColumn("pAD", phased_depth("GT", "AD", "DP")))
    major = F.when(F.col("haplo") == "major", F.col("AD")).when(F.col("haplo") == "minor", F.col("DP") - F.col("AD"))
    s = x.withColumn("_m", major).where("_m is not null").groupBy("cell", "CHROM", "seg", "cnv_state").agg(F.sum("_m").alias("major"), F.sum(F.col("DP") - F.col("_m")).alias("minor"))
    return s.withColumn("total", F.col("major") + F.col("minor")).withColumn("MAF", F.try_divide("major", "total"))


def allele_post(alleles: DataFrame, haplotypes: DataFrame, priors: DataFrame) -> DataFrame:
    """R05."""
    x = compute_posterior(with_priors(allele_likelihoods(allele_sums(alleles, haplotypes)), priors))
    return x.withColumn("seg_label", seg_label("seg", "cnv_state"))


def joint_post(expression: DataFrame, alleles: DataFrame, priors: DataFrame) -> DataFrame:
    """Both sources' log-likelihoods added, missing ones as 0; posteriors, and the states of highest likelihood and posterior."""
    keys = ["cell", "CHROM", "seg", "cnv_state"]
    names = [*LIKELIHOODS, "Z_cnv", "Z_n", "logBF"]
    x = expression.select(*keys, *[F.col(c).alias(f"{c}_x") for c in names])
    y = alleles.select(*keys, *[F.col(c).alias(f"{c}_y") for c in names])
    j = x.join(y, keys, "full_outer")
    j = j.withColumns({f"{c}_{s}": F.coalesce(F.col(f"{c}_{s}"), F.lit(0.0)) for c in LIKELIHOODS for s in "xy"})
    j = j.withColumns({c: F.col(f"{c}_x") + F.col(f"{c}_y") for c in LIKELIHOODS})
    j = compute_posterior(with_priors(j, priors)).withColumn("p_cnv_x", logistic("logBF_x")).withColumn("p_cnv_y", logistic("logBF_y"))
    like = ["l11", "l20", "l10", "l21", "l31", "l22"]
    best = F.element_at(F.array(*[F.lit(s) for s in ("neu", "loh", "del", "amp", "amp", "bamp")]), F.array_position(F.array(*[F.col(c) for c in like]), F.greatest(*like)).cast("int"))
    post = F.regexp_replace(first_max_name(["p_neu", "p_loh", "p_del", "p_amp", "p_bamp"]), "^p_", "")
    return j.withColumn("cnv_state_mle", best).withColumn("cnv_state_map", post).withColumn("seg_label", seg_label("seg", "cnv_state"))


def multi_allelic(bulks: DataFrame, consensus: DataFrame, min_llr: float = 5.0, p_min: float = 0.999) -> DataFrame:
    """Segments with more than one sure state: equal posteriors for those, n_states and cnv_states."""
    sure = bulks.where((F.col("LLR") > min_llr) & (F.greatest(*[F.col(f"p_{s}") for s in STATES]) > p_min))
    found = sure.groupBy("seg_cons").agg(F.array_sort(F.collect_set("cnv_state_post")).alias("_s")).where(F.size("_s") > 1)
    x = consensus.join(found, "seg_cons", "left")
    x = x.withColumns({f"p_{s}": F.when(F.col("_s").isNull(), F.col(f"p_{s}")).otherwise(F.when(F.array_contains("_s", s), 0.5).otherwise(0.0)) for s in STATES})
    return x.withColumn("n_states", F.coalesce(F.when(F.col("_s").isNotNull(), F.size("_s")), F.lit(1))).withColumn("cnv_states", F.coalesce(F.array_join("_s", ","), F.col("cnv_state"))).drop("_s")


def clone_post(clones: DataFrame, expression: DataFrame, alleles: DataFrame) -> DataFrame:
    """Posteriors of clones for each cell. ``clones``: clone, GT (comma list), compartment.

    A clone's prior is 0.5 if it has no event, else 0.5 shared by the others; evidence by segment is Z_cnv where the clone has the segment, Z_n elsewhere.
    """
    tumour = clones.agg(F.count_if(F.col("GT") != "").alias("_n"))
    c = clones.crossJoin(F.broadcast(tumour)).withColumn("prior", F.when(F.col("GT") == "", F.lit(0.5)).otherwise(F.lit(0.5) / F.col("_n")))

    def evidence(post: DataFrame, name: str) -> DataFrame:
        # cells by segments meet only the clones that have the segment; a cell meets each clone once
        neutral = post.groupBy("cell").agg(F.sum(F.coalesce("Z_n", F.lit(0.0))).alias("_z"))
        gain = post.select("cell", "seg", (F.coalesce("Z_cnv", F.lit(0.0)) - F.coalesce("Z_n", F.lit(0.0))).alias("_g")).join(c.select("clone", F.explode(F.array_distinct(F.split("GT", ","))).alias("seg")), "seg")
        gain = gain.groupBy("cell", "clone").agg(F.sum("_g").alias("_g"))
        grid = neutral.crossJoin(small_enough(c.select("clone", "GT", "prior", "compartment")))
        x = grid.join(gain, ["cell", "clone"], "left").withColumn(name, F.col("_z") + F.coalesce("_g", F.lit(0.0)))
        return x.select("cell", "clone", "GT", "prior", "compartment", name)

    x = evidence(expression, "l_x").join(evidence(alleles, "l_y"), ["cell", "clone", "GT", "prior", "compartment"], "full_outer")
    x = x.fillna(0.0, ["l_x", "l_y"]).withColumn("Z_x", F.log("prior") + F.col("l_x")).withColumn("Z_y", F.log("prior") + F.col("l_y")).withColumn("Z", F.log("prior") + F.col("l_x") + F.col("l_y"))
    for z, p in (("Z", "p"), ("Z_x", "p_x"), ("Z_y", "p_y")):
        x = with_softmax(x, z, ["cell"], p)
    return x


def clone_calls(post: DataFrame, clones: list[int]) -> DataFrame:
    """The best clone of each cell, the tumour mass, the compartment, and posteriors side by side."""
    best = post.groupBy("cell").agg(F.max_by(F.struct("clone", "GT"), F.struct("p", -F.col("clone"))).alias("_b"), F.max("p").alias("p_opt"), *[F.sum(F.when(F.col("compartment") == "tumor", F.col(c)).otherwise(0.0)).alias(n) for c, n in (("p", "p_cnv"), ("p_x", "p_cnv_x"), ("p_y", "p_cnv_y"))])
    wide = post.groupBy("cell").pivot("clone", clones).agg(F.first("p").alias("p"), F.first("p_x").alias("p_x"), F.first("p_y").alias("p_y"))
    wide = wide.select("cell", *[F.col(f"{k}_{n}").alias(f"{n}_{k}") for k in clones for n in ("p", "p_x", "p_y")])
    return best.select("cell", F.col("_b.clone").alias("clone_opt"), F.col("_b.GT").alias("GT_opt"), "p_opt", "p_cnv", "p_cnv_x", "p_cnv_y", F.when(F.col("p_cnv") > 0.5, F.lit("tumor")).otherwise(F.lit("normal")).alias("compartment_opt")).join(wide, "cell")


def expression_likelihoods(counts: DataFrame, fits: DataFrame, ref: DataFrame, segs: DataFrame) -> DataFrame:
    """Log-likelihoods by (cell, seg) under each genotype's fold change; a Poisson-lognormal with the cell's mu and sigma.

    ``fits``: cell, ref, d, mu, sigma. ``segs``: gene, CHROM, seg, cnv_state. Rows are independent, so the quadrature runs in Arrow batches before the sum.
    """
    from ploidyne.functions.kernels import poilog_udf

    x = counts.join(segs, "gene").join(fits, "cell").join(ref.select("gene", "ref", "lambda"), ["gene", "ref"]).where("lambda > 0")
    base = F.col("mu") + F.log(F.col("d") * F.col("lambda"))
    x = x.withColumns({k: poilog_udf(F.col("cnt"), base + math.log(p), F.col("sigma")) for k, p in EXPRESSION_PHI.items() if k not in ("l20", "l22")})
    out = x.groupBy("cell", "ref", "CHROM", "seg", "cnv_state").agg(F.count(F.lit(1)).alias("n"), F.first("mu").alias("mu"), F.first("sigma").alias("sigma"), *[F.sum(k).alias(k) for k in EXPRESSION_PHI if k not in ("l20", "l22")])
    return out.withColumn("l20", F.col("l11")).withColumn("l22", F.col("l31"))


