"""Hidden Markov models and fits by group: grouped Arrow maps over (sample, CHROM) or segments.

What can run by row is computed by row before; a task sees one chromosome of one sample, or one segment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ploidyne.functions import kernels as K
from ploidyne.functions.scalars import phase_suffix, strip_phase
from ploidyne.operators import posterior
from ploidyne.operators.plumbing import cut
from ploidyne.operators.windows import annotate_segments, forward_fill, rolling_phi, rolling_theta, smooth_segments

ORDER = ("POS", "snp_id")
KEYS = ("sample", "CHROM")


def _num(s: pd.Series) -> np.ndarray:
    return pd.to_numeric(s).to_numpy(float, na_value=np.nan)


class _Columns:
    """Columns of an Arrow table as pandas series, made when they are asked for."""

    def __init__(self, table: pa.Table):
        self.table = table

    def __getitem__(self, name: str) -> pd.Series:
        return self.table.column(name).to_pandas()

    def __len__(self) -> int:
        return self.table.num_rows


def _grouped(df: DataFrame, keys, add: dict[str, T.DataType], f, order=ORDER) -> DataFrame:
    """``df`` with the columns ``add``, which ``f`` finds from a group's columns in ``order``; the other columns pass through as Arrow, whatever they hold."""
    kept = [x for x in df.schema.fields if x.name not in add]
    kinds = T.StructType([*kept, *[T.StructField(k, t) for k, t in add.items()]])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order]))
        found = f(_Columns(table))
        out = table.select([x.name for x in kept])
        for name, kind in add.items():
            out = out.append_column(name, pa.array(found[name], to_arrow_type(kind)))
        return out

    return df.groupBy(*keys).applyInArrow(run, kinds)


def allele_hmm(bulk: DataFrame, t: float = 1e-5, theta=(0.08, 0.4), gamma: float = 20.0, nu: float | None = None) -> DataFrame:
    """State of each SNP under the five-state model. With ``nu`` switch probabilities come from inter_snp_cm, to the last bit as C computes them."""

    def f(p):
        switch = _num(p["p_s"]) if nu is None else K.switch_probs(_num(p["inter_snp_cm"]), nu)
        return {"state": K.allele_hmm5(_num(p["pAD"]), _num(p["DP"]), switch, t, theta, gamma)}

    return _grouped(bulk, KEYS, {"state": T.StringType()}, f)


def joint_hmm(bulk: DataFrame, t: float = 1e-5, theta_min: float = 0.08, gamma: float = 20.0, allele_only: bool = False, exp_only: bool = False) -> DataFrame:
    """State of each row under the fifteen-state model; needs mu and sig."""

    def f(p):
        return {"state": K.joint_hmm15(_num(p["pAD"]), _num(p["DP"]), _num(p["p_s"]), _num(p["Y_obs"]), _num(p["lambda_ref"]), _num(p["d_obs"]), float(p["mu"].iloc[0]), float(p["sig"].iloc[0]), t, theta_min, gamma, allele_only, exp_only)}

    return _grouped(bulk, KEYS, {"state": T.StringType()}, f)


def baseline(bulk: DataFrame, where: str = "true") -> DataFrame:
    """F06 by sample: (sample, mu, sig) over genes with counts that satisfy ``where``."""
    x = bulk.where("Y_obs is not null and lambda_ref > 0").where(where).select("sample", "Y_obs", "lambda_ref", "d_obs")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        mu, sig = K.fit_lnpois(_num(pdf["Y_obs"]), _num(pdf["lambda_ref"]), _num(pdf["d_obs"]))
        return pd.DataFrame({"sample": [pdf["sample"].iloc[0]], "mu": [mu], "sig": [sig]})

    return x.groupBy("sample").applyInPandas(fit, "sample string, mu double, sig double")


def allele_scores(bulk: DataFrame, keys=("sample", "CHROM", "seg"), theta: float = 0.2, gamma: float = 20.0) -> DataFrame:
    """By segment the forward log-likelihood at ``theta``, and its gain over balance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(ORDER))
        a, d, s = _num(pdf["pAD"]), _num(pdf["DP"]), _num(pdf["p_s"])
        ok = ~np.isnan(a)
        a, d, s = a[ok], d[ok], s[ok]
        lik = K.allele_likelihood(a, d, s, theta, gamma) if len(a) else 0.0
        flat = float(K.beta_binom(a, d, gamma / 2, gamma / 2).sum()) if len(a) > 1 else lik
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"l_allele": [lik], "LLR_y": [lik - flat]})

    fields = ", ".join(f"{k} string" for k in keys)
    return bulk.select(*keys, "pAD", "DP", "p_s", *ORDER).groupBy(*keys).applyInPandas(run, f"{fields}, l_allele double, LLR_y double")


def classify_alleles(bulk: DataFrame, gamma: float = 20.0) -> DataFrame:
    """By called segment with several SNPs the chance that the first haplotype is up, and major or minor by phase."""
    x = bulk.where("cnv_state_post <> 'neu' and pAD is not null").select("sample", "CHROM", "seg", "snp_id", "POS", "GT", "AR", "pAD", "DP", "p_s", "theta_mle")

    def f(p):
        if len(p) < 2:
            return {"p_up": np.full(len(p), np.nan)}
        theta = float(p["theta_mle"].iloc[0])
        post = K.forward_backward(*K.two_state(_num(p["pAD"]), _num(p["DP"]), _num(p["p_s"]), min(max(theta, 0.001), 0.499), gamma))
        return {"p_up": post[:, 0]}

    x = _grouped(x, ("sample", "CHROM", "seg"), {"p_up": T.DoubleType()}, f).withColumn("p_up", F.when(~F.isnan("p_up"), F.col("p_up")))
    up = F.col("p_up") >= 0.5
    x = x.withColumn("haplo_post", F.when(F.col("p_up").isNotNull(), F.when(up == (F.col("GT") == "1|0"), F.lit("major")).otherwise(F.lit("minor"))))
    x = x.withColumn("haplo_naive", F.when(F.col("AR") < 0.5, F.lit("minor")).otherwise(F.lit("major")))
    return bulk.drop("p_up", "haplo_post", "haplo_naive").join(x.select("sample", "snp_id", "p_up", "haplo_post", "haplo_naive"), ["sample", "snp_id"], "left")


def theta_roll(bulk: DataFrame, h: int = 100) -> DataFrame:
    """Major and minor counts by the phase of the state, else by the ratio; rolling imbalance, filled forward."""
    up = F.when(F.col("state").endswith("up"), True).when(F.col("state").endswith("down"), False).otherwise(F.col("pBAF") > 0.5)
    x = bulk.withColumn("major_count", F.when(up, F.col("pAD")).otherwise(F.col("DP") - F.col("pAD"))).withColumn("minor_count", F.col("DP") - F.col("major_count"))
    x = x.withColumn("theta_hat_roll", F.when(F.col("pAD").isNotNull(), rolling_theta("major_count", "minor_count", h, KEYS, *ORDER)))
    return x.withColumn("theta_hat_roll", forward_fill("theta_hat_roll", KEYS, *ORDER))


def segment_fits(bulk: DataFrame, gamma: float = 20.0, keys=("sample", "CHROM", "seg", "cnv_state")) -> DataFrame:
    """Theta and phi of each segment with their spreads, and the log-likelihood ratios of both kinds of evidence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(ORDER))
        a = pdf[pdf["pAD"].notna()]
        e = pdf[pdf["Y_obs"].notna() & (pdf["lambda_ref"] > 0)]
        snp = _num(a["pAD"]), _num(a["DP"]), _num(a["p_s"])
        theta, ts = K.theta_post(*snp, gamma)
        mu, sig = float(pdf["mu"].iloc[0]), float(pdf["sig"].iloc[0])
        y, lam, d = _num(e["Y_obs"]), _num(e["lambda_ref"]), _num(e["d_obs"])
        phi, ps = K.phi_post(y, lam, d, mu, sig)
        ly = K.allele_likelihood(*snp, theta, gamma) - float(K.beta_binom(snp[0], snp[1], gamma / 2, gamma / 2).sum()) if len(a) > 1 else 0.0
        lx = K.l_lnpois(y, lam, d, mu, sig, phi) - K.l_lnpois(y, lam, d, mu, sig, 1.0) if len(e) else 0.0
        row = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame(row | {"seg_start": [int(pdf["POS"].min())], "seg_end": [int(pdf["POS"].max())], "n_genes": [pdf["gene"].nunique()], "n_snps": [len(a)], "theta_mle": [theta], "theta_sigma": [ts], "phi_mle": [phi], "phi_sigma": [ps], "LLR_x": [lx], "LLR_y": [ly]})

    kinds = ", ".join(f"{k} string" for k in keys) + ", seg_start long, seg_end long, n_genes long, n_snps long, theta_mle double, theta_sigma double, phi_mle double, phi_sigma double, LLR_x double, LLR_y double"
    return bulk.select(*keys, "pAD", "DP", "p_s", "Y_obs", "lambda_ref", "d_obs", "mu", "sig", "gene", *ORDER).groupBy(*keys).applyInPandas(run, kinds)


#: Prior weights of the genotypes.
GENOTYPES = {"11": 0.5, "20": 0.1, "10": 0.1, "21": 0.05, "31": 0.05, "22": 0.1, "00": 0.1}


def retest_posterior(fits: DataFrame, theta_min: float = 0.08) -> DataFrame:
    """Interval masses of theta and phi combined into Z, posteriors conditional on an event, LLR and the state."""
    step = 2**0.25
    mass = lambda lo, hi, m, s: K.pnorm_range_udf(F.lit(float(lo)), F.lit(float(hi)), F.col(m), F.col(s))
    x = fits.withColumns({"_yn": mass(0, theta_min, "theta_mle", "theta_sigma"), "_yd": mass(theta_min, 0.499, "theta_mle", "theta_sigma"), "_ya": mass(theta_min, 0.375, "theta_mle", "theta_sigma"), "_xn": mass(1 / step, step, "phi_mle", "phi_sigma"), "_xd": mass(0.1, 1 / step, "phi_mle", "phi_sigma"), "_xa": mass(step, 3, "phi_mle", "phi_sigma")})
    g = {k: F.lit(float(np.log(v))) for k, v in GENOTYPES.items()}
    x = x.withColumns({"Z_loh": g["20"] + F.col("_xn") + F.col("_yd"), "Z_del": g["10"] + F.col("_xd") + F.col("_yd"), "_a1": g["21"] + F.col("_xa") + F.col("_ya"), "_a2": g["31"] + F.col("_xa") + F.col("_ya"), "Z_bamp": g["22"] + F.col("_xa") + F.col("_yn"), "Z_bdel": g["00"] + F.col("_xd") + F.col("_yn"), "Z_n": g["11"] + F.col("_xn") + F.col("_yn")})
    from ploidyne.functions.scalars import first_max_name, log_sum_exp

    x = x.withColumn("Z_amp", log_sum_exp([F.col("_a1"), F.col("_a2")]))
    cnv = [F.col(f"Z_{s}") for s in posterior.STATES]
    x = x.withColumn("Z_cnv", log_sum_exp(cnv)).withColumn("Z", log_sum_exp([F.col("Z_n"), *cnv])).withColumn("logBF", F.col("Z_cnv") - F.col("Z_n"))
    clean = lambda c: F.when(c.isNotNull() & ~F.isnan(c), c).otherwise(F.lit(0.0))
    x = x.withColumns({f"p_{s}": clean(F.exp(F.col(f"Z_{s}") - F.col("Z_cnv"))) for s in posterior.STATES} | {"p_neu": clean(F.exp(F.col("Z_n") - F.col("Z")))})
    best = F.regexp_replace(first_max_name([f"p_{s}" for s in posterior.STATES]), "^p_", "")
    x = x.withColumn("LLR", F.col("logBF")).withColumn("cnv_state_post", F.when(F.col("p_neu") >= 0.5, F.lit("neu")).otherwise(best))
    return x.drop("_yn", "_yd", "_ya", "_xn", "_xd", "_xa", "_a1", "_a2")


def analyze_bulk(bulk: DataFrame, t: float = 1e-5, gamma: float = 20.0, theta_min: float = 0.08, min_genes: int = 10, run_hmm: bool = True, diploid: str = "true", allele_only: bool = False) -> DataFrame:
    """Baseline, decoding, segments, retest, phases and rolling estimates of all samples."""
    drop = ("mu", "sig", "cnv_state_post", "theta_mle", "theta_sigma", "phi_mle", "phi_sigma", "LLR", "LLR_x", "LLR_y", "logBF", "Z", "Z_n", "Z_cnv", "p_neu", *[f"{a}_{s}" for s in posterior.STATES for a in ("p", "Z")])
    x = bulk.drop(*drop)
    x = x.join(baseline(x, diploid), "sample", "left").fillna({"mu": 0.0, "sig": 1.0})
    if run_hmm:
        x = joint_hmm(x, t, theta_min, gamma, allele_only)
        x = x.withColumn("state", F.when(F.col("loh"), F.lit("del_up")).otherwise(F.col("state"))).withColumn("cnv_state", strip_phase("state"))
        for last in (False, True):
            x = annotate_segments(x.drop("seg", "boundary", "seg_start", "seg_end", "n_genes", "n_snps"), "cnv_state", KEYS, *ORDER)
            if not last:
                x = smooth_segments(x, "cnv_state", min_genes, KEYS, *ORDER)
    # the fits and the rows that they go to both come from these states
    x = cut(x)
    fits = retest_posterior(segment_fits(x, gamma), theta_min)
    x = x.drop("seg_start", "seg_end", "n_genes", "n_snps").join(fits, ["sample", "CHROM", "seg", "cnv_state"], "left")
    x = x.withColumn("cnv_state_post", F.when(F.col("loh"), F.lit("del")).otherwise(F.col("cnv_state_post"))).withColumn("p_del", F.when(F.col("loh"), F.lit(1.0)).otherwise(F.col("p_del")))
    x = x.withColumn("state_post", phase_suffix("state", "cnv_state_post") if run_hmm else F.col("cnv_state_post"))
    x = theta_roll(classify_alleles(cut(x), 20.0))
    x = x.withColumn("phi_mle_roll", rolling_phi("Y_obs", F.col("d_obs"), "lambda_ref", F.col("mu"), 50, KEYS, *ORDER))
    return x.withColumn("phi_mle_roll", forward_fill("phi_mle_roll", KEYS, *ORDER))


def clonal_loh(bulk: DataFrame, t: float = 1e-5, loh_rate: float = 5.0, min_depth: int = 0) -> DataFrame:
    """Segments of lost heterozygosity in all cells together, from SNP counts of genes in the order of the genome.

    One chain over the genes of one bulk; their number is that of an annotation, whatever the data's size.
    """
    from ploidyne.functions.scalars import chrom_key

    g = bulk.where("gene is not null").groupBy("CHROM", "gene").agg(F.count_if(F.col("AD").isNotNull() & (F.col("DP") > min_depth)).alias("n_snps"), F.max("Y_obs").alias("Y_obs"), F.max("lambda_ref").alias("lambda_ref"), F.max("d_obs").alias("d_obs"), F.max("gene_start").alias("gene_start"), F.max("gene_end").alias("gene_end"), F.max("logFC").alias("logFC"))
    g = g.where("gene_start is not null and abs(logFC) < 8").withColumn("_o", chrom_key("CHROM"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_o", "CHROM", "gene_start"]).reset_index(drop=True)
        y, lam, d = _num(pdf["Y_obs"]), _num(pdf["lambda_ref"]), _num(pdf["d_obs"])
        n, length = _num(pdf["n_snps"]), _num(pdf["gene_end"]) - _num(pdf["gene_start"])
        mu, sig = K.fit_lnpois(y, lam, d)
        v, size = K.fit_snp_rate(n, length)
        pdf["state"] = K.loh_hmm(n, length, y, lam, d, mu, sig, v, size, t, loh_rate)
        key = (pdf["state"] != pdf["state"].shift()) | (pdf["CHROM"] != pdf["CHROM"].shift())
        out = pdf.groupby(key.cumsum()).agg(CHROM=("CHROM", "first"), seg_start=("gene_start", "min"), seg_end=("gene_end", "max"), n_snps=("n_snps", "sum"), length=("gene_start", "size"), state=("state", "first"))
        out["snp_rate"] = out["n_snps"] / np.maximum((out["seg_end"] - out["seg_start"]) / 1e6, 1e-9)
        out["seg"] = [f"{c}_{i}" for i, c in enumerate(out["CHROM"])]
        out["loh"] = True
        return out[out["state"] == "loh"][["CHROM", "seg", "seg_start", "seg_end", "snp_rate", "loh"]]

    return g.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "CHROM string, seg string, seg_start long, seg_end long, snp_rate double, loh boolean")


def common_diploid(bulks: DataFrame, t: float = 1e-5, theta=(0.08, 0.4), gamma: float = 20.0, min_genes: int = 10, alpha: float = 1e-4, fc_min: float = 1.25) -> tuple[DataFrame, list[str]]:
    """Balanced segments of all samples, and the names of those taken for diploid.

    Allele decoding, smoothing and merging give balanced ranges; pairs of them are tested by sample with Welch's t and
    joined over samples by Simes; pairs that don't differ after FDR form a graph, whose cliques are candidates.
    """
    from ploidyne.operators.graph import maximal_cliques
    from ploidyne.operators.intervals import annotate_consensus, union_ranges
    from ploidyne.operators.relational import balanced_counts
    from ploidyne.operators.windows import benjamini_hochberg, running_label

    # bulks, ranges and their statistics are read several times, so each is made once
    bulks = cut(bulks)
    x = allele_hmm(bulks, t, theta, gamma).withColumn("cnv_state", F.when(F.col("loh"), F.lit("loh")).when(F.col("state") == "neu", F.lit("neu")).otherwise(F.lit("theta")))
    x = annotate_segments(x.drop("seg"), "cnv_state", KEYS, *ORDER)
    x = annotate_segments(smooth_segments(x, "cnv_state", min_genes, KEYS, *ORDER).drop("seg", "boundary"), "cnv_state", KEYS, *ORDER)
    spans = x.groupBy("sample", "CHROM", "seg", "cnv_state").agg(F.min("POS").alias("seg_start"), F.max("POS").alias("seg_end"))
    spans = cut(spans)
    from ploidyne.operators.intervals import subtract_ranges

    imbalanced = union_ranges(spans.where("cnv_state <> 'neu'").select("CHROM", "seg_start", "seg_end"))
    every = union_ranges(spans.select("CHROM", "seg_start", "seg_end"))
    balanced = cut(running_label(subtract_ranges(every, imbalanced)).withColumn("cnv_state", F.lit("neu")))
    b = cut(annotate_consensus(bulks.select("sample", "CHROM", "snp_id", "POS", "DP", "gene", "lnFC"), balanced))
    enough = cut(balanced_counts(b).where("ok").select("CHROM", "seg").distinct())
    b = b.join(enough, ["CHROM", "seg"], "left_semi")
    stat = cut(b.where("lnFC is not null").groupBy("sample", "seg").agg(F.count("lnFC").alias("n"), F.avg("lnFC").alias("m"), F.var_samp("lnFC").alias("v")))
    i, j = (stat.select("sample", *[F.col(c).alias(f"{c}_{s}") for c in ("seg", "n", "m", "v")]) for s in "ij")
    tests = i.join(j, "sample").where("seg_i < seg_j").withColumn("p", K.welch_udf("n_i", "m_i", "v_i", "n_j", "m_j", "v_j"))
    from ploidyne.operators.relational import pair_summary

    pairs = pair_summary(tests.select(F.col("seg_i").alias("i"), F.col("seg_j").alias("j"), "sample", F.col("m_i").alias("lnFC_i"), F.col("m_j").alias("lnFC_j"), "p"))
    pairs = benjamini_hochberg(pairs.withColumn("_all", F.lit(1)), "p_simes", ["_all"])
    names = sorted(r.seg for r in enough.select("seg").distinct().collect())  # tens of ranges
    edges = [(r.i, r.j) for r in pairs.where(F.col("q") > alpha).select("i", "j").collect()]
    cliques = maximal_cliques(names, edges)
    if not cliques:
        return balanced, names
    table = bulks.sparkSession.createDataFrame([(k, s) for k, c in enumerate(cliques) for s in c], "k int, seg string")
    mean = stat.join(table, "seg").groupBy("sample", "k").agg(F.avg("m").alias("m"))
    from ploidyne.operators.relational import common_argmin

    best = common_argmin(mean, "sample", "k", "m").first()
    spread = mean.groupBy("sample").agg((F.max("m") - F.min("m")).alias("d")).agg(F.max("d")).first()[0] or 0.0
    return balanced, list(cliques[best.k]) if best is not None and np.exp(spread) > fc_min else names


def run_group_hmms(bulks: DataFrame, diploid: bool = True, **options) -> DataFrame:
    """All samples with reads: one search for diploid ranges, then M09 with the sample as a key."""
    x = bulks.join(bulks.groupBy("sample").agg(F.sum("DP").alias("_d")).where("_d > 0").select("sample"), "sample", "left_semi")
    where = "true"
    if diploid:
        from ploidyne.operators.intervals import point_join

        ranges, names = common_diploid(x)
        inside = point_join(x.select("snp_id", "CHROM", "POS").distinct(), ranges.where(F.col("seg").isin(names)), "seg_start", "seg_end", closed=True).select("snp_id").distinct().withColumn("diploid", F.lit(True))
        x = x.drop("diploid").join(inside, "snp_id", "left").withColumn("diploid", F.coalesce("diploid", F.lit(False)))
        where = "diploid"
    return analyze_bulk(x, diploid=where, **options)


def retest_bulks(bulks: DataFrame, consensus: DataFrame, min_llr: float = 5.0, **options) -> DataFrame:
    """Consensus segments tested again in each sample, weak ones neutral."""
    from ploidyne.operators.intervals import annotate_consensus

    segs = consensus.select("CHROM", F.col("seg_cons").alias("seg"), "seg_cons", "seg_start", "seg_end", "cnv_state")
    x = annotate_consensus(bulks.drop("cnv_state", "seg", "seg_cons", "seg_start", "seg_end", "state", "state_post"), segs)
    x = x.withColumn("diploid", F.col("cnv_state") == "neu").withColumn("state", F.col("cnv_state"))
    x = analyze_bulk(x, run_hmm=False, diploid="diploid", **options)
    weak = F.coalesce("LLR", F.lit(0.0)) < min_llr
    return x.withColumn("LLR", F.coalesce("LLR", F.lit(0.0))).withColumn("cnv_state_post", F.when(weak, F.lit("neu")).otherwise(F.col("cnv_state_post"))).withColumn("cnv_state", F.when(weak, F.lit("neu")).otherwise(F.col("cnv_state")))


def cell_fits(counts: DataFrame, ref: DataFrame, choice: DataFrame, genes: DataFrame) -> DataFrame:
    """R03, F06 by cell: (cell, ref, d, mu, sigma) over the neutral ``genes``."""
    total = counts.groupBy("cell").agg(F.sum("cnt").alias("d"))
    x = counts.join(genes.select("gene"), "gene", "left_semi").join(total, "cell").join(choice.select("cell", "ref"), "cell").join(ref, ["gene", "ref"]).select("cell", "ref", "cnt", "lambda", "d")

    def fit(part: pa.Table) -> pa.Table:
        mu, sig = K.fit_lnpois(*(part.column(c).cast(pa.float64()).to_numpy() for c in ("cnt", "lambda", "d")), 32)
        first = part.slice(0, 1)
        return pa.table({"cell": first.column("cell"), "ref": first.column("ref"), "d": first.column("d"), "mu": [mu], "sigma": [sig]})

    return x.groupBy("cell").applyInArrow(fit, "cell string, ref string, d long, mu double, sigma double")
