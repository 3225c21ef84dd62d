"""The whole analysis: run() takes tables and returns a Result with every intermediate table."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidyne.operators import bulk as B
from ploidyne.operators import graph, intervals, phylogeny, posterior, relational, sequence
from ploidyne.operators.windows import expression_changes


@dataclass
class Result:
    """``status`` is complete or why the run ended early; ``tables`` hold what was computed, by name and iteration."""

    status: str
    tables: dict[str, DataFrame] = field(default_factory=dict)


def run(counts: DataFrame, ref: DataFrame, alleles: DataFrame, genes: DataFrame, *, max_iter: int = 2, max_nni: int = 100, t: float = 1e-5, gamma: float = 20.0, min_llr: float = 5.0, alpha: float = 1e-4, eps: float = 1e-5, max_entropy: float = 0.5, init_k: int = 3, min_cells: int = 50, tau: float = 0.3, nu: float = 1.0, max_cost: float | None = None, n_cut: int = 0, min_depth: int = 0, common_diploid: bool = True, min_overlap: float = 0.45, segs_loh: DataFrame | None = None, call_clonal_loh: bool = False, segs_fixed: DataFrame | None = None, min_genes: int = 10, skip_nj: bool = False, multi_allelic: bool = True, check_convergence: bool = False, p_min: float = 1e-10, filter_hla: bool = True, filter_segments: DataFrame | None = None, edges: DataFrame | None = None, spatial_method: str = "cpr", max_tree_cells: int = 20_000) -> Result:
    """Validate, call segments by group of cells, retest, score cells, build a tree of them, regroup by clone; ``max_iter`` times.

    ``edges`` (src, dst, w between cells) smooths the cells' likelihoods. Each iteration's tables are written to the shared folder, so plans don't grow.
    """
    out: dict[str, DataFrame] = {}
    if segs_loh is not None and call_clonal_loh:
        raise ValueError("segs_loh and call_clonal_loh exclude each other")
    alleles = relational.check_alleles(alleles)
    ref = relational.check_reference(ref)
    alleles = intervals.annotate_genes(alleles, genes) if "gene" not in alleles.columns else alleles
    genes = graph.cut(relational.gene_universe(genes, counts, ref))
    counts = counts.join(genes.select("gene"), "gene", "left_semi")
    counts, alleles = relational.drop_empty_cells(counts, alleles)
    counts, alleles = graph.cut(counts), graph.cut(alleles)
    if counts.isEmpty():
        raise ValueError("no cell has counts")
    ref = ref.join(genes.select("gene"), "gene", "left_semi")
    bulk = lambda m, loh: B.get_bulk(counts, alleles, m, ref, genes, nu, min_depth, filter_hla, loh, filter_segments)
    if call_clonal_loh:
        everyone = counts.select(F.lit("0").alias("sample"), "cell").distinct()
        segs_loh = graph.cut(sequence.clonal_loh(bulk(everyone, None), t))
        out["segs_loh"] = segs_loh
    choice = graph.cut(relational.best_reference(counts, ref))
    out["sc_refs"] = choice
    mean_ref = ref.groupBy("gene").agg(F.avg("lambda").alias("lambda"))
    clusters = graph.cut(graph.expression_clusters(*expression_changes(counts, counts, genes, mean_ref), init_k))
    out["clusters"] = clusters
    clones = clusters.select(F.col("cluster").cast("string").alias("sample"), "cell")
    subtrees = clones.unionByName(clusters.select(F.lit("0").alias("sample"), "cell"))
    max_cost = tau * counts.select("cell").distinct().count() if max_cost is None else max_cost

    def big(m: DataFrame) -> DataFrame:
        keep = m.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_cells).select("sample")
        return m.join(keep, "sample", "left_semi")

    for i in range(1, max_iter + 1):
        put = lambda name, df: out.setdefault(f"{name}_{i}", graph.cut(df))  # noqa: B023, E731
        if segs_fixed is None:
            groups = put("subtrees", big(subtrees))
            if groups.isEmpty():
                return Result("no group has enough cells", out)
            bulks = put("bulk_subtrees", sequence.run_group_hmms(graph.cut(bulk(groups, segs_loh)), common_diploid, t=t, gamma=gamma, min_genes=min_genes))
            first = put("segs_first", intervals.consensus_segments(bulks, min_llr, min_overlap, retest=True))
            if first.where("cnv_state <> 'neu'").isEmpty():
                return Result("no copy-number event was found", out)
            again = put("bulk_retest", sequence.retest_bulks(bulks, first, min_llr, gamma=gamma))
            segs = put("segs_consensus", intervals.consensus_segments(again, min_llr, min_overlap))
            if segs.where("cnv_state <> 'neu'").isEmpty():
                return Result("no event is left after the retest", out)
        else:
            segs = put("segs_consensus", relational.fixed_segments(segs_fixed))
        groups = put("clones", big(clones))
        if groups.isEmpty():
            return Result("no clone has enough cells", out)
        bulks = put("bulk_clones", sequence.retest_bulks(sequence.run_group_hmms(graph.cut(bulk(groups, segs_loh)), common_diploid, t=t, gamma=gamma, min_genes=min_genes), segs, min_llr, gamma=gamma))
        stats = bulks.groupBy("CHROM", "seg").agg(F.max("LLR").alias("LLR"), *[F.max(f"p_{s}").alias(f"p_{s}") for s in posterior.STATES])
        segs = put("segs", segs.drop("LLR", "seg", *[f"p_{s}" for s in posterior.STATES]).withColumn("seg", F.col("seg_cons")).join(stats, ["CHROM", "seg"], "left").fillna(0.0, [f"p_{s}" for s in posterior.STATES]).withColumn("n_states", F.lit(1)).withColumn("cnv_states", F.col("cnv_state")))
        if multi_allelic:
            segs = put("segs_multi", posterior.multi_allelic(bulks.withColumn("seg_cons", F.col("seg")), segs, min_llr, 1 - alpha))
        called = segs.select("CHROM", "seg", "cnv_state", "seg_start", "seg_end")
        hap = posterior.haplotype_post(bulks, bulks.select("sample", "CHROM", "seg", "cnv_state").where("cnv_state <> 'neu'").distinct()).dropDuplicates(["snp_id"])
        ge = intervals.gene_segments(genes, called)
        neutral = ge.where("cnv_state = 'neu'")
        fits = graph.cut(sequence.cell_fits(counts, ref, choice, neutral if not neutral.isEmpty() else genes))
        ex = posterior.expression_likelihoods(counts, fits, ref, ge.where("cnv_state <> 'neu'"))
        if edges is not None:
            ex = smooth_likelihoods(ex, edges, spatial_method)
        exp_post = put("exp_post", posterior.compute_posterior(posterior.with_priors(ex, segs, floor=True)))
        allele_post = put("allele_post", posterior.allele_post(alleles, hap, segs))
        joint = posterior.joint_post(exp_post, allele_post, segs).join(segs.select("seg", F.col("LLR"), "n_states", "cnv_states"), "seg", "left")
        joint = put("joint_post", relational.expand_states(relational.mean_entropy(joint)))
        usable = relational.posterior_filter(joint, max_entropy, min_llr)
        names = sorted(r.seg for r in usable.select("seg").distinct().collect())  # called segments: tens
        if not names:
            return Result("no segment tells cells apart", out)
        matrix = put("posteriors", relational.posterior_matrix(usable, names, p_min))
        n = matrix.count()
        if n > max_tree_cells:
            return Result(f"{n} cells are too many for a tree; raise max_tree_cells or take groups of cells", out)
        rows = matrix.orderBy("cell").collect()
        p, cells = np.array([[r[s] for s in names] for r in rows]), [r.cell for r in rows]
        tree, _ = phylogeny.candidate_tree(p, cells, max_nni, eps, skip_nj)
        history = phylogeny.simplify(phylogeny.mutation_graph(tree, p, names), tree, p, names, max_cost, n_cut)
        table = put("clone_table", counts.sparkSession.createDataFrame(phylogeny.clone_table(history, tree), "clone int, GT string, compartment string"))
        out[f"tree_{i}"] = phylogeny.node_table(tree, cells, counts.sparkSession)
        # states of a multi-allelic segment stand beside each other here too
        tree_exp = relational.expand_states(exp_post.join(segs.select("seg", "n_states", "cnv_states"), "seg"))
        tree_allele = relational.expand_states(allele_post.join(segs.select("seg", "n_states", "cnv_states"), "seg"))
        post = posterior.clone_post(table, tree_exp, tree_allele)
        calls = put("clone_post", posterior.clone_calls(post, [r.clone for r in table.select("clone").orderBy("clone").collect()]))
        subtrees, clones = phylogeny.regroup(calls, history)
        if check_convergence and i > 1 and relational.same_rows(out[f"segs_{i}"].select("CHROM", "seg_start", "seg_end", "cnv_state"), out[f"segs_{i - 1}"].select("CHROM", "seg_start", "seg_end", "cnv_state")):
            return Result("converged", out)
    return Result("complete", out)


def smooth_likelihoods(ex: DataFrame, edges: DataFrame, method: str) -> DataFrame:
    """R06 with space: each log-likelihood smoothed over neighbouring cells, segment by segment."""
    names = list(posterior.LIKELIHOODS)
    long = ex.select("cell", "seg", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(c) for c in names]))).alias("k", "x"))
    node = F.struct("cell", "seg", "k")
    pairs = long.select("seg", "k").distinct()
    wide = edges.crossJoin(F.broadcast(pairs)).select(F.struct(F.col("src").alias("cell"), "seg", "k").alias("src"), F.struct(F.col("dst").alias("cell"), "seg", "k").alias("dst"), "w")
    z = graph.neighbours_average(long.select(node.alias("node"), "x"), wide, method).select("node.*", "x")
    back = z.groupBy("cell", "seg").pivot("k", names).agg(F.first("x"))
    return ex.drop(*names).join(back, ["cell", "seg"])
