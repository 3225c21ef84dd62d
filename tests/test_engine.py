"""Micro-fixtures, kernels against brute force, and a look at the registry."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ploidyne.functions import kernels as K
from ploidyne.functions import scalars as S
from ploidyne.operators import bulk, graph, intervals, phylogeny, posterior, relational, windows


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_scalars(spark):
    assert [one(spark, S.base26(F.lit(n))) for n in (0, 25, 26, 27, 51, 52, 675, 676)] == ["a", "z", "ba", "bb", "bz", "ca", "zz", "baa"]
    assert abs(one(spark, S.switch_prob(F.lit(0.5))) - 0.3160602794) < 1e-9
    assert abs(one(spark, S.beta_binom_logpmf(F.lit(1), F.lit(2), 1.0, 1.0)) + 1.0986122887) < 1e-9
    assert one(spark, S.beta_binom_logpmf(F.lit(3), F.lit(2), 1.0, 1.0)) == float("-inf")
    assert abs(one(spark, S.nbinom_logpmf(F.lit(0), 1.0, 1.0)) + 0.6931471806) < 1e-9
    assert abs(one(spark, S.binom_logpmf(F.lit(3), F.lit(4), 0.5)) + 1.3862943611) < 1e-9


def test_intervals(spark):
    genes = spark.createDataFrame([("A", "1", 100, 200), ("B", "1", 150, 300)], "gene string, CHROM string, gene_start long, gene_end long")
    snps = spark.createDataFrame([(str(p), "1", p) for p in (100, 150, 151, 200, 300)], "snp_id string, CHROM string, POS long")
    got = {r.POS: r.gene for r in intervals.annotate_genes(snps, genes).collect()}
    assert got == {100: None, 150: "A", 151: "A", 200: "B", 300: None}
    r = lambda *x: spark.createDataFrame([("1", a, b) for a, b in x], "CHROM string, seg_start long, seg_end long")
    assert sorted((x.seg_start, x.seg_end, x.seg_length) for x in intervals.union_ranges(r((1, 5), (4, 9), (11, 12))).collect()) == [(1, 9, 9), (11, 12, 2)]
    assert [(x.seg_start, x.seg_end) for x in intervals.union_ranges(r((1, 5), (6, 9))).collect()] == [(1, 9)]
    assert sorted((x.seg_start, x.seg_end) for x in intervals.subtract_ranges(r((1, 100)), r((20, 30))).collect()) == [(1, 19), (31, 100)]
    cons = r((20, 30)).withColumn("cnv_state", F.lit("del"))
    assert sorted((x.seg_cons, x.seg_start, x.seg_end, x.seg_length) for x in intervals.fill_neutral(cons, r((1, 100))).collect()) == [("1a", 1, 20, 19), ("1b", 20, 30, 10), ("1c", 30, 100, 70)]
    marks = spark.createDataFrame([("1", 100, 1.0), ("1", 200, 2.0)], "CHROM string, POS long, cM double")
    pts = spark.createDataFrame([("1", p) for p in (50, 150, 250)], "CHROM string, POS long")
    assert sorted(x.cM for x in intervals.interpolate(pts, marks).collect()) == [1.0, 1.5, 2.0]


def test_ranges_that_meet_none_come_back_once(spark):
    r = lambda *x: spark.createDataFrame([("1", a, b) for a, b in x], "CHROM string, s long, e long")
    left = r((10, 120_000), (49_000, 51_000), (200_000, 330_000), (200_000, 330_000))
    right = r((110_000, 115_000), (100, 200)).select("CHROM", F.col("s").alias("rs"), F.col("e").alias("re"))
    got = sorted((x.s, x.e, x.rs or 0) for x in intervals.range_join(left, right, "s", "e", "rs", "re", "left").collect())
    assert got == [(10, 120_000, 100), (10, 120_000, 110_000), (49_000, 51_000, 0), (200_000, 330_000, 0), (200_000, 330_000, 0)]


def test_lineage_below_the_heaviest_vertex_is_tumour():
    # cells 0-1 normal, 2-4 below vertex 1 (two of them also below 2), 5 below vertex 3
    tree = phylogeny.Tree(6, {6: [2, 3], 7: [6, 4], 8: [0, 1], 9: [8, 5], 10: [9, 7]})
    h = phylogeny.History({0: [], 1: ["a"], 2: ["b"], 3: ["c"]}, {0: [1, 3], 1: [2], 2: [], 3: []}, {0: 10, 1: 7, 2: 6, 3: 5}, 0)
    assert phylogeny.own_cells(h, tree) == {0: 2, 1: 1, 2: 2, 3: 1} and phylogeny.tumour_root(h, phylogeny.own_cells(h, tree)) == 1
    assert phylogeny.clone_table(h, tree) == [(0, "", "normal"), (1, "a", "tumor"), (2, "a,b", "tumor"), (3, "c", "normal")]
    none = phylogeny.History({0: []}, {0: []}, {0: 10}, 0)
    assert phylogeny.clone_table(none, tree) == [(0, "", "normal")]


def test_components_of_a_hub(spark):
    from ploidyne.operators import plumbing

    e = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(500, 520)]
    old, plumbing.HOT_ROWS = plumbing.HOT_ROWS, 20
    try:
        got = {r.node: r.component for r in plumbing.connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    finally:
        plumbing.HOT_ROWS = old
    assert got == {k: 0 for k in range(400)} | {k: 500 for k in range(500, 521)}


def test_windows(spark):
    d = spark.createDataFrame([("1", i, s, "g", 1) for i, s in enumerate("nnlln")], "CHROM string, POS long, state string, gene string, pAD int")
    assert [(r.boundary, r.seg) for r in windows.annotate_segments(d, "state").orderBy("POS").collect()] == [(0, "1a"), (0, "1a"), (1, "1b"), (0, "1b"), (1, "1c")]
    d = spark.createDataFrame([("1", i, a, b) for i, (a, b) in enumerate([(1, 1), (0, 2), (2, 0), (3, 1)])], "CHROM string, POS long, a int, b int")
    assert [round(r.t, 9) for r in d.select("POS", windows.rolling_theta("a", "b", 1).alias("t")).orderBy("POS").collect()] == [-0.25, 0.0, 0.1, 0.125]


def test_posterior_of_equal_evidence(spark):
    x = spark.range(1).select(*[F.lit(0.0).alias(c) for c in posterior.LIKELIHOODS], *[F.lit(0.2).alias(f"prior_{s}") for s in posterior.STATES])
    r = posterior.compute_posterior(x).first()
    assert abs(r.p_neu - 0.5) < 1e-12 and all(abs(r[f"p_{s}"] - 0.1) < 1e-12 for s in posterior.STATES) and abs(r.logBF) < 1e-12


def test_kernels():
    rng = np.random.default_rng(0)
    for n, m in ((1, 2), (4, 3), (6, 2)):
        start, emit, trans = rng.normal(size=m), rng.normal(size=(n, m)), rng.normal(size=(n, m, m))
        score = {p: start[p[0]] + emit[0, p[0]] + sum(trans[t, p[t - 1], p[t]] + emit[t, p[t]] for t in range(1, n)) for p in itertools.product(range(m), repeat=n)}
        assert tuple(K.viterbi(start, emit, trans)) == max(score, key=score.get)
        assert abs(K.forward(start, emit, trans) - np.log(sum(np.exp(s) for s in score.values()))) < 1e-9
        assert np.allclose(K.forward_backward(start, emit, trans).sum(1), 1)
    assert abs(np.exp(K.poilog_logpmf(np.arange(200), 0.0, 1.0)).sum() - 1) < 1e-3
    assert np.allclose(K.allele_likelihoods([3, 1, np.nan, 5], [8, 4, np.nan, 6], [0, 0.1, 0.2, 0.3], [0.1, 0.3]), [K.allele_likelihood(np.array([3, 1, np.nan, 5]), np.array([8, 4, np.nan, 6]), [0, 0.1, 0.2, 0.3], t) for t in (0.1, 0.3)])
    y = rng.poisson(np.exp(rng.normal(0.3, 0.5, 3000)) * 20)
    mu, sig = K.fit_lnpois(y, np.full(3000, 0.02), 1000)
    assert abs(mu - 0.3) < 0.1 and abs(sig - 0.5) < 0.1
    assert abs(K.welch_p(5, 1.0, 1.0, 5, 1.0, 1.0) - 1) < 1e-12 and K.welch_p(1, 0, 0, 5, 1, 1) == 1.0
    assert np.exp(K.transitions15([0.1], 1e-5)).sum(2).ravel() == pytest.approx(1, abs=1e-9)


def test_trees_and_graphs(spark):
    assert graph.maximal_cliques(list("abcd"), [("a", "b"), ("b", "c"), ("a", "c")]) == [("a", "b", "c"), ("d",)]
    p = np.clip(np.random.default_rng(1).random((8, 4)), 0.01, 0.99)
    tree, history = phylogeny.candidate_tree(p, [str(i) for i in range(8)])
    assert all(b >= a for a, b in itertools.pairwise(history)) and sorted(v for v in tree.postorder() if v < 8) == list(range(8))
    assert abs(phylogeny.tree_score(phylogeny.Tree(2, {2: [0, 1]}), np.array([[0.9], [0.9]])) + 0.2107210313) < 1e-9
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, w double")
    x = spark.createDataFrame([("a", 0.0), ("b", 2.0)], "node string, x double")
    assert {r.node: r.x for r in graph.neighbours_average(x, e, "degree").collect()} == {"a": 1.0, "b": 1.0}
    assert {r.node: r.x for r in graph.neighbours_average(x, e, "cpr", steps=1).collect()} == {"a": 1.5, "b": 0.5}
    assert bulk.__all__ and relational.same_rows(x, x)


@pytest.mark.parametrize("name", ["m03_joint_hmm", "m06_m07_f07_clonal_loh", "m09_r01_f08_f09_analyze_bulk", "r09_run_group_hmms", "r03_a23_expression_likelihoods"])
def test_queries_read_whole_tables(spark, name):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = entry.queries()[name](spark, sf).toPandas()
    part, lineitem = spark.read.parquet(f"{sf}/part.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet")
    chroms = {r.c for r in part.select(F.regexp_extract("p_brand", r"(\d+)", 1).alias("c")).distinct().collect()}
    if name.startswith("m06"):
        # one chain over the bulk of all cells; before, over those of one sample
        from ploidyne.operators import bulk, sequence
        from ploidyne.plans.views import Views

        v = Views(spark, sf)
        pooled = bulk.get_bulk(v.counts(), relational.check_alleles(v.alleles(), False), v.membership().withColumn("sample", F.lit("x")), v.ref(), v.genes())
        want = sequence.clonal_loh(pooled).toPandas()
        assert sorted(map(tuple, got[["seg", "seg_start", "seg_end"]].to_numpy())) == sorted(map(tuple, want[["seg", "seg_start", "seg_end"]].to_numpy()))
    elif name.startswith("r03"):
        assert set(got.seg) == {f"{c}a" for c in chroms} and set(got.cell) == {str(r.l_suppkey) for r in lineitem.select("l_suppkey").distinct().collect()}
    else:
        assert set(got.CHROM) == chroms


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 140
