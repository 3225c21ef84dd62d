"""Cases that only larger tables bring up."""

import numpy as np
from pyspark.sql import functions as F

from ploidyne.functions import kernels as K
from ploidyne.functions import scalars as S
from ploidyne.operators import bulk, graph, intervals, phylogeny, relational, windows


def test_depth_is_that_of_shared_genes(spark):
    counts = spark.createDataFrame([("c", "g1", 3), ("c", "g2", 1), ("c", "g3", 6)], "cell string, gene string, cnt long")
    member = spark.createDataFrame([("s", "c")], "sample string, cell string")
    ref = spark.createDataFrame([("g1", 0.5), ("g2", 0.5)], "gene string, lambda_ref double")
    genes = spark.createDataFrame([(g, "1", i, i + 1) for i, g in enumerate(("g1", "g2", "g3"))], "gene string, CHROM string, gene_start long, gene_end long")
    got = {r.gene: (r.d_obs, r.lambda_obs) for r in bulk.expression_bulk(counts, member, ref, genes).collect()}
    assert got == {"g1": (4, 0.75), "g2": (4, 0.25)}
    assert {r.d_obs for r in bulk.expression_bulk(counts, member, ref, genes, whole_depth=True).collect()} == {10}


def test_labels_past_three_letters_differ(spark):
    n = (17575, 17576, 17577, 18252, 26 * 676 * 2, 150_000)
    got = [r.x for r in spark.createDataFrame([(k,) for k in n], "n long").orderBy("n").select(S.base26("n").alias("x")).collect()]
    assert got == [chr(97 + k // 676) + chr(97 + k // 26 % 26) + chr(97 + k % 26) for k in n] and len(set(got)) == len(n)


def test_best_reference_keeps_cells_without_shared_genes(spark):
    counts = spark.createDataFrame([("c", "g1", 5), ("c", "g2", 1), ("d", "g9", 4), ("e", "g1", 3)], "cell string, gene string, cnt long")
    ref = spark.createDataFrame([("g1", "A", 0.9), ("g2", "A", 0.1), ("g2", "B", 0.7), ("g3", "B", 0.3)], "gene string, ref string, lambda double")
    got = {r.cell: (r.ref, r.r) for r in relational.best_reference(counts, ref).collect()}
    x, y = np.log1p(np.array([1e6, 0, 0])), {"A": np.log1p(np.array([9e5, 1e5, 0])), "B": np.log1p(np.array([0, 7e5, 3e5]))}
    assert set(got) == {"c", "d", "e"} and np.isnan(got["d"][1])
    assert got["e"][0] == "A" and abs(got["e"][1] - np.corrcoef(x, y["A"])[0, 1]) < 1e-9
    # of profiles that share no gene with a cell the correlation is negative, not missing
    only = relational.best_reference(counts.where("cell = 'e'"), ref.where("ref = 'B'").union(ref.where("ref = 'A'").withColumn("gene", F.lit("g4")))).collect()
    assert len(only) == 1 and only[0].r is not None
    assert relational.best_reference(counts, ref, 2.0).count() == 0


def test_closure_of_a_deep_tree(spark):
    n = 40
    tree = phylogeny.Tree(n, {n: [0, 1], **{n + k: [n + k - 1, k + 1] for k in range(1, n - 1)}})
    old = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        got = {(r.node, r.leaf) for r in phylogeny.closure_table(phylogeny.node_table(tree, [str(i) for i in range(n)], spark)).collect()}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", old)
    want = set()
    for leaf in range(n):
        v = leaf
        while v >= 0:
            want.add((v, leaf))
            v = tree.parent[v]
    assert got == want


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_smoothing_has_no_frame_that_is_made_anew_for_each_row(spark):
    rows = [("1", i, s, g) for i, (s, g) in enumerate([("a", 1), ("b", 1), ("c", 9), ("d", 1), ("e", 9)])] + [("2", 0, "x", 1)]
    x = windows.smooth_segments(spark.createDataFrame(rows, "CHROM string, POS long, state string, n_genes int"), "state", 2)
    assert [r.state for r in x.orderBy("CHROM", "POS").collect()] == ["c", "c", "c", "c", "e", None]
    assert "currentrow$(), unboundedfollowing$()" not in _plan(x)


def test_interpolation_has_no_frame_that_is_made_anew_for_each_row(spark):
    marks = spark.createDataFrame([("1", p, c) for p, c in ((100, 1.0), (200, 2.0), (400, 8.0))], "CHROM string, POS long, cM double")
    x = intervals.interpolate(spark.createDataFrame([("1", p) for p in (50, 100, 150, 200, 300, 400, 500)], "CHROM string, POS long"), marks)
    assert [r.cM for r in x.orderBy("POS").collect()] == [1.0, 1.0, 1.5, 2.0, 5.0, 8.0, 8.0]
    assert "currentrow$(), unboundedfollowing$()" not in _plan(x)


def test_allele_model_is_exact_to_the_last_bit():
    import ctypes
    import math

    c = ctypes.CDLL("libm.so.6").lgamma
    c.restype, c.argtypes = ctypes.c_double, [ctypes.c_double]
    x = np.arange(1, 3000) / 5
    assert K.lgamma(x).tolist() == [c(v) for v in x]
    d, t = np.linspace(1e-7, 3, 4001), 1e-5
    s = K.switch_probs(d)
    assert s.tolist() == [max(0.5 * (1 - math.exp(-2 * v)), 1e-10) for v in d] and K.switch_probs([np.nan]).tolist() == [0.0]
    step = K.transitions5(s, t)
    assert step[:, 1, 1].tolist() == [math.log((1 - t) * (1 - v)) for v in s] and step[:, 3, 4].tolist() == [math.log((1 - t) * v) for v in s]


def test_linkage_of_thousands_takes_seconds():
    import time

    from ploidyne.operators import graph

    rng = np.random.default_rng(5)
    x = rng.random((12, 3))
    for method in ("ward", "average"):
        # merges by hand: the nearest two clusters, by all pairs of members
        groups, merges = {i: [i] for i in range(12)}, []
        for step in range(11):
            def gap(a, b):
                if method == "average":
                    return np.mean([np.linalg.norm(x[i] - x[j]) for i in groups[a] for j in groups[b]])
                p, q = x[groups[a]], x[groups[b]]
                return np.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * np.linalg.norm(p.mean(0) - q.mean(0))

            a, b = min(((a, b) for a in groups for b in groups if a < b), key=lambda k: gap(*k))
            merges.append((a, b, gap(a, b)))
            groups[12 + step] = groups.pop(a) + groups.pop(b)
        got = graph.linkage(graph.pairwise(x), method)
        assert [tuple(r[:2]) for r in got] == [m[:2] for m in merges] and np.allclose(got[:, 2], [m[2] for m in merges])
    far = graph.pairwise(rng.random((4000, 5)))
    start = time.time()
    assert len(graph.linkage(far, "average")) == 3999 and time.time() - start < 15


def test_neighbour_joining_of_a_thousand_takes_seconds():
    import time

    from ploidyne.operators import graph

    # distances along a tree give that tree back
    rng = np.random.default_rng(6)
    n = 60
    tree = phylogeny.upgma(graph.pairwise(rng.random((n, 4))))
    length = {v: rng.uniform(0.1, 1) for v in tree.parent}
    up = []
    for leaf in range(n):
        v, way = leaf, {}
        while tree.parent[v] >= 0:
            way[v] = length[v]
            v = tree.parent[v]
        up.append(way)
    d = np.array([[sum(x for k, x in a.items() if k not in b) + sum(x for k, x in b.items() if k not in a) for b in up] for a in up])
    out = np.array([sum(a.values()) + 1 for a in up])
    d = np.block([[d, out[:, None]], [out[None], np.zeros((1, 1))]])

    def clades(t):
        below = {}
        for v in t.postorder():
            below[v] = frozenset([v]) if v < t.n else frozenset().union(*[below[c] for c in t.children[v]])
        return set(below.values())

    assert clades(phylogeny.neighbour_joining(d, n)) == clades(tree)
    p = rng.random((1500, 8))
    start = time.time()
    got = phylogeny.neighbour_joining(graph.pairwise(np.vstack([p, np.zeros(8)])), 1500)
    assert got.n == 1500 and time.time() - start < 15


def test_decoding_runs_once(spark):
    from ploidyne.operators import sequence
    from ploidyne.plans import catalog
    from ploidyne.plans.views import Views

    bulks = catalog._full_bulk(Views(spark, "/root/testdata/sf0.001"))
    ranges, _ = sequence.common_diploid(bulks)
    assert "FlatMapGroups" not in _plan(ranges)
    # the phases of called segments alone are still to be made
    assert _plan(sequence.analyze_bulk(bulks, min_genes=2)).count("FlatMapGroups") == 1


def test_expression_is_smoothed_without_frames_of_rows(spark):
    rng = np.random.default_rng(8)
    n, half = 30, 3
    lam, cnt = rng.random(n) / 1e3, {(c, g): int(rng.integers(1, 90)) for c in "ab" for g in range(n + 2) if rng.random() < 0.4}
    counts = spark.createDataFrame([(c, f"g{g}", k) for (c, g), k in cnt.items()], "cell string, gene string, cnt long")
    genes = spark.createDataFrame([(f"g{g}", g) for g in range(n)], "gene string, gene_index long")
    ref = spark.createDataFrame([(f"g{g}", float(x)) for g, x in enumerate(lam)], "gene string, lambda double")
    x = windows.smooth_expression(counts, counts, genes, ref, half=half)
    got = {(r.cell, r.gene): r.x for r in x.collect()}
    assert len(got) == 2 * n
    for c in "ab":
        total = sum(k for (d, _), k in cnt.items() if d == c)
        z = np.clip([np.log2(cnt.get((c, g), 0) / total * 1e6 + 1) - np.log2(lam[g] * 1e6 + 1) for g in range(n)], -3, 3)
        z -= z.mean()
        assert np.allclose([got[c, f"g{g}"] for g in range(n)], [z[max(g - half, 0) : g + half + 1].mean() for g in range(n)], atol=1e-12)
    assert "Window" not in _plan(x)


def _cells(spark, seed, cells, n):
    rng = np.random.default_rng(seed)
    # cells of three kinds, each with counts mostly in a region of its own; one has no counts on known genes
    counts = [(f"c{c:02}", f"g{g}", int(rng.integers(1, 4))) for c in range(cells) for g in range(n) if rng.random() < (0.8 if g * 3 // n == c % 3 else 0.15)] + [("none", "other", 4)]
    counts = spark.createDataFrame(counts, "cell string, gene string, cnt long")
    genes = spark.createDataFrame([(f"g{g}", g) for g in range(n)], "gene string, gene_index long")
    ref = spark.createDataFrame([(f"g{g}", float(x)) for g, x in enumerate(rng.random(n) / 1e3)], "gene string, lambda double")
    return counts, counts, genes, ref


def test_cells_are_compared_by_stored_genes_in_blocks(spark, monkeypatch):
    half, tables = 3, _cells(spark, 5, 23, 50)
    smooth = windows.smooth_expression(*tables, half=half).toPandas().pivot(index="cell", columns="gene_index", values="x")
    x = smooth.to_numpy()
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    changes, n = windows.expression_changes(*tables)
    assert n == 50 and changes.count() == 24 and "FlatMapGroups" not in _plan(changes)
    for width in (7, 64):
        monkeypatch.setattr(graph, "WIDTH", width)
        rows = [graph._flat(t) for t in [changes.orderBy("cell").toArrow().combine_chunks()]][0]
        split = lambda a, b: tuple(z[(rows[0] >= a) & (rows[0] < b)] - (a if k == 0 else 0) for k, z in enumerate(rows))  # noqa: B023, E731
        whole = np.block([[graph.block_products(split(*i), split(*j), (i[1] - i[0], j[1] - j[0]), n, half) for j in ((0, 10), (10, 24))] for i in ((0, 10), (10, 24))])
        own = np.diagonal(whole)
        assert np.allclose(np.maximum(own[:, None] + own - 2 * whole, 0), want**2, atol=1e-9)
        sparse = tuple(z[::29] for z in split(10, 24))  # few stored genes are met one by one
        dense = graph.block_products(sparse, split(0, 10), (14, 10), n, half)
        assert np.allclose(graph.block_products(split(0, 10), sparse, (10, 14), n, half), dense.T, atol=1e-9)
    monkeypatch.setattr(graph, "ENTRIES", 0)
    assert np.allclose(graph.cell_distances(changes, n, list(smooth.index), half), want, atol=1e-6)
    labels = graph.cut_tree(graph.linkage(want), 24, 3)
    assert {r.cell: r.cluster for r in graph.expression_clusters(changes, n, 3, half).collect()} == dict(zip(smooth.index, labels, strict=True))


def test_many_cells_are_clustered_without_dense_rows(spark):
    counts, _, genes, ref = _cells(spark, 6, 30, 60)
    changes, n = windows.expression_changes(*(x.where("cell != 'none'") if "cell" in x.columns else x for x in (counts, counts, genes, ref)))
    got = {r.cell: r.cluster for r in graph.expression_clusters(changes, n, 3, 3, max_cells=10).collect()}
    assert len(got) == 30 and len({(got[f"c{c:02}"], c % 3) for c in range(30)}) == 3
    same = spark.createDataFrame([(f"c{c}", [1, 4], [1.0, 2.0]) for c in range(12)], "cell string, place array<int>, change array<double>")
    assert {r.cluster for r in graph.expression_clusters(same, 9, 3, 2, max_cells=10).collect()} == {1}


def test_poisson_lognormal_needs_few_steps(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 300, 40), [0, 0, 1, 10**6]]).astype(float)
    m, s = rng.normal(1, 4, 44), np.exp(rng.uniform(np.log(0.01), np.log(5), 44))
    for k in range(44):
        # the whole integral, over twelve deviations around the mode of a fine grid
        z = np.linspace(-60, 60, 2_000_001)
        h = x[k] * z - np.exp(np.minimum(z, 700)) - (z - m[k]) ** 2 / (2 * s[k] ** 2)
        near = z[h > h.max() - 40]
        z = np.linspace(near[0] - 1e-3, near[-1] + 1e-3, 20_001)
        h = x[k] * z - np.exp(z) - (z - m[k]) ** 2 / (2 * s[k] ** 2)
        want = np.log(np.exp(h - h.max()).sum() * (z[1] - z[0])) + h.max() - K.lgamma(x[k] + 1) - 0.5 * np.log(2 * np.pi * s[k] ** 2)
        want = want if want > -744 else np.log(1e-15)
        assert abs(K.poilog_logpmf(x[k], m[k], s[k])[0] - want) < 1e-8 * max(1, abs(want))
    assert K.poilog_logpmf([3, 3, 4], [1, 1, 1], 0.5)[0] == K.poilog_logpmf(3, 1, 0.5)[0]
    calls, real = [], K._poilog
    monkeypatch.setattr(K, "_poilog", lambda *a, **k: calls.append(1) or real(*a, **k))
    lam, d = rng.random(400) / 50, 3000.0
    y = rng.poisson(d * lam * np.exp(rng.normal(0.7, 0.6, 400))).astype(float)
    mu, sig = K.fit_lnpois(y, lam, d)
    assert len(calls) < 20
    base = np.round(np.log(lam * d), 2)
    at = lambda a, b: float(K.poilog_logpmf(y, a + base, b).sum())
    assert all(at(mu + a, sig + b) <= at(mu, sig) + 1e-8 for a, b in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)))
    # no spread beyond Poisson's, and counts that are all 0
    assert abs(K.fit_lnpois(np.full(50, 4.0), np.full(50, 0.1), 40.0)[1] - 0.01) < 1e-12
    assert K.fit_lnpois(np.zeros(9), np.full(9, 0.1), 40.0)[1] >= 0.01


def _clades(tree):
    below = {}
    for v in tree.postorder():
        below[v] = frozenset([v]) if v < tree.n else frozenset().union(*[below[c] for c in tree.children[v]])
    return set(below.values())


def test_average_linkage_without_a_matrix(monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(0.5, 0.07, (400, 6))
    some = x[rng.integers(0, 60, 300)]
    far = graph.pairwise(some)
    far[(some[:, None] == some[None]).all(2)] = 0
    want, repeated = phylogeny.upgma(graph.pairwise(x)), phylogeny.upgma(far)
    for dense in (100, 20):
        monkeypatch.setattr(phylogeny, "DENSE", dense)
        assert phylogeny.upgma_cells(x).children == want.children
        assert phylogeny.upgma_cells(some).children == repeated.children
    scores = phylogeny.greedy_nni(want, x)[1]
    assert abs(scores[-1] - phylogeny.tree_score(phylogeny.greedy_nni(want, x)[0], x)) < 1e-6


def test_trees_of_many_cells_need_no_matrix_of_pairs(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(phylogeny, "DENSE", 500, raising=False)
    p = np.random.default_rng(10).normal(0.5, 0.07, (3000, 8)).clip(0, 1)
    tracemalloc.start()
    tree, _ = phylogeny.candidate_tree(p, [str(i) for i in range(3000)], 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the matrix alone takes 72 MB
    assert tree.n == 3000 and most < 40e6


def test_neighbour_joining_without_a_matrix(monkeypatch):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0.5, 0.07, (300, 6)), np.zeros(6)])
    some = np.vstack([x[rng.integers(0, 40, 200)], np.zeros(6)])
    far = graph.pairwise(some)
    far[(some[:, None] == some[None]).all(2)] = 0
    want, repeated = _clades(phylogeny.neighbour_joining(graph.pairwise(x), 300)), phylogeny.neighbour_joining(far, 200)
    kinds = lambda t: {frozenset(some[k].tobytes() for k in c) for c in _clades(t)}
    for dense, near in ((100, 32), (8, 32), (20, 2)):
        monkeypatch.setattr(phylogeny, "DENSE", dense)
        monkeypatch.setattr(phylogeny, "NEAR", near)
        assert _clades(phylogeny.join_cells(x, 300)) == want
        # of equal rows any two may be joined first
        assert kinds(phylogeny.join_cells(some, 200)) == kinds(repeated)
