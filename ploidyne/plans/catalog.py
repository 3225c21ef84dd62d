"""Queries: every operator applied to the driver's tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ploidyne.functions import kernels as K
from ploidyne.functions import scalars as S
from ploidyne.operators import bulk as B
from ploidyne.operators import graph as G
from ploidyne.operators import intervals as I
from ploidyne.operators import phylogeny as Y
from ploidyne.operators import posterior as P
from ploidyne.operators import relational as R
from ploidyne.operators import sequence as M
from ploidyne.operators import windows as W
from ploidyne.operators.plumbing import new_path
from ploidyne.plans.views import SQL, Views

#: The 25 labels of parts, as segments.
SEGMENT_NAMES = [f"{k}a" for k in range(1, 26)]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            sql_ = sql.strip()
            # lambda is a keyword of DuckDB
            ORACLES[name] = re.sub(r"\blambda\b", '"lambda"', f"WITH RECURSIVE {SQL}" + (", " + sql_[5:] if sql_.startswith("WITH ") else sql_))
        return f

    return put


def rnd(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


# filters and validation


@query("p01_check_alleles", """SELECT "CHROM", count(*) AS n, sum("DP")::BIGINT AS dp FROM alleles WHERE "CHROM" IN (SELECT i::VARCHAR FROM range(1, 23) r(i)) GROUP BY ALL""")
def _(v):
    return R.check_alleles(v.alleles()).groupBy("CHROM").agg(F.count(F.lit(1)).alias("n"), F.sum("DP").alias("dp"))


@query("p02_check_reference", "SELECT ref, count(*) AS genes, round(sum(lambda), 6) AS total FROM refs GROUP BY ref")
def _(v):
    return R.check_reference(v.ref()).groupBy("ref").agg(F.count(F.lit(1)).alias("genes"), F.round(F.sum("lambda"), 6).alias("total"))


@query("p03_unique_names", """SELECT p_partkey, CASE WHEN n > 0 THEN p_brand || '-' || n ELSE p_brand END AS p_brand FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)""")
def _(v):
    return R.unique_names(v.table("part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


@query("p04_gene_universe", """SELECT gene, (row_number() OVER (ORDER BY "CHROM"::INT, gene_start, gene) - 1)::BIGINT AS gene_index FROM genes WHERE gene IN (SELECT gene FROM counts) AND gene IN (SELECT gene FROM refs)""")
def _(v):
    return R.gene_universe(v.genes(), v.counts(), v.ref()).select("gene", F.col("gene_index").cast("long").alias("gene_index"))


@query("p05_drop_empty_cells", "WITH c AS (SELECT cell, gene, CASE WHEN cell::INT % 5 = 0 THEN 0 ELSE cnt END AS cnt FROM counts), k AS (SELECT cell FROM c GROUP BY cell HAVING sum(cnt) > 0) SELECT 'alleles' AS t, count(*) AS n FROM alleles WHERE cell IN (SELECT cell FROM k) UNION ALL SELECT 'counts', count(*) FROM c WHERE cell IN (SELECT cell FROM k)")
def _(v):
    c, a = R.drop_empty_cells(v.counts().withColumn("cnt", F.when(F.col("cell").cast("int") % 5 == 0, 0).otherwise(F.col("cnt"))), v.alleles())
    n = F.count(F.lit(1)).alias("n")
    return c.agg(n).select(F.lit("counts").alias("t"), "n").union(a.agg(n).select(F.lit("alleles").alias("t"), "n"))


EXPR = """e AS (SELECT g.*, c.y::DOUBLE / d.d AS lambda_obs, r.lambda AS lambda_ref FROM genes g JOIN (SELECT gene, sum(cnt) AS y FROM counts GROUP BY gene) c USING (gene) CROSS JOIN (SELECT sum(cnt) AS d FROM counts) d JOIN refs r ON r.gene = g.gene AND r.ref = 'R')"""


def _expr(v):
    x = R.gene_totals(v.counts()).join(v.genes(), "gene")
    return x.join(v.ref().where("ref = 'R'").select("gene", F.col("lambda").alias("lambda_ref")), "gene")


@query("p06_filter_genes", f"""WITH {EXPR}, f AS (SELECT * FROM e WHERE NOT ("CHROM" = '6' AND gene_start < 33480577 AND gene_end > 28510120) AND NOT EXISTS (SELECT 1 FROM segments s WHERE s.cnv_state = 'loh' AND s."CHROM" = e."CHROM" AND e.gene_start < s.seg_end AND e.gene_end > s.seg_start)),
m AS (SELECT avg(lambda_ref) FILTER (lambda_ref > 0) AS mr, avg(lambda_obs) FILTER (lambda_obs > 0) AS mo FROM f)
SELECT gene, "CHROM" FROM f, m WHERE lambda_ref > 0 AND ((lambda_ref * 1e6 > 2 AND lambda_obs * 1e6 > 2) OR lambda_ref > mr OR lambda_obs > mo)""")
def _(v):
    return R.filter_genes(_expr(v), v.segments().where("cnv_state = 'loh'")).select("gene", "CHROM")


@query("p07_filter_positions", """SELECT snp_id, count(*) AS n FROM alleles a WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s."CHROM" = a."CHROM" AND "POS" > seg_start AND "POS" < seg_end) GROUP BY snp_id""")
def _(v):
    return R.filter_positions(v.alleles(), v.segments()).groupBy("snp_id").agg(F.count(F.lit(1)).alias("n"))


@query("p08_het_filter", """SELECT cell, count(*) AS n FROM alleles WHERE "GT" IN ('1|0','0|1') AND "cM" IS NOT NULL AND "DP" >= 20 GROUP BY cell""")
def _(v):
    return R.het_filter(v.alleles(), 20).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query("p09_fold_change_filter", f"""WITH {EXPR} SELECT gene, round(log2(lambda_obs / lambda_ref), 6) AS "logFC" FROM e WHERE lambda_obs > 0 AND lambda_ref > 0 AND abs(log2(lambda_obs / lambda_ref)) < 0.5""")
def _(v):
    return rnd(R.fold_change_filter(B.fold_changes(_expr(v)), 0.5).select("gene", "logFC"), "logFC")


@query("p10_thin", """SELECT cell, count(*) AS n FROM (SELECT cell, "POS" - lag("POS") OVER (PARTITION BY cell, "CHROM" ORDER BY "POS") AS d FROM alleles) WHERE d IS NULL OR d > 250 GROUP BY cell""")
def _(v):
    return W.thin(v.alleles()).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def _plot(v):
    s = v.segments()
    k = F.col("seg_start") / 1000
    return s.select(F.col("seg").alias("snp_id"), "CHROM", F.col("seg_start").alias("POS"), "LLR", (k % 2 == 0).alias("loh"), F.col("cnv_state").alias("state_post"), F.concat("cnv_state", F.when(k % 3 == 0, F.lit("_2_up")).otherwise(F.lit("_1_up"))).alias("state"), ((k % 10) / 10).alias("p_up"), F.col("LLR").alias("logFC"), F.lit(3.0).alias("mu"), F.col("LLR").cast("int").alias("DP"), (F.col("LLR") / 10).alias("pBAF"))


@query("p11_p12_plot_states", """SELECT seg AS snp_id, CASE WHEN s IN ('amp','loh','del') THEN s || '_' || CASE WHEN k % 3 = 0 THEN '2' ELSE '1' END || '_' || CASE WHEN (k % 10) / 10.0 > 0.5 THEN 'up' ELSE 'down' END ELSE s END AS state_post FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 'del' WHEN "LLR" < 5 THEN 'neu' ELSE cnv_state END AS s FROM (SELECT *, seg_start // 1000 AS k FROM segments))""")
def _(v):
    return R.plot_states(_plot(v)).select("snp_id", "state_post")


@query("p13_plot_values", """SELECT seg AS snp_id, 'logFC' AS variable, round(CASE WHEN "LLR" - 3 / ln(2) BETWEEN -2 AND 2 THEN "LLR" - 3 / ln(2) END, 6) AS value FROM segments UNION ALL SELECT seg, 'pHF', round(CASE WHEN "LLR" >= 8 THEN "LLR" / 10 END, 6) FROM segments""")
def _(v):
    return rnd(R.plot_values(_plot(v)).select("snp_id", "variable", "value"), "value")


@query("p14_fixed_segments", """SELECT "CHROM" || '_' || k AS seg, cnv_state, (cnv_state = 'amp')::DOUBLE AS p_amp, (cnv_state = 'del')::DOUBLE AS p_del, (cnv_state = 'loh')::DOUBLE AS p_loh, cnv_state = 'neu' AS "no_LLR" FROM (SELECT *, seg_start // 1000 AS k FROM segments)""")
def _(v):
    s = v.segments().withColumn("seg", (F.col("seg_start") / 1000).cast("long"))
    return R.fixed_segments(s).select("seg", "cnv_state", "p_amp", "p_del", "p_loh", F.col("LLR").isNull().alias("no_LLR"))


@query("p15_loh_segments", """SELECT "CHROM" || '_' || (seg_start // 1000) AS seg, true AS loh FROM segments""")
def _(v):
    return R.loh_segments(v.segments().withColumn("seg", (F.col("seg_start") / 1000).cast("long"))).select("seg", "loh")


@query("p17_posterior_filter", """SELECT seg, "LLR" FROM segments WHERE cnv_state <> 'neu' AND "LLR" / 20 < 0.45 AND "LLR" > 5""")
def _(v):
    return R.posterior_filter(v.segments().withColumn("avg_entropy", F.col("LLR") / 20), 0.45).select("seg", "LLR")


@query("p18_null_repeated_expression", """SELECT "CHROM", count(*) AS n, sum(CASE WHEN r = 1 THEN dp END)::BIGINT AS y FROM (SELECT "CHROM", gene, dp, row_number() OVER (PARTITION BY "CHROM", gene ORDER BY "POS") AS r FROM (SELECT "CHROM", gene, "POS", sum("DP") AS dp FROM alleles GROUP BY ALL)) GROUP BY "CHROM" """)
def _(v):
    x = v.alleles().groupBy("CHROM", "gene", "POS").agg(F.sum("DP").alias("Y_obs"))
    return R.null_repeated_expression(x).groupBy("CHROM").agg(F.count(F.lit(1)).alias("n"), F.sum("Y_obs").alias("y"))


# joins


@query("j01_annotate_genes", """SELECT s.snp_id, min(g.gene) AS gene FROM (SELECT DISTINCT snp_id, "CHROM", "POS" FROM alleles) s LEFT JOIN genes g ON g."CHROM" = s."CHROM" AND s."POS" > g.gene_start AND s."POS" < g.gene_end GROUP BY s.snp_id""")
def _(v):
    return I.annotate_genes(v.alleles().select("snp_id", "CHROM", "POS").distinct(), v.genes()).select("snp_id", "gene")


@query("j02_annotate_genes_with_range", """SELECT snp_id, gene, gene_start, gene_end FROM (SELECT s.snp_id, g.gene, g.gene_start, g.gene_end, row_number() OVER (PARTITION BY s.snp_id ORDER BY g.gene) AS r FROM (SELECT DISTINCT snp_id, "CHROM", "POS" FROM alleles) s JOIN genes g ON g."CHROM" = s."CHROM" AND s."POS" > g.gene_start AND s."POS" < g.gene_end) WHERE r = 1""")
def _(v):
    return I.annotate_genes(v.alleles().select("snp_id", "CHROM", "POS").distinct(), v.genes()).where("gene is not null").select("snp_id", "gene", "gene_start", "gene_end")


J03 = """SELECT snp_id, seg, cnv_state FROM (SELECT s.snp_id, g.seg, g.cnv_state, row_number() OVER (PARTITION BY s.snp_id, s."CHROM" ORDER BY g.seg_start, g.seg_end, g.seg) AS r FROM (SELECT DISTINCT snp_id, "CHROM", "POS" FROM alleles) s {how} segments g ON g."CHROM" = s."CHROM" AND s."POS" >= g.seg_start AND s."POS" <= g.seg_end) WHERE r = 1"""


@query("j03_consensus_inner", J03.format(how="JOIN"))
def _(v):
    return I.annotate_consensus(v.alleles().select("snp_id", "CHROM", "POS").distinct(), v.segments()).select("snp_id", "seg", "cnv_state")


@query("j03_consensus_left", J03.format(how="LEFT JOIN"))
def _(v):
    return I.annotate_consensus(v.alleles().select("snp_id", "CHROM", "POS").distinct(), v.segments(), "left").select("snp_id", "seg", "cnv_state")


@query("j04_gene_segments", """SELECT gene, seg FROM (SELECT g.gene, s.seg, row_number() OVER (PARTITION BY g.gene ORDER BY s.seg_start, s.seg_end, s.seg) AS r FROM genes g JOIN segments s ON s."CHROM" = g."CHROM" AND g.gene_start < s.seg_end AND g.gene_end > s.seg_start) WHERE r = 1""")
def _(v):
    return I.gene_segments(v.genes(), v.segments()).select("gene", "seg")


@query("j05_flag_loh", """SELECT gene, EXISTS (SELECT 1 FROM segments s WHERE s.cnv_state = 'loh' AND s."CHROM" = g."CHROM" AND g.gene_start < s.seg_end AND g.gene_end > s.seg_start) AS loh FROM genes g""")
def _(v):
    return I.flag_overlap(v.genes(), v.segments().where("cnv_state = 'loh'")).select("gene", "loh")


@query("j06_i07_self_overlap", """WITH s AS (SELECT *, seg_start // 1000 AS id FROM segments), o AS (SELECT x.id AS id_x, y.id AS id_y, least(x.seg_end, y.seg_end) - greatest(x.seg_start, y.seg_start) AS len_overlap, x.seg_end - x.seg_start AS lx, y.seg_end - y.seg_start AS ly FROM s x JOIN s y ON x."CHROM" = y."CHROM" AND x.id < y.id AND x.seg_start < y.seg_end AND x.seg_end > y.seg_start) SELECT id_x, id_y, len_overlap, round(len_overlap / lx, 6) AS frac_x, round(len_overlap / ly, 6) AS frac_y FROM o WHERE len_overlap / lx >= 0.45 OR len_overlap / ly >= 0.45""")
def _(v):
    s = v.segments().withColumn("id", (F.col("seg_start") / 1000).cast("long"))
    return rnd(I.self_overlaps(s).drop("CHROM"), "frac_x", "frac_y")


@query("j07_alleles_expression", """WITH a AS (SELECT "CHROM", CASE WHEN "POS" % 4 = 0 THEN NULL ELSE gene END AS gene, "POS", sum("DP") AS dp FROM alleles GROUP BY ALL), e AS (SELECT g."CHROM", c.gene, sum(cnt) AS y FROM counts c JOIN genes g USING (gene) GROUP BY ALL) SELECT coalesce(a."CHROM", e."CHROM") AS "CHROM", coalesce(a.gene, e.gene) AS gene, a."POS", dp::BIGINT AS dp, y::BIGINT AS y FROM a FULL JOIN e ON a."CHROM" = e."CHROM" AND a.gene = e.gene""")
def _(v):
    a = v.alleles().withColumn("gene", F.when(F.col("POS") % 4 != 0, F.col("gene"))).groupBy("CHROM", "gene", "POS").agg(F.sum("DP").alias("dp"))
    e = v.counts().join(v.genes().select("gene", "CHROM"), "gene").groupBy("CHROM", "gene").agg(F.sum("cnt").alias("y"))
    return a.join(e, ["CHROM", "gene"], "full_outer")


@query("j08_posteriors_full_outer", """WITH x AS (SELECT * FROM cell_alleles WHERE cell::INT % 3 <> 0), y AS (SELECT * FROM cell_alleles WHERE cell::INT % 4 <> 0) SELECT coalesce(x.cell, y.cell) AS cell, coalesce(x.seg, y.seg) AS seg, coalesce(x.major, 0) + coalesce(y.minor, 0) AS n FROM x FULL JOIN y ON x.cell = y.cell AND x.seg = y.seg AND x.cnv_state = y.cnv_state""")
def _(v):
    c = v.cell_alleles()
    x, y = c.where("cast(cell as int) % 3 <> 0").select("cell", "seg", "cnv_state", "major"), c.where("cast(cell as int) % 4 <> 0").select("cell", "seg", "cnv_state", "minor")
    return x.join(y, ["cell", "seg", "cnv_state"], "full_outer").select("cell", "seg", (F.coalesce("major", F.lit(0)) + F.coalesce("minor", F.lit(0))).alias("n"))


@query("j10_inner_joins", """SELECT m.sample, a."CHROM", count(*) AS n FROM alleles a JOIN membership m USING (cell) JOIN genes g ON g.gene = a.gene AND g."CHROM" = a."CHROM" GROUP BY ALL""")
def _(v):
    return v.alleles().join(v.membership(), "cell").join(v.genes().select("gene", "CHROM"), ["gene", "CHROM"]).groupBy("sample", "CHROM").agg(F.count(F.lit(1)).alias("n"))


@query("j11_left_joins", """SELECT g.gene, coalesce(y, 0)::BIGINT AS y FROM genes g LEFT JOIN (SELECT gene, sum(cnt) AS y FROM counts GROUP BY gene) c USING (gene)""")
def _(v):
    y = v.counts().groupBy("gene").agg(F.sum("cnt").alias("y"))
    return v.genes().select("gene").join(y, "gene", "left").fillna(0, ["y"])


CLONES = [(0, "", "normal"), (1, "11a", "tumor"), (2, "11a,12a", "tumor"), (3, "11a,13a", "tumor")]
CLONES_SQL = "clones AS (SELECT * FROM (VALUES (0, '', 'normal'), (1, '11a', 'tumor'), (2, '11a,12a', 'tumor'), (3, '11a,13a', 'tumor')) t(clone, gt, compartment))"


@query("j12_cross_segments_clones", f"""WITH {CLONES_SQL} SELECT seg, clone, list_contains(string_split(gt, ','), seg) AS carries FROM (SELECT DISTINCT seg FROM cell_alleles), clones""")
def _(v):
    c = v.spark.createDataFrame(CLONES, "clone int, gt string, compartment string")
    return v.cell_alleles().select("seg").distinct().crossJoin(F.broadcast(c)).select("seg", "clone", F.array_contains(F.split("gt", ","), F.col("seg")).alias("carries"))


@query("j13_pairs", """SELECT x.sample, x.seg AS i, y.seg AS j FROM segments x JOIN segments y ON x.sample = y.sample AND x.seg < y.seg WHERE x.cnv_state = 'neu' AND y.cnv_state = 'neu'""")
def _(v):
    return R.pair_up(v.segments().where("cnv_state = 'neu'"), "sample", "seg").select("sample", "i", "j")


@query("j14_semi", "SELECT cell, count(*) AS n FROM counts WHERE cell IN (SELECT cell FROM membership WHERE sample = '1') GROUP BY cell")
def _(v):
    return v.counts().join(v.membership().where("sample = '1'"), "cell", "left_semi").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query("j15_anti", "SELECT gene, gene_length FROM genes WHERE gene NOT IN (SELECT gene FROM counts WHERE cnt > 60)")
def _(v):
    return v.genes().join(v.counts().where("cnt > 60"), "gene", "left_anti").select("gene", "gene_length")


@query("j18_interpolate", """WITH m AS (SELECT DISTINCT "CHROM", gene_start AS "POS", gene_start::DOUBLE / 1e6 * ("CHROM"::INT % 3 + 1) AS c FROM genes), p AS (SELECT DISTINCT "CHROM", "POS" FROM alleles),
x AS (SELECT p."CHROM", p."POS", lo."POS" AS lp, lo.c AS lc FROM p ASOF LEFT JOIN m lo ON p."CHROM" = lo."CHROM" AND p."POS" >= lo."POS"),
y AS (SELECT x.*, hi."POS" AS hp, hi.c AS hc FROM x ASOF LEFT JOIN m hi ON x."CHROM" = hi."CHROM" AND x."POS" <= hi."POS")
SELECT "CHROM", "POS", round(CASE WHEN lp IS NULL THEN hc WHEN hp IS NULL OR lp = "POS" THEN lc ELSE lc + (hc - lc) * ("POS" - lp) / (hp - lp) END, 6) AS "cM" FROM y""")
def _(v):
    m = v.genes().select("CHROM", F.col("gene_start").alias("POS"), (F.col("gene_start") / 1e6 * (F.col("CHROM").cast("int") % 3 + 1)).alias("cM")).distinct()
    return rnd(I.interpolate(v.alleles().select("CHROM", "POS").distinct(), m), "cM")


# interval algebra

UNION = """u0 AS (SELECT *, CASE WHEN max({e}) OVER w IS NULL OR {s} > max({e}) OVER w + 1 THEN 1 ELSE 0 END AS new FROM {t} WINDOW w AS (PARTITION BY "CHROM" ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u1 AS (SELECT *, sum(new) OVER (PARTITION BY "CHROM" ORDER BY {s}, {e} ROWS UNBOUNDED PRECEDING) AS island FROM u0)"""


@query("i01_union", "WITH " + UNION.format(t="genes", s="gene_start", e="gene_end") + """ SELECT "CHROM", min(gene_start) AS seg_start, max(gene_end) AS seg_end, max(gene_end) - min(gene_start) + 1 AS seg_length FROM u1 GROUP BY "CHROM", island""")
def _(v):
    return I.union_ranges(v.genes().select("CHROM", F.col("gene_start").alias("seg_start"), F.col("gene_end").alias("seg_end")))


@query("i02_subtract", """WITH b AS (SELECT "CHROM", seg_start AS s, seg_end + 1 AS e FROM segments), g AS (SELECT "CHROM", gene_start AS s, gene_end + 1 AS e FROM genes),
c AS (SELECT "CHROM", s AS pt FROM b UNION SELECT "CHROM", e FROM b UNION SELECT "CHROM", s FROM g UNION SELECT "CHROM", e FROM g),
p AS (SELECT "CHROM", pt AS s, lead(pt) OVER (PARTITION BY "CHROM" ORDER BY pt) AS e FROM c),
k AS (SELECT * FROM p WHERE e IS NOT NULL AND EXISTS (SELECT 1 FROM g WHERE g."CHROM" = p."CHROM" AND g.s <= p.s AND g.e >= p.e) AND NOT EXISTS (SELECT 1 FROM b WHERE b."CHROM" = p."CHROM" AND b.s <= p.s AND b.e >= p.e)),
n AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY "CHROM" ORDER BY s) = s THEN 0 ELSE 1 END AS new FROM k),
i AS (SELECT *, sum(new) OVER (PARTITION BY "CHROM" ORDER BY s) AS island FROM n)
SELECT "CHROM", min(s) AS seg_start, max(e) - 1 AS seg_end FROM i GROUP BY "CHROM", island""")
def _(v):
    return I.subtract_ranges(v.genes().select("CHROM", F.col("gene_start").alias("seg_start"), F.col("gene_end").alias("seg_end")), v.segments())


def _bulk_like(v):
    s = v.segments()
    return s.select("sample", "CHROM", "seg", "cnv_state", "LLR", F.col("LLR").alias("LLR_x"), F.col("LLR").alias("LLR_y"), F.explode(F.array("seg_start", "seg_end")).alias("POS"))


@query("i03_neutral_ranges", """WITH n AS (SELECT "CHROM", seg_start, seg_end FROM segments WHERE cnv_state = 'neu'), """ + UNION.format(t="n", s="seg_start", e="seg_end") + """ SELECT "CHROM", min(seg_start) AS seg_start, max(seg_end) AS seg_end, max(seg_end) - min(seg_start) + 1 AS seg_length FROM u1 GROUP BY "CHROM", island""")
def _(v):
    return I.neutral_ranges(_bulk_like(v))


@query("i04_fill_neutral")
def _(v):
    c = I.consensus_segments(_bulk_like(v))
    return c.select("CHROM", "seg_cons", "cnv_state", "seg_start", "seg_end", "seg_length")


@query("i05_resolve_cnvs")
def _(v):
    s = v.segments().where("cnv_state <> 'neu'").withColumn("id", (F.col("seg_start") / 1000).cast("long")).withColumn("LLR_x", F.col("LLR")).withColumn("LLR_y", F.lit(1.0))
    return I.resolve_cnvs(s).select("id", "CHROM", "seg", "component")


@query("i06_consensus_segments")
def _(v):
    return I.consensus_segments(_bulk_like(v), retest=True).select("CHROM", "seg_cons", "cnv_state", "seg_start", "seg_end")


# aggregates


@query("a01_allele_totals", """SELECT snp_id, "CHROM", "POS", "GT", gene, sum("AD")::BIGINT AS "AD", sum("DP")::BIGINT AS "DP" FROM (SELECT * REPLACE (CASE WHEN "POS" % 4 = 0 THEN NULL ELSE gene END AS gene) FROM alleles) GROUP BY ALL""")
def _(v):
    return R.allele_totals(v.alleles().withColumn("gene", F.when(F.col("POS") % 4 != 0, F.col("gene"))), ("snp_id", "CHROM", "POS", "GT", "gene"))


@query("a02_gene_totals", """SELECT sample, gene, sum(cnt)::BIGINT AS "Y_obs", (sum(sum(cnt)) OVER (PARTITION BY sample))::BIGINT AS d_obs, round(sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY sample), 9) AS lambda_obs FROM counts JOIN membership USING (cell) GROUP BY sample, gene""")
def _(v):
    return rnd(R.gene_totals(v.counts().join(v.membership(), "cell"), ("sample", "gene")), "lambda_obs", digits=9)


@query("a03_a05_segment_summary", """SELECT "CHROM", state AS seg, count(DISTINCT gene) AS n_genes, count("pAD") AS n_snps, min("POS") AS seg_start, max("POS") AS seg_end FROM states GROUP BY ALL""")
def _(v):
    return R.segment_summary(v.states().withColumn("seg", F.col("state")), ("CHROM", "seg"))


@query("a04_balanced_counts", """WITH x AS (SELECT a."CHROM", a."CHROM" AS seg, m.sample, count(*) FILTER (a."DP" >= 5) AS n_snps, count(a.gene) AS n_genes FROM alleles a JOIN membership m USING (cell) GROUP BY ALL) SELECT *, bool_or(n_snps > 50 AND n_genes > 50) OVER (PARTITION BY "CHROM", seg) AS ok FROM x""")
def _(v):
    return R.balanced_counts(v.alleles().join(v.membership(), "cell").withColumn("seg", F.col("CHROM")))


@query("a06_allele_sums", """SELECT cell, seg, major, minor, total, round("MAF", 6) AS "MAF" FROM cell_alleles""")
def _(v):
    return rnd(v.cell_alleles().select("cell", "seg", "major", "minor", "total", "MAF"), "MAF")


@query("a07_j16_mean_by", """SELECT sample, cnv_state, round(avg("LLR"), 6) AS "LLR" FROM segments GROUP BY ALL""")
def _(v):
    return rnd(R.mean_by(v.segments(), ["sample", "cnv_state"], "LLR"), "LLR")


@query("a08_proportions", """WITH l AS (SELECT unnest(['neu','del','amp','loh','bamp','bdel']) AS cnv_state) SELECT cnv_state, round(coalesce(n, 0) / (SELECT count(*) FROM segments), 9) AS share FROM l LEFT JOIN (SELECT cnv_state, count(*) AS n FROM segments GROUP BY ALL) USING (cnv_state)""")
def _(v):
    levels = v.spark.createDataFrame([(s,) for s in ("neu", "del", "amp", "loh", "bamp", "bdel")], "cnv_state string")
    return rnd(R.proportions(v.segments(), "cnv_state", levels), "share", digits=9)


@query("a09_modes", """SELECT "CHROM", state, n FROM (SELECT *, rank() OVER (PARTITION BY "CHROM" ORDER BY n DESC) AS r FROM (SELECT "CHROM", state, count(*) AS n FROM states GROUP BY "CHROM", state)) WHERE r = 1""")
def _(v):
    return R.modes(v.states(), ["CHROM"], "state")


@query("a10_common_argmin", """SELECT cnv_state, count(*) AS n FROM (SELECT "CHROM", arg_min(cnv_state, ("LLR" , cnv_state)) AS cnv_state FROM (SELECT "CHROM", cnv_state, "LLR" FROM segments) GROUP BY "CHROM") GROUP BY cnv_state ORDER BY n DESC, cnv_state LIMIT 1""")
def _(v):
    return R.common_argmin(v.segments(), "CHROM", "cnv_state", "LLR")


@query("a11_argmax", """SELECT "CHROM", min(seg) AS seg, any_value("LLR") AS "LLR" FROM (SELECT *, rank() OVER (PARTITION BY "CHROM" ORDER BY "LLR" DESC) AS r FROM segments) WHERE r = 1 GROUP BY "CHROM" """)
def _(v):
    return R.argmax_by(v.segments(), ["CHROM"], "seg", "LLR")


@query("a12_a13_sorted_states", """SELECT "CHROM", string_agg(DISTINCT cnv_state, ',' ORDER BY cnv_state) AS cnv_states FROM segments GROUP BY ALL""")
def _(v):
    return R.sorted_list(v.segments(), ["CHROM"], "cnv_state", "cnv_states")


@query("a14_mean_entropy", """WITH h AS (SELECT cell, seg, "MAF" AS p, CASE WHEN "MAF" <= 0 OR "MAF" >= 1 THEN 0 ELSE -("MAF" * log2("MAF") + (1 - "MAF") * log2(1 - "MAF")) END AS h FROM cell_alleles WHERE "MAF" IS NOT NULL) SELECT DISTINCT seg, round(avg(h) OVER (PARTITION BY seg), 6) AS avg_entropy FROM h""")
def _(v):
    return rnd(R.mean_entropy(v.cell_alleles().where("MAF is not null"), "MAF").select("seg", "avg_entropy").distinct(), "avg_entropy")


@query("a15_log_sum_exp", """SELECT seg, round(max(z) + ln(sum(exp(z - m))), 6) AS lse FROM (SELECT seg, -major / 100.0 AS z, max(-major / 100.0) OVER (PARTITION BY seg) AS m FROM cell_alleles) GROUP BY seg, m""")
def _(v):
    return rnd(R.log_sum_exp_by(v.cell_alleles().withColumn("z", -F.col("major") / 100), ["seg"], "z", "lse"), "lse")


@query("a16_positive_median", """SELECT round(quantile_cont("LLR", 0.5), 6) AS median FROM segments WHERE "LLR" > 0""")
def _(v):
    return rnd(R.positive_median(v.segments(), "LLR"), "median")


@query("a17_best_reference", """WITH g AS (SELECT gene FROM refs GROUP BY gene HAVING max(lambda) > 2e-6), r AS (SELECT p.ref, g.gene, ln(1 + coalesce(f.lambda, 0) * 1e6) AS y FROM g CROSS JOIN (SELECT DISTINCT ref FROM refs) p LEFT JOIN refs f ON f.gene = g.gene AND f.ref = p.ref),
t AS (SELECT cell, sum(cnt) AS t FROM counts GROUP BY cell), x AS (SELECT t.cell, g.gene, ln(1 + coalesce(c.cnt, 0) / t.t * 1e6) AS x FROM t CROSS JOIN g LEFT JOIN counts c ON c.cell = t.cell AND c.gene = g.gene),
k AS (SELECT cell, ref, corr(x, y) AS r FROM x JOIN r USING (gene) GROUP BY ALL)
SELECT cell, arg_max(ref, r) AS ref, round(max(r), 6) AS r FROM k GROUP BY cell""")
def _(v):
    return rnd(R.best_reference(v.counts(), v.ref()), "r")


@query("a18_fit_reference")
def _(v):
    return rnd(K.fit_reference(R.gene_totals(v.counts().join(v.membership(), "cell"), ("sample", "gene")), v.ref()), "w", "mse", digits=4)


@query("a19_contamination", """SELECT round(avg(("AD" = 0 OR "AD" = "DP")::INT), 6) AS hom_rate FROM alleles WHERE "DP" >= 8""")
def _(v):
    return rnd(R.contamination(v.alleles().withColumn("AR", S.ratio("AD", "DP"))), "hom_rate")


@query("a19_noise_level", """SELECT DISTINCT sample, "LLR" AS mse, CASE WHEN "LLR" < 0.5 THEN 'low' WHEN "LLR" <= 1.5 THEN 'medium' ELSE 'high' END AS noise FROM segments""")
def _(v):
    return R.noise_level(v.segments().withColumn("mse", F.col("LLR")))


@query("a20_call_genotypes", """WITH s AS (SELECT snp_id, sum("AD")::BIGINT AS "AD", sum("DP")::BIGINT AS "DP" FROM alleles GROUP BY ALL) SELECT snp_id, "AD", "DP", CASE WHEN "AD" / "DP" BETWEEN 0.1 AND 0.9 THEN '0/1' ELSE '1/1' END AS "GT" FROM s WHERE "AD" / "DP" BETWEEN 0.1 AND 0.9 OR ("AD" = "DP" AND "DP" >= 10)""")
def _(v):
    p = v.alleles().select("snp_id", "CHROM", "POS", F.lit("A").alias("REF"), F.lit("C").alias("ALT"), "AD", "DP", F.lit(0).alias("OTH"))
    return R.call_genotypes(p).select("snp_id", "AD", "DP", "GT")


@query("a21_snps_per_gene", """SELECT "CHROM", gene, count(*) FILTER ("AD" IS NOT NULL AND "DP" > 20) AS n_snps FROM alleles GROUP BY ALL""")
def _(v):
    return R.snps_per_gene(v.alleles(), 20)


PAIRS = """t AS (SELECT x.seg AS i, y.seg AS j, x.sample, x."LLR" AS a, y."LLR" AS b, (x.seg_start // 1000 % 97 + 1) / 100.0 AS p FROM segments x JOIN segments y ON x."CHROM" = y."CHROM" AND x.seg < y.seg)"""


def _pairs(v):
    s = v.segments()
    x = s.select("CHROM", "sample", F.col("seg").alias("i"), F.col("LLR").alias("lnFC_i"), ((F.floor(F.col("seg_start") / 1000) % 97 + 1) / 100).alias("p"))
    return x.join(s.select("CHROM", F.col("seg").alias("j"), F.col("LLR").alias("lnFC_j")), "CHROM").where("i < j")


@query("a22_f14_pair_summary", f"""WITH {PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY p) AS k FROM t) SELECT i, j, max(a) AS "lnFC_max_i", max(b) AS "lnFC_max_j", abs(max(a) - max(b)) AS delta_max, round(count(*) * min(p / k), 6) AS p_simes FROM k GROUP BY i, j""")
def _(v):
    return rnd(R.pair_summary(_pairs(v)), "p_simes")


# windows


@query("w01_marker_index", """SELECT snp_id, row_number() OVER (PARTITION BY "CHROM" ORDER BY "POS") - 1 AS snp_index FROM (SELECT DISTINCT snp_id, "CHROM", "POS" FROM alleles)""")
def _(v):
    return W.marker_index(v.alleles().select("snp_id", "CHROM", "POS").distinct()).select("snp_id", F.col("snp_index").cast("long").alias("snp_index"))


@query("w02_global_index", """SELECT snp_id, row_number() OVER (ORDER BY "CHROM"::INT, "POS", snp_id) - 1 AS snp_index FROM (SELECT DISTINCT snp_id, "CHROM", "POS" FROM alleles)""")
def _(v):
    return W.global_index(v.alleles().select("snp_id", "CHROM", "POS").distinct()).select("snp_id", F.col("snp_index").cast("long").alias("snp_index"))


@query("w03_w04_f01_switch", """SELECT snp_id, round(d, 9) AS inter_snp_cm, round(CASE WHEN d IS NULL THEN 0 ELSE greatest(0.5 * (1 - exp(-2 * d)), 1e-10) END, 9) AS p_s FROM (SELECT snp_id, "cM" - lag("cM") OVER (PARTITION BY "CHROM" ORDER BY "POS") AS d FROM (SELECT DISTINCT snp_id, "CHROM", "POS", "cM" FROM alleles))""")
def _(v):
    x = v.alleles().select("snp_id", "CHROM", "POS", "cM").distinct().withColumn("inter_snp_cm", W.lag_distance("cM"))
    return rnd(x.select("snp_id", "inter_snp_cm", S.switch_prob("inter_snp_cm").alias("p_s")), "inter_snp_cm", "p_s", digits=9)


SEGS = """b AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN state = lag(state) OVER w THEN 0 ELSE 1 END AS boundary FROM states WINDOW w AS (PARTITION BY "CHROM" ORDER BY "POS")),
i AS (SELECT *, sum(boundary) OVER (PARTITION BY "CHROM" ORDER BY "POS") AS n FROM b),
s AS (SELECT *, "CHROM" || CASE WHEN n < 26 THEN chr((97 + n)::INT) WHEN n < 676 THEN chr((97 + n // 26)::INT) || chr((97 + n % 26)::INT) ELSE chr((97 + n // 676)::INT) || chr((97 + n // 26 % 26)::INT) || chr((97 + n % 26)::INT) END AS seg FROM i),
g AS (SELECT "CHROM", n, any_value(seg) AS seg, any_value(state) AS state, min("POS") AS seg_start, max("POS") AS seg_end, count(DISTINCT gene) AS n_genes, count("pAD") AS n_snps FROM s GROUP BY "CHROM", n)"""


@query("w05_f15_segments", f"WITH {SEGS} SELECT seg, state, seg_start, seg_end, n_genes, n_snps FROM g")
def _(v):
    return W.annotate_segments(v.states(), "state").select("seg", "state", "seg_start", "seg_end", F.col("n_genes").cast("long").alias("n_genes"), "n_snps").distinct()


@query("w06_smooth_segments", f"""WITH {SEGS}, m AS (SELECT s.*, CASE WHEN g.n_genes > 2 THEN s.state END AS t FROM s JOIN g ON s."CHROM" = g."CHROM" AND s.n = g.n),
f AS (SELECT "CHROM", "POS", coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY "CHROM" ORDER BY "POS"), first_value(t IGNORE NULLS) OVER (PARTITION BY "CHROM" ORDER BY "POS" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS state FROM m) SELECT * FROM f""")
def _(v):
    return W.smooth_segments(W.annotate_segments(v.states(), "state"), "state", 2).select("CHROM", "POS", "state")


@query("w07_forward_fill", """SELECT "CHROM", "POS", last_value("pAD" IGNORE NULLS) OVER (PARTITION BY "CHROM" ORDER BY "POS") AS filled FROM states""")
def _(v):
    return v.states().select("CHROM", "POS", W.forward_fill("pAD").alias("filled"))


@query("w08_rolling_theta", """WITH x AS (SELECT snp_id, "CHROM", "POS", sum("AD") AS a, sum("DP" - "AD") AS b FROM alleles GROUP BY ALL) SELECT snp_id, round(coalesce(sum(a) OVER w / nullif(sum(a) OVER w + sum(b) OVER w, 0) - 0.5, 0), 6) AS theta FROM x WINDOW w AS (PARTITION BY "CHROM" ORDER BY "POS" ROWS BETWEEN 101 PRECEDING AND 100 FOLLOWING)""")
def _(v):
    x = v.alleles().groupBy("snp_id", "CHROM", "POS").agg(F.sum("AD").alias("a"), F.sum(F.col("DP") - F.col("AD")).alias("b"))
    return rnd(x.select("snp_id", W.rolling_theta("a", "b").alias("theta")), "theta")


@query("w09_f12_rolling_phi", f"""WITH {EXPR}, y AS (SELECT e.*, c.y, d.d FROM e JOIN (SELECT gene, sum(cnt) AS y FROM counts GROUP BY gene) c USING (gene) CROSS JOIN (SELECT sum(cnt) AS d FROM counts) d) SELECT gene, round(exp(avg(CASE WHEN y > 0 AND lambda_ref > 0 THEN ln(y / d) - ln(lambda_ref) - 0.1 END) OVER (PARTITION BY "CHROM" ORDER BY gene_start ROWS BETWEEN 51 PRECEDING AND 50 FOLLOWING)), 6) AS phi FROM y""")
def _(v):
    return rnd(_expr(v).select("gene", W.rolling_phi("Y_obs", F.col("d_obs"), "lambda_ref", F.lit(0.1), 50, ("CHROM",), "gene_start").alias("phi")), "phi")


@query("w10_rolling_mean", """SELECT "CHROM", "POS", round(avg("pAD") OVER (PARTITION BY "CHROM" ORDER BY "POS" ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING), 4) AS m FROM states""")
def _(v):
    return rnd(v.states().select("CHROM", "POS", W.rolling_mean("pAD", ("CHROM",), "POS").alias("m")), "m", digits=4)


@query("w11_running_label", """SELECT seg_start, "CHROM" || '_' || row_number() OVER (PARTITION BY "CHROM" ORDER BY seg_start, seg_end) AS seg FROM segments""")
def _(v):
    return W.running_label(v.segments()).select("seg_start", "seg")


@query("w12_partitioned", """SELECT cell, "CHROM", "POS", count(*) OVER (PARTITION BY cell, "CHROM") AS n, max("DP") OVER (PARTITION BY cell, "CHROM") AS top FROM alleles""")
def _(v):
    w = Window.partitionBy("cell", "CHROM")
    return v.alleles().select("cell", "CHROM", "POS", F.count(F.lit(1)).over(w).alias("n"), F.max("DP").over(w).alias("top"))


@query("w13_softmax", """WITH z AS (SELECT cell, seg, major / 50.0 AS z FROM cell_alleles), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY cell)) AS e FROM z) SELECT cell, seg, round(e / sum(e) OVER (PARTITION BY cell), 6) AS p FROM e""")
def _(v):
    x = v.cell_alleles().withColumn("z", F.col("major") / 50)
    return rnd(W.with_softmax(x, "z", ["cell"], "p").select("cell", "seg", "p"), "p")


@query("w14_o02_keep_first", """SELECT "CHROM", "POS", snp_id FROM (SELECT *, row_number() OVER (PARTITION BY "CHROM", gene ORDER BY "POS", snp_id, cell) AS r FROM alleles) WHERE r = 1""")
def _(v):
    return W.keep_first(v.alleles(), ("CHROM", "gene"), "POS", "snp_id", "cell").select("CHROM", "POS", "snp_id")


@query("w15_benjamini_hochberg", """WITH p AS (SELECT sample, seg, (seg_start // 1000 % 97 + 1) / 1000.0 AS p FROM segments), k AS (SELECT *, p * count(*) OVER (PARTITION BY sample) / count(*) OVER (PARTITION BY sample ORDER BY p RANGE UNBOUNDED PRECEDING) AS q FROM p) SELECT sample, seg, round(least(1.0, min(q) OVER (PARTITION BY sample ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS q FROM k""")
def _(v):
    x = v.segments().withColumn("p", (F.floor(F.col("seg_start") / 1000) % 97 + 1) / 1000)
    return rnd(W.benjamini_hochberg(x, "p", ["sample"]).select("sample", "seg", "q"), "q")


@query("w16_smooth_expression", """WITH g AS (SELECT gene, row_number() OVER (ORDER BY "CHROM"::INT, gene_start, gene) - 1 AS gi FROM genes WHERE gene IN (SELECT gene FROM counts)), r AS (SELECT gene, avg(lambda) AS l FROM refs GROUP BY gene), t AS (SELECT cell, sum(cnt) AS t FROM counts GROUP BY cell),
x AS (SELECT t.cell, g.gene, g.gi, greatest(-3, least(3, log2(coalesce(c.cnt, 0) / t.t * 1e6 + 1) - log2(r.l * 1e6 + 1))) AS x FROM t CROSS JOIN g JOIN r USING (gene) LEFT JOIN counts c ON c.cell = t.cell AND c.gene = g.gene),
y AS (SELECT *, x - avg(x) OVER (PARTITION BY cell) AS z FROM x)
SELECT cell, gene, round(avg(z) OVER (PARTITION BY cell ORDER BY gi ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING), 5) AS x FROM y""")
def _(v):
    c = v.counts()
    g = R.gene_universe(v.genes(), c, v.ref())
    return rnd(W.smooth_expression(c, c, g, v.ref().groupBy("gene").agg(F.avg("lambda").alias("lambda"))).select("cell", "gene", "x"), "x", digits=5)


@query("w17_rank_sizes", """SELECT sample, row_number() OVER (ORDER BY n DESC, sample) AS label FROM (SELECT sample, count(*) AS n FROM segments GROUP BY ALL)""")
def _(v):
    n = v.segments().groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    return n.select("sample", F.row_number().over(Window.orderBy(F.desc("n"), "sample")).cast("long").alias("label"))


# sorting, sampling, reshaping


@query("o01_natural_sort", """SELECT "CHROM", row_number() OVER (ORDER BY "CHROM"::INT) AS place FROM (SELECT DISTINCT "CHROM" FROM genes)""")
def _(v):
    return v.genes().select("CHROM").distinct().select("CHROM", F.row_number().over(Window.orderBy(S.chrom_key("CHROM"), "CHROM")).cast("long").alias("place"))


@query("o04_top_two", """SELECT "CHROM", seg, rank FROM (SELECT "CHROM", seg, row_number() OVER (PARTITION BY "CHROM" ORDER BY "LLR" DESC, seg) AS rank FROM segments) WHERE rank <= 2""")
def _(v):
    return R.top_two(v.segments(), ["CHROM"], "LLR", "seg").select("CHROM", "seg", F.col("rank").cast("long").alias("rank"))


@query("o05_best_move", """SELECT seg, "LLR" FROM segments ORDER BY "LLR" DESC, seg LIMIT 1""")
def _(v):
    return v.segments().select("seg", "LLR").orderBy(F.desc("LLR"), "seg").limit(1)


@query("o06_sample")
def _(v):
    return R.sample_rows(v.counts().select("cell").distinct(), "cell", 20)


@query("u01_union_ragged", """SELECT "CHROM", seg, "LLR", NULL::BIGINT AS gene_length FROM segments UNION ALL SELECT "CHROM", gene, NULL, gene_length FROM genes""")
def _(v):
    return R.stack([v.segments().select("CHROM", "seg", "LLR"), v.genes().select("CHROM", F.col("gene").alias("seg"), "gene_length")])


@query("u02_distinct", """SELECT DISTINCT "CHROM", "GT" FROM alleles""")
def _(v):
    return v.alleles().select("CHROM", "GT").distinct()


@query("u03_intersect", "SELECT gene FROM genes INTERSECT SELECT gene FROM counts WHERE cnt > 50")
def _(v):
    return v.genes().select("gene").intersect(v.counts().where("cnt > 50").select("gene"))


@query("u04_except", "SELECT gene FROM genes EXCEPT SELECT gene FROM counts WHERE cnt > 50")
def _(v):
    return v.genes().select("gene").subtract(v.counts().where("cnt > 50").select("gene"))


@query("u05_posterior_matrix", """SELECT cell, """ + ", ".join(f"""greatest(1e-10, least(1 - 1e-10, coalesce(round(max(CASE WHEN seg = '{s}' THEN "MAF" END), 9), 0.5))) AS "{s}" """ for s in SEGMENT_NAMES) + " FROM cell_alleles GROUP BY cell")
def _(v):
    return R.posterior_matrix(v.cell_alleles().withColumn("p_cnv", F.round("MAF", 9)), SEGMENT_NAMES)


@query("u05_posterior_long", """SELECT cell, seg, round(greatest(1e-10, least(1 - 1e-10, coalesce(p, 0.5))), 6) AS p_cnv FROM (SELECT DISTINCT cell FROM cell_alleles) c CROSS JOIN (SELECT DISTINCT seg FROM cell_alleles) s LEFT JOIN (SELECT cell, seg, "MAF" AS p FROM cell_alleles) USING (cell, seg)""")
def _(v):
    return rnd(R.posterior_long(v.cell_alleles().withColumn("p_cnv", F.col("MAF"))), "p_cnv")


@query("u07_expand_states", """SELECT CASE WHEN k THEN seg || '_' || s ELSE seg END AS seg, CASE WHEN k THEN s ELSE cnv_state END AS cnv_state, CASE WHEN NOT k THEN 0.5 WHEN s = 'amp' THEN 0.3 ELSE 0.7 END AS p_cnv FROM (SELECT seg, cnv_state, "LLR" > 5 AS k, unnest(CASE WHEN "LLR" > 5 THEN ['amp', 'del'] ELSE ['x'] END) AS s FROM segments)""")
def _(v):
    s = v.segments().select("seg", "cnv_state", F.when(F.col("LLR") > 5, 2).otherwise(1).alias("n_states"), F.lit("amp,del").alias("cnv_states"), F.lit(0.3).alias("p_amp"), F.lit(0.7).alias("p_del"), F.lit(0.5).alias("p_cnv"))
    return R.expand_states(s, ("p",)).select("seg", "cnv_state", "p_cnv")


@query("u08_sparse_long", """SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 0""")
def _(v):
    return v.table("lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").cast("long").alias("v")).where("v > 0")


@query("u09_membership_union", "SELECT sample, cell FROM membership UNION ALL SELECT '0.' || sample, cell FROM membership WHERE sample <> '0'")
def _(v):
    m = v.membership()
    return R.stack([m, m.where("sample <> '0'").withColumn("sample", F.concat(F.lit("0."), "sample"))])


@query("u10_y11_same_rows", "SELECT true AS same, false AS other")
def _(v):
    s = v.segments()
    return v.spark.createDataFrame([(R.same_rows(s, s), R.same_rows(s, s.where("LLR > 1")))], "same boolean, other boolean")


# scalar functions


@query("f02_beta_binomial", """SELECT cell, seg, round(lgamma(total + 1) - lgamma(major + 1) - lgamma(total - major + 1) + lgamma(major + 12) + lgamma(total - major + 8) - lgamma(total + 20) - (lgamma(12) + lgamma(8) - lgamma(20)), 5) AS l FROM cell_alleles""")
def _(v):
    return rnd(v.cell_alleles().select("cell", "seg", S.beta_binom_logpmf("major", "total", 12.0, 8.0).alias("l")), "l", digits=5)


@query("f03_negative_binomial", """SELECT cell, gene, round(lgamma(cnt + 2) - lgamma(2) - lgamma(cnt + 1) + 2 * ln(2 / 32.0) + cnt * ln(30 / 32.0), 6) AS l FROM counts""")
def _(v):
    return rnd(v.counts().select("cell", "gene", S.nbinom_logpmf("cnt", 30.0, 2.0).alias("l")), "l")


@query("f04_poisson_lognormal", """WITH x AS (SELECT DISTINCT cnt FROM counts), g AS (SELECT cnt, -3 + i * 0.003 AS z, cnt * (-3 + i * 0.003) - exp(-3 + i * 0.003) - power(-3 + i * 0.003 - 3, 2) / (2 * 0.49) - lgamma(cnt + 1) - 0.5 * ln(2 * pi() * 0.49) AS l FROM x, range(0, 4001) r(i)),
m AS (SELECT cnt, max(l) AS m FROM g GROUP BY cnt) SELECT cnt, round(any_value(m.m) + ln(sum(exp(l - m.m)) * 0.003), 4) AS l FROM g JOIN m USING (cnt) GROUP BY cnt""")
def _(v):
    return rnd(v.counts().select("cnt").distinct().select("cnt", K.poilog_udf(F.col("cnt"), F.lit(3.0), F.lit(0.7)).alias("l")), "l", digits=4)


@query("f05_f06_fit_lnpois")
def _(v):
    x = _expr(v).withColumn("sample", F.lit("0"))
    return rnd(M.baseline(x), "mu", "sig", digits=3)


@query("f11_pnorm_range", """WITH s AS (SELECT seg, "LLR" / 20 AS m FROM segments WHERE "LLR" > 0), g AS (SELECT seg, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(i * 4e-5 - m, 2) / (2 * 0.0025)) AS y FROM s, range(0, 2001) r(i))
SELECT seg, round(ln(sum(y) * 4e-5 / 3 / sqrt(2 * pi() * 0.0025)), 5) AS l FROM g GROUP BY seg""")
def _(v):
    s = v.segments().where("LLR > 0")
    return rnd(s.select("seg", K.pnorm_range_udf(F.lit(0.0), F.lit(0.08), F.col("LLR") / 20, F.lit(0.05)).alias("l")), "l", digits=5)


@query("f13_welch", """WITH s AS (SELECT "CHROM", sample, count(*) AS n, avg("LLR") AS m, coalesce(var_samp("LLR"), 0) AS v FROM segments GROUP BY ALL), j AS (SELECT a."CHROM", a.n AS n0, b.n AS n1, a.m AS m0, b.m AS m1, a.v / a.n AS s0, b.v / b.n AS s1 FROM s a JOIN s b ON a."CHROM" = b."CHROM" AND a.sample = '0' AND b.sample = '1'),
t AS (SELECT *, abs(m0 - m1) / sqrt(s0 + s1) AS t, power(s0 + s1, 2) / (s0 * s0 / (n0 - 1) + s1 * s1 / (n1 - 1)) AS df FROM j WHERE n0 > 1 AND n1 > 1 AND s0 + s1 > 0),
g AS (SELECT "CHROM", sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(1 + power(t * i / 2000.0, 2) / df, -(df + 1) / 2)) * any_value(t / 6000 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())) AS half FROM t, range(0, 2001) r(i) GROUP BY "CHROM")
SELECT "CHROM", round(CASE WHEN n0 <= 1 OR n1 <= 1 THEN 1 WHEN s0 + s1 = 0 THEN (m0 = m1)::INT ELSE 1 - 2 * half END, 5) AS p FROM j LEFT JOIN g USING ("CHROM")""")
def _(v):
    s = v.segments().groupBy("CHROM", "sample").agg(F.count(F.lit(1)).alias("n"), F.avg("LLR").alias("m"), F.var_samp("LLR").alias("v"))
    a, b = (s.where(f"sample = '{k}'").select("CHROM", *[F.col(c).alias(c + k) for c in "nmv"]) for k in "01")
    return rnd(a.join(b, "CHROM").select("CHROM", K.welch_udf("n0", "m0", "v0", "n1", "m1", "v1").alias("p")), "p", digits=5)


@query("f15_base26", """SELECT n, CASE WHEN n < 26 THEN chr((97 + n)::INT) WHEN n < 676 THEN chr((97 + n // 26)::INT) || chr((97 + n % 26)::INT) ELSE chr((97 + n // 676)::INT) || chr((97 + n // 26 % 26)::INT) || chr((97 + n % 26)::INT) END AS label FROM (SELECT p_partkey AS n FROM part WHERE p_partkey < 17576)""")
def _(v):
    return v.table("part").where("p_partkey < 17576").select(F.col("p_partkey").alias("n"), S.base26("p_partkey").alias("label"))


@query("f16_f17_phase", """SELECT seg, regexp_replace(s, '_up|_down', '') AS level, nullif(regexp_extract(s, '(up|down)', 1), '') AS phase, concat_ws('_', 'del', nullif(regexp_extract(s, '(up_1|down_1|up_2|down_2|1_up|1_down|2_up|2_down|up|down)', 1), '')) AS post FROM (SELECT seg, cnv_state || CASE WHEN "LLR" < 4 THEN '_1_up' WHEN "LLR" < 8 THEN '_2_down' ELSE '' END AS s FROM segments)""")
def _(v):
    s = v.segments().select("seg", F.concat("cnv_state", F.when(F.col("LLR") < 4, F.lit("_1_up")).when(F.col("LLR") < 8, F.lit("_2_down")).otherwise(F.lit(""))).alias("s"))
    return s.select("seg", S.strip_phase("s").alias("level"), S.phase("s").alias("phase"), S.phase_suffix("s", F.lit("del")).alias("post"))


@query("f18_normalize_chrom", """SELECT DISTINCT c, CASE WHEN lower(regexp_replace(c, '^chr', '')) IN ('m', 'mt') THEN 'MT' ELSE regexp_replace(c, '^chr', '') END AS chrom FROM (SELECT 'chr' || "CHROM" AS c FROM genes UNION ALL SELECT unnest(['chrM', 'Mt', 'X']))""")
def _(v):
    c = v.genes().select(F.concat(F.lit("chr"), "CHROM").alias("c")).distinct().union(v.spark.createDataFrame([("chrM",), ("Mt",), ("X",)], "c string"))
    return c.select("c", S.normalize_chrom("c").alias("chrom"))


@query("f19_mutation_lists", """SELECT sample, string_agg(DISTINCT seg, ',' ORDER BY seg) AS muts, count(DISTINCT seg) AS n FROM segments GROUP BY ALL""")
def _(v):
    x = v.segments().groupBy("sample").agg(S.join_muts(F.collect_set("seg")).alias("muts"))
    return x.select("sample", S.normalize_gt("muts").alias("muts"), F.size(S.split_muts("muts")).cast("long").alias("n"))


@query("f20_phased_ratios", """SELECT snp_id, cell, CASE WHEN "GT" = '1|0' THEN "AD" ELSE "DP" - "AD" END AS "pAD", round(CASE WHEN "GT" = '1|0' THEN "AD" ELSE "DP" - "AD" END / "DP", 6) AS "pBAF" FROM alleles""")
def _(v):
    x = v.alleles().withColumn("pAD", S.phased_depth("GT", "AD", "DP"))
    return rnd(x.select("snp_id", "cell", "pAD", S.ratio("pAD", "DP").alias("pBAF")), "pBAF")


@query("f21_fold_changes", f"""WITH {EXPR} SELECT gene, round(log2(lambda_obs / lambda_ref), 6) AS "logFC", round(ln(lambda_obs / lambda_ref), 6) AS "lnFC" FROM e""")
def _(v):
    return rnd(B.fold_changes(_expr(v)).select("gene", "logFC", "lnFC"), "logFC", "lnFC")


@query("f22_logistic", """SELECT seg, round(1 / (1 + exp(-"LLR")), 6) AS p FROM segments""")
def _(v):
    return rnd(v.segments().select("seg", S.logistic("LLR").alias("p")), "p")


@query("f23_decay_weights", """SELECT seg, round(exp(-("LLR" * "LLR") / (4 + 1e-12)), 6) AS gaussian, round(exp(-"LLR" / (2 + 1e-12)), 6) AS exp, round(1 / (1 + "LLR" * "LLR" / (4 + 1e-12)), 6) AS cauchy, round(1 / ("LLR" + 1 + 1e-12), 6) AS invdist FROM segments""")
def _(v):
    s = v.segments()
    x = s.select("seg", *[S.decay_weight(k, "LLR", 2.0).alias(k) for k in ("gaussian", "exp", "cauchy")], S.decay_weight("invdist", F.col("LLR") + 1, 2.0).alias("invdist"))
    return rnd(x, "gaussian", "exp", "cauchy", "invdist")


BINOM = ", ".join(f"lgamma(total + 1) - lgamma(major + 1) - lgamma(total - major + 1) + major * ln({p}) + (total - major) * ln({1 - p}) AS {n}" for n, p in P.ALLELE_P.items())


@query("f24_binomial", f"SELECT cell, seg, {', '.join(f'round({n}, 5) AS {n}' for n in P.ALLELE_P)} FROM (SELECT cell, seg, {BINOM} FROM cell_alleles)")
def _(v):
    return rnd(v.likelihoods().select("cell", "seg", *P.ALLELE_P), *P.ALLELE_P, digits=5)


@query("f25_reference_mixture", """SELECT gene, round(sum(lambda * CASE ref WHEN 'A' THEN 0.2 WHEN 'N' THEN 0.5 ELSE 0.3 END), 9) AS lambda_bar FROM refs GROUP BY gene""")
def _(v):
    w = v.spark.createDataFrame([("A", 0.2), ("N", 0.5), ("R", 0.3)], "ref string, w double")
    return rnd(v.ref().join(w, "ref").groupBy("gene").agg(F.sum(F.col("lambda") * F.col("w")).alias("lambda_bar")), "lambda_bar", digits=9)


@query("s04_f26_parse_info", """SELECT DISTINCT snp_id, "POS" AS ad, "POS" % 7 AS oth FROM alleles""")
def _(v):
    from ploidyne.sources.io import parse_info

    x = v.alleles().select("snp_id", F.format_string("AD=%d;DP=1;OTH=%d", F.col("POS"), F.col("POS") % 7).alias("i")).distinct().withColumn("m", parse_info(F.col("i")))
    return x.select("snp_id", F.element_at("m", F.lit("AD")).cast("long").alias("ad"), F.element_at("m", F.lit("OTH")).cast("long").alias("oth"))


@query("s05_s12_vcf_round_trip", """SELECT "CHROM" || '_' || "POS" || '_A_C' AS snp_id, "POS", sum("AD")::INT AS "AD", sum("DP")::INT AS "DP", round(sum("AD") / sum("DP"), 9) AS "AR" FROM alleles GROUP BY "CHROM", "POS" """)
def _(v):
    from ploidyne.sources import io

    p = v.alleles().groupBy("CHROM", "POS").agg(F.sum("AD").alias("AD"), F.sum("DP").alias("DP")).withColumns({"REF": F.lit("A"), "ALT": F.lit("C"), "OTH": F.lit(0), "GT": F.lit("0/1")}).cache()
    path = _path(v.spark, "vcf")
    for c in sorted(r.CHROM for r in v.genes().select("CHROM").distinct().collect()):
        io.write_vcf(p, f"{path}/{c}", "sample", c, "chr")
    return rnd(io.read_pileup(v.spark, f"{path}/*").select("snp_id", "POS", "AD", "DP", "AR"), "AR", digits=9)


def _lines(v, df, name, compression="none"):
    path = f"{_path(v.spark, 'lines')}/{name}"
    df.write.option("compression", compression).text(path)
    return path


def _tsv(v, df):
    path = _path(v.spark, "table")
    df.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return path


@query("s01_s02_annotation", """SELECT gene, gene_start, gene_end, "CHROM", gene_length FROM genes""")
def _(v):
    from ploidyne.sources import io

    path = _tsv(v, v.genes().select("CHROM", "gene", "gene_end", "gene_start"))
    return io.Catalog(v.spark, {"hg38": path}).hg38


@query("s03_filter_segments", """SELECT "CHROM", seg_start, seg_end FROM segments""")
def _(v):
    from ploidyne.sources import io

    return io.read_filter_segments(v.spark, _tsv(v, v.segments().select("seg", "CHROM", "seg_end", "seg_start")))


PHASED = """p AS (SELECT DISTINCT "CHROM", "POS", CASE WHEN "POS" % 7 = 0 THEN '1|1' ELSE "GT" END AS gt FROM alleles)"""


@query("s06_s07_phased_vcf", f"""WITH {PHASED} SELECT "CHROM" || '_' || "POS" || '_A_C' AS snp_id, "CHROM", "POS", gt AS "GT", 'PASS' AS "FILTER" FROM p WHERE gt <> '1|1'""")
def _(v):
    from ploidyne.sources import io

    folder, x = _path(v.spark, "phased"), v.alleles().select("CHROM", "POS", F.when(F.col("POS") % 7 == 0, F.lit("1|1")).otherwise(F.col("GT")).alias("GT")).distinct().cache()
    chroms = sorted(r.CHROM for r in x.select("CHROM").distinct().collect())
    for c in chroms:
        line = F.concat_ws("\t", F.concat(F.lit("chr"), "CHROM"), F.col("POS").cast("string"), F.lit("."), F.lit("A"), F.lit("C"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:PS"), F.concat("GT", F.lit(":1")))
        head = v.spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts",)], "value string")
        head.union(x.where(F.col("CHROM") == c).select(line)).write.option("compression", "gzip").text(f"{folder}/s_chr{c}.phased.vcf.gz")
    return io.read_phased(v.spark, folder, "s", chroms).select("snp_id", "CHROM", "POS", "GT", "FILTER")


@query("s08_matrix_market", """SELECT l_partkey::INT AS i, l_suppkey::INT AS j, sum(l_quantity)::INT AS v FROM lineitem GROUP BY ALL""")
def _(v):
    from ploidyne.sources import io

    x = v.table("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("int").alias("q"))
    head = v.spark.createDataFrame([("%%MatrixMarket matrix coordinate integer general", 0), ("% made for a test", 1), ("20000 1000 99", 2)], "value string, k int")
    rows = head.union(x.select(F.concat_ws(" ", "l_partkey", "l_suppkey", "q"), F.lit(3)))
    return io.read_matrix(v.spark, _lines(v, rows.repartition(1).sortWithinPartitions("k").select("value"), "cellSNP.tag.DP.mtx"))


@query("s08_lines", """SELECT row_number() OVER (ORDER BY s_suppkey)::INT AS j, s_name AS barcode FROM supplier""")
def _(v):
    from ploidyne.sources import io

    return io.read_lines(v.spark, _lines(v, v.table("supplier").repartition(1).sortWithinPartitions("s_suppkey").select("s_name"), "cellSNP.samples.tsv"), "barcode")


@query("s09_genetic_map", """SELECT "CHROM", gene_start AS "POS", round(gene_length / 7, 6) AS rate, round(gene_start / 1e6, 6) AS "cM" FROM genes""")
def _(v):
    from ploidyne.sources import io

    rows = v.genes().select(F.concat_ws("  ", F.concat(F.lit("chr"), "CHROM"), F.col("gene_start").cast("string"), F.round(F.col("gene_length") / 7, 6).cast("string"), F.round(F.col("gene_start") / 1e6, 6).cast("string")).alias("value"))
    head = v.spark.createDataFrame([("chr position COMBINED_rate(cM/Mb) Genetic_Map(cM)",)], "value string")
    return rnd(io.read_genetic_map(v.spark, _lines(v, head.union(rows), "map.txt", "gzip")), "rate", "cM")


@query("s10_allele_table", """SELECT cell, snp_id, "CHROM", "POS", round("cM", 6) AS "cM", 'A' AS "REF", 'C' AS "ALT", "AD"::INT AS "AD", "DP"::INT AS "DP", "GT", CASE WHEN "POS" % 4 <> 0 THEN gene END AS gene FROM alleles""")
def _(v):
    from ploidyne.sources import io

    x = v.alleles().withColumns({"REF": F.lit("A"), "ALT": F.lit("C"), "gene": F.when(F.col("POS") % 4 != 0, F.col("gene"))})
    path = _path(v.spark, "alleles")
    io.write_tsv(x.select(*reversed(x.columns)), path, compressed=True)
    return rnd(io.read_tsv(v.spark, path, io.ALLELES), "cM")


@query("s11_counts_round_trip", """SELECT cell, gene, cnt FROM counts""")
def _(v):
    from ploidyne.sources import io

    path = _path(v.spark, "counts")
    v.counts().withColumn("batch", F.lit(1)).write.parquet(path)
    return io.read_counts(v.spark, path)


@query("s14_table_round_trip", """SELECT "CHROM", seg, "LLR" FROM segments""")
def _(v):
    from ploidyne.sources import io

    path = _path(v.spark, "segments")
    io.write_table(v.segments().select("CHROM", "seg", "LLR"), path, ("CHROM",))
    return v.spark.read.schema("seg string, LLR double, CHROM string").parquet(path).select("CHROM", "seg", "LLR")


@query("s13_s15_tsv_round_trip", """SELECT "CHROM", seg, "LLR" FROM segments""")
def _(v):
    from ploidyne.sources import io

    path = _path(v.spark, "tsv")
    io.write_tsv(v.segments().select("CHROM", "seg", "LLR"), path, compressed=True)
    return io.read_tsv(v.spark, path, "CHROM string, seg string, LLR double")


def _path(spark, name: str) -> str:
    return new_path(spark, name)


# sequence models


def _bulk(v) -> DataFrame:
    return B.allele_bulk(v.alleles(), v.membership())


@query("b02_allele_bulk", """WITH x AS (SELECT sample, snp_id, "CHROM", "POS", "cM", "GT", sum("AD")::BIGINT AS "AD", sum("DP")::BIGINT AS "DP" FROM alleles JOIN membership USING (cell) WHERE "GT" IN ('1|0','0|1') GROUP BY ALL)
SELECT sample, snp_id, "AD", "DP", row_number() OVER w - 1 AS snp_index, CASE WHEN "GT" = '1|0' THEN "AD" ELSE "DP" - "AD" END AS "pAD", round("cM" - lag("cM") OVER w, 9) AS inter_snp_cm FROM x WINDOW w AS (PARTITION BY sample, "CHROM" ORDER BY "POS", snp_id)""")
def _(v):
    x = _bulk(v).select("sample", "snp_id", "AD", "DP", F.col("snp_index").cast("long").alias("snp_index"), "pAD", "inter_snp_cm")
    return rnd(x, "inter_snp_cm", digits=9)


def _viterbi5(t: float = 1e-5, gamma: float = 20.0) -> str:
    """Viterbi of the five-state model as recursive SQL: scores and back pointers forward, then the path backward."""
    shapes = [gamma * x for x in (0.5, 0.58, 0.42, 0.9, 0.1)]
    emit = ", ".join(f"lgamma(n + 1) - lgamma(a + 1) - lgamma(n - a + 1) + lgamma(a + {x!r}) + lgamma(n - a + {gamma - x!r}) - lgamma(n + {gamma!r}) - (lgamma({x!r}) + lgamma({gamma - x!r}) - lgamma({gamma!r})) AS e{i}" for i, x in enumerate(shapes))

    def into(i, j):
        if not j:
            return f"r.s{i} + ({math.log(1 - t if not i else t / 2)!r})"
        if i and (i - 1) // 2 == (j - 1) // 2:
            return f"r.s{i} + ln({1 - t!r} * {'(1 - s)' if i == j else 's'})"
        return f"r.s{i} + ({math.log(t / 4)!r})"

    from_ = ["[" + ", ".join(into(i, j) for i in range(5)) + "]" for j in range(5)]
    return f"""x AS (SELECT sample, "CHROM", snp_id, row_number() OVER w AS k, CASE WHEN "GT" = '1|0' THEN "AD" ELSE "DP" - "AD" END AS a, "DP" AS n, CASE WHEN row_number() OVER w = 1 THEN 0.0 ELSE greatest(0.5 * (1 - exp(-2 * ("cM" - lag("cM") OVER w))), 1e-10) END AS s
  FROM (SELECT sample, snp_id, "CHROM", "POS", "cM", "GT", sum("AD") AS "AD", sum("DP") AS "DP" FROM alleles JOIN membership USING (cell) GROUP BY ALL) WINDOW w AS (PARTITION BY sample, "CHROM" ORDER BY "POS", snp_id)),
e AS MATERIALIZED (SELECT sample, "CHROM", snp_id, k::BIGINT AS k, s, {emit} FROM x),
r AS (SELECT sample, "CHROM", k, {", ".join(f"(e{i} + {math.log(0.2)!r})::DOUBLE AS s{i}" for i in range(5))}, {", ".join(f"0::BIGINT AS b{i}" for i in range(5))} FROM e WHERE k = 1
  UNION ALL SELECT sample, "CHROM", k, {", ".join(f"list_max(l{j}) + e{j}" for j in range(5))}, {", ".join(f"list_position(l{j}, list_max(l{j}))::BIGINT - 1" for j in range(5))}
  FROM (SELECT e.*, {", ".join(f"{f} AS l{j}" for j, f in enumerate(from_))} FROM r JOIN e ON e.sample = r.sample AND e."CHROM" = r."CHROM" AND e.k = r.k + 1)),
rm AS MATERIALIZED (SELECT * FROM r),
bt AS (SELECT sample, "CHROM", k, list_position([s0, s1, s2, s3, s4], greatest(s0, s1, s2, s3, s4))::BIGINT - 1 AS st FROM (SELECT *, max(k) OVER (PARTITION BY sample, "CHROM") AS m FROM rm) WHERE k = m
  UNION ALL SELECT rm.sample, rm."CHROM", rm.k - 1, [rm.b0, rm.b1, rm.b2, rm.b3, rm.b4][bt.st + 1] FROM bt JOIN rm ON rm.sample = bt.sample AND rm."CHROM" = bt."CHROM" AND rm.k = bt.k WHERE bt.k > 1)"""


VITERBI = _viterbi5()


@query("m02_allele_hmm", f"""WITH {VITERBI} SELECT sample, e.snp_id, {list(K.FIVE)!r}[st + 1] AS state FROM bt JOIN e USING (sample, "CHROM", k)""")
def _(v):
    return M.allele_hmm(_bulk(v), nu=1.0).select("sample", "snp_id", "state")


def flagship(v) -> DataFrame:
    """Pseudobulk, allele HMM, segments, summary."""
    x = M.allele_hmm(_bulk(v))
    x = W.annotate_segments(x, "state", M.KEYS, *M.ORDER)
    return R.segment_summary(x.withColumn("seg", F.concat_ws(":", "seg", "state")))


@query("flagship_allele_segments")
def _(v):
    return flagship(v)


FORWARD = """x AS (SELECT sample, "CHROM", row_number() OVER w AS k, CASE WHEN "GT" = '1|0' THEN "AD" ELSE "DP" - "AD" END AS a, "DP" AS n, CASE WHEN row_number() OVER w = 1 THEN 0.0 ELSE greatest(0.5 * (1 - exp(-2 * ("cM" - lag("cM") OVER w))), 1e-10) END AS s
  FROM (SELECT sample, snp_id, "CHROM", "POS", "cM", "GT", sum("AD") AS "AD", sum("DP") AS "DP" FROM alleles JOIN membership USING (cell) GROUP BY ALL) WINDOW w AS (PARTITION BY sample, "CHROM" ORDER BY "POS", snp_id)),
e AS (SELECT *, lgamma(n + 1) - lgamma(a + 1) - lgamma(n - a + 1) - lgamma(n + 20) - (lgamma(14) + lgamma(6) - lgamma(20)) + lgamma(a + 14) + lgamma(n - a + 6) AS u, lgamma(n + 1) - lgamma(a + 1) - lgamma(n - a + 1) - lgamma(n + 20) - (lgamma(14) + lgamma(6) - lgamma(20)) + lgamma(a + 6) + lgamma(n - a + 14) AS d FROM x),
r AS (SELECT sample, "CHROM", k::BIGINT AS k, (u + ln(0.5))::DOUBLE AS u, (d + ln(0.5))::DOUBLE AS d FROM e WHERE k = 1
  UNION ALL SELECT e.sample, e."CHROM", e.k, greatest(r.u, r.d) + ln(exp(r.u - greatest(r.u, r.d)) * (1 - s) + exp(r.d - greatest(r.u, r.d)) * s) + e.u, greatest(r.u, r.d) + ln(exp(r.d - greatest(r.u, r.d)) * (1 - s) + exp(r.u - greatest(r.u, r.d)) * s) + e.d FROM r JOIN e ON e.sample = r.sample AND e."CHROM" = r."CHROM" AND e.k = r.k + 1)"""


@query("m04_f10_allele_scores", f"""WITH {FORWARD}, f AS (SELECT sample, "CHROM", max(greatest(u, d) + ln(exp(u - greatest(u, d)) + exp(d - greatest(u, d)))) FILTER (k = m) AS l, max(m) AS m FROM (SELECT *, max(k) OVER (PARTITION BY sample, "CHROM") AS m FROM r) GROUP BY ALL),
b AS (SELECT sample, "CHROM", sum(lgamma(n + 1) - lgamma(a + 1) - lgamma(n - a + 1) - lgamma(n + 20) - (2 * lgamma(10) - lgamma(20)) + lgamma(a + 10) + lgamma(n - a + 10)) AS l0 FROM x GROUP BY ALL)
SELECT sample, "CHROM", "CHROM" AS seg, round(l, 3) AS l_allele, round(CASE WHEN m > 1 THEN l - l0 ELSE 0 END, 3) AS "LLR_y" FROM f JOIN b USING (sample, "CHROM")""")
def _(v):
    x = _bulk(v).withColumn("seg", F.col("CHROM"))
    return rnd(M.allele_scores(x), "l_allele", "LLR_y", digits=3)


@query("m04_forward", f"""WITH {FORWARD} SELECT sample, "CHROM", round(max(greatest(u, d) + ln(exp(u - greatest(u, d)) + exp(d - greatest(u, d)))) FILTER (k = m), 4) AS l_allele FROM (SELECT *, max(k) OVER (PARTITION BY sample, "CHROM") AS m FROM r) GROUP BY ALL""")
def _(v):
    x = _bulk(v).withColumn("seg", F.col("CHROM"))
    return rnd(M.allele_scores(x).select("sample", "CHROM", "l_allele"), "l_allele", digits=4)


@query("m05_m10_classify_alleles")
def _(v):
    x = _bulk(v).withColumns({"seg": F.col("CHROM"), "cnv_state_post": F.lit("del"), "theta_mle": F.lit(0.2)})
    return rnd(M.classify_alleles(x).select("sample", "snp_id", "p_up", "haplo_post", "haplo_naive"), "p_up", digits=4)


def _full_bulk(v, loh=None, membership=None):
    g = v.genes()
    return B.get_bulk(v.counts(), R.check_alleles(v.alleles(), False), membership or v.membership(), v.ref(), g, loh=loh)


@query("b01_expression_bulk", """WITH y AS (SELECT sample, gene, sum(cnt) AS y FROM counts JOIN membership USING (cell) GROUP BY ALL), x AS (SELECT y.sample, g.*, y.y, y.y / sum(y.y) OVER (PARTITION BY sample) AS lo, r.lambda AS lr FROM y JOIN genes g USING (gene) JOIN refs r ON r.gene = y.gene AND r.ref = 'R'),
m AS (SELECT sample, avg(lr) FILTER (lr > 0) AS mr, avg(lo) FILTER (lo > 0) AS mo FROM x WHERE NOT ("CHROM" = '6' AND gene_start < 33480577 AND gene_end > 28510120) GROUP BY sample)
SELECT sample, gene, y::BIGINT AS "Y_obs", round(log2(lo / lr), 6) AS "logFC" FROM x JOIN m USING (sample) WHERE NOT ("CHROM" = '6' AND gene_start < 33480577 AND gene_end > 28510120) AND lr > 0 AND lo > 0 AND ((lr * 1e6 > 2 AND lo * 1e6 > 2) OR lr > mr OR lo > mo)""")
def _(v):
    r = v.ref().where("ref = 'R'").select("gene", F.col("lambda").alias("lambda_ref"))
    return rnd(B.expression_bulk(v.counts(), v.membership(), r, v.genes()).select("sample", "gene", "Y_obs", "logFC"), "logFC")


@query("b03_b04_b05_group_bulks")
def _(v):
    return _full_bulk(v).groupBy("sample", "CHROM").agg(F.count(F.lit(1)).alias("n"), F.count("Y_obs").alias("genes"), F.sum("DP").alias("dp"), F.sum("Y_obs").alias("y"))


@query("b06_preprocess", """WITH d AS (SELECT l_suppkey AS j, l_partkey * 10 + l_linenumber AS i, sum(trunc(l_quantity)::BIGINT)::BIGINT AS dp FROM lineitem GROUP BY ALL), k AS (SELECT i FROM d GROUP BY i HAVING sum(dp) > 1)
SELECT cell, "POS", "DP", "AD", gene FROM (SELECT d.j::VARCHAR AS cell, (i // 10) * 1000 + (i % 10) * 137 AS "POS", dp AS "DP", CASE WHEN dp > 20 THEN dp // 2 ELSE 0 END AS "AD", (SELECT min(g.gene) FROM genes g WHERE g."CHROM" = p."CHROM" AND (i // 10) * 1000 + (i % 10) * 137 > g.gene_start AND (i // 10) * 1000 + (i % 10) * 137 < g.gene_end) AS gene FROM d JOIN genes p ON p.gene = (i // 10)::VARCHAR WHERE i IN (SELECT i FROM k) AND i % 2 = 0)""")
def _(v):
    li = v.table("lineitem")
    i = (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("i")
    dp = li.groupBy(i, F.col("l_suppkey").alias("j")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    ad = dp.where("v > 20").withColumn("v", F.floor(F.col("v") / 2))
    pos = F.floor(F.col("i") / 10) * 1000 + F.col("i") % 10 * 137
    g = v.genes().select(F.col("gene").cast("long").alias("k"), "CHROM")
    snps = dp.select("i").distinct().withColumn("k", F.floor(F.col("i") / 10)).join(g, "k").select("i", "CHROM", pos.alias("POS"), F.lit("A").alias("REF"), F.lit("C").alias("ALT"), F.lit(0).alias("OTH"), F.concat_ws("_", "CHROM", pos.cast("string")).alias("snp_id"))
    phased = snps.select("snp_id", F.when(F.col("i") % 2 == 0, F.lit("1|0")).otherwise(F.lit("1|1")).alias("GT"))
    marks = v.genes().select("CHROM", F.col("gene_start").alias("POS"), (F.col("gene_start") / 1e6).alias("cM"))
    return B.preprocess_alleles(ad, dp, snps, phased, v.genes(), marks).select("cell", "POS", "DP", "AD", "gene")


@query("m03_joint_hmm")
def _(v):
    x = _full_bulk(v)
    x = x.join(M.baseline(x), "sample")
    return M.joint_hmm(x).groupBy("sample", "CHROM", "state").agg(F.count(F.lit(1)).alias("n"))


@query("m06_m07_f07_clonal_loh")
def _(v):
    return rnd(M.clonal_loh(_full_bulk(v, membership=v.membership().withColumn("sample", F.lit("0")))), "snp_rate", digits=3)


@query("m08_g02_common_diploid")
def _(v):
    ranges, names = M.common_diploid(_full_bulk(v))
    return ranges.withColumn("diploid", F.col("seg").isin(names)).select("CHROM", "seg", "seg_start", "seg_end", "diploid")


@query("m09_r01_f08_f09_analyze_bulk")
def _(v):
    x = M.analyze_bulk(_full_bulk(v), min_genes=2)
    return x.groupBy("sample", "CHROM", "seg", "cnv_state", "cnv_state_post").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("theta_mle"), 3).alias("theta_mle"), F.round(F.max("phi_mle"), 3).alias("phi_mle"))


@query("m11_theta_roll", """WITH x AS (SELECT sample, snp_id, "CHROM", "POS", "GT", sum("AD") AS ad, sum("DP") AS dp FROM alleles JOIN membership USING (cell) GROUP BY ALL), p AS (SELECT *, CASE WHEN "GT" = '1|0' THEN ad ELSE dp - ad END AS a FROM x), m AS (SELECT *, CASE WHEN a / dp > 0.5 THEN a ELSE dp - a END AS major FROM p)
SELECT sample, snp_id, round(coalesce(sum(major) OVER w / nullif(sum(dp) OVER w, 0) - 0.5, 0), 6) AS theta_hat_roll FROM m WINDOW w AS (PARTITION BY sample, "CHROM" ORDER BY "POS", snp_id ROWS BETWEEN 101 PRECEDING AND 100 FOLLOWING)""")
def _(v):
    return rnd(M.theta_roll(_bulk(v).withColumn("state", F.lit("neu"))).select("sample", "snp_id", "theta_hat_roll"), "theta_hat_roll")


@query("m12_theta_mle")
def _(v):
    def with_theta(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["POS", "snp_id"])
        theta, sigma = K.theta_post(*(pdf[c].to_numpy(float) for c in ("pAD", "DP", "p_s")), 30.0)
        return pd.DataFrame({"sample": [pdf["sample"].iloc[0]], "CHROM": [pdf["CHROM"].iloc[0]], "theta_mle": [round(theta, 3)]})

    return _bulk(v).select("sample", "CHROM", "POS", "snp_id", "pAD", "DP", "p_s").groupBy("sample", "CHROM").applyInPandas(with_theta, "sample string, CHROM string, theta_mle double")


@query("r09_run_group_hmms")
def _(v):
    x = M.run_group_hmms(_full_bulk(v), diploid=False, min_genes=2)
    return x.groupBy("sample", "CHROM", "seg", "cnv_state").agg(F.min("snp_index").alias("seg_start_index"), F.max("snp_index").alias("seg_end_index"))


@query("r08_retest_bulks")
def _(v):
    b = _full_bulk(v)
    segs = b.groupBy("CHROM").agg(F.min("POS").alias("seg_start"), F.max("POS").alias("seg_end")).withColumn("seg_cons", F.concat("CHROM", F.lit("a"))).withColumn("cnv_state", F.when(F.col("CHROM") == "12", F.lit("neu")).otherwise(F.lit("del")))
    return M.retest_bulks(b, segs).select("sample", "CHROM", "seg", "cnv_state", "cnv_state_post").distinct()


# posteriors

PRIORS = {"loh": 0.2, "del": 0.3, "amp": 0.3, "bamp": 0.1, "bdel": 0.1}


def _priors(v, segs=None):
    s = segs or v.spark.createDataFrame([(n,) for n in SEGMENT_NAMES], "seg string")
    return s.select("seg", *[F.lit(p).alias(f"p_{k}") for k, p in PRIORS.items()])


def _lse(*z):
    top = f"greatest({', '.join(z)})"
    return f"({top} + ln({' + '.join(f'exp({x} - {top})' for x in z)}))"


POST = f"""l AS (SELECT cell, seg, cnv_state, major, total, {BINOM} FROM cell_alleles),
z AS (SELECT *, {_lse(f"l21 + {math.log(PRIORS['amp'] / 4)!r}", f"l31 + {math.log(PRIORS['amp'] / 4)!r}")} AS z_amp, l20 + {math.log(PRIORS['loh'] / 2)!r} AS z_loh, l10 + {math.log(PRIORS['del'] / 2)!r} AS z_del, l11 + {math.log(PRIORS['bamp'] / 2)!r} AS z_bamp, l11 + {math.log(PRIORS['bdel'] / 2)!r} AS z_bdel, l11 + ln(0.5) AS z_n FROM l),
zz AS (SELECT *, {_lse('z_amp', 'z_loh', 'z_del', 'z_bamp', 'z_bdel')} AS z_cnv, {_lse('z_n', 'z_amp', 'z_loh', 'z_del', 'z_bamp', 'z_bdel')} AS z_all FROM z)"""


@query("r02_r05_allele_posterior", f"""WITH {POST} SELECT cell, seg, round(z_cnv - z_n, 4) AS "logBF", round(exp(z_cnv - z_all), 6) AS p_cnv, round(exp(z_amp - z_all), 6) AS p_amp, round(exp(z_del - z_all), 6) AS p_del, round(exp(z_loh - z_all), 6) AS p_loh, round(exp(z_n - z_all), 6) AS p_neu FROM zz""")
def _(v):
    x = P.compute_posterior(P.with_priors(v.likelihoods(), _priors(v)))
    x = rnd(x.select("cell", "seg", "logBF", "p_cnv", "p_amp", "p_del", "p_loh", "p_neu"), "p_cnv", "p_amp", "p_del", "p_loh", "p_neu")
    return rnd(x, "logBF", digits=4)


@query("r04_haplotype_post")
def _(v):
    x = _bulk(v).withColumns({"seg": F.col("CHROM"), "cnv_state": F.when(F.col("CHROM").isin("11", "13"), F.lit("del")).otherwise(F.lit("neu"))}).withColumn("cnv_state_post", F.col("cnv_state")).withColumn("theta_mle", F.lit(0.2))
    x = M.classify_alleles(x)
    return P.haplotype_post(x, x.select("sample", "CHROM", "seg", "cnv_state").distinct()).groupBy("CHROM", "haplo").agg(F.count(F.lit(1)).alias("n"))


def _two_posts(v):
    post = P.compute_posterior(P.with_priors(v.likelihoods(), _priors(v)))
    return post.where("cast(cell as int) % 3 <> 0"), post.where("cast(cell as int) % 4 <> 0")


@query("r06_joint_posterior", f"""WITH {POST}, b AS (SELECT coalesce(x.cell, y.cell) AS cell, coalesce(x.seg, y.seg) AS seg, {", ".join(f"coalesce(x.{n}, 0) + coalesce(y.{n}, 0) AS {n}" for n in ("l11", "l20", "l10", "l21", "l31"))}, x.z_cnv - x.z_n AS bx FROM (SELECT * FROM zz WHERE cell::INT % 3 <> 0) x FULL JOIN (SELECT * FROM zz WHERE cell::INT % 4 <> 0) y ON x.cell = y.cell AND x.seg = y.seg),
c AS (SELECT *, {_lse(f"l21 + {math.log(PRIORS['amp'] / 4)!r}", f"l31 + {math.log(PRIORS['amp'] / 4)!r}")} AS z_amp, l20 + {math.log(PRIORS['loh'] / 2)!r} AS z_loh, l10 + {math.log(PRIORS['del'] / 2)!r} AS z_del, l11 + {math.log(PRIORS['bamp'] / 2)!r} AS z_bamp, l11 + {math.log(PRIORS['bdel'] / 2)!r} AS z_bdel, l11 + ln(0.5) AS z_n FROM b),
d AS (SELECT *, {_lse('z_amp', 'z_loh', 'z_del', 'z_bamp', 'z_bdel')} AS z_cnv, {_lse('z_n', 'z_amp', 'z_loh', 'z_del', 'z_bamp', 'z_bdel')} AS z_all FROM c)
SELECT cell, seg, round(exp(z_cnv - z_all), 6) AS p_cnv, round(1 / (1 + exp(-bx)), 6) AS p_cnv_x, CASE greatest(l11, l20, l10, l21, l31) WHEN l11 THEN 'neu' WHEN l20 THEN 'loh' WHEN l10 THEN 'del' ELSE 'amp' END AS cnv_state_mle FROM d""")
def _(v):
    j = P.joint_post(*_two_posts(v), _priors(v))
    return rnd(j.select("cell", "seg", "p_cnv", "p_cnv_x", "cnv_state_mle"), "p_cnv", "p_cnv_x")


@query("r07_multi_allelic", """WITH s AS (SELECT "CHROM" AS seg_cons, list_sort(list_distinct(list(cnv_state))) AS s FROM segments WHERE "LLR" > 5 AND cnv_state <> 'neu' GROUP BY ALL) SELECT DISTINCT x."CHROM" AS seg_cons, coalesce(CASE WHEN len(s) > 1 THEN len(s) END, 1)::INT AS n_states, CASE WHEN len(s) > 1 THEN array_to_string(s, ',') ELSE 'del' END AS cnv_states, CASE WHEN len(s) > 1 THEN CASE WHEN list_contains(s, 'amp') THEN 0.5 ELSE 0 END ELSE 0.25 END::DOUBLE AS p_amp FROM segments x LEFT JOIN s ON s.seg_cons = x."CHROM" """)
def _(v):
    s = v.segments()
    b = s.select(F.col("CHROM").alias("seg_cons"), "LLR", F.col("cnv_state").alias("cnv_state_post"), *[(F.col("cnv_state") == k).cast("double").alias(f"p_{k}") for k in P.STATES])
    c = s.select(F.col("CHROM").alias("seg_cons")).distinct().withColumn("cnv_state", F.lit("del")).withColumns({f"p_{k}": F.lit(0.25) for k in P.STATES})
    return P.multi_allelic(b, c).select("seg_cons", "n_states", "cnv_states", "p_amp")


@query("r03_a23_expression_likelihoods")
def _(v):
    c, ref = G.cut(v.counts()), G.cut(v.ref())  # used by choice, fits and likelihoods
    fits = M.cell_fits(c, ref, R.best_reference(c, ref), v.genes())
    segs = v.genes().select("gene", "CHROM", F.concat("CHROM", F.lit("a")).alias("seg"), F.lit("del").alias("cnv_state"))
    x = P.expression_likelihoods(c, fits, ref, segs)
    x = P.compute_posterior(P.with_priors(x, _priors(v, segs.select("seg").distinct()), floor=True))
    return rnd(x.select("cell", "seg", "n", "l11", "p_cnv"), "l11", "p_cnv", digits=2)


@query("r10_clone_posterior", f"""WITH {POST}, {CLONES_SQL}, pr AS (SELECT *, CASE WHEN gt = '' THEN 0.5 ELSE 0.5 / 3 END AS prior FROM clones), t AS (SELECT z.cell, p.clone, any_value(p.compartment) AS compartment, ln(any_value(p.prior)) + 2 * sum(CASE WHEN list_contains(string_split(p.gt, ','), z.seg) THEN z.z_cnv ELSE z.z_n END) AS z FROM zz z CROSS JOIN pr p GROUP BY ALL),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY cell)) AS e FROM t), q AS (SELECT *, e / sum(e) OVER (PARTITION BY cell) AS p FROM e)
SELECT cell, arg_max(clone, p) AS clone_opt, round(max(p), 5) AS p_opt, round(sum(p) FILTER (compartment = 'tumor'), 5) AS p_cnv FROM q GROUP BY cell""")
def _(v):
    c = v.spark.createDataFrame(CLONES, "clone int, GT string, compartment string")
    post = P.compute_posterior(P.with_priors(v.likelihoods(), _priors(v)))
    return rnd(P.clone_calls(P.clone_post(c, post, post), [0, 1, 2, 3]).select("cell", "clone_opt", "p_opt", "p_cnv"), "p_opt", "p_cnv", digits=5)


@query("u06_j09_clone_matrix")
def _(v):
    c = v.spark.createDataFrame(CLONES, "clone int, GT string, compartment string")
    x, y = _two_posts(v)
    return rnd(P.clone_calls(P.clone_post(c, x, y), [0, 1, 2, 3]), "p_opt", "p_cnv", "p_cnv_x", "p_cnv_y", *[f"{n}_{k}" for k in range(4) for n in ("p", "p_x", "p_y")], digits=5)


# graphs and trees


@query("g01_components", """WITH r(node, other) AS (SELECT src, src FROM edges UNION SELECT r.node, e.dst FROM r JOIN (SELECT src, dst FROM edges WHERE src <> dst) e ON e.src = r.other) SELECT node, min(other) AS component FROM r WHERE node IN (SELECT src FROM edges WHERE src <> dst) GROUP BY node""")
def _(v):
    e = v.edges().where("src <> dst")
    return G.connected_components(e, "src", "dst")


DIST = """ed AS (SELECT e.src, e.dst, sqrt(list_sum([(x[1] - x[2])::DOUBLE * (x[1] - x[2])::DOUBLE FOR x IN list_zip(a.embedding, b.embedding)])) AS dist FROM edges e JOIN embeddings a ON a.vec_id = e.src JOIN embeddings b ON b.vec_id = e.dst)"""


def _vectors(v):
    return v.table("embeddings").select(F.col("vec_id").alias("node"), "embedding")


@query("g03_edge_distances", f"WITH {DIST} SELECT src, dst, round(dist, 4) AS dist FROM ed")
def _(v):
    return rnd(G.edge_distances(v.edges(), _vectors(v).withColumnRenamed("embedding", "vec")), "dist", digits=4)


@query("g04_f23_spatial_weights", f"WITH {DIST}, m AS (SELECT quantile_cont(dist, 0.5) AS s FROM ed WHERE dist > 0), w AS (SELECT src, dst, exp(-dist * dist / (s * s + 1e-12)) AS w FROM ed, m), b AS (SELECT src, dst, w FROM w UNION ALL SELECT dst, src, w FROM w) SELECT src, dst, round(sum(w) / 2, 4) AS w FROM b GROUP BY ALL")
def _(v):
    return rnd(G.spatial_weights(G.edge_distances(v.edges(), _vectors(v).withColumnRenamed("embedding", "vec"))), "w", digits=4)


def _signal(v):
    return v.table("embeddings").select(F.col("vec_id").alias("node"), F.col("label").cast("double").alias("x")), v.edges().select("src", "dst", F.lit(1.0).alias("w"))


@query("g05_degree", """SELECT n.vec_id AS node, round((coalesce(s.ax, 0) + n.label) / (coalesce(s.d, 0) + 1), 6) AS x FROM embeddings n LEFT JOIN (SELECT src, sum(b.label) AS ax, count(*) AS d FROM edges e JOIN embeddings b ON b.vec_id = e.dst GROUP BY src) s ON s.src = n.vec_id""")
def _(v):
    return rnd(G.neighbours_average(*_signal(v), method="degree"), "x")


def _steps(prefix: str, alpha: float, n: int) -> str:
    out = ["z0 AS (SELECT vec_id AS node, label::DOUBLE AS x, label::DOUBLE AS z FROM embeddings)"]
    for k in range(1, n + 1):
        out.append(f"z{k} AS (SELECT a.node, a.x, {alpha} * coalesce(s.pz, 0) + {1 - alpha} * a.x AS z FROM z{k - 1} a LEFT JOIN (SELECT p.src, sum(p.p * b.z) AS pz FROM p JOIN z{k - 1} b ON b.node = p.dst GROUP BY p.src) s ON s.src = a.node)")
    return f"{prefix}, " + ", ".join(out) + f" SELECT node, round(z, 6) AS x FROM z{n}"


@query("g05_g06_diffuse", "WITH " + _steps("p AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS p FROM edges)", 0.7, 5))
def _(v):
    return rnd(G.neighbours_average(*_signal(v), method="diffuse"), "x")


@query("g05_g06_cpr", "WITH " + _steps("dg AS (SELECT src, count(*) AS d FROM edges GROUP BY src), w AS (SELECT e.src, e.dst, 1 / sqrt(a.d * b.d) AS w FROM edges e JOIN dg a ON a.src = e.src JOIN dg b ON b.src = e.dst), p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w)", 0.75, 4))
def _(v):
    return rnd(G.neighbours_average(*_signal(v), method="cpr"), "x")


@query("g07_g08_expression_clusters")
def _(v):
    c = v.counts()
    g = R.gene_universe(v.genes(), c, v.ref())
    return G.expression_clusters(*W.expression_changes(c, c, g, v.ref().groupBy("gene").agg(F.avg("lambda").alias("lambda"))), 3)


def _matrix(v):
    x = v.alleles().groupBy("cell", "CHROM").agg((F.sum("AD") / F.sum("DP")).alias("p"))
    wide = x.groupBy("cell").pivot("CHROM", [n[:-1] for n in SEGMENT_NAMES]).agg(F.first("p")).orderBy(F.col("cell").cast("int")).fillna(0.5)
    table = wide.toArrow()
    return np.column_stack([table.column(c).to_numpy() for c in wide.columns[1:]]), table.column("cell").to_pylist(), wide.columns[1:]


@query("t01_t08_candidate_tree")
def _(v):
    p, names, _ = _matrix(v)
    tree, history = Y.candidate_tree(p, names)
    return Y.node_table(tree, names, v.spark)


#: A balanced tree: the node at height h over leaves j * 2^h and on has the number n * h + j; it stands if its right half has a leaf.
BALANCED = """lv AS (SELECT dense_rank() OVER (ORDER BY cell::INT) - 1 AS leaf, "CHROM" AS site, greatest(1e-10, least(1 - 1e-10, sum("AD") / sum("DP"))) AS p FROM alleles GROUP BY cell, "CHROM"),
lf AS (SELECT leaf, count(*) OVER () AS n FROM (SELECT DISTINCT leaf FROM lv)),
cl AS (SELECT leaf AS node, leaf FROM lf UNION ALL SELECT node, leaf FROM (SELECT n * h + (leaf >> h) AS node, leaf, h, count(*) OVER (PARTITION BY h, leaf >> h) AS m, n FROM lf, range(1, 30) r(h)) WHERE m > (1::BIGINT << (h - 1))),
q AS (SELECT node::BIGINT AS node, site, sum(ln(p / (1 - p))) AS l FROM cl JOIN lv USING (leaf) GROUP BY ALL)"""


def _balanced(v):
    p = v.alleles().groupBy("cell", F.col("CHROM").alias("site")).agg((F.sum("AD") / F.sum("DP")).alias("p"))
    cells = v.alleles().select("cell").distinct().withColumn("leaf", F.dense_rank().over(Window.orderBy(F.col("cell").cast("int"))) - 1)
    p = p.join(cells, "cell").drop("cell")
    n = cells.count()
    children = {}

    def node(h, j):
        while h and j * 2**h + 2 ** (h - 1) >= n:
            h, j = h - 1, 2 * j
        return n * h + j

    for h in range(1, max(1, (n - 1).bit_length()) + 1):
        for j in range(-(-n // 2**h)):
            if j * 2**h + 2 ** (h - 1) < n:
                children[n * h + j] = [node(h - 1, 2 * j), node(h - 1, 2 * j + 1)]
    nodes = Y.node_table(Y.Tree(n, children), [str(i) for i in range(n)], v.spark)
    return Y.score_table(Y.closure_table(nodes), p)


@query("t05_node_scores", f"WITH {BALANCED} SELECT node, site, round(l, 5) AS l FROM q")
def _(v):
    return rnd(_balanced(v), "l", digits=5)


@query("t06_y02_tree_score", f"WITH {BALANCED} SELECT site, round(max(l), 5) AS best, arg_max(node, l) AS node FROM q GROUP BY site")
def _(v):
    return rnd(_balanced(v).groupBy("site").agg(F.max("l").alias("best"), F.max_by("node", "l").alias("node")), "best", digits=5)


@query("t07_nni")
def _(v):
    p, names, _ = _matrix(v)
    _, history = Y.greedy_nni(Y.upgma_cells(p), p)
    return v.spark.createDataFrame([(i, round(s, 4)) for i, s in enumerate(history)], "step int, score double")


def _history(v):
    p, names, sites = _matrix(v)
    tree, _ = Y.candidate_tree(p, names)
    return tree, p, sites, Y.mutation_graph(tree, p, sites)


@query("y01_y06_mutation_graph")
def _(v):
    _, _, _, h = _history(v)
    parent = h.parent()
    return v.spark.createDataFrame([(k, ",".join(e), parent.get(k)) for k, e in h.events.items()], "vertex int, events string, parent int")


@query("y07_y09_simplify")
def _(v):
    tree, p, sites, h = _history(v)
    s = Y.simplify(h, tree, p, sites, 50.0)
    return v.spark.createDataFrame([(k, g, c) for k, g, c in Y.clone_table(s, tree)], "clone int, GT string, compartment string")


@query("y10_j19_regroup")
def _(v):
    c = v.spark.createDataFrame(CLONES, "clone int, GT string, compartment string")
    post = P.compute_posterior(P.with_priors(v.likelihoods(), _priors(v)))
    calls = P.clone_calls(P.clone_post(c, post, post), [0, 1, 2, 3])
    h = Y.History({0: [], 1: ["11a"], 2: ["12a"], 3: ["13a"]}, {0: [1], 1: [2, 3], 2: [], 3: []}, {0: 0, 1: 1, 2: 2, 3: 3}, 0)
    return Y.regroup(calls, h)[0]
