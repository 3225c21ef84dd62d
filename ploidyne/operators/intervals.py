"""Interval joins and interval algebra.

A range predicate alone plans as a nested loop, so every join here has an equi-key: the chromosome and a genomic bin. Intervals are
put in each bin that they touch, points in one; bins, unlike broadcasts, hold at any size of either side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ploidyne.functions.scalars import base26, chrom_key

BIN = 50_000


def _bins(start, end, width):
    return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))


def point_join(points: DataFrame, ranges: DataFrame, start: str, end: str, closed: bool, how: str = "inner", width: int = BIN) -> DataFrame:
    """Points (CHROM, POS) with the ranges that hold them: ends included if ``closed``. A point has one bin, so no pair comes twice."""
    r = ranges.withColumn("_bin", _bins(start, end, width)).withColumnRenamed("CHROM", "_chrom")
    p = points.withColumn("_pbin", F.floor(F.col("POS") / width))
    inside = (F.col("POS") >= F.col(start)) & (F.col("POS") <= F.col(end)) if closed else (F.col("POS") > F.col(start)) & (F.col("POS") < F.col(end))
    return p.join(r, (F.col("CHROM") == F.col("_chrom")) & (F.col("_pbin") == F.col("_bin")) & inside, how).drop("_pbin", "_bin", "_chrom")


def range_join(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, how: str = "inner", width: int = BIN) -> DataFrame:
    """Half-open overlaps of ranges: ls < re and le > rs; ``how`` is inner or left. A pair counts in the bin where the later of them starts, so it comes once."""
    l = left.withColumn("_lbin", _bins(ls, le, width))  # noqa: E741
    r = right.withColumn("_rbin", _bins(rs, re, width)).withColumnRenamed("CHROM", "_chrom")
    on = (F.col("CHROM") == F.col("_chrom")) & (F.col("_lbin") == F.col("_rbin")) & (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs))
    met = l.join(r, on & (F.col("_lbin") == F.floor(F.greatest(ls, rs) / width))).drop("_lbin", "_rbin", "_chrom")
    if how == "inner":
        return met
    # ranges on the left that meet none: by all of their columns, so that one in two bins comes back once
    seen = met.select(*[F.col(c).alias(f"_{c}") for c in left.columns]).distinct()
    alone = left
    for_all = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in left.columns]
    alone = alone.join(seen, reduce(lambda a, b: a & b, for_all), "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


def annotate_genes(snps: DataFrame, genes: DataFrame) -> DataFrame:
    """The gene that a SNP lies strictly inside; the least name of several; null if none."""
    hits = point_join(snps.select("snp_id", "CHROM", "POS").distinct(), genes.select("gene", "CHROM", "gene_start", "gene_end"), "gene_start", "gene_end", closed=False)
    first = hits.groupBy("snp_id", "CHROM", "POS").agg(F.min_by(F.struct("gene", "gene_start", "gene_end"), "gene").alias("g"))
    return snps.drop("gene", "gene_start", "gene_end").join(first, ["snp_id", "CHROM", "POS"], "left").select("*", "g.*").drop("g")


def annotate_consensus(bulk: DataFrame, segs: DataFrame, how: str = "inner") -> DataFrame:
    """The first segment whose closed range holds the SNP; its columns replace the bulk's."""
    columns = [c for c in segs.columns if c != "CHROM"]
    hits = point_join(bulk.select("snp_id", "CHROM", "POS").distinct(), segs, "seg_start", "seg_end", closed=True)
    first = hits.groupBy("snp_id", "CHROM").agg(F.min_by(F.struct(*columns), F.struct("seg_start", "seg_end", "seg")).alias("s"))
    return bulk.drop(*columns).join(first, ["snp_id", "CHROM"], how).select("*", "s.*").drop("s")


def gene_segments(genes: DataFrame, segs: DataFrame) -> DataFrame:
    """The first segment that a gene overlaps, half-open."""
    g = range_join(genes.select("gene", "CHROM", "gene_start", "gene_end"), segs, "gene_start", "gene_end", "seg_start", "seg_end")
    return g.groupBy("gene", "CHROM").agg(F.min_by(F.struct("seg", "cnv_state"), F.struct("seg_start", "seg_end", "seg")).alias("s")).select("gene", "CHROM", "s.*")


def flag_overlap(genes: DataFrame, segs: DataFrame, name: str = "loh") -> DataFrame:
    """Whether a gene's range overlaps any of ``segs``."""
    hit = range_join(genes.select("gene", "CHROM", "gene_start", "gene_end"), segs.select("CHROM", "seg_start", "seg_end"), "gene_start", "gene_end", "seg_start", "seg_end").select("gene").distinct().withColumn(name, F.lit(True))
    return genes.join(hit, "gene", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def self_overlaps(segs: DataFrame, min_overlap: float = 0.45) -> DataFrame:
    """Unordered pairs of segments with their overlap as a fraction of each; kept unless both are below."""
    x = segs.select("CHROM", F.col("id").alias("id_x"), F.col("seg_start").alias("sx"), F.col("seg_end").alias("ex"))
    y = segs.select("CHROM", F.col("id").alias("id_y"), F.col("seg_start").alias("sy"), F.col("seg_end").alias("ey"))
    p = range_join(x, y, "sx", "ex", "sy", "ey").where("id_x < id_y")
    p = p.withColumn("len_overlap", F.least("ex", "ey") - F.greatest("sx", "sy"))
    p = p.withColumn("frac_x", F.col("len_overlap") / (F.col("ex") - F.col("sx"))).withColumn("frac_y", F.col("len_overlap") / (F.col("ey") - F.col("sy")))
    return p.where((F.col("frac_x") >= min_overlap) | (F.col("frac_y") >= min_overlap)).select("CHROM", "id_x", "id_y", "len_overlap", "frac_x", "frac_y")


def union_ranges(ranges: DataFrame, keys=("CHROM",), start: str = "seg_start", end: str = "seg_end", gap: int = 1) -> DataFrame:
    """Merged closed ranges and their length; ranges up to ``gap`` apart are bookended and merge. Islands by a running maximum."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = ranges.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    x = x.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island").withColumn("seg_length", F.col(end) - F.col(start) + 1)


def subtract_ranges(left: DataFrame, right: DataFrame, shift: int = 1) -> DataFrame:
    """The parts of ``left`` outside ``right``. With ``shift`` 1 ends are included; with 0 pieces touch what was taken.

    Both sides become events; running sums tell where the left side is open and the right is not.
    """
    half = lambda d, kind: d.select("CHROM", F.explode(F.array(F.struct(F.col("seg_start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("seg_end") + shift).alias("at"), F.lit(-1).alias("d")))).alias("e")).select("CHROM", "e.at", *[(F.col("e.d") if kind == k else F.lit(0)).alias(k) for k in ("a", "b")])
    e = half(left, "a").union(half(right, "b")).groupBy("CHROM", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy("CHROM").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("a", F.sum("a").over(upto)).withColumn("b", F.sum("b").over(upto)).withColumn("next", F.lead("at").over(w)).where("a > 0 and b = 0 and next > at")
    merged = union_ranges(e.select("CHROM", F.col("at").alias("seg_start"), F.col("next").alias("seg_end")), gap=0)
    return merged.select("CHROM", "seg_start", (F.col("seg_end") - shift).alias("seg_end"))


def neutral_ranges(bulks: DataFrame) -> DataFrame:
    """Merged ranges of neutral segments."""
    s = bulks.where("cnv_state = 'neu'").groupBy("sample", "seg", "CHROM").agg(F.min("POS").alias("seg_start"), F.max("POS").alias("seg_end"))
    return union_ranges(s.select("CHROM", "seg_start", "seg_end"))


def fill_neutral(consensus: DataFrame, neutral: DataFrame) -> DataFrame:
    """Consensus segments and the neutral gaps between them, labelled by chromosome in order."""
    gaps = subtract_ranges(neutral.select("CHROM", "seg_start", "seg_end"), consensus.select("CHROM", "seg_start", "seg_end"), shift=0).withColumn("seg_length", F.col("seg_end") - F.col("seg_start"))
    x = consensus.withColumn("seg_length", F.col("seg_end") - F.col("seg_start")).unionByName(gaps, allowMissingColumns=True).withColumn("cnv_state", F.coalesce("cnv_state", F.lit("neu")))
    n = F.row_number().over(Window.partitionBy("CHROM").orderBy("seg_start", "seg_end")) - 1
    return x.withColumn("seg_cons", F.concat("CHROM", base26(n)))


def interpolate(points: DataFrame, marks: DataFrame) -> DataFrame:
    """cM at points from a map (CHROM, POS, cM), linear between the marks on both sides and clamped at the ends."""
    both = points.select("CHROM", "POS").distinct().select("CHROM", "POS", F.lit(None).cast("double").alias("m"), F.lit(1).alias("is_point")).union(marks.select("CHROM", "POS", "cM", F.lit(0)))
    # the marks after a row come from the same order backwards: a frame from the row on would be summed up anew for each row
    w, back = Window.partitionBy("CHROM").orderBy("POS", "is_point", "m"), Window.partitionBy("CHROM").orderBy(F.desc("POS"), F.desc("is_point"), F.desc("m"))
    at = F.when(F.col("m").isNotNull(), F.struct("POS", "m"))
    both = both.withColumn("lo", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.last(at, True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.col("lo.m") + (F.col("hi.m") - F.col("lo.m")) * (F.col("POS") - F.col("lo.POS")) / (F.col("hi.POS") - F.col("lo.POS"))
    value = F.when(F.col("lo").isNull(), F.col("hi.m")).when(F.col("hi").isNull() | (F.col("lo.POS") == F.col("POS")), F.col("lo.m")).otherwise(line)
    return points.join(both.where("is_point = 1").select("CHROM", "POS", value.alias("cM")), ["CHROM", "POS"], "left")


def resolve_cnvs(segs: DataFrame, min_overlap: float = 0.45) -> DataFrame:
    """Of each component of overlapping segments the row with the greatest LLR_x + LLR_y; the least id of equals."""
    from ploidyne.operators.graph import connected_components

    pairs = self_overlaps(segs, min_overlap)
    parts = connected_components(pairs.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")))
    x = segs.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    best = x.groupBy("component").agg(F.max_by("id", F.struct(F.col("LLR_x") + F.col("LLR_y"), -F.col("id"))).alias("id"))
    return x.join(best, ["component", "id"]).select(*segs.columns, "component")


def consensus_segments(bulks: DataFrame, min_llr: float = 5.0, min_overlap: float = 0.45, retest: bool = False) -> DataFrame:
    """Segments agreed on by all samples: called ranges resolved, the rest neutral.

    ``bulks``: sample, seg, CHROM, POS, cnv_state, LLR, LLR_x, LLR_y. With ``retest`` called ranges that were not chosen come back as
    state ``retest``.
    """
    s = bulks.groupBy("sample", "seg", "CHROM").agg(F.min("POS").alias("seg_start"), F.max("POS").alias("seg_end"), F.first("cnv_state").alias("cnv_state"), *[F.first(c).alias(c) for c in ("LLR", "LLR_x", "LLR_y")]).where("seg_start <> seg_end")
    s = s.withColumn("cnv_state", F.when(F.col("LLR").isNull() | (F.col("LLR") < min_llr), F.lit("neu")).otherwise(F.col("cnv_state")))
    called = s.where("cnv_state <> 'neu'").withColumn("id", F.xxhash64("sample", "seg", "CHROM"))
    kept = resolve_cnvs(called, min_overlap).select("CHROM", "seg", "seg_start", "seg_end", "cnv_state", "LLR", "LLR_x", "LLR_y")
    if retest:
        again = subtract_ranges(union_ranges(called.select("CHROM", "seg_start", "seg_end")), kept)
        kept = kept.unionByName(again.withColumn("cnv_state", F.lit("retest")), allowMissingColumns=True)
    neutral = union_ranges(s.where("cnv_state = 'neu'").select("CHROM", "seg_start", "seg_end"))
    return fill_neutral(kept, neutral).withColumn("_o", chrom_key("CHROM")).orderBy("_o", "seg_start").drop("_o")
