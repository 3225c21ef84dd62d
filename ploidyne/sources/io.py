"""Sources and sinks: TSV, VCF, MatrixMarket, genetic maps, Parquet."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ploidyne.operators.relational import require

GENES = "gene string, gene_start long, gene_end long, CHROM string, gene_length long"
ALLELES = "cell string, snp_id string, CHROM string, POS long, cM double, REF string, ALT string, AD int, DP int, GT string, gene string"
SEGMENTS = "CHROM string, seg_start long, seg_end long"


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, sep: str = "\t") -> DataFrame:
    """With a header; with a schema its columns are taken by name."""
    raw = spark.read.csv(path, sep=sep, header=True, nullValue="", nanValue="nan")
    if schema is None:
        return raw
    want = [c.strip().split(" ") for c in schema.split(",")]
    require(raw, [n for n, _ in want], path)
    return raw.select(*[F.expr(f"try_cast(nullif(`{n}`, 'nan') as {t})").alias(n) for n, t in want])


def read_annotation(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Genes with their length."""
    return read_tsv(spark, path, GENES.rsplit(",", 1)[0], sep).withColumn("gene_length", F.col("gene_end") - F.col("gene_start"))


class Catalog:
    """Named annotation files, each read once."""

    def __init__(self, spark: SparkSession, paths: dict[str, str]):
        self._spark, self._paths, self._read = spark, paths, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._paths:
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = read_annotation(self._spark, self._paths[name]).cache()
        return self._read[name]


def read_filter_segments(spark: SparkSession, path: str) -> DataFrame:
    """S03."""
    return read_tsv(spark, path, SEGMENTS)


def parse_info(info):
    """k=v;k=v as a map."""
    return F.str_to_map(info, F.lit(";"), F.lit("="))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """The body's first eight columns and the samples', chr stripped."""
    f = F.split("value", "\t")
    names = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "SAMPLE"]
    x = spark.read.text(path).where("not startswith(value, '#') and value <> ''").select(*[F.try_element_at(f, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    return x.withColumn("CHROM", F.regexp_replace("CHROM", "^chr", "")).withColumn("POS", F.col("POS").cast("long"))


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    """Depths from INFO, snp_id, AR; SNPs without reads go."""
    x = read_vcf(spark, path).withColumn("_i", parse_info(F.col("INFO")))
    x = x.withColumns({k: F.try_element_at("_i", F.lit(k)).try_cast("int") for k in ("AD", "DP", "OTH")}).where("DP > 0")
    return x.select("CHROM", "POS", "REF", "ALT", "AD", "DP", "OTH", F.concat_ws("_", "CHROM", F.col("POS").cast("string"), "REF", "ALT").alias("snp_id"), F.try_divide("AD", "DP").alias("AR"))


def read_phased(spark: SparkSession, folder: str, label: str, chroms=tuple(str(k) for k in range(1, 23))) -> DataFrame:
    """The phased files of all chromosomes; a missing one is an error. GT is 1|0 or 0|1."""
    paths = [f"{folder}/{label}_chr{c}.phased.vcf.gz" for c in chroms]
    x = read_vcf(spark, paths if len(paths) > 1 else paths[0])
    x = x.withColumn("GT", F.substring_index("SAMPLE", ":", 1)).withColumn("snp_id", F.concat_ws("_", "CHROM", F.col("POS").cast("string"), "REF", "ALT"))
    return x.where("GT in ('1|0', '0|1')")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of a MatrixMarket file; the line of dimensions is the first that isn't a comment, and no entry stands before it."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path, wholetext=False).withColumn("_n", F.monotonically_increasing_id()).where("not startswith(value, '%') and trim(value) <> ''")
    first = rows.agg(F.min("_n")).first()[0]
    return rows.where(F.col("_n") > F.lit(-1 if first is None else first)).select(*[f[k].cast("int").alias(n) for k, n in enumerate("ijv")])


def read_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(index from 1, line), such as barcodes: ids grow in the order of a file's lines."""
    x = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id())
    return x.select(F.row_number().over(Window.orderBy("_n")).alias("j"), F.trim("value").alias(name))


def read_genetic_map(spark: SparkSession, path: str) -> DataFrame:
    """CHROM, POS, rate, cM; rows that aren't numbers go, the first of each position stays."""
    f = F.split(F.trim("value"), r"\s+")
    x = spark.read.text(path).select(F.regexp_replace(f[0], "^chr", "").alias("CHROM"), F.get(f, F.lit(1)).try_cast("long").alias("POS"), F.get(f, F.lit(2)).try_cast("double").alias("rate"), F.get(f, F.lit(3)).try_cast("double").alias("cM"))
    return x.where("POS is not null and cM is not null").dropDuplicates(["CHROM", "POS"])


def write_vcf(snps: DataFrame, path: str, label: str, chrom: str, prefix: str = "") -> None:
    """Header and rows in order of position, as one text file."""
    head = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', f"##contig=<ID={prefix}{chrom}>", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", label])]
    info = F.concat(F.lit("AD="), F.col("AD").cast("string"), F.lit(";DP="), F.col("DP").cast("string"), F.lit(";OTH="), F.col("OTH").cast("string"))
    rows = snps.where(F.col("CHROM") == chrom).select(F.lit(1).alias("_k"), F.col("POS").alias("_p"), F.concat_ws("\t", F.concat(F.lit(prefix), "CHROM"), F.col("POS").cast("string"), F.lit("."), "REF", "ALT", F.lit("."), F.lit("PASS"), info, F.lit("GT"), "GT").alias("value"))
    top = snps.sparkSession.createDataFrame([(0, i, h) for i, h in enumerate(head)], "_k int, _p long, value string")
    top.union(rows).orderBy("_k", "_p").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str, compressed: bool = False) -> None:
    """With a header; nulls as nan if compressed."""
    w = df.write.mode("overwrite").option("sep", "\t").option("header", True)
    (w.option("compression", "gzip").option("nullValue", "nan") if compressed else w).csv(path)


def write_table(df: DataFrame, path: str, keys=()) -> None:
    """Parquet, partitioned by ``keys``."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Long counts from Parquet: cell, gene, cnt."""
    return require(spark.read.parquet(path), ("cell", "gene", "cnt"), "counts").where("cnt > 0").select("cell", "gene", "cnt")


def preprocess(spark: SparkSession, pileup: str, phased: DataFrame, genes: DataFrame, marks: DataFrame) -> DataFrame:
    """B06 from a pileup folder: cellSNP.base.vcf, matrices and barcodes give the allele table."""
    from ploidyne.operators.bulk import preprocess_alleles

    base = read_lines(spark, f"{pileup}/cellSNP.base.vcf", "value").where("not startswith(value, '#') and value <> ''")
    f = F.split("value", "\t")
    n = F.row_number().over(Window.orderBy("j"))
    info = parse_info(f[7])
    chrom = F.regexp_replace(f[0], "^chr", "")
    snps = base.select(n.alias("i"), chrom.alias("CHROM"), f[1].cast("long").alias("POS"), f[3].alias("REF"), f[4].alias("ALT"), F.try_element_at(info, F.lit("OTH")).try_cast("int").alias("OTH"), F.concat_ws("_", chrom, f[1], f[3], f[4]).alias("snp_id"))
    cells = read_lines(spark, f"{pileup}/cellSNP.samples.tsv", "barcode")
    x = preprocess_alleles(read_matrix(spark, f"{pileup}/cellSNP.tag.AD.mtx"), read_matrix(spark, f"{pileup}/cellSNP.tag.DP.mtx"), snps, phased, genes, marks)
    return x.join(cells, F.col("cell") == F.col("j").cast("string")).withColumn("cell", F.col("barcode")).drop("j", "barcode")


def main(argv=None) -> None:
    """The preprocessing command: pileup and phasing must have run; their outputs become an allele table."""
    a = argparse.ArgumentParser(description=main.__doc__)
    for name in ("label", "pileup", "phased", "genes", "map", "out"):
        a.add_argument(f"--{name}", required=True)
    o = a.parse_args(argv)
    spark = SparkSession.builder.appName("ploidyne-preprocess").getOrCreate()
    out = preprocess(spark, o.pileup, read_phased(spark, o.phased, o.label), read_annotation(spark, o.genes), read_genetic_map(spark, o.map))
    write_tsv(out, str(Path(o.out) / f"{o.label}_allele_counts.tsv.gz"), compressed=True)


if __name__ == "__main__":
    main()
