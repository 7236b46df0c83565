"""GFF sources."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import numbered_lines

COLUMNS = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")
# Where each field of a start-site comment is found.
TSS_ID = r"ID=([^;]+)"
TSS_SIGMA = r"Sigma:\s*([^,;]+)"
TSS_RESOLUTION = r"Resolution:\s*(\d+)"
TSS_PUBMED = r'PubMed:\s*([^"]+)'
TSS_SOURCE = r"Based on:\s*([^,]+)"


def parse_gff(lines: DataFrame) -> DataFrame:
    """GFF columns of text lines (value, ...); comments, blank and short lines are skipped."""
    parts = F.split("value", "\t")
    rest = [c for c in lines.columns if c != "value"]
    ok = (~F.col("value").startswith("#")) & (F.trim("value") != "") & (F.size(parts) >= len(COLUMNS))
    return lines.where(ok).select(*[parts[i].alias(c) for i, c in enumerate(COLUMNS)], *rest).withColumns({
        "start": F.col("start").try_cast("bigint"), "end": F.col("end").try_cast("bigint")})


# S4
def parse_genes(lines: DataFrame) -> DataFrame:
    """Named genes: (contig_id, gene, g_start, g_end, strand, ...)."""
    g = parse_gff(lines).where(F.col("type") == "gene")
    name = F.regexp_extract("attributes", r"(?:^|;)Name=([^;]*)", 1)
    rest = [c for c in lines.columns if c != "value"]
    return g.select(F.col("seqid").alias("contig_id"), F.trim(name).alias("gene"), F.col("start").alias("g_start"),
                    F.col("end").alias("g_end"), "strand", *rest).where(F.col("gene") != "")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    return parse_genes(numbered_lines(spark, path))


# S5
def parse_tss(lines: DataFrame) -> DataFrame:
    """Start sites with a sigma factor: id, place, sigma, resolution, source and references."""
    t = parse_gff(lines).where((F.col("type") == "TSS") & F.col("attributes").contains("Sigma:"))
    get = lambda rx: F.trim(F.regexp_extract("attributes", rx, 1))
    or_unknown = lambda c: F.when(c == "", "Unknown").otherwise(c)
    rest = [c for c in lines.columns if c != "value"]
    return t.select(
        or_unknown(get(TSS_ID)).alias("tss_id"), F.col("seqid").alias("chromosome"), F.col("start").alias("coordinate"),
        "strand", or_unknown(get(TSS_SIGMA)).alias("sigma_factor"), get(TSS_RESOLUTION).try_cast("int").alias("resolution"),
        get(TSS_SOURCE).alias("data_source"), get(TSS_PUBMED).alias("pubmed_references"), *rest)


def read_tss(spark: SparkSession, path: str) -> DataFrame:
    return parse_tss(numbered_lines(spark, path))
