"""Delimited tables, name lists and sinks."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expression import plot_points

GENE_SCHEMA = "Gene string, Start bigint, End bigint, Strand string, Sequence string"
# Separators an upload may use, in order of preference, and the accepted extensions.
DELIMITERS = (",", "\t", ";", "|")
EXTENSIONS = {"csv": ",", "tsv": "\t", "txt": "\t"}
# The column names of exported results.
RESULT_COLUMNS = ("Start", "End", "Strand", "Pattern", "Found_Sequence", "Location", "Distance_from_TSS", "Mismatches")
MAP_RESULT_COLUMNS = ("Start", "End", "Strand", "Pattern", "Found Sequence", "RevComp", "Mismatches", "Location")


def _extension(path: str) -> str:
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if ext not in EXTENSIONS:
        raise ValueError(f"not a csv, tsv or txt file: {path}")
    return ext


# S7
def write_gene_table(genes: DataFrame, path: str) -> None:
    genes.select(F.col("gene").alias("Gene"), F.col("g_start").alias("Start"), F.col("g_end").alias("End"),
                 F.col("strand").alias("Strand"), F.col("sequence").alias("Sequence")).write.mode("overwrite").csv(path, header=True)


def _gene_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("Gene").alias("gene"), F.col("Start").alias("g_start"), F.col("End").alias("g_end"),
        F.col("Strand").alias("strand"), F.col("Sequence").alias("sequence"))


def read_gene_table(spark: SparkSession, path: str) -> DataFrame:
    return _gene_columns(spark.read.schema(GENE_SCHEMA).csv(path, header=True))


def parse_gene_table(lines: DataFrame, value: str = "value") -> DataFrame:
    """The gene table of text rows; header lines are left out."""
    header = ",".join(c.split()[0] for c in GENE_SCHEMA.split(", "))
    return _gene_columns(lines.where(F.col(value) != header).select(F.from_csv(value, GENE_SCHEMA).alias("r")).select("r.*"))


# S8
def sniff_delimiter(lines: list[str]) -> str:
    """The separator that occurs equally often, and at all, in each sample line; else a comma."""
    sample = [ln for ln in lines if ln.strip()]
    for d in DELIMITERS:
        counts = {ln.count(d) for ln in sample}
        if len(counts) == 1 and counts != {0}:
            return d
    return ","


def delimiter_of(lines: Column) -> Column:
    """`sniff_delimiter` of an array of sample lines."""
    sample = F.filter(lines, lambda ln: F.trim(ln) != "")
    out = F.lit(",")
    for d in reversed(DELIMITERS):
        counts = F.array_distinct(F.transform(sample, lambda ln: F.length(ln) - F.length(F.replace(ln, F.lit(d)))))  # noqa: B023
        out = F.when((F.size(counts) == 1) & (F.try_element_at(counts, F.lit(1)) != 0), d).otherwise(out)
    return out


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """A delimited upload as strings, headers trimmed, all-blank rows dropped. Five lines are sampled."""
    sep = sniff_delimiter([r.value for r in spark.read.text(path).limit(5).collect()])
    df = spark.read.csv(path, header=True, sep=sep)
    return drop_blank_rows(df.toDF(*[c.strip() for c in df.columns]))


def drop_blank_rows(df: DataFrame) -> DataFrame:
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    return df.where(F.exists(cells, lambda c: F.trim(c) != ""))


# S10
def header_columns(file: Column, header: Column) -> Column:
    """Column names of a header line, split by what the file's ending says; null for other endings."""
    ending = F.lower(F.regexp_extract(file, r"\.([^.]*)$", 1))
    out = F.lit(None).cast("array<string>")
    for name, sep in EXTENSIONS.items():
        out = F.when(ending == name, F.split(header, sep)).otherwise(out)
    return out


def file_columns(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True, sep=EXTENSIONS[_extension(path)]).columns


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep=EXTENSIONS[_extension(path)])


# S13
def parse_name_list(lines: DataFrame) -> DataFrame:
    return lines.select(F.trim("value").alias("gene"))


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_name_list(spark.read.text(path))


# S18
def plot_gene_names(tables: Iterable[DataFrame], column: str = "geneName") -> DataFrame:
    """Distinct non-null gene names of several tables; tables without the column add none."""
    out = None
    for df in tables:
        if column in df.columns:
            part = df.select(F.col(column).alias("gene")).where(F.col("gene").isNotNull())
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no table has a column {column!r}")
    return out.distinct()


# S14
def result_table(hits: DataFrame, with_tss: bool | None = None) -> DataFrame:
    """Hits in the results file's column order; the start-site column only when it is there."""
    have = hits.columns
    use_tss = "Distance_from_TSS" in have if with_tss is None else with_tss
    return hits.select(*[c for c in RESULT_COLUMNS if c in have and (c != "Distance_from_TSS" or use_tss)])


def write_results(hits: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Quoted CSV. The original leaves labels with commas unquoted; readers could not split those lines."""
    w = hits.write.mode("overwrite").option("header", True).option("quoteAll", True)
    (w.partitionBy(partition_by) if partition_by else w).csv(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions as JSON with alternatives nested and as CSV with them joined by `; `."""
    predictions.write.mode("overwrite").json(f"{path}/json")
    flat = F.array_join(F.transform("alternatives", lambda a: F.format_string("%s (%.3f)", a["function"], a["confidence"])), "; ")
    predictions.withColumn("alternatives", flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


# S16
def write_selection(sources: DataFrame, path: str) -> None:
    sources.select("gene", "sources").write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


# S17
def plot_tables(configs: dict[str, tuple[DataFrame, dict]]) -> DataFrame:
    """Points of every configured plot in one table, tagged by plot_id; bad configurations raise.

    Each value is (table, settings) with gene_col, x_col, y_col and optional title and thresholds.
    """
    out = None
    for plot_id, (df, cfg) in configs.items():
        missing = [cfg.get(k) for k in ("gene_col", "x_col", "y_col") if cfg.get(k) not in df.columns]
        if missing:
            raise ValueError(f"plot {plot_id}: no columns {missing}")
        pts = plot_points(df.select(cfg["gene_col"], cfg["x_col"], cfg["y_col"]), cfg["gene_col"], cfg["x_col"], cfg["y_col"],
                          cfg.get("title", ""), float(cfg.get("p_thresh", 0.05)), float(cfg.get("fc_thresh", 1.0)))
        pts = pts.withColumn("plot_id", F.lit(plot_id))
        out = pts if out is None else out.unionByName(pts)
    return out


def write_plots(plots: DataFrame, path: str) -> None:
    plots.write.mode("overwrite").partitionBy("plot_id").parquet(path)


def read_plots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_sif(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
