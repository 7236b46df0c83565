"""FASTA and plain-sequence sources.

`parse_*` functions take text DataFrames (column `value`), so that lines from any source can
be used; `read_*` functions read files.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .order import numbered_lines

POLICIES = ("first_header", "all_headers", "bases_only")
#: Bases in a piece of a sequence, at most.
PIECE = 1 << 16


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per FASTA record (value, file, record_no), split where a line starts with `>`.

    `record_no` grows with the position in a file.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("record_no"))


def _header(value: Column) -> Column:
    line = F.substring_index(F.regexp_replace(value, r"\r", ""), "\n", 1)
    return F.trim(F.regexp_replace(line, "^>", ""))


def _body(value: Column) -> Column:
    """Everything after the header line, joined and upper-cased."""
    text = F.regexp_replace(value, r"\r", "")
    rest = F.regexp_replace(text, r"^[^\n]*\n?", "")
    return F.upper(F.regexp_replace(rest, r"\s", ""))


# S1
def parse_contigs(records: DataFrame) -> DataFrame:
    """(header, contig_id, seq) of FASTA records; the contig id is the header's first word."""
    h = _header(F.col("value"))
    rest = [c for c in records.columns if c != "value"]
    return records.select(h.alias("header"), F.substring_index(h, " ", 1).alias("contig_id"), _body(F.col("value")).alias("seq"), *rest)


def read_contigs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Multi-record FASTA as contigs, each record its own row."""
    return parse_contigs(read_records(spark, path))


def genome_text(policy: str = "all_headers", text: str = "value") -> Column:
    """A whole file as one upper-case sequence.

    `first_header` skips only a header in the first line, `all_headers` every header line, and
    `bases_only` also every letter outside ACGTU, which shifts coordinates.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    t = F.regexp_replace(text, r"\r", "")
    body = F.regexp_replace(t, r"^>[^\n]*\n?", "") if policy == "first_header" else F.regexp_replace(t, r"(?m)^>[^\n]*\n?", "")
    seq = F.upper(F.regexp_replace(body, r"\s", ""))
    return F.regexp_replace(seq, "[^ACGTU]", "") if policy == "bases_only" else seq


def read_genomes(spark: SparkSession, path: str | list[str], policy: str = "all_headers") -> DataFrame:
    """One row per file: contig_id is the file path and seq its whole sequence."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("contig_id"), genome_text(policy).alias("seq"))


# S1, files of any size
def read_pieces(spark: SparkSession, path: str | list[str], policy: str = "records", piece: int = PIECE) -> DataFrame:
    """Sequences as pieces (contig_id, contig_len, at, bases), read by byte ranges.

    Every task reads the lines of its own blocks of the files, so one record of any length is read by all tasks; only a line is never
    cut by a reader. `policy` is `records` for a contig per FASTA record, or one of `genome_text` for a contig per file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    return _placed(lines.mapInArrow(_gather(policy, piece), _GATHERED), policy)


def parse_pieces(lines: DataFrame, policy: str = "records", piece: int = PIECE) -> DataFrame:
    """`read_pieces` of a table of lines (file, block, line, value) in any order; blocks and lines are numbered upwards, a file's first block is 0."""
    sorted_ = lines.select("file", "block", "line", "value").repartition("file", "block").sortWithinPartitions("file", "block", "line")
    return _placed(sorted_.mapInArrow(_gather(policy, piece), _GATHERED), policy)


_GATHERED = "file string, block long, record int, header string, at long, bases string"


def _gather(policy: str, piece: int):
    """Pieces of each block: their record's number in the block (0 goes on from earlier blocks) and the record's bases before them in the block.

    A row without bases brings a header. Lines of a block come in order.
    """
    if policy not in (*POLICIES, "records"):
        raise ValueError(f"unknown policy {policy!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, record, at, first = None, 0, 0, True
        for batch in batches:
            out: list[tuple] = []
            held: list[str] = []

            def close() -> None:
                nonlocal at
                text = re.sub(r"\s", "", "".join(held)).upper()
                if policy == "bases_only":
                    text = re.sub("[^ACGTU]", "", text)
                out.extend((*now, record, None, at + i, text[i:i + piece]) for i in range(0, len(text), piece))
                at += len(text)
                held.clear()

            for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now != (file, block):
                    if now is not None:
                        close()
                    now, record, at, first = (file, block), 0, 0, block == 0
                if value is None:
                    continue
                if value.startswith(">") and (policy != "first_header" or first):
                    close()
                    if policy == "records":
                        record, at = record + 1, 0
                        out.append((*now, record, value.replace("\r", "")[1:].strip(" "), 0, ""))
                else:
                    held.append(value)
                first = False
            if now is not None:
                close()
            names = ["file", "block", "record", "header", "at", "bases"]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _placed(pieces: DataFrame, policy: str) -> DataFrame:
    """Pieces with places in their contig: sums over the records of a block, then over the blocks of a file."""
    parts = pieces.groupBy("file", "block", "record").agg(F.max("header").alias("header"), F.sum(F.length("bases")).cast("bigint").alias("size"))
    heads = parts.groupBy("file", "block").agg(F.max("record").alias("heads"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("file", "block", F.coalesce(F.sum("heads").over(earlier), F.lit(0)).alias("before"))
    numbered = parts.join(heads, ["file", "block"]).withColumn("number", F.col("before") + F.col("record"))
    # A record's rows are one per block that it reaches into.
    whole = Window.partitionBy("file", "number")
    run = whole.orderBy("block", "record").rowsBetween(Window.unboundedPreceding, -1)
    header = F.max("header").over(whole)
    own = F.col("file") if policy != "records" else F.coalesce(F.substring_index(header, " ", 1), F.col("file"))
    rows = numbered.select("file", "block", "record", own.alias("contig_id"), F.sum("size").over(whole).alias("contig_len"), F.coalesce(F.sum("size").over(run), F.lit(0)).alias("shift"))
    return pieces.where("bases <> ''").join(rows, ["file", "block", "record"]).select(
        "contig_id", "contig_len", (F.col("at") + F.col("shift")).alias("at"), "bases")


# S2
def parse_queries(records: DataFrame) -> DataFrame:
    """(query, pattern): a repeated header restarts, so its last record counts."""
    named = parse_contigs(records).select(F.concat(F.lit(">"), "header").alias("query"), "seq", "record_no")
    return named.groupBy("query").agg(F.max_by("seq", "record_no").alias("pattern"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return parse_queries(read_records(spark, path))


# S3
def parse_annotations(headers: DataFrame, key_by_locus: bool = False) -> DataFrame:
    """(name, locus_tag, g_start, g_end, strand) from `[gene=] [locus_tag=] [location=]` headers.

    Start and end are the smallest and largest number of the location, so a join becomes its
    span. With `key_by_locus` later genes replace earlier ones of the same tag, genes without
    a tag sharing `N/A`; `headers` then needs an `ordinal`.
    """
    loc = F.regexp_extract("value", r"\[location=([^\]]+)\]", 1)
    field = lambda tag, none: F.coalesce(
        F.nullif(F.regexp_extract("value", rf"\[{tag}=([^\]]+)\]", 1), F.lit("")), F.lit(none))
    numbers = F.transform(F.regexp_extract_all(loc, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))
    rest = [c for c in headers.columns if c != "value"]
    out = headers.select(
        field("gene", "unknown").alias("name"), field("locus_tag", "N/A").alias("locus_tag"),
        F.array_min(numbers).alias("g_start"), F.array_max(numbers).alias("g_end"),
        F.when(loc.contains("complement"), "-").otherwise("+").alias("strand"), *rest,
    ).where(F.col("g_start").isNotNull())
    if not key_by_locus:
        return out
    cols = [c for c in out.columns if c != "locus_tag"]
    return out.groupBy("locus_tag").agg(F.max_by(F.struct(*cols), F.struct("g_start", "ordinal")).alias("_g")).select("locus_tag", "_g.*")


def read_annotations(spark: SparkSession, path: str, key_by_locus: bool = False) -> DataFrame:
    return parse_annotations(numbered_lines(spark, path).where(F.col("value").startswith(">")), key_by_locus)
