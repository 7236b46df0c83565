"""From raw documents to token ids: quality, near-duplicates, benchmark leaks, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but the last return the
columns of `documents`.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwork.llm import bpe, decontaminate, near_dedup, quality, secret_scan
from strandwork.llm.common import stored, table

#: The co-trained model, its thresholds and the later stages have no SQL form.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays: five-word shingles, similarity of 0.8 or more.

    Rows without id stay, as do texts without words. Rows that repeat an id are judged by their own texts; of those that are near copies of each other the first by
    its text and then its other columns stays.
    """
    found = stored(near_dedup.near_duplicates(docs, size=5, percent=80, tell_texts=True), "stage-near")
    row = ["doc_id", "text_key"]
    gone = found.where("NOT kept").select(row).distinct()
    left = docs.withColumn("text_key", F.xxhash64(F.col("text").cast("string"))).join(gone, row, "left_anti")
    shared = found.where("kept AND component IS NOT NULL").groupBy("doc_id", "component").count().where("count > 1").select("doc_id", "component")
    if shared.isEmpty():
        return left.select(docs.columns)
    twice = stored(found.join(shared, ["doc_id", "component"]).select(*row, "component").distinct(), "stage-near-twice")
    ranked = left.join(twice, row).withColumn("rank_", F.row_number().over(Window.partitionBy("doc_id", "component").orderBy("text", *[c for c in docs.columns if c != "text"])))
    return left.join(twice, row, "left_anti").select(docs.columns).union(ranked.where("rank_ = 1").select(docs.columns))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with at most a tenth of it edited, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_scan.redact(docs, length_col="n_chars")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, packed as little-endian unsigned 32-bit integers, and whether they decode to the same text."""
    rows = docs.select("doc_id", "text")
    coded = bpe.encode(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [("quality classifier", quality_stage), ("near-dedup", near_dedup_stage), ("decontamination", decontaminate_stage), ("secret scan", secrets_stage), ("byte-level BPE", encode_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
