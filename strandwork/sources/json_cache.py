"""JSON snapshots, gene tables and outlines."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENE = "map<string, struct<start: bigint, `end`: bigint, strand: string, sequence: string>>"


# S6
def parse_gene_json(docs: DataFrame) -> DataFrame:
    """(gene, g_start, g_end, strand, sequence, ordinal) of JSON objects keyed by gene name.

    `ordinal` keeps the order of the keys, which decides what "first gene" means. A key that an object
    repeats keeps its first place and its last value. Genes without coordinates are left out.
    """
    rest = [c for c in docs.columns if c != "value"]
    keys = docs.select(*rest, F.array_sort(F.transform(
        F.map_entries(F.from_json("value", GENE)), lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value")))).alias("_k"))
    other = lambda x, i: F.get("_k", i)["key"].isNull() | (F.get("_k", i)["key"] != x["key"])
    firsts = F.filter("_k", lambda x, i: other(x, i - 1))
    lasts = F.filter("_k", lambda x, i: other(x, i + 1))
    once = F.zip_with(firsts, lasts, lambda a, b: F.struct(a["at"].alias("at"), b["key"].alias("key"), b["value"].alias("value")))
    rows = keys.select(*rest, F.posexplode(F.array_sort(once)).alias("ordinal", "e"))
    return rows.select(*rest, F.col("e.key").alias("gene"), F.col("e.value.start").alias("g_start"),
                       F.col("e.value.end").alias("g_end"), F.col("e.value.strand").alias("strand"),
                       F.col("e.value.sequence").alias("sequence"), "ordinal").where(
        F.col("g_start").isNotNull() & F.col("g_end").isNotNull())


def read_gene_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_gene_json(spark.read.text(path, wholetext=True))


# S11
def parse_cache(docs: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON snapshots under `schema`, one snapshot per row.

    A byte-order mark is ignored, a `data` envelope is unwrapped, and a malformed snapshot has no
    rows. A list yields one row per element, an object one row.
    """
    rest = [c for c in docs.columns if c != "value"]
    text = F.regexp_replace("value", "^﻿", "")
    inner = F.coalesce(F.get_json_object(text, "$.data"), text)
    many = F.from_json(inner, f"array<struct<{schema}>>")
    one = F.from_json(inner, f"struct<{schema}>")
    listed = F.when(F.ltrim(inner).startswith("["), many).otherwise(F.when(one.isNotNull(), F.array(one)))
    return docs.select(*rest, F.explode(listed).alias("_r")).select(*rest, "_r.*")


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A snapshot file; a missing file is an empty table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", path.rsplit("/", 1)[-1]).load(path.rsplit("/", 1)[0])
    return parse_cache(files.select(F.decode("content", "UTF-8").alias("value")), schema)


# S12
def parse_outline(lines: DataFrame) -> DataFrame:
    """(dot, name, level, parent_dot) of lines such as `1.2.3 Name`; other lines are skipped."""
    hit = lines.select(
        F.regexp_extract("value", r"^\s*(\d+(?:\.\d+)*)\.?\s+(.+?)\s*$", 1).alias("dot"),
        F.regexp_extract("value", r"^\s*(\d+(?:\.\d+)*)\.?\s+(.+?)\s*$", 2).alias("name")).where(F.col("dot") != "")
    return hit.select("dot", "name", F.size(F.split("dot", r"\.")).alias("level"),
                      F.when(F.contains("dot", F.lit(".")), F.regexp_replace("dot", r"\.[^.]+$", "")).alias("parent_dot"))


def read_outline(spark: SparkSession, path: str) -> DataFrame:
    return parse_outline(spark.read.text(path))


# A25
CATEGORY = ("id bigint, name string, dot_notation string, parent_id bigint, genes array<struct<id: bigint, name: string>>, "
            "children array<struct<id: bigint>>")


def category_members(payload: DataFrame) -> DataFrame:
    """(category, gene) of nested category details."""
    return payload.select(F.col("name").alias("category"), F.explode("genes").alias("g")).select(
        "category", F.col("g.name").alias("gene")).where(F.col("gene").isNotNull())


def category_details(payload: DataFrame) -> DataFrame:
    """One row per category with its gene count and children."""
    return payload.select(
        "id", "name", "dot_notation", "parent_id", F.coalesce(F.size("genes"), F.lit(0)).alias("gene_count"),
        F.transform("children", lambda c: c["id"]).alias("children_ids"))
