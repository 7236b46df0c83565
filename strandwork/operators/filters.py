"""Hit filters, ordering and numbering."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# P1
def touches_region(first: int, last: int) -> Column:
    """An endpoint lies in the region; a hit that spans the whole region does not count."""
    return F.col("start").between(first, last) | F.col("end").between(first, last)


# P2
def overlaps_region(first: int, last: int) -> Column:
    return (F.col("start") <= last) & (F.col("end") >= first)


# P3
def within_mismatches(k: int) -> Column:
    return F.col("mismatches") <= k


# P4
def label_says(kind: str, label: str = "location") -> Column:
    """Label tests: 'in', 'between', 'intergenic', and 'map_in' / 'map_between' for map labels."""
    c = F.col(label)
    return {
        "in": c.contains("(in)"), "between": ~c.contains("(in)"),
        "intergenic": c.contains("---") & ~c.contains("(in)"),
        "map_in": c.contains("[In]"), "map_between": ~c.contains("[In]"),
    }[kind]


# P5
def filter_or_all(df: DataFrame, keep: Column) -> DataFrame:
    """The rows that pass, or every row when none does."""
    passing = df.agg(F.count_if(keep)).scalar()
    return df.where(keep | (passing == 0))


# W1
def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key by `order`: a partial aggregate, so a hot key shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*[c if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


# W2, W7
def by_position(hits: DataFrame, limit: int | None = None) -> DataFrame:
    out = hits.orderBy("contig_id", "start", "strand", "pattern")
    return out.limit(limit) if limit is not None else out


# W6
def numbered(rows: DataFrame, keys: list[str], order: list[str], out: str = "match_no", block: int = 1 << 20) -> DataFrame:
    """1-based number of each row within its key, in `order`, whose first column is an integer.

    Numbers are counted inside blocks of that column and shifted by the sizes of earlier
    blocks, so a key that holds most rows is not ordered in a single task.
    """
    keyed = rows.withColumn("_blk", F.floor(F.col(order[0]) / block))
    sizes = keyed.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_blk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    return keyed.withColumn("_in", F.row_number().over(w)).join(shift, [*keys, "_blk"]).withColumn(
        out, F.col("_in") + F.col("_shift")).drop("_blk", "_in", "_shift")


def number_hits(hits: DataFrame, block: int = 1 << 20) -> DataFrame:
    return numbered(hits, ["contig_id"], ["start", "strand", "pattern"], "match_no", block)


def every_nth(numbered_hits: DataFrame, n: int = 10) -> DataFrame:
    """Label thinning: the 1st, (n+1)th, ... of each contig."""
    return numbered_hits.where((F.col("match_no") - 1) % n == 0)


# F19
def match_name(number: str = "match_no", label: str = "location") -> Column:
    """`Match_i_label` with brackets removed and parentheses turned into one underscore."""
    return F.concat(F.lit("Match_"), F.col(number), F.lit("_"), F.translate(label, "(])[", "_"))
