"""Best span over each point, by dyadic blocks.

A span splits into at most two aligned blocks of each power of two, and a point lies in one block of each. Aggregates per block
and a lookup of a point's blocks therefore give the best of all spans over it, in time that does not depend on how
many spans pile up there.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 34


def dyadic_blocks(start: Column, end: Column, levels: int = LEVELS) -> Column:
    """The blocks (level, no) that make up [start, end]; positions are at least 0 and below 2 ** levels."""
    s, e = start.cast("bigint"), end.cast("bigint") + 1

    def at(j: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), j)
        low, high = F.call_function("shiftright", s + size - 1, j), F.call_function("shiftright", e, j)
        left = F.when((low < high) & (low % 2 == 1), F.struct(j.alias("level"), low.alias("no")))
        right = F.when((low < high) & (high % 2 == 1), F.struct(j.alias("level"), (high - 1).alias("no")))
        return F.array(left, right)

    # No block is longer than the span.
    top = F.floor(F.log2(F.greatest(e - s, F.lit(1)).cast("double"))).cast("int") + 1
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.least(top, F.lit(levels - 1))), at)))


def best_over(
    points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, most: dict[str, Column] | None = None,
    least: dict[str, Column] | None = None, levels: int = LEVELS,
) -> DataFrame:
    """Distinct points (keys, at) under at least one span, with the maximum of each `most` and the minimum of each `least` over the spans."""
    most, least = most or {}, least or {}
    best = [F.max(n).alias(n) for n in most] + [F.min(n).alias(n) for n in least]
    blocks = spans.select(*keys, *[c.alias(n) for n, c in (most | least).items()], F.explode(dyadic_blocks(F.col(start), F.col(end), levels)).alias("b"))
    # Level and number as one key.
    blocks = blocks.groupBy(*keys, (F.col("b.no") * 64 + F.col("b.level")).alias("block")).agg(*best)
    # No block is longer than the longest span; the levels above it cost nothing.
    size = (F.floor(F.log2((F.col(end) - F.col(start) + 1).cast("double"))) + 1).cast("int")
    used = spans.where(F.col(end) >= F.col(start)).select(F.explode(F.sequence(F.lit(0), size)).alias("level")).distinct()
    # `used` has `levels` rows at most; joined by shuffle, all points of a level would meet in one task.
    up = points.select(*keys, at).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).join(F.broadcast(used), "level", "left_semi")
    up = up.select(*keys, at, (F.call_function("shiftright", F.col(at).cast("bigint"), F.col("level")) * 64 + F.col("level")).alias("block"))
    return up.join(blocks, [*keys, "block"]).groupBy(*keys, at).agg(*best)
