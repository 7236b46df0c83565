"""Scalar functions behind the expression plots."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import col

# The ends and the middle of the diverging colour scale.
BLUE, WHITE, RED = (33, 102, 172), (247, 247, 247), (178, 24, 43)
NO_DATA_COLOUR = "#fff"
P_THRESHOLD, FC_THRESHOLD = 0.05, 1.0


# F9
def neg_log10(p: Column | str) -> Column:
    return -F.log10(col(p))


def neg_log10_threshold(p_threshold: float = P_THRESHOLD) -> float:
    return -math.log10(p_threshold)


# F10
def passes_threshold(x: Column | str, y: Column | str, fc: float | None = None, y_min: float | None = None) -> Column:
    """|x| and y reach their thresholds; 1 and 1.3 stand in for missing ones."""
    return (F.abs(col(x)) >= (fc if fc else 1.0)) & (col(y) >= (y_min if y_min else 1.3))


# F17
def diverging_colour(df: DataFrame, value: str, out: str = "colour") -> DataFrame:
    """`rgb(r, g, b)` on a white-to-blue or white-to-red scale of value / max |value|."""
    top = df.agg(F.max(F.abs(value))).scalar()
    t = F.when(top == 0, 0.0).otherwise(F.col(value) / top)
    parts = [
        F.floor(w + F.abs(t) * (F.when(t < 0, b).otherwise(r) - w) + 0.5).cast("int")
        for b, w, r in zip(BLUE, WHITE, RED)
    ]
    rgb = F.format_string("rgb(%d, %d, %d)", *parts)
    return df.withColumn(out, F.when(F.col(value).isNull(), NO_DATA_COLOUR).otherwise(rgb))


# F18
def track_opacity(value: Column | str) -> Column:
    return F.least(F.lit(0.8), F.abs(col(value)) / 5)


def regulation_class(value: Column | str) -> Column:
    return F.when(col(value) > 0, "up").otherwise("down")


# F20
# The key prefixes that name a category kind.
KINDS = ("group", "regulation", "regulon", "reaction", "material", "pathway")


def category_kind(key: Column | str) -> Column:
    c = col(key)
    prefix = F.substring_index(c, "_", 1)
    return (
        F.when(c.startswith("individual"), "individual")
        .when(c.contains("_") & prefix.isin(*KINDS), prefix).otherwise("unknown")
    )
