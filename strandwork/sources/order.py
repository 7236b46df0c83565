"""Load order of lines over several files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str | list[str], out: str = "ordinal") -> DataFrame:
    """(value, out): lines with a gapless number from 0 in the order of (file, place in the file), however splits are packed into tasks.

    Readers cut files into blocks; lines are counted per block and shifted by the counts of earlier blocks, a table with one row for each block.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    blocks = lines.groupBy("_file", "_block").agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select("_file", "_block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return lines.join(shifts, ["_file", "_block"]).select("value", (F.col("_line") + F.col("_shift")).alias(out))
