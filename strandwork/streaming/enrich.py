"""Incremental enrichment of a results folder (T1) and its per-file summary."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = "Start bigint, End bigint, Strand string, Pattern string, Found_Sequence string, Location string, Mismatches int"


def enrich_batch(
    batch: DataFrame, enrich: Callable[[DataFrame], DataFrame], required: tuple[str, ...] = ("Start", "End", "Strand", "Location"),
) -> tuple[DataFrame, DataFrame]:
    """The enriched rows of a batch, and the rejected ones, which lack a required value."""
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    return enrich(batch.where(~bad)), batch.where(bad)


def enrich_folder(
    spark: SparkSession, folder: str, out: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame],
    schema: str = RESULTS, required: tuple[str, ...] = ("Start", "End", "Strand", "Location"),
) -> None:
    """Enrich every CSV file of `folder` that has not been enriched yet, then stop.

    The stream's checkpoint remembers the files, in place of a name suffix. Rows that lack a
    required value go to `out`/rejected with their file, so a bad file does not stop the others.
    Batches write to folders named by their id, so a replayed batch replaces itself.
    """
    rows = spark.readStream.schema(schema).option("header", True).csv(folder).withColumn("file", F.col("_metadata.file_path"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        done, rejected = enrich_batch(batch, enrich, required)
        done.write.mode("overwrite").parquet(f"{out}/enriched/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
        batch.unpersist()

    q = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def folder_summary(rows: DataFrame, bad: str) -> DataFrame:
    """(file, rows, failed, status) of rows tagged with their file."""
    per = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(bad)).alias("failed"))
    return per.withColumn("status", F.when(F.col("failed") == F.col("rows"), "failed").otherwise("success"))
