"""Session helpers: a tuned local session and the shared checkpoint folder."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "strandwork", checkpoints: str | None = None) -> SparkSession:
    """A session for tests and benchmarks. On a cluster use the one you are given."""
    builder = SparkSession.builder
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints).config("spark.sql.warehouse.dir", f"{checkpoints}/warehouse")
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Point the session at its configured checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``; where that is unset, it is one in the warehouse,
    which the driver and all executors share as well.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder and drop its lineage."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in a folder of their own below the checkpoint folder, deleted together when their work is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{use_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        """Write `df` as Parquet and read it back, which cuts its lineage."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete the tables. Spark deletes shuffle files when the driver collects their plans as garbage, which a short loop may not do by itself."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()
