"""What the operators share: work tables in the cluster's shared folder, Arrow batch sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from wayfare.operators.tables import checked

_LOCAL_WORK: list[str] = []


def work_root(spark: SparkSession) -> str:
    """The folder for work tables: spark.checkpoint.dir or what setCheckpointDir() was given, which all executors share.

    Where neither is set, a local master gets one temporary folder per process, and a
    cluster the warehouse folder. A cluster's folder can't be local to a machine: that is tried once, see checked().
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.startswith("local"):
            if not _LOCAL_WORK:
                folder = tempfile.mkdtemp(prefix="wayfare-work-")
                atexit.register(shutil.rmtree, folder, ignore_errors=True)
                _LOCAL_WORK.append(folder)
            return "file://" + _LOCAL_WORK[0]
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return checked(spark, root)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as a Parquet work table and reads it back: cut lineage that survives executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes work tables that no returned frame reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bounds the rows of an Arrow batch, so that very long texts don't add up in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
