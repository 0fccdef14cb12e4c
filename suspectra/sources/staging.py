"""Intermediate tables in a folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Where that is unset, a temporary one, in local mode only: other executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="suspectra-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _file_system(spark, path)
    return files.exists(at)


def new_folder(spark: SparkSession, name: str) -> str:
    """An empty shared folder that goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/suspectra/{name}-{uuid.uuid4().hex}"
    at, files = _file_system(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. The
    table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
