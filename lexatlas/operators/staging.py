"""Intermediate tables in the folder that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, which only a local master can share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lexatlas-plans-"))
    return _own[0]


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which goes when the session ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, for plans that use it several times; the files go when the session ends."""
    spark = df.sparkSession
    path = f"{fresh_folder(spark, label)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
