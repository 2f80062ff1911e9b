"""Shared plumbing of the training-data operators: tables, the shared folder, staging, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """Only the columns an operator works on, so that other columns of any name can't clash."""
    return df.select("doc_id", "text", *extra)


_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees (``spark.checkpoint.dir``).

    A folder of our own is made only where the session names none and the master is local, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own_dir:
        _own_dir["dir"] = "file://" + tempfile.mkdtemp(prefix="lexatlas-shared-")
    return _own_dir["dir"]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a frame of ``staged`` that nothing needs any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files whose plans are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_libc = ctypes.CDLL(None)


def trim() -> None:
    """Give freed memory of a Python worker back to the system, where the C library can; workers live on between tasks."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, component)``, component being the smallest id.

    Hash-min with pointer jumping: each round takes the smallest label among neighbours (an
    aggregation with map-side combine, so hubs cause no skew) and then each label's own label.
    Rounds are staged in the shared folder; nothing but a count reaches the driver.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        lower = labels.join(near, "id").select("id", F.least("component", "c").alias("now"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("now"), F.col("component").alias("far"))
        step = lower.join(jump, "now").select("id", F.least("now", "far").alias("component"), "was")
        step = staged(step, "labels")
        changed = step.where("component <> was").limit(1).count()
        drop_staged(labels)
        labels = step.select("id", "component")
        if not changed:
            drop_staged(both)
            return labels


#: Stands for a null id inside Python workers, where a column with nulls would become floating point.
NO_ID = -(1 << 63)


def map_by_id(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInPandas`` over a frame with ``doc_id``, whose nulls come and go as NO_ID and so stay exact integers."""
    solid = df.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    return solid.mapInPandas(function, schema).withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))
