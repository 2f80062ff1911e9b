"""Stored flat vector indexes: Parquet shards of ``id, v`` beside a configuration; built in steps, checked, merged, loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_ROWS = 100_000


def _config(spark: SparkSession, path: str) -> dict | None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/config")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("model string, dims int").parquet(f"{path}/config").first().asDict()


def read(spark: SparkSession, path: str) -> DataFrame:
    """``id, v, shard`` of all shards; an index without any is an error."""
    if _config(spark, path) is None:
        raise FileNotFoundError(f"no vector index in {path}")
    return spark.read.parquet(f"{path}/vectors")


def unit(v: Column) -> Column:
    """``v`` at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def build(vectors: DataFrame, path: str, model: str, dims: int, shard_rows: int = SHARD_ROWS) -> int:
    """Append the vectors (id, v) that the index in ``path`` lacks; returns how many were added.

    A run that ended early is resumed by calling again: ids that are there are skipped.  Null ids, and ids that
    occur again, are left out; a vector of another length is an error, as is an index of another model.
    """
    spark = vectors.sparkSession
    known = _config(spark, path)
    if known is not None and (known["model"], known["dims"]) != (model, dims):
        raise ValueError(f"{path} holds {known['dims']} dimensions of {known['model']}, not {dims} of {model}")
    if known is None:
        spark.createDataFrame([(model, dims)], "model string, dims int").coalesce(1).write.parquet(f"{path}/config")
    rows = vectors.where("id is not null and v is not null").select("id", F.col("v").cast("array<float>").alias("v")).dropDuplicates(["id"])
    wrong = rows.where(F.size("v") != dims).limit(1).collect()
    if wrong:
        raise ValueError(f"vector {wrong[0]['id']} has {len(wrong[0]['v'])} dimensions, not {dims}")
    base = 0
    if known is not None and _has_vectors(spark, path):
        rows = rows.join(read(spark, path).select("id"), "id", "left_anti")
        numbers = spark.read.parquet(f"{path}/vectors").select("shard")
        if _exists(spark, f"{path}/records"):  # numbers of quarantined shards aren't used again
            numbers = numbers.union(_records(spark, path).select("shard"))
        last = numbers.agg(F.max("shard")).first()[0]
        base = 0 if last is None else last + 1
    n = rows.count()
    if n:
        shards = max(1, -(-n // shard_rows))
        dealt = rows.withColumn("shard", (F.lit(base) + F.pmod(F.xxhash64("id"), F.lit(shards))).cast("int"))
        dealt.repartition(shards, "shard").write.mode("append").partitionBy("shard").parquet(f"{path}/vectors")
        added = spark.read.parquet(f"{path}/vectors").where((F.col("shard") >= base) & (F.col("shard") < base + shards))
        _contents(added).coalesce(1).write.mode("append").parquet(f"{path}/records")
    return n


def _contents(rows: DataFrame) -> DataFrame:
    """``shard, n, digest``: row counts, and a sum of row hashes that the order of rows doesn't change."""
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "v").cast("decimal(38,0)")).cast("string").alias("digest"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard int, n long, digest string").parquet(f"{path}/records")


def damaged(spark: SparkSession, path: str) -> list[int]:
    """Shards whose rows aren't those that were written: files lost, cut short, altered or unreadable.  Quarantined ones don't count."""
    rows = spark.read.schema("id " + dict(_readable(spark, path).dtypes)["id"] + ", v array<float>, shard int").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(f"{path}/vectors")
    now = _contents(rows).withColumnsRenamed({"shard": "s", "n": "m", "digest": "d"})
    wrong = _records(spark, path).join(now, F.col("shard") == F.col("s"), "left").where(~(F.col("n").eqNullSafe(F.col("m")) & F.col("digest").eqNullSafe(F.col("d"))))
    if _exists(spark, f"{path}/quarantined"):
        wrong = wrong.join(spark.read.schema("shard int").parquet(f"{path}/quarantined"), "shard", "left_anti")
    return sorted(r["shard"] for r in wrong.select("shard").distinct().collect())  # numbers of shards


def repair(vectors: DataFrame, path: str, model: str, dims: int, shard_rows: int = SHARD_ROWS) -> tuple[list[int], int]:
    """Move damaged shards to ``quarantine`` and build only what they held; returns their numbers and how many vectors were written."""
    spark = vectors.sparkSession
    bad = damaged(spark, path)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    for n in bad:
        old, new = files.Path(f"{path}/vectors/shard={n}"), files.Path(f"{path}/quarantine/shard={n}")
        system = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(new.getParent())
        if system.exists(old) and not system.rename(old, new):
            raise OSError(f"could not move {old.toString()}")
    if bad:
        spark.createDataFrame([(n,) for n in bad], "shard int").coalesce(1).write.mode("append").parquet(f"{path}/quarantined")
    return bad, build(vectors, path, model, dims, shard_rows)


def _readable(spark: SparkSession, path: str) -> DataFrame:
    """The index read by the schema of any file that can be opened."""
    return spark.read.option("ignoreCorruptFiles", "true").parquet(f"{path}/vectors")


def _has_vectors(spark: SparkSession, path: str) -> bool:
    return _exists(spark, f"{path}/vectors/_SUCCESS")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """``shard, n_vectors, min_dims, max_dims, n_bad`` of each shard; bad vectors hold null or non-finite components."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return read(spark, path).groupBy("shard").agg(F.count("*").alias("n_vectors"), F.min(F.size("v")).alias("min_dims"), F.max(F.size("v")).alias("max_dims"), F.count_if(bad).alias("n_bad"))


def validate(spark: SparkSession, path: str, expected: int | None = None) -> int:
    """Number of vectors; a corrupt shard, an id that occurs again, or more vectors than ``expected`` is an error."""
    config, found = _config(spark, path), shards(spark, path)
    wrong = found.where((F.col("n_bad") > 0) | (F.col("min_dims") != config["dims"]) | (F.col("max_dims") != config["dims"])).limit(1).collect()
    if wrong:
        raise ValueError(f"shard {wrong[0]['shard']} of {path} is corrupt: repair the index")
    n = found.agg(F.sum("n_vectors")).first()[0] or 0
    if read(spark, path).groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError(f"an id occurs twice in {path}")
    if expected is not None and n > expected:
        raise ValueError(f"{path} holds {n} vectors, but there are {expected} rows")
    return n


def merge(spark: SparkSession, paths: list[str], out: str) -> int:
    """One index of several of the same model and dimensions; of an id in several the first path's vector stays."""
    configs = [_config(spark, p) for p in paths]
    if not paths or None in configs or any(c != configs[0] for c in configs):
        raise ValueError("indexes to merge must exist and agree in model and dimensions")
    rows = None
    for k, p in enumerate(paths):
        one = read(spark, p).select("id", F.struct(F.lit(k).alias("k"), "v").alias("x"))
        rows = one if rows is None else rows.unionByName(one)
    return build(rows.groupBy("id").agg(F.min_by("x", "x.k").alias("x")).select("id", "x.v"), out, configs[0]["model"], configs[0]["dims"])


def load(spark: SparkSession, path: str, metadata: DataFrame, model: str, key: str = "chunk_id") -> DataFrame:
    """Vectors with their metadata, if the index is whole: same model, and one vector for each row of ``metadata``."""
    config = _config(spark, path)
    if config is None or config["model"] != model:
        raise ValueError(f"{path} is no index of {model}")
    n, rows = validate(spark, path), metadata.count()
    if n != rows:
        raise ValueError(f"{path} holds {n} vectors for {rows} rows")
    joined = metadata.join(read(spark, path).select(F.col("id").alias(key), "v"), key)
    if joined.count() != rows:
        raise ValueError(f"vectors of {path} belong to other rows")
    return joined


def moved(path: Column, folder: str) -> Column:
    """A shard's path after it was moved to ``folder``: the name stays."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract(path, r"([^/\\]*)$", 1))
