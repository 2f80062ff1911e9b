"""Stages that are run again only for documents whose input changed.

A stage has a folder with numbered runs.  Run N writes to ``entries/run=N`` one row for each document that is there now (its key, the
fingerprint of its rows, and the run that holds its outputs), then to ``outputs/run=N`` the outputs of the documents it computed, and last a
commit with the settings.  A run that dies before its commit leaves folders that nobody reads.
The next run compares fingerprints: unchanged documents keep pointing to the run that made them, changed and
new ones are computed, and the outputs of documents that are gone have no entry any more.  Other settings, or another fingerprint of
what all documents depend on, compute everything anew.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT = "run long, settings string"


def fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """``key, fingerprint`` of each key's rows, whatever their order: their number, and sums of two hashes over all columns."""
    columns = sorted(c for c in rows.columns if c != key)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    hashes = rows.select(key, F.xxhash64(F.lit(1), text).alias("_a"), F.xxhash64(F.lit(2), text).alias("_b"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return hashes.groupBy(key).agg(F.concat_ws("/", F.count("*"), total("_a"), total("_b")).alias("fingerprint"))


def table_fingerprint(rows: DataFrame) -> str:
    """One fingerprint of a whole table, for settings of stages that depend on all of it."""
    found = fingerprints(rows.withColumn("_all", F.lit(0)), "_all").first()
    return found["fingerprint"] if found else "0"


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs that were begun."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/outputs")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    return [int(f.getPath().getName().split("=")[1]) for f in files.listStatus(place) if f.getPath().getName().startswith("run=")]


def _commits(spark: SparkSession, path: str) -> list[dict]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    done = [str(f.getPath()) for f in files.listStatus(place) if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted((r.asDict() for d in done for r in spark.read.schema(_COMMIT).json(d).collect()), key=lambda c: c["run"])  # one row each


def refresh(docs: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], path: str, settings: dict, keep: int = 1) -> tuple[DataFrame, dict[str, int]]:
    """The stage's outputs for ``docs``, computed only where needed; and how many documents were computed, kept and dropped.

    ``compute`` takes the documents to compute (all rows of their keys) and returns rows with ``key``, each made from rows of that key and what ``settings`` names.
    Null keys take no part.  The last ``keep`` runs before this one stay readable.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col(key).isNotNull())
    commits = _commits(spark, path)
    settings_text = json.dumps(settings, sort_keys=True)
    last = commits[-1] if commits and commits[-1]["settings"] == settings_text else None
    run = max([-1, *_folders(spark, path), *(c["run"] for c in commits)]) + 1
    now = fingerprints(docs, key)
    if last is None:
        entries = now.withColumn("made", F.lit(run).cast("long"))
    else:
        before = spark.read.parquet(f"{path}/entries/run={last['run']}").select(F.col(key).alias("_key"), F.col("fingerprint").alias("_old"), "made")
        matched = now.join(before, (F.col(key) == F.col("_key")) & (F.col("fingerprint") == F.col("_old")), "left")
        entries = matched.select(key, "fingerprint", F.coalesce("made", F.lit(run)).cast("long").alias("made"))
    # fixed before outputs are made from them
    entries.write.mode("overwrite").parquet(f"{path}/entries/run={run}")
    entries = spark.read.parquet(f"{path}/entries/run={run}")
    new = entries.where(F.col("made") == run).select(key)
    compute(docs.join(new, key, "left_semi")).write.mode("overwrite").parquet(f"{path}/outputs/run={run}")
    computed, total = new.count(), entries.count()
    spark.createDataFrame([(run, settings_text)], _COMMIT).coalesce(1).write.mode("overwrite").json(f"{path}/commits/run={run}")
    old = 0 if last is None else spark.read.parquet(f"{path}/entries/run={last['run']}").join(entries, key, "left_anti").count()
    _forget(spark, path, commits, entries, run, keep)
    return outputs(spark, path, key), {"computed": computed, "kept": total - computed, "dropped": old}


def outputs(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Outputs of the last committed run."""
    commits = _commits(spark, path)
    if not commits:
        raise FileNotFoundError(f"no run was committed in {path}")
    entries = spark.read.parquet(f"{path}/entries/run={commits[-1]['run']}").select(F.col(key).alias("_key"), "made")
    runs = sorted(r["made"] for r in entries.select("made").distinct().collect())  # one number for each run
    rows = None
    for n in runs:
        one = spark.read.parquet(f"{path}/outputs/run={n}").withColumn("_run", F.lit(n).cast("long"))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return spark.read.parquet(f"{path}/outputs/run={commits[-1]['run']}").where("false")
    return rows.join(entries, (F.col(key) == F.col("_key")) & (F.col("_run") == F.col("made")), "left_semi").drop("_run")


def _forget(spark: SparkSession, path: str, commits: list[dict], entries: DataFrame, run: int, keep: int) -> None:
    """Delete runs that neither this run's entries nor the ``keep`` commits before it point to."""
    needed = {run} | {r["made"] for r in entries.select("made").distinct().collect()}
    for c in commits[len(commits) - keep :] if keep else []:
        needed |= {c["run"]} | {r["made"] for r in spark.read.parquet(f"{path}/entries/run={c['run']}").select("made").distinct().collect()}
    for c in commits:
        if c["run"] not in needed:
            for part in ("commits", "entries", "outputs"):
                place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}/run={c['run']}")
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
