"""Sources and sinks."""

from __future__ import annotations

from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def require_columns(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path, content`` of every file below ``root``, those of no bytes included.

    Spark's scans leave out files of no bytes.  Their names come from the scan's own file index, which the driver
    holds in any case; the second read is of paths alone.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")
    same = lambda path: F.regexp_replace(path, "^file:/+", "file:/")
    raw = raw.withColumn("path", same("path"))
    listed = spark.createDataFrame([(unquote(f),) for f in raw.inputFiles()], "path string").select(same("path").alias("path"))
    return raw.union(listed.join(raw.select("path"), "path", "left_anti").select("path", F.lit(b"")))


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_text_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.txt`` below ``root`` as one row: doc_id, file_name, relative_path, part, raw_text.

    Files are decoded as UTF-8; bytes that are no UTF-8 are left out, replacement characters of the text itself stay.  An empty file is a
    row with an empty text.  Only files that aren't valid go to a Python worker.
    """
    raw = _files(spark, root, "*.txt").where(_name(F.col("path")).endswith(".txt"))
    top = root.split("://")[-1].rstrip("/").lstrip("/")
    rel = F.regexp_replace("path", rf"^.*?{_quoted(top)}/", "")
    strict = F.try_validate_utf8(F.col("content").cast("string"))
    df = raw.select(rel.alias("relative_path"), strict.alias("strict"), F.when(strict.isNull(), F.col("content")).alias("odd"))
    text = F.coalesce("strict", _decoded("odd"))
    return df.select(T.safe_id(F.col("relative_path")).alias("doc_id"), F.element_at(F.split("relative_path", "/"), -1).alias("file_name"), "relative_path", F.when(F.col("relative_path").contains("/"), F.element_at(F.split("relative_path", "/"), 1)).alias("part"), text.alias("raw_text"))


def _decoded(content: str) -> Column:
    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else bytes(x).decode("utf-8", "ignore") for x in content], dtype=object)

    return run(content)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def document_table(raw: DataFrame) -> DataFrame:
    """The documents table: cleaned text and counts before and after."""
    d = raw.withColumn("clean_text", T.clean(F.col("raw_text")))
    return d.withColumns({f"{k}_char_count": F.length(f"{k}_text") for k in ("raw", "clean")} | {f"{k}_word_count": T.word_count(F.col(f"{k}_text")) for k in ("raw", "clean")})


def read_xml_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, xml`` of every XML file below ``root``."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def file_parts(spark: SparkSession, root: str) -> DataFrame:
    """Bare file name to its folder."""
    return _files(spark, root, "*").select(_name(F.col("path")).alias("file_name"), F.element_at(F.split("path", "/"), -2).alias("part")).distinct()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("doc_id")).where("doc_id <> ''")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return require_columns(df, columns, path).select(*columns) if columns else df


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write by suffix: .parquet, .csv (with header) or .json."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"no sink for .{kind}: use .parquet, .csv or .json")
    writer = df.write.mode(mode)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_xml(df: DataFrame, path: str, root: str = "documents", row: str = "document") -> None:
    df.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def unprocessed(todo: DataFrame, done: DataFrame, key: str = "suspicious_doc_id", fresh: bool = False) -> DataFrame:
    """What a resumed run still has to do."""
    return todo if fresh else todo.join(done.select(key).distinct(), key, "left_anti")
