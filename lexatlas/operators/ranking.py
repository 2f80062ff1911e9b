"""Roll-up of chunk candidates to documents, and the rankings over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of documents by branch: all descending, the source id breaks ties.
ORDERS = {
    "tfidf": ("max_score", "unique_suspicious_chunks", "match_count", "mean_score"),
    "lexical": ("max_score", "match_count", "mean_score"),
    "embedding": ("max_score", "mean_score", "match_count"),
    "mean": ("mean_score", "match_count", "max_score"),
    "fusion_input": ("max_score", "mean_score"),
}


def roll_up(candidates: DataFrame, by: str = "suspicious_doc_id") -> DataFrame:
    """One row for each pair of documents from candidates of their chunks."""
    return candidates.groupBy(by, "source_doc_id").agg(F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.count("*").alias("match_count"), F.countDistinct("source_chunk_id").alias("unique_source_chunks"), F.countDistinct("suspicious_chunk_id").alias("unique_suspicious_chunks"))


def top_documents(rolled: DataFrame, order: str = "lexical", n: int = 50, min_match_count: int = 1, by: str = "suspicious_doc_id") -> DataFrame:
    keys = [F.desc(c) for c in ORDERS[order]]
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*keys, "source_doc_id"))
    return rolled.where(F.col("match_count") >= min_match_count).withColumn("source_doc_rank", rank).where(F.col("source_doc_rank") <= n)


def first_of(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_first = 1").drop("_first")


def ids_containing(df: DataFrame, part: str, col: str = "doc_id") -> DataFrame:
    """Rows whose id has ``part`` in it, in any case; an empty part keeps all."""
    return df.where(F.contains(F.lower(F.col(col).cast("string")), F.lit(part.lower())))


def first_documents(df: DataFrame, n: int, col: str = "doc_id") -> DataFrame:
    """The first ``n`` rows by id: a top-n, so no partition sends more than n."""
    return df.orderBy(col).limit(n)


def of_document(found: DataFrame, doc_id, col: str = "suspicious_doc_id") -> DataFrame:
    """Rows of one document; none is an error, while runs over all documents leave it out."""
    rows = found.where(F.col(col) == F.lit(doc_id))
    if rows.isEmpty():
        raise LookupError(f"nothing was found for {doc_id}")
    return rows
