"""Span operators: merging with a gap, unions, coverage, relocation and extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking, interval_join, simjoin


def islands(df: DataFrame, by: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Number runs of intervals whose start is at most ``gap`` beyond the furthest end before (column ``island``)."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) - reach > gap), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_matches(matches: DataFrame, gap: int = 1800, score: str = "score") -> DataFrame:
    """Best match of each suspicious chunk, then spans of each pair of documents merged across gaps up to ``gap``.

    Extents and the score are the extremes of a run; other columns come from its first row.
    """
    pick = F.row_number().over(Window.partitionBy("suspicious_doc_id", "suspicious_start_char", "suspicious_end_char").orderBy(F.desc(score), "source_doc_id", "source_start_char"))
    best = matches.withColumn("_p", pick).where("_p = 1").drop("_p")
    pair = ["suspicious_doc_id", "source_doc_id"]
    run = islands(best, pair, "suspicious_start_char", "suspicious_end_char", gap)
    merged = run.groupBy(*pair, "island").agg(F.min("suspicious_start_char").alias("suspicious_start_char"), F.max("suspicious_end_char").alias("suspicious_end_char"), F.min("source_start_char").alias("source_start_char"), F.max("source_end_char").alias("source_end_char"), F.max(score).alias(score), F.count("*").alias("n_merged"))
    return merged.drop("island")


def union(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Disjoint intervals that cover the same places; touching ones are joined."""
    return islands(df, by, start, end).groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def covered(df: DataFrame, by: list[str], start: str, end: str) -> Column:
    """Per row, the length it adds to the union of those before it: the sum over a group is the union's length."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(F.max(end).over(w), F.col(start))))


def extend_by_trigrams(confirmed: DataFrame, suspicious: DataFrame, sources: DataFrame, window: int = 800, stride: int = 400, least: float = 0.12, gap: int = 1800) -> DataFrame:
    """Confirmed spans and merged windows of high trigram similarity with each document's dominant source.

    The dominant source is the one with the most confirmed characters; windows inside a confirmed span are skipped.
    ``suspicious`` and ``sources``: doc_id, text.
    """
    size = confirmed.groupBy("suspicious_doc_id", "source_doc_id").agg(F.sum(F.col("suspicious_end_char") - F.col("suspicious_start_char")).alias("chars"))
    lead = F.row_number().over(Window.partitionBy("suspicious_doc_id").orderBy(F.desc("chars"), "source_doc_id"))
    lead = size.withColumn("_r", lead).where("_r = 1").select("suspicious_doc_id", F.col("source_doc_id").alias("lead"))
    q = chunking.char_windows(suspicious.join(lead, suspicious["doc_id"] == lead["suspicious_doc_id"]).select("doc_id", "text"), "doc_id", "text", window, stride)
    sure = confirmed.select(F.col("suspicious_doc_id").alias("doc_id"), "suspicious_start_char", "suspicious_end_char")
    q = interval_join.contained(sure, q, ["doc_id"], ("suspicious_start_char", "suspicious_end_char"), ("start", "end"), how="left_anti")
    s = chunking.char_windows(sources, "doc_id", "text", window, stride)
    feats = lambda d: d.select(F.col("doc_id").alias("id"), F.col("start").alias("pos"), F.lower("part").alias("text"))
    qf = feats(q).join(lead, F.col("id") == F.col("suspicious_doc_id")).select("id", "pos", "text", "lead")
    best = simjoin.trigram_best(qf, feats(s).withColumn("lead", F.col("id")), least, group="lead")
    found = best.select(F.col("q").alias("suspicious_doc_id"), F.col("s").alias("source_doc_id"), F.col("qpos").alias("suspicious_start_char"), (F.col("qpos") + window).alias("suspicious_end_char"), F.col("spos").alias("source_start_char"), (F.col("spos") + window).alias("source_end_char"), "score")
    return confirmed.unionByName(merge_matches(found, gap), allowMissingColumns=True)


def relocate(raw_passage: Column, clean_text: Column, anchors: tuple[int, int] = (80, 40)) -> Column:
    """Place of a raw passage in the cleaned text, as struct(start, end); null if no anchor is found."""
    passage = T.clean(raw_passage)
    at = F.lit(None).cast("int")
    for n in reversed(anchors):
        hit = F.instr(clean_text, F.left(passage, F.lit(n)))
        at = F.when(hit > 0, hit - 1).otherwise(at)
    return F.when(at.isNotNull() & (F.length(passage) > 0), F.struct(at.alias("start"), (at + F.length(passage)).alias("end")))
