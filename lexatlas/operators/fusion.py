"""Weighted fusion of branches, the gates, and the union of branch leaders."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {"tfidf": 0.10, "esa": 0.15, "lsa": 0.25, "embedding": 0.50}
MEAN_SHARE, MAX_SHARE = 0.20, 0.80


def _sum(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def fuse(long: DataFrame, weights: dict[str, float] | None = None, n: int = 20, by: str = "suspicious_doc_id") -> DataFrame:
    """Final ranking from one long table (branch, pair, max_score, mean_score, source_doc_rank).

    The n-way outer join of branches is one conditional aggregation.  Weights of the branches given are scaled to sum 1;
    a branch that misses a document counts as 0.
    """
    weights = weights or WEIGHTS
    total = sum(weights.values())
    aggs = []
    for b in weights:
        mine = F.col("branch") == b
        aggs += [F.max(F.when(mine, F.col(f"{k}_score"))).alias(f"{b}_{k}_score") for k in ("mean", "max")]
        aggs.append(F.max(F.when(mine, F.col("source_doc_rank"))).alias(f"{b}_rank"))
    wide = long.groupBy(by, "source_doc_id").agg(*aggs)
    wide = wide.withColumns({f"found_by_{b}": F.col(f"{b}_max_score").isNotNull() for b in weights})
    part = {k: _sum([F.coalesce(f"{b}_{k}_score", F.lit(0.0)) * (w / total) for b, w in weights.items()]) for k in ("mean", "max")}
    wide = wide.withColumns({"methods_found_count": _sum([F.col(f"found_by_{b}").cast("int") for b in weights]), "weighted_mean_score": part["mean"], "weighted_max_score": part["max"]})
    wide = wide.withColumn("final_score", MEAN_SHARE * F.col("weighted_mean_score") + MAX_SHARE * F.col("weighted_max_score"))
    order = Window.partitionBy(by).orderBy(F.desc("final_score"), F.desc("methods_found_count"), F.desc("weighted_mean_score"), F.desc("weighted_max_score"), "source_doc_id")
    return wide.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= n)


def gates(fused: DataFrame, branches: list[str], min_top1: float = 0.60, relative_gap: float = 0.85, soft_branch: float = 0.0, coherent: Column | None = None, leaders: int = 3, by: str = "suspicious_doc_id") -> DataFrame:
    """Flags for every fused row: gate 1 (hard or soft), gate 2, branch union, and ``kept``."""
    doc = Window.partitionBy(by)
    best = F.greatest(*(F.coalesce(F.max(f"{b}_max_score").over(doc), F.lit(0.0)) for b in branches), F.lit(0.0))
    soft = F.lit(soft_branch > 0) & (best >= soft_branch) & (coherent if coherent is not None else F.lit(True))
    out = fused.withColumn("top1_score", F.max("final_score").over(doc)).withColumn("best_branch_score", best)
    out = out.withColumn("gate1", (F.col("top1_score") >= min_top1) | soft)
    leader = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{b}_rank") <= leaders, F.lit(False)) for b in branches])
    out = out.withColumn("gate2", F.col("final_score") >= F.col("top1_score") * relative_gap).withColumn("branch_leader", leader)
    return out.withColumn("kept", F.col("gate1") & (F.col("gate2") | F.col("branch_leader")))


def kept(tops: list[tuple[np.ndarray, ...]], weights: list[float], shape: tuple[int, int], n: int = 20, min_top1: float = 0.60, relative_gap: float = 0.85, soft_branch: float = 0.0, leaders: int = 3) -> np.ndarray:
    """``fuse`` and the ``kept`` of ``gates`` for whole documents in a task: a matrix of documents by sources, these in order of their ids.

    ``tops``: document, source, mean, max and rank of the top documents of each branch.
    """
    total = sum(weights)
    mean = most = None
    found, best, leader = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape, bool)
    for (i, s, b_mean, b_max, rank), w in zip(tops, weights):
        x, y = np.zeros(shape), np.zeros(shape)
        x[i, s], y[i, s] = b_mean * (w / total), b_max * (w / total)
        mean, most = (x, y) if mean is None else (mean + x, most + y)  # in the order of ``fuse``
        found[i, s] += 1
        best[i, s] = np.maximum(best[i, s], b_max)
        leader[i, s] |= rank <= leaders
    i, s = np.nonzero(found)
    mean, most, final = mean[i, s], most[i, s], MEAN_SHARE * mean[i, s] + MAX_SHARE * most[i, s]
    o = np.lexsort((s, -most, -mean, -found[i, s], -final, i))
    o = o[np.arange(len(i)) - np.searchsorted(i[o], i[o]) < n]
    i, s, final = i[o], s[o], final[o]
    top1, top = np.zeros(shape[0]), np.zeros(shape[0])
    np.maximum.at(top1, i, final)
    np.maximum.at(top, i, best[i, s])
    gate1 = (top1 >= min_top1) | ((soft_branch > 0) & (top >= soft_branch))
    out = np.zeros(shape, bool)
    out[i, s] = gate1[i] & ((final >= top1[i] * relative_gap) | leader[i, s])
    return out


def branch_leaders(long: DataFrame, k: int = 3, by: str = "suspicious_doc_id") -> DataFrame:
    """Documents among the first k of any branch, with the branches that put them there."""
    return long.where(F.col("source_doc_rank") <= k).groupBy(by, "source_doc_id").agg(F.array_join(F.array_sort(F.collect_set("branch")), "+").alias("branches"))


def branch_diagnostics(long: DataFrame, by: str = "suspicious_doc_id") -> DataFrame:
    """Top document and score of each branch."""
    top = F.max_by(F.struct("source_doc_id", "max_score"), F.struct("max_score", -F.col("source_doc_rank")))
    return long.groupBy(by, "branch").agg(top.alias("t")).select(by, "branch", F.col("t.source_doc_id").alias("top1_source"), F.col("t.max_score").alias("top1_score"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rerank(pairs: DataFrame, score: Column, k: int = 40, by: str = "suspicious_doc_id") -> DataFrame:
    """Order sources by the sigmoid of the largest score of their best ``k`` pairs (a pluggable pair scorer)."""
    r = F.row_number().over(Window.partitionBy(by, "source_doc_id").orderBy(F.desc("score"), "suspicious_chunk_id", "source_chunk_id"))
    some = pairs.withColumn("_r", r).where(F.col("_r") <= k).withColumn("_s", score)
    return some.groupBy(by, "source_doc_id").agg(sigmoid(F.max("_s")).alias("rerank_score"))
