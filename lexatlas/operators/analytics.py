"""Distributions, summaries, gate diagnostics and the stratified selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import staging


def shares(df: DataFrame, col: str) -> DataFrame:
    """Count and share of each value."""
    n = df.groupBy(col).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row for each value


def with_subset_shares(df: DataFrame, col: str, inside: Column) -> DataFrame:
    """Counts and shares of each value over all rows, and over those ``inside`` a subset."""
    n = df.groupBy(col).agg(F.count("*").alias("n"), F.count_if(inside).alias("n_subset"))
    total = Window.partitionBy()  # one row for each value
    share = lambda c: F.when(F.sum(c).over(total) > 0, F.col(c) / F.sum(c).over(total)).otherwise(0.0)
    return n.withColumns({"share": share("n"), "share_subset": share("n_subset")})


def pivot_counts(df: DataFrame, by: str, category: str, values: list[str]) -> DataFrame:
    """Rows of ``by`` with a count for each of the fixed values, 0 where there is none."""
    return df.groupBy(by).agg(*(F.count_if(F.col(category) == v).alias(v) for v in values))


#: Relative rank error of the sketch that narrows a quantile down is at most 1 / ACCURACY.
ACCURACY = 2000


def quantiles(df: DataFrame, col: str, by: str, wanted: dict[str, float]) -> DataFrame:
    """``by`` and the exact quantiles of ``col`` in each group, linear between neighbours; nulls are left out.

    Equal values are counted first.  A sketch of bounded size gives a range of values for each quantile that holds about 4 / ACCURACY of the rows; the
    rows below it are counted and only the values within are put in order, so no buffer holds all values of a group.
    """
    rows = df.where(F.col(col).isNotNull()).select(F.col(by).alias("_by"), F.col(col).alias("_v"))
    counted = staging.written(rows.groupBy("_by", "_v").agg(F.count("*").alias("_n")), "counted-values")
    edge = 2.0 / ACCURACY
    around = [(name, p, max(0.0, p - edge), min(1.0, p + edge)) for name, p in wanted.items()]
    sketch = F.percentile_approx("_v", [x for _, _, a, b in around for x in (a, b)], F.lit(ACCURACY))
    total = rows.groupBy("_by").agg(F.count("*").alias("_rows"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch.alias("_s"))
    ranges = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("_rows") - 1)).alias("at"), F.col("_s")[2 * i].alias("lo"), F.col("_s")[2 * i + 1].alias("hi")) for i, (name, p, _, _) in enumerate(around)))
    state = total.select(F.col("_by").alias("_g"), "_min", "_max", F.explode(ranges).alias("_q")).select("_g", "_min", "_max", "_q.*")
    state = staging.written(state, "quantile-ranges")

    def met(ranges: DataFrame) -> DataFrame:
        return counted.join(ranges, F.col("_by").eqNullSafe(F.col("_g")))

    below = met(state).groupBy("_g", "name").agg(F.sum(F.when(F.col("_v") < F.col("lo"), F.col("_n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("_v").between(F.col("lo"), F.col("hi")), F.col("_n")).otherwise(0)).alias("inside"))
    both = state.join(below.withColumnsRenamed({"_g": "_h", "name": "_name"}), F.col("_g").eqNullSafe(F.col("_h")) & (F.col("name") == F.col("_name")))
    held = (F.col("below") <= F.floor("at")) & (F.ceil("at") < F.col("below") + F.col("inside"))  # else the whole range is searched
    sure = both.select("_g", "name", "at", F.when(held, F.col("lo")).otherwise(F.col("_min")).alias("lo"), F.when(held, F.col("hi")).otherwise(F.col("_max")).alias("hi"), F.when(held, F.col("below")).otherwise(0).alias("below"))
    inner = met(sure).where(F.col("_v").between(F.col("lo"), F.col("hi")))
    upto = F.col("below") + F.sum("_n").over(Window.partitionBy("_g", "name").orderBy("_v"))
    ends = inner.withColumn("_upto", upto).groupBy("_g", "name", "at").agg(F.min(F.when(F.col("_upto") > F.floor("at"), F.col("_v"))).alias("a"), F.min(F.when(F.col("_upto") > F.ceil("at"), F.col("_v"))).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return ends.groupBy(F.col("_g").alias(by)).agg(*(F.max(F.when(F.col("name") == name, value)).alias(name) for name in wanted))


def describe(df: DataFrame, col: str, by: str) -> DataFrame:
    base = df.groupBy(by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))
    q = quantiles(df, col, by, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).withColumnRenamed(by, "_by")
    return base.join(q, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def span_lengths(df: DataFrame, start: str, end: str) -> DataFrame:
    rows = staging.written(df.select((F.col(end) - F.col(start)).alias("length"), F.lit(0).alias("all")), "span-lengths")
    base = rows.agg(F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.count("*").alias("n"))
    middle = quantiles(rows, "length", "all", {"median_length": 0.5}).select("median_length")
    return base.join(middle, F.lit(True), "left").select("min_length", "median_length", "max_length", "n")  # one row each


def gate_breakdown(rows: DataFrame, min_top1: float = 0.60) -> DataFrame:
    """Blocked or passed by plagiarised or clean (rows: top1_score, is_clean)."""
    return rows.groupBy((F.col("top1_score") >= min_top1).alias("passed"), "is_clean").agg(F.count("*").alias("n_docs"), F.avg("top1_score").alias("mean_top1"))


def rank_gap(ranked: DataFrame, truth: DataFrame, gap: float = 0.85) -> DataFrame:
    """Rank of each true source, its ratio to the best, and whether it survives the gap."""
    top = F.max("final_score").over(Window.partitionBy("suspicious_doc_id"))
    r = ranked.withColumn("ratio_to_top1", F.col("final_score") / top)
    true = truth.select("suspicious_doc_id", "source_doc_id").distinct()
    return r.join(true, ["suspicious_doc_id", "source_doc_id"]).select("suspicious_doc_id", "source_doc_id", "final_rank", "ratio_to_top1", (F.col("ratio_to_top1") >= gap).alias("survives_gap"))


def select_addon(cases: DataFrame, existing: DataFrame, categories: list[str], prefer: dict[str, float], cap: int = 8) -> list:
    """Greedy choice of documents that brings category counts up to the corpus shares.

    Sequential by nature: the pool of candidates, one row of counts for each document, is walked in order of
    score on the driver through a local iterator, one partition at a time, until every need is met.
    """
    have = existing.select("suspicious_doc_id").distinct()
    target = {r["category"]: r["n"] for r in cases.groupBy("category").agg(F.count("*").alias("n")).collect() if r["category"] in categories}
    now = {r["category"]: r["n"] for r in cases.join(have, "suspicious_doc_id", "left_semi").groupBy("category").agg(F.count("*").alias("n")).collect()}
    everything = cases.count()
    share = {c: target.get(c, 0) / everything for c in categories}
    size = max((now.get(c, 0) / share[c] for c in categories if share[c]), default=0)
    need = {c: max(0.0, share[c] * size - now.get(c, 0)) for c in categories}
    pool = pivot_counts(cases.join(have, "suspicious_doc_id", "left_anti"), "suspicious_doc_id", "category", categories)
    within = F.lit(True)
    score = F.lit(0.0)
    for c in categories:
        within = within & (F.col(c) <= cap)
        score = score + F.col(c) * prefer.get(c, 0.0)
    chosen = []
    for row in pool.where(within).withColumn("_score", score).orderBy(F.desc("_score"), "suspicious_doc_id").toLocalIterator():
        if all(v <= 0 for v in need.values()):
            break
        useful = [c for c in categories if row[c] > 0 and need[c] > 0]
        if useful and all(row[c] <= need[c] for c in useful):
            chosen.append(row["suspicious_doc_id"])
            need = {c: max(0.0, need[c] - row[c]) for c in categories}
    return chosen
