"""Run reports: settings, row counts, distributions as bars, written as one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 40


def bars(counts: DataFrame, label: str, n: str = "n", most: int = 50) -> DataFrame:
    """``place, line``: the ``most`` largest counts as text bars; what is beyond them is summed up in one line."""
    top = counts.select(F.coalesce(F.col(label).cast("string"), F.lit("(none)")).alias("label"), F.col(n).cast("long").alias("n"))
    total, peak = (top.agg(f("n").alias("x")).scalar() for f in (F.sum, F.max))
    bar = F.repeat(F.lit("#"), F.ceil(F.col("n") * WIDTH / F.greatest(peak, F.lit(1))).cast("int"))
    shown = top.orderBy(F.desc("n"), "label").limit(most)
    lines = shown.select("n", "label", F.format_string("%-30s %12d %5.1f%% %s", "label", "n", F.col("n") * 100 / total, bar).alias("line"))
    rest = top.agg((F.sum("n") - shown.agg(F.sum("n").alias("x")).scalar()).alias("n")).where("n > 0").select(F.lit(-1).cast("long").alias("n"), F.lit("").alias("label"), F.format_string("%-30s %12d", F.lit("others"), "n").alias("line"))
    return lines.union(rest).orderBy(F.desc("n"), "label").select("line")


def run_report(spark: SparkSession, title: str, settings: dict[str, object], tables: dict[str, DataFrame], counts: dict[str, tuple[DataFrame, str]] | None = None) -> str:
    """The report as text: settings, the number of rows of each table, bars of each distribution (DataFrame with ``n``, label)."""
    lines = [title, "=" * len(title), "", "Settings", *(f"  {k} = {v}" for k, v in settings.items()), "", "Rows", *(f"  {name:<28} {df.count():>12}" for name, df in tables.items())]
    for name, (df, label) in (counts or {}).items():
        lines += ["", name, *(f"  {r['line']}" for r in bars(df, label).collect())]  # at most ``most`` + 1 lines
    return "\n".join(lines) + "\n"


def write_report(spark: SparkSession, text: str, path: str) -> None:
    """One text file below ``path``; the sink ends it with a line break."""
    spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
