"""A stored index for exact inner-product search: vectors in folders by cell, with a summary of each cell.

``build`` draws centroids, moves them by a few rounds of means, and writes every vector below ``vectors/cell=N``.  The
summary ``cells`` has each cell's centroid, radius, largest norm and number of rows, so Cauchy-Schwarz bounds any inner
product with a row of the cell: q.x <= q.c + |q| * radius, and q.x <= |q| * norm.  ``search`` first reads the cells that can hold a query's best rows, whose
k-th score is then a floor for all others; only cells that can reach it are read.  Both reads name their cells as a filter on
the partition column, so files of other cells are never opened.  Results are exact, whatever the centroids.

Vectors that are null or empty, of another length than the first centroid's or with null or non-finite components are refused by ``build``;
null ids take no part.  Ties go to the smaller id.  A cell of many rows is searched in pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.simjoin import top_k
from ..operators.staging import written

#: Cells at most (the driver and each task hold their summary), rows of a cell that one task searches, rows that centroids are moved by.
CELLS, PIECE, TRAINING = 4096, 8192, 65536


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in v])


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell = ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
    return cell, np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))


def build(vectors: DataFrame, path: str, cells: int | None = None, rounds: int = 4) -> int:
    """Write the index of ``vectors`` (id, v) to ``path``; returns the number of cells that hold rows.

    ``cells``: the square root of the rows by default, CELLS at most.  Centroids come from at most TRAINING rows, chosen by a hash of the id.
    """
    rows = vectors.where("id is not null").select("id", F.col("v").cast("array<double>").alias("v"))
    n = rows.count()
    wanted = min(CELLS, cells or math.isqrt(n) + 1)
    sample = rows.where("v is not null and size(v) > 0").orderBy(F.xxhash64("id"), "id").limit(min(n, max(wanted, min(TRAINING, 64 * wanted)))).select("v").toPandas()
    if sample.empty:
        raise ValueError("an index needs a vector")
    if sample["v"].map(len).nunique() > 1:
        raise ValueError("vectors of several lengths")
    x = _stack(sample["v"])
    if not np.isfinite(x).all():
        raise ValueError("a vector has a null or non-finite component")
    centres = np.unique(x[:wanted], axis=0)
    for _ in range(rounds):
        cell, _far = _nearest(x, centres)
        count = np.bincount(cell, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    dim = x.shape[1]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                if any(v is None or len(v) != dim for v in pdf["v"]):
                    raise ValueError(f"a vector has not {dim} components")
                y = _stack(pdf["v"])
                if not np.isfinite(y).all():
                    raise ValueError("a vector has a null or non-finite component")
                cell, far = _nearest(y, centres)
                yield pdf.assign(cell=cell.astype(np.int32), far=far, norm=np.sqrt((y * y).sum(axis=1)))

    kind = dict(rows.dtypes)["id"]
    spark = rows.sparkSession
    dealt = rows.mapInPandas(assign, f"id {kind}, v array<double>, cell int, far double, norm double")
    # a large cell is written by several tasks: its rows are dealt by a hash of their id
    spread = max(1, n // (PIECE * 64))
    dealt.repartition(max(len(centres) // 64, spread, 1), "cell", F.pmod(F.xxhash64("id"), F.lit(spread))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    found = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm"))
    places = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    found.join(F.broadcast(places), "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")  # CELLS rows at most
    return spark.read.parquet(f"{path}/cells").count()


def summary(spark: SparkSession, path: str) -> pd.DataFrame:
    """``cell, n, radius, norm, centre`` of the cells that hold rows: CELLS rows at most."""
    return spark.read.parquet(f"{path}/cells").toPandas().sort_values("cell").reset_index(drop=True)


def read_cells(spark: SparkSession, path: str, cells: list[int]) -> DataFrame:
    """``id, v, cell`` of the named cells; the filter is on folders, so the others aren't opened."""
    return spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin([int(c) for c in cells])).select("id", "v", "cell")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 500) -> tuple[DataFrame, dict[str, int]]:
    """``q, s, score, rank``: the ``k`` stored rows of the largest inner product with each query (id, v); and how many cells there are and were read."""
    known = summary(spark, path)
    centres, radius, norm, count = _stack(known["centre"]), known["radius"].to_numpy(), known["norm"].to_numpy(), known["n"].to_numpy()
    number = known["cell"].to_numpy()

    def bounds(q: np.ndarray) -> np.ndarray:
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        return np.minimum(q @ centres.T + length * radius, length * norm) + 1e-9 * (1 + length * norm)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                upper = bounds(_stack(pdf["v"]))
                order = np.argsort(-upper, axis=1, kind="stable")
                enough = np.cumsum(count[order], axis=1) - count[order] < k  # until k rows are seen
                i, j = np.nonzero(enough)
                yield pd.DataFrame({"q": pdf["id"].to_numpy()[i], "v": pdf["v"].to_numpy()[i], "cell": number[order[i, j]]})

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                able = bounds(_stack(pdf["v"])) >= pdf["floor"].fillna(-np.inf).to_numpy()[:, None]
                for row, seen in enumerate(pdf["seen"]):
                    able[row, np.isin(number, seen)] = False
                i, j = np.nonzero(able)
                yield pd.DataFrame({"q": pdf["id"].to_numpy()[i], "v": pdf["v"].to_numpy()[i], "cell": number[j]})

    kind = dict(queries.dtypes)["id"]
    asked = queries.where("id is not null and v is not null").select("id", F.col("v").cast("array<double>").alias("v"))
    schema = f"q {kind}, v array<double>, cell int"
    routed = written(asked.mapInPandas(first, schema), "cell-routes")
    near, n_near = _scored(spark, path, routed, known, k)
    near = written(near, "cell-scores")
    floors = near.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(F.col("q").alias("id"), F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    seen = routed.groupBy("q").agg(F.collect_set("cell").alias("seen")).withColumnRenamed("q", "id")
    rest = written(asked.join(floors, "id", "left").join(seen, "id").mapInPandas(others, schema), "cell-routes")
    far, n_far = _scored(spark, path, rest, known, k)
    return top_k(near.unionByName(far), k), {"cells": len(known), "read": len(n_near | n_far), "read_first": len(n_near)}


def _scored(spark: SparkSession, path: str, routed: DataFrame, known: pd.DataFrame, k: int) -> tuple[DataFrame, set[int]]:
    """The ``k`` best rows of each cell for the queries sent there (q, v, cell); and the cells."""
    cells = {r["cell"] for r in routed.select("cell").distinct().collect()}  # CELLS rows at most
    pieces = spark.createDataFrame([(int(c), max(1, -(-int(n) // PIECE))) for c, n in zip(known["cell"], known["n"])], "cell int, pieces int")
    rows = read_cells(spark, path, sorted(cells)).join(F.broadcast(pieces), "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"))
    asks = routed.join(F.broadcast(pieces), "cell").select("q", F.col("v").alias("qv"), "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    kind, other = dict(rows.dtypes)["id"], dict(routed.dtypes)["q"]

    def solve(data: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asking):
            return pd.DataFrame({"q": asking["q"].iloc[:0], "s": data["id"].iloc[:0], "score": np.zeros(0)})
        data = data.sort_values("id")
        ids, x, out = data["id"].to_numpy(), _stack(data["v"]), []
        for a in range(0, len(asking), 512):
            part = asking.iloc[a : a + 512]
            scores = _stack(part["qv"]) @ x.T
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"q": np.repeat(part["q"].to_numpy(), order.shape[1]), "s": ids[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()}))
        return pd.concat(out)

    met = rows.groupBy("cell", "piece").cogroup(asks.groupBy("cell", "piece")).applyInPandas(solve, f"q {other}, s {kind}, score double")
    return top_k(met, k).drop("rank"), cells
