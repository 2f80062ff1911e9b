"""Centroid clustering by exact integer k-means with annulus search.

Centroids are sorted by norm.  For a vector x, the exact distance to the centroid whose norm is nearest to that of x is an
upper bound u of its distance to the nearest one; by the triangle inequality only centroids with a norm in
[|x| - u, |x| + u] can be as near.  That run of the sorted norms is found by binary search, and its centroids are compared exactly,
with a bound that shrinks as nearer ones turn up.  Norms are floating point, so the annulus is widened by
more than their rounding: a centroid on the boundary, which can tie, is always compared.  Distances are integers.

A round is one pass over the vectors; each task adds up its vectors by cluster, and k rows of sums come back.
No vector is shuffled, so equal vectors and hot clusters cost nothing special.

Cases: vectors that are null, of another length, or hold null or non-finite components take no part, nor do those with a component beyond
MAX_COMPONENT after scaling, whose squared distances need not fit a long.  Ties go to the smaller centroid number.  With fewer vectors than
centroids, each is a centroid; repeated rows count each, and repeated ids among the first centroids are ordered by their vectors; a null id is
a first centroid only after all others.  An empty table gives no row.  Sums of distances beyond a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: With 64 components the squared distance of vectors within this bound is below 2^63.
MAX_COMPONENT = 1 << 27


def _integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their components floor(scale * x) as int64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = pc.equal(pc.fill_null(pc.list_value_length(column), -1), dim).to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        x = np.floor(flat.reshape(-1, dim) * scale)
        good = (np.abs(x) <= MAX_COMPONENT).all(axis=1)  # false for NaN, which stands for null too
    keep = np.flatnonzero(fits)[good]
    return keep, x[good].astype(np.int64)


def _dot(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of each row with one integer vector."""
    top = int(np.abs(x).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, len(c))
    return (x.astype(np.float64) @ c.astype(np.float64)).astype(np.int64) if top < 1 << 53 else x @ c


class Annulus:
    """Centroids by norm; ``nearest`` gives each row's centroid number, squared distance and how many were compared."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64)
        norms = np.sqrt((self.centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.squares = (self.centroids * self.centroids).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, k = len(x), len(self.order)
        number, best, compared = np.full(n, k, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        square = (x * x).sum(axis=1)
        norm = np.sqrt(square.astype(np.float64))
        slack = 1e-6 * (1 + norm + self.norms[-1])

        def compare(rows: np.ndarray, place: int) -> None:
            c = self.order[place]
            d = square[rows] + self.squares[c] - 2 * _dot(x[rows], self.centroids[c])
            better = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
            best[rows[better]], number[rows[better]] = d[better], c
            compared[rows] += 1

        right = np.searchsorted(self.norms, norm).clip(0, k - 1)
        left = np.maximum(right - 1, 0)
        middle = np.where(np.abs(self.norms[left] - norm) <= np.abs(self.norms[right] - norm), left, right)
        for place in np.unique(middle):
            compare(np.flatnonzero(middle == place), place)
        reach = np.sqrt(best.astype(np.float64)) + slack
        low, high = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        for place in range(int(low.min(initial=k)), int(high.max(initial=0))):
            rows = np.flatnonzero((low <= place) & (place < high) & (middle != place))
            near = np.abs(self.norms[place] - norm[rows]) <= np.sqrt(best[rows].astype(np.float64)) + slack[rows]  # the bound shrinks as nearer ones turn up
            if near.any():
                compare(rows[near], place)
        return number, best, compared


def _first_centroids(vectors: DataFrame, k: int, dim: int, scale: int, seed: str) -> np.ndarray:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, x = _integers(b.column(1), dim, scale)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dim, x.ravel())], ["vec_id", "v"])

    ints = vectors.mapInArrow(whole, "vec_id long, v array<long>")
    named = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = ints.orderBy(named.asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, dim)


def _sums(vectors: DataFrame, centroids: np.ndarray, dim: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Count and exact componentwise sums of each non-empty cluster: one row for each cluster and task, added up by Spark."""
    index = Annulus(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
        for b in batches:
            _, x = _integers(b.column(0), dim, scale)
            if len(x):
                number = index.nearest(x)[0]
                order = np.argsort(number, kind="stable")
                found, first = np.unique(number[order], return_index=True)
                total[found] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(number, minlength=len(centroids))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    part = vectors.select("embedding").mapInArrow(run, "cluster int, n long, s array<long>")
    wide = part.select("cluster", F.posexplode(F.array_insert("s", F.lit(1), F.col("n"))).alias("place", "x"))  # place 0 holds the count
    added = wide.groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # k * (dim + 1) numbers
    out: dict[int, list[int]] = {}
    for r in added:
        out.setdefault(r["cluster"], [0] * (dim + 1))[r["place"]] = int(r["x"])
    return {c: (s[0], s[1:]) for c, s in out.items()}


def kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, compared`` of every vector that takes part, and the final centroids.

    ``vectors``: ``vec_id, embedding``.  A new centroid is the exact floor of the mean of its vectors; empty clusters keep theirs.
    ``compared``: how many centroids the annulus left to compare.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    centroids = _first_centroids(vectors, k, dim, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, s) in _sums(vectors, centroids, dim, scale).items():
            centroids[c] = [x // n for x in s]
    return assign(vectors, centroids, dim, scale), centroids


def assign(vectors: DataFrame, centroids: np.ndarray, dim: int = 64, scale: int = 64) -> DataFrame:
    """``vec_id, cluster, distance, compared``: the nearest centroid of each vector, by squared distance."""
    index = Annulus(centroids) if len(centroids) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, x = _integers(b.column(1), dim, scale)
            if index is not None and len(x):
                number, best, compared = index.nearest(x)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(number, pa.int32()), pa.array(best), pa.array(compared, pa.int32())], ["vec_id", "cluster", "distance", "compared"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, cluster int, distance long, compared int")


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> DataFrame:
    """Every vector with its cluster, the summed distances of the cluster and of all, and a digest of its final centroid."""
    found, centroids = kmeans(vectors, k, rounds, dim, scale)
    found = staged(found, "clusters")
    digests = [(c, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)]
    named = found.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    inertia = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = inertia.agg(F.try_sum("cluster_inertia").alias("inertia"))
    info = inertia.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(total))  # k rows and one row
    return found.join(F.broadcast(info), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")
