"""Exact top-k on odd tables: null and repeated ids, several lengths, hot vectors, other columns."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.llm import voronoi_knn as V


def brute(rows, k):
    ok = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, v in ok:
        if i % 50 == 0:
            out[i] = sorted(((int(v @ w), -j) for j, w in ok if j != i), reverse=True)[:k]
    return {i: [(s, -j) for s, j in x] for i, x in out.items()}


@pytest.mark.parametrize("pivots,piece", [(None, 4096), (1, 10), (40, 7)])
def test_odd_tables(spark, pivots, piece):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)] + [(i, [0.25] * 6) for i in range(400, 520)]
    rows += [(None, [9.0] * 6), (7, [9.0] * 6), (7, [9.0] * 6), (600, [1.0] * 5), (601, [float("inf")] * 6), (602, [None] * 6), (603, []), (604, None)]
    rows += [(650, [3.0] * 6)] * 9  # a query whose own rows are the nearest of all
    rows += [(100, rows[100][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, g int, v string")
    got = collections.defaultdict(set)
    for r in V.knn(V.integer_vectors(df), F.col("vec_id") % 50 == 0, 5, pivots=pivots, piece=piece).collect():
        got[r.query_id].add((r.rank, r.vec_id, r.score))
    want = brute(rows, 5)
    assert set(got) == set(want)
    for i, x in want.items():
        assert sorted(s for _, _, s in got[i]) == sorted(s for s, _ in x) and all((n + 1, j, s) in got[i] for n, (s, j) in enumerate(x) if [t for t, _ in x].count(s) == 1)


def test_few_candidates(spark):
    df = spark.createDataFrame([(50, [1.0]), (1, [2.0]), (100, [0.5])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in V.knn(V.integer_vectors(df), F.col("vec_id") % 50 == 0).collect())
    assert got == [(50, 1, 1, 256 * 512), (50, 2, 100, 256 * 128), (100, 1, 1, 128 * 512), (100, 2, 50, 128 * 256)]
