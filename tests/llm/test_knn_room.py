"""What the steps of the top-k search hold at once, and how often a query is sent."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_knn import brute

from lexatlas.llm import voronoi_knn as V


def test_room_of_a_batch():
    """10,000 rows against 4096 pivots: no matrix of all of them."""
    rng = np.random.default_rng(1)
    x, pivots = rng.normal(size=(10_000, 8)), rng.normal(size=(4096, 8))
    tracemalloc.start()
    g, d = V._nearest(x, pivots)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    far = ((x[:50, None, :] - pivots[None]) ** 2).sum(axis=2)
    assert (g[:50] == far.argmin(axis=1)).all() and np.allclose(d[:50] ** 2, far.min(axis=1))


def test_pieces():
    """Small groups share a piece, large ones are split, and no piece takes more than its rows."""
    rng = np.random.default_rng(2)
    for _ in range(50):
        counts = [int(n) for n in rng.integers(0, 40, 30)]
        load = {}
        places = V._placed(counts, 16)
        for n, (begin, many) in zip(counts, places):
            assert many == max(1, -(-n // 16))
            for p in range(begin, begin + many):
                load[p] = load.get(p, 0) + -(-n // many)
        assert max(load.values()) <= 16 and [b for b, _ in places] == sorted(b for b, _ in places)


@pytest.mark.parametrize("queries,room", [(3, 50), (1000, 1 << 21)])
def test_blocks_and_rows_sent(spark, monkeypatch, queries, room):
    """Unclustered vectors, where every group is visited: a query is sent once for each piece, in any blocks."""
    monkeypatch.setattr(V, "QUERIES", queries)
    monkeypatch.setattr(V, "ROOM", room)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent = spark.sparkContext.accumulator(0)
    stack = V._matrix

    def counted(col):
        if col.name == "q":
            sent.add(len(col))
        return stack(col)

    monkeypatch.setattr(V, "_matrix", counted)
    got = V.knn(V.integer_vectors(df), F.col("vec_id") % 50 == 0, 5, piece=300).collect()
    found = {}
    for r in sorted(got, key=lambda r: r.rank):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert found == {i: x for i, x in brute(rows, 5).items()}
    assert sent.value <= 18 * 4
