"""Annulus clustering against plain integer k-means, with ties, repeats, odd vectors and other columns."""

import hashlib

import numpy as np
import pytest

from lexatlas.llm import annulus_kmeans as A


def brute(rows, k, rounds, dim, scale=64):
    x = [(i, [int(np.floor(c * scale)) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    first = sorted(x, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    cents = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        got = [near(v)[1] for _, v in x]
        for n in range(len(cents)):
            mine = [v for (_, v), g in zip(x, got) if g == n]
            if mine:
                cents[n] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, near(v)) for i, v in x]
    per = {n: sum(d for _, (d, m) in out if m == n) for n in range(len(cents))}
    total = sum(d for _, (d, _) in out)
    return sorted(((i, n, d, per[n], total, hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, (d, n) in out), key=repr)


def clustered(spark, rows, k=16, rounds=3, dim=6):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string")
    got = A.clustered(df, k, rounds, dim).collect()
    return sorted((tuple(r)[:6] for r in got), key=repr), got


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_odd_tables(spark, spread):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * spread).tolist()) for i in range(300)] + [(i, [0.25] * 6) for i in range(300, 450)]
    rows += [(None, [0.5] * 6), (7, [0.5] * 6), (7, [0.5] * 6), (600, [1.0] * 5), (601, [float("inf")] * 6), (602, [None] * 6), (603, []), (604, None), (605, [float("nan")] * 6)]
    rows += [(606, [1.0] * 5 + [None])]
    got, full = clustered(spark, rows)
    assert got == brute(rows, 16, 3, 6)
    assert all(1 <= r["compared"] <= 16 for r in full)


def test_few_and_none(spark):
    few = [(1, [0.0] * 6), (2, [0.0] * 6), (3, [9.0] * 6)]
    assert clustered(spark, few)[0] == brute(few, 16, 3, 6)
    assert clustered(spark, [(1, None), (2, [1.0])])[0] == []
    assert clustered(spark, [])[0] == []


def test_large_components(spark):
    rows = [(i, [float((-1) ** i * 2**20 + i)] * 6) for i in range(40)] + [(99, [1e30] * 6)]
    assert clustered(spark, rows)[0] == brute(rows[:-1], 16, 3, 6)


def test_annulus_compares_boundary_ties_and_skips_the_rest():
    rng = np.random.default_rng(1)
    # centroids on shells: most norms are out of reach of a vector that lies near its own centroid
    cents = np.concatenate([r * v / np.abs(v).max() for r in (10, 200, 4000, 80000) for v in [rng.normal(size=(1, 8))]] + [np.array([[3, 0, 0, 0, 0, 0, 0, 0], [-3, 0, 0, 0, 0, 0, 0, 0], [3, 0, 0, 0, 0, 0, 0, 0]])]).astype(np.int64)
    x = np.concatenate([cents + rng.integers(-2, 3, cents.shape) for _ in range(50)] + [np.zeros((5, 8), np.int64)])
    number, best, compared = A.Annulus(cents).nearest(x)
    d = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert compared.sum() < 0.6 * d.size
    assert number[-1] == 4  # three centroids at the same distance: the smallest number
