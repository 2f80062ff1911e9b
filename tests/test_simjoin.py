"""Pruned similarity joins against brute force: sparse top-k, trigram sets, the stored cell index."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.operators import simjoin
from lexatlas.sources import cell_index


def sparse_rows(rng, name, n, topics, words=400):
    """Unit rows about a topic each: most weight on the topic's words, some on words that all share."""
    out = []
    for i in range(n):
        t = rng.randrange(topics)
        fs = {f"t{t}_{j}": 1 + rng.random() for j in rng.sample(range(12), 6)} | {f"c{j}": 0.2 * rng.random() for j in rng.sample(range(30), 5)}
        norm = sum(w * w for w in fs.values()) ** 0.5
        out += [(f"{name}{i:04}", f, w / norm) for f, w in fs.items()]
    return out


@pytest.mark.parametrize("block", [4096, 100])
def test_sparse_top_k_skips_what_cannot_reach_it(spark, monkeypatch, block):
    monkeypatch.setattr(simjoin._sparse_blocks, "__defaults__", (block,))
    monkeypatch.setattr(simjoin, "HELD", 20_000)
    rng = random.Random(2)
    ss, qs = sparse_rows(rng, "s", 700, 20), sparse_rows(rng, "q", 90, 20)
    by = collections.defaultdict(list)
    for i, f, w in ss:
        by[f].append((i, w))
    want = collections.defaultdict(lambda: collections.defaultdict(float))
    for i, f, w in qs:
        for j, x in by[f]:
            want[i][j] += w * x
    q, s = (spark.createDataFrame(rows, "id string, feature string, w double") for rows in (qs, ss))
    rows = simjoin.sparse_top_k(q, s, 5).collect()
    got = collections.defaultdict(dict)
    for r in rows:
        got[r.q][r.rank] = (round(r.score, 9), r.s)
    for i, scores in want.items():
        best = sorted(((-round(v, 9), j) for j, v in scores.items()))[:5]
        assert [got[i][k] for k in range(1, 6)] == [(-v, j) for v, j in best]
    # pairs that were scored, of all pairs; 20 of the best take more than 5
    share = lambda k: sum(r.compared for r in simjoin._sparse_blocks(q, s, k).select("q", "b", "compared").distinct().collect()) / (90 * 700)
    assert share(5) < 0.15 and share(20) < 0.5


def test_sparse_join_with_equal_rows_and_unknown_features(spark):
    q = spark.createDataFrame([("a", "x", 0.6), ("a", "y", 0.8), ("b", "z", 1.0), ("c", "x", -1.0)], "id string, feature string, w double")
    s = spark.createDataFrame([(f"s{i}", "x", 1.0) for i in range(300)] + [("t", "y", 1.0)], "id string, feature string, w double")
    got = [(r.q, r.rank, r.s, r.score) for r in simjoin.sparse_top_k(q, s, 4).orderBy("q", "rank").collect()]
    assert got == [("a", 1, "t", 0.8), ("a", 2, "s0", 0.6), ("a", 3, "s1", 0.6), ("a", 4, "s10", 0.6)]
    assert simjoin.sparse_cosine(q, s).where("score < 0").count() == 300


def trigrams(text):
    return {text[i : i + 3] for i in range(len(text) - 2)}


def brute(qs, ss, least, same=None):
    out = {}
    for qi, qp, qt in qs:
        best = None
        for si, sp, st in sorted(ss):
            if same is not None and same[qi] != si:
                continue
            x, y = trigrams(qt), trigrams(st)
            score = len(x & y) / len(x | y) if x | y else 0
            if score >= least and (best is None or score > best[2]):
                best = (si, sp, score)
        if best:
            out[qi, qp] = best
    return out


@pytest.mark.parametrize("least,block", [(0.12, None), (0.5, 20), (0.85, 7)])
def test_trigram_join(spark, least, block):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randrange(2, 8))) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    ss = [(i, p, text(rng.randrange(1, 60))) for i in range(40) for p in (0, 400)] + [(90, 0, ""), (91, 0, "ab"), (92, 0, "same text here"), (93, 0, "same text here")]
    qs = [(i, p, rng.choice(ss)[2][: rng.randrange(5, 300)] + " " + text(rng.randrange(0, 12))) for i in range(50) for p in (0, 400)] + [(300, 0, ""), (301, 0, "zz"), (302, 0, "same text here"), (303, 0, "\U0001f600 unknown")]
    q, s = (spark.createDataFrame(rows, "id long, pos long, text string") for rows in (qs, ss))
    got = simjoin.trigram_best(q, s, least, block=block).collect()
    assert {(r.q, r.qpos): (r.s, r.spos, r.score) for r in got} == brute(qs, ss, least)
    if least > 0.5:
        assert sum(r.compared for r in got) < 0.3 * len(got) * len(ss)  # prefixes and sizes leave few
    lead = {i: i % 40 for i, _, _ in qs}
    paired = simjoin.trigram_best(q.withColumn("g", F.col("id") % 40), s.withColumn("g", F.col("id")), least, "g").collect()
    assert {(r.q, r.qpos): (r.s, r.spos, r.score) for r in paired} == brute(qs, ss, least, lead)
    assert simjoin.trigram_best(q.where("false"), s, least).count() == 0 == simjoin.trigram_best(q, s.where("false"), least).count()


def clusters(rng, n, centres, dim=8):
    c = rng.normal(size=(centres, dim)) * 10
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.3


@pytest.mark.parametrize("piece", [8192, 50])
def test_stored_cells(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(cell_index, "PIECE", piece)
    rng = np.random.default_rng(4)
    x = np.concatenate([clusters(rng, 900, 30), np.tile(rng.normal(size=8), (300, 1))]).round(3)  # a quarter of the rows are one vector
    e = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)] + [(None, [1.0] * 8, "x")], "id long, v array<double>, cell string")
    path = f"file://{tmp_path}/index"
    cells = cell_index.build(e.select("id", "v"), path)
    assert cells > 5
    found, counts = cell_index.search(spark, path, e.where("id % 40 = 0").select("id", "v"), 7)
    got = collections.defaultdict(list)
    for r in found.orderBy("q", "rank").collect():
        got[r.q].append((r.s, r.score))
    for i in range(0, 1200, 40):
        scores = x @ x[i]
        order = np.lexsort((np.arange(1200), -scores))[:7]
        assert [round(s, 6) for _, s in got[i]] == [round(s, 6) for s in scores[order]]
        assert [j for j, _ in got[i]] == order.tolist() or len({round(s, 9) for s in scores[order]}) < 7
    assert counts["cells"] == cells
    one, few = cell_index.search(spark, path, e.where("id = 0").select("id", "v"), 3)
    assert one.count() == 3 and few["read"] < cells / 2
    plan = cell_index.read_cells(spark, path, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = [r[0] for r in cell_index.read_cells(spark, path, [1, 2]).select(F.input_file_name()).distinct().collect()]
    assert files and all("/cell=1/" in f or "/cell=2/" in f for f in files)


def test_stored_cells_of_odd_vectors(spark, tmp_path):
    with pytest.raises(ValueError):
        cell_index.build(spark.createDataFrame([], "id long, v array<double>"), f"file://{tmp_path}/a")
    with pytest.raises(ValueError):
        cell_index.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), f"file://{tmp_path}/b")
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    cell_index.build(few, f"file://{tmp_path}/c")
    found = cell_index.search(spark, f"file://{tmp_path}/c", few, 5)[0].collect()
    assert sorted((r.q, r.rank, r.s) for r in found) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]
