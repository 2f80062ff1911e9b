"""Joins and summaries that stay bounded under skew, and runs that compute only what changed."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.operators import analytics, evaluate, groundtruth, interval_join, ranking
from lexatlas.plans import incremental
from lexatlas.sources import io, vector_index


def intervals(rng, n, keys, most):
    out = []
    for i in range(n):
        a = rng.randrange(-50, most)
        out.append((i, rng.choice(keys), a, a + rng.choice((0, 1, 3, 40, 5000)) * rng.randrange(0, 2 + i % 3)))
    return out + [(n, keys[0], None, 5), (n + 1, keys[0], 5, None), (n + 2, None, 0, 10)]


@pytest.mark.parametrize("width", [1, 7, 1024])
def test_interval_joins(spark, width):
    rng = random.Random(width)
    a, b = intervals(rng, 150, ["x", "y"], 3000), intervals(rng, 150, ["x", "y"], 3000)
    left = spark.createDataFrame(a, "i long, k string, a0 int, a1 int")
    right = spark.createDataFrame(b, "j long, k string, b0 int, b1 int")
    got = [(r.i, r.j) for r in interval_join.overlapping(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), width).collect()]
    ok = [(x, y) for x in a for y in b if x[1] is not None and x[1] == y[1] and None not in (*x[2:], *y[2:])]
    assert sorted(got) == sorted((x[0], y[0]) for x, y in ok if x[2] < y[3] and y[2] < x[3])
    got = [(r.i, r.j) for r in interval_join.contained(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), width).collect()]
    want = sorted((x[0], y[0]) for x, y in ok if x[2] <= y[2] and y[3] <= x[3])
    assert sorted(got) == want
    inside = {j for _, j in want}
    assert sorted(r.j for r in interval_join.contained(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), width, "left_anti").collect()) == sorted(y[0] for y in b if y[0] not in inside)


def test_one_pair_of_documents_with_very_many_spans(spark):
    """The rows that meet stay near those that overlap: no nested loop over one pair's spans."""
    n = 60_000
    span = lambda shift: spark.range(n).select(F.lit("a").alias("suspicious_doc_id"), F.lit("b").alias("source_doc_id"), (F.col("id") * 100 + shift).alias("s0"), (F.col("id") * 100 + shift + 60).alias("s1"), F.lit(0).alias("r0"), F.lit(9).alias("r1"))
    links = evaluate.span_links(span(0), span(50))
    assert links.count() == 2 * n - 1 and links.agg(F.sum(F.col("o1") - F.col("o0"))).first()[0] == (2 * n - 1) * 10


@pytest.mark.parametrize("portion", [1 << 16, 2])
def test_passages_of_any_length_are_found_anywhere(spark, monkeypatch, portion):
    monkeypatch.setattr(groundtruth, "PASSAGES", portion)
    docs = [(1, "bathe cat sat on the mat, the cat sat on the mat"), (2, "x"), (3, None), (4, ""), (5, "the cat sat on the hat " * 20_000 + "end"), (6, "Ünï 日本語 x cat"), (7, "a.b(c a+b [x]")]
    passages = [(1, "he cat sat on the mat"), (2, "cat"), (3, "x"), (4, ""), (5, None), (6, "日本"), (7, "the cat sat on the hat end"), (8, "cat"), (9, "a+b"), (10, "the cat sat on the hat the"), (11, "nowhere"), (12, " ")]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, passage int")
    p = spark.createDataFrame([(*r, 0) for r in passages], "item_id long, text string, at int")
    got = sorted((r.suspicious_doc_id, r.source_doc_id, r.suspicious_offset, r.suspicious_length) for r in groundtruth.planted(d, p).collect())
    assert got == sorted((i, j, t.index(x), len(x)) for i, t in docs for j, x in passages if t and x and x in t)
    assert groundtruth.planted(d, p.where("false")).count() == 0 == groundtruth.planted(d.where("false"), p).count()


@pytest.mark.parametrize("accuracy", [2000, 20])
def test_exact_quantiles(spark, monkeypatch, accuracy):
    monkeypatch.setattr(analytics, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    groups = {"hot": np.r_[np.full(4000, 7.0), rng.normal(size=3000) * 1e6], "tiny": np.array([3.5]), "two": np.array([1.0, 2.0]), "wide": 10.0 ** rng.uniform(-200, 200, 900), None: np.arange(101.0)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in analytics.describe(df, "x", "g").collect()}
    for g, xs in groups.items():
        assert got[g].n == len(xs)
        for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            assert got[g][name] == pytest.approx(np.quantile(xs, p), rel=1e-12)
    assert got["none"].n == 0 and got["none"].p50 is None
    plan = analytics.describe(df, "x", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan.lower()
    assert analytics.span_lengths(df.where("false").selectExpr("1 as a", "2 as b"), "a", "b").collect()[0].n == 0


def rows_of(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_only_changed_documents_are_computed(spark, tmp_path):
    seen = []

    def compute(d):
        d = d.select("doc_id", F.explode(F.split("text", " ")).alias("word"))
        seen.append(sorted({r.doc_id for r in d.collect()}))
        return d.groupBy("doc_id", "word").agg(F.count("*").alias("n"))

    path = f"file://{tmp_path}/stage"
    with pytest.raises(FileNotFoundError):
        incremental.outputs(spark, path, "doc_id")
    full = lambda d: sorted(tuple(r) for r in rows_of(spark, d).select("doc_id", F.explode(F.split("text", " ")).alias("w")).groupBy("doc_id", "w").count().collect())
    states = [
        [(i, f"a b{i} a") for i in range(6)] + [(9, "x"), (9, "y"), (None, "z")],
        [(i, f"a b{i} a") for i in range(1, 6)] + [(9, "y"), (9, "x")],  # 0 gone, order of rows changed
        [(1, "new text"), (2, "a b2 a"), (7, "seven"), (9, "x"), (9, "y"), (9, "y")],  # 1 changed, 7 new, 9 has a row more
        [],
        [(2, "a b2 a")],
    ]
    for state, (computed, kept, dropped) in zip(states, [(7, 0, 0), (0, 6, 1), (3, 1, 3), (0, 0, 4), (1, 0, 0)]):
        found, counts = incremental.refresh(rows_of(spark, state), "doc_id", compute, path, {"v": 1})
        assert sorted(tuple(r) for r in found.collect()) == full([r for r in state if r[0] is not None])
        assert counts == {"computed": computed, "kept": kept, "dropped": dropped}
    assert seen == [[0, 1, 2, 3, 4, 5, 9], [], [1, 7, 9], [], [2]]
    assert incremental.refresh(rows_of(spark, states[-1]), "doc_id", compute, path, {"v": 2})[1]["computed"] == 1


def test_a_run_that_failed_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/stage"
    ok = lambda d: d.select("doc_id", F.upper("text").alias("t"))
    incremental.refresh(rows_of(spark, [(1, "a"), (2, "b")]), "doc_id", ok, path, {})

    def broken(d):
        return d.select("doc_id", F.raise_error(F.lit("lost")).cast("string").alias("t"))

    with pytest.raises(Exception, match="lost"):
        incremental.refresh(rows_of(spark, [(1, "a"), (2, "c")]), "doc_id", broken, path, {})
    assert sorted(tuple(r) for r in incremental.outputs(spark, path, "doc_id").collect()) == [(1, "A"), (2, "B")]
    found, counts = incremental.refresh(rows_of(spark, [(1, "a"), (2, "c")]), "doc_id", ok, path, {})
    assert sorted(tuple(r) for r in found.collect()) == [(1, "A"), (2, "C")] and counts["computed"] == 1


@pytest.mark.parametrize("harm", ["cut", "lost", "other"])
def test_damaged_shards_are_quarantined_and_rebuilt(spark, tmp_path, harm):
    path = tmp_path / "index"
    rows = spark.createDataFrame([(f"c{i}", [float(i), 1.0]) for i in range(60)], "id string, v array<double>")
    vector_index.build(rows, str(path), "m", 2, shard_rows=10)
    assert vector_index.damaged(spark, str(path)) == [] and vector_index.repair(rows, str(path), "m", 2, 10) == ([], 0)
    whole = sorted(p for p in path.glob("vectors/shard=*/*.parquet"))
    victim = whole[1]
    number = int(victim.parent.name.split("=")[1])
    held = spark.read.parquet(str(victim)).count()
    if harm == "cut":
        victim.write_bytes(victim.read_bytes()[:60])
    elif harm == "lost":
        victim.unlink()
    else:  # a file that can be read, with another vector in it
        other = spark.read.parquet(str(victim)).withColumn("v", F.array(F.lit(5.0).cast("float"), F.lit(5.0).cast("float")))
        other.coalesce(1).write.parquet(str(tmp_path / "other"))
        victim.write_bytes(next((tmp_path / "other").glob("*.parquet")).read_bytes())
    for crc in victim.parent.glob(".*.crc"):
        crc.unlink()
    untouched = {p: p.stat().st_mtime_ns for p in whole if p != victim}
    assert vector_index.damaged(spark, str(path)) == [number]
    assert vector_index.repair(rows, str(path), "m", 2, 10) == ([number], held)
    assert vector_index.damaged(spark, str(path)) == [] and vector_index.validate(spark, str(path), 60) == 60
    assert {r.id: list(r.v) for r in vector_index.read(spark, str(path)).collect()} == {f"c{i}": [float(i), 1.0] for i in range(60)}
    assert {p: p.stat().st_mtime_ns for p in untouched} == untouched and (path / "quarantine" / f"shard={number}").exists() == (harm != "none")


def test_decoding_keeps_what_the_text_holds(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("ok � é".encode())
    (tmp_path / "b.txt").write_bytes("own � ".encode() + b"\xff\xfe bad \xe9t\xe9 " + "日".encode()[:2])
    (tmp_path / "c.txt").write_bytes(b"")
    got = {r.file_name: r.raw_text for r in io.read_text_corpus(spark, str(tmp_path)).collect()}
    assert got == {p.name: p.read_bytes().decode("utf-8", "ignore") for p in tmp_path.glob("*.txt")} and "�" in got["b.txt"]


def test_one_document_without_a_find_is_an_error(spark):
    found = spark.createDataFrame([(1, 2)], "suspicious_doc_id int, source_doc_id int")
    assert ranking.of_document(found, 1).count() == 1
    with pytest.raises(LookupError):
        ranking.of_document(found, 3)
