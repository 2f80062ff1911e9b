import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lexatlas.functions import text as T
from lexatlas.operators import chunking, confirm, evaluate, simjoin, spans
from lexatlas.plans import detection, registry
from lexatlas.sources import io
from lexatlas.streaming import incremental


def test_registry_names_match():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_clean(spark):
    raw = "﻿“communi-\ncation” — it’s\x00fine ,ok\n---- [Illustrated: a\nb] CHAPTER IV end ﬁn"
    assert spark.createDataFrame([(raw,), (None,)], "t string").select(T.clean(F.col("t"))).collect()[0][0] == '"communication" - it\'s fine, ok end fin'


def test_counts_of_empty(spark):
    row = spark.createDataFrame([("",), (None,), ("a b",)], "t string").select(T.word_count(F.col("t")), T.token_estimate(F.col("t"))).collect()
    assert [tuple(r) for r in row] == [(0, 0), (0, 0), (2, 2)]


def python_windows(tokens, size, overlap, least):
    out, step, n = [], max(1, size - overlap), len(tokens)
    for a in range(0, n, step):
        b = min(a + size, n)
        if b - a < least:
            continue
        out.append((a, b, sum(len(x) + 1 for x in tokens[:a]), " ".join(tokens[a:b])))
        if b == n:
            break
    return out


def test_windows(spark):
    rng = random.Random(3)
    texts = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(n))) for i, n in enumerate([0, 3, 10, 20, 30, 31, 55])]
    got = chunking.windows(spark.createDataFrame(texts, "doc_id long, clean_text string"), size=10, overlap=4, min_words=4).collect()
    for i, t in texts:
        mine = sorted((r.word_start, r.word_end, r.start_char, r.chunk_text) for r in got if r.doc_id == i)
        assert mine == python_windows(t.split(), 10, 4, 4)
        assert all(t[r.start_char : r.end_char] == r.chunk_text for r in got if r.doc_id == i)


def test_windows_of_long_null_and_empty_texts(spark):
    tokens = [f"w{i % 13}" + "é" * (i % 3) for i in range(1500)]
    rows = [(1, " ".join(tokens)), (2, None), (3, ""), (4, "  "), (5, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, clean_text string")
    got = chunking.windows(docs, size=10, overlap=5, min_words=1).collect()
    mine = sorted((r.word_start, r.word_end, r.start_char, r.chunk_text) for r in got if r.doc_id == 1)
    assert mine == python_windows(tokens, 10, 5, 1) and len(mine) > 2 * 64
    assert [(r.doc_id, r.chunk_text, r.start_char, r.end_char) for r in got if r.doc_id > 1] == [(5, "one", 0, 3)]
    assert chunking.windows(docs.limit(0)).count() == 0


def test_spread_keeps_rows(spark):
    one = spark.range(50).coalesce(1)
    assert sorted(r.id for r in detection.spread(one, "id").collect()) == list(range(50))
    many = spark.range(50).repartition(16)
    assert detection.spread(many, "id") is many


def test_composition_leaves_plain_text_and_nulls(spark):
    df = spark.createDataFrame([("plain",), (None,), ("ﬁ e\u0301",)], "t string")
    assert [r[0] for r in df.select(T.nfkc(F.col("t"))).collect()] == ["plain", None, "fi \u00e9"]


def test_incremental_run(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    go = lambda: incremental.run_available(incremental.stream_documents(spark, str(tmp_path / "in"), "doc_id long, text string"), lambda d: d.select("doc_id", T.word_count(F.col("text")).alias("n")), str(tmp_path / "out"), str(tmp_path / "at"))
    go()
    spark.createDataFrame([(3, "c")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert sorted((r.doc_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 2), (2, 0), (3, 1)]


def test_resume_and_columns(spark):
    todo = spark.createDataFrame([(1,), (2,), (3,)], "suspicious_doc_id int")
    done = todo.where("suspicious_doc_id = 2")
    assert sorted(r[0] for r in io.unprocessed(todo, done).collect()) == [1, 3]
    assert io.unprocessed(todo, done, fresh=True).count() == 3
    with pytest.raises(ValueError):
        io.require_columns(todo, ["missing"])


def test_ngrams(spark):
    df = spark.createDataFrame([(["ab", "abcdef"], "abcab")], "w array<string>, t string")
    row = df.select(chunking.word_ngrams(F.col("w")), chunking.char_ngrams_in_words(F.col("w")), chunking.trigram_set(F.col("t"))).collect()[0]
    assert row[0] == ["ab", "abcdef", "ab abcdef"]
    assert row[1][0] == " ab " and set(row[1][1:]) == {" abcd", "abcde", "bcdef", "cdef ", " abcde", "abcdef", "bcdef ", " abcdef", "abcdef "}
    assert row[2] == ["abc", "bca", "cab"]


def test_island_gaps(spark):
    rows = [(1, 1, 0, 100, 0, 50, 0.5), (1, 1, 1900, 2000, 60, 90, 0.7), (1, 1, 3801, 3900, 10, 20, 0.4)]
    m = spark.createDataFrame(rows, "suspicious_doc_id int, source_doc_id int, suspicious_start_char int, suspicious_end_char int, source_start_char int, source_end_char int, score double")
    got = sorted((r.suspicious_start_char, r.suspicious_end_char, r.source_end_char, r.score) for r in spans.merge_matches(m).collect())
    assert got == [(0, 2000, 90, 0.7), (3801, 3900, 20, 0.4)]


def test_plagdet_edges(spark):
    schema = "suspicious_doc_id int, source_doc_id int, s0 int, s1 int, r0 int, r1 int"
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "suspicious_doc_id int")
    truth = spark.createDataFrame([(1, 9, 0, 100, 0, 100), (2, 9, 0, 50, 0, 50)], schema)
    found = spark.createDataFrame([(1, 9, 0, 50, 0, 50), (1, 9, 50, 100, 50, 100), (3, 9, 0, 10, 0, 10)], schema)
    got = {r.suspicious_doc_id: r for r in evaluate.document_plagdet(docs, truth, found).collect()}
    assert got[1].granularity == 2 and abs(got[1].plagdet - 0.6309297535714574) < 1e-12
    assert (got[2].plagdet, got[2].precision, got[2].granularity) == (0, 0, 1)
    assert (got[3].plagdet, got[4].plagdet) == (0, 1)
    o = evaluate.official(truth, found).collect()[0]
    assert (o.n_cases, o.n_detections, o.n_cases_detected, o.recall, round(o.precision, 6)) == (2, 3, 1, 0.5, 0.666667)


def test_text_corpus(spark, tmp_path):
    for name, raw in {"a.txt": b"plain", "part1/b.txt": b"bad \xff byte", "part1/deep/c.txt": b"", "part1/d.md": b"no"}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(raw)
    got = {r.relative_path: (r.file_name, r.part, r.raw_text) for r in io.read_text_corpus(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.txt": ("a.txt", None, "plain"), "part1/b.txt": ("b.txt", "part1", "bad  byte"), "part1/deep/c.txt": ("c.txt", "part1", "")}
    table = {r.raw_text: (r.raw_char_count, r.clean_word_count) for r in io.document_table(io.read_text_corpus(spark, str(tmp_path / "in"))).collect()}
    assert table == {"plain": (5, 1), "bad  byte": (9, 2), "": (0, 0)}
    assert sorted((r.file_name, r.part) for r in io.file_parts(spark, str(tmp_path / "in")).collect()) == [("a.txt", "in"), ("b.txt", "part1"), ("c.txt", "deep"), ("d.md", "part1")]


def test_sinks_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "x, y"), (2, None)], "id long, name string")
    for kind in ("parquet", "csv", "json"):
        path = str(tmp_path / f"out.{kind}")
        io.write(df, path)
        io.write(df, path)
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        assert sorted((int(r.id), r.name) for r in reader.format(kind).load(path).collect()) == [(1, "x, y"), (2, None)]
    io.append(df, str(tmp_path / "out.parquet"))
    assert io.read_parquet(spark, str(tmp_path / "out.parquet"), ["id"]).count() == 4
    with pytest.raises(ValueError):
        io.read_parquet(spark, str(tmp_path / "out.parquet"), ["other"])
    with pytest.raises(ValueError):
        io.write(df, str(tmp_path / "out.tsv"))


def test_id_list_and_xml(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("d1\n\n  \nd2 \n")
    assert sorted(r.doc_id for r in io.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["d1", "d2"]
    io.write_xml(spark.createDataFrame([(1, "a<b")], "id long, name string"), str(tmp_path / "xml"))
    back = spark.read.format("xml").option("rowTag", "document").load(str(tmp_path / "xml")).collect()
    assert [(r.id, r.name) for r in back] == [(1, "a<b")]


WORKER = """
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry_module", {path!r})
module = importlib.util.module_from_spec(spec)
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
spec.loader.exec_module(module)
assert module.queries()["n4_embedding_text"](spark, "/root/testdata/sf0.001").count() > 0
print(module.queries()["n1_clean_text"](spark, "/root/testdata/sf0.001").toPandas().shape)
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    path = registry.__file__.rsplit("/", 3)[0] + "/__spark_entry__.py"
    done = subprocess.run([sys.executable, "-c", WORKER.format(path=path)], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_confirmation(spark):
    chunk = lambda rows: spark.createDataFrame(rows, "chunk_id string, chunk_text string")
    a, b = chunk([("q1", "abcdefghij"), ("q2", "zzzzzzzzzz")]), chunk([("s1", "abcdefghij"), ("s2", "abcde")])
    found = spark.createDataFrame([(1, 5, "q1", "s1", 0.9), (1, 6, "q1", "s2", 0.8), (2, 5, "q2", "s1", 0.1), (3, 5, "q1", "s1", 0.9)], "suspicious_doc_id int, source_doc_id int, suspicious_chunk_id string, source_chunk_id string, score double")
    pairs = confirm.build_pairs(found, a, b).withColumn("perplexity", F.when(F.col("suspicious_doc_id") == 3, 300.0).otherwise(10.0))
    got = {(r.suspicious_doc_id, r.source_doc_id): (r.share, r.llm_score, r.llm_is_likely_source, r.capped) for r in confirm.confirm(pairs, cap=confirm.word_salad()).collect()}
    assert got == {(1, 5): (1.0, 1.0, True, False), (1, 6): (1.0, 1.0, True, False), (2, 5): (0.0, 0.0, False, False), (3, 5): (1.0, 0.25, False, True)}
    assert not any(r.capped for r in confirm.confirm(pairs).collect())


def test_unigram_perplexity(spark):
    tf = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 1)], "id string, feature string, tf long")
    got = {r.id: r.perplexity for r in confirm.unigram_perplexity(tf).collect()}
    assert abs(got["b"] - 4 / 3) < 1e-12 and abs(got["a"] - ((4 / 3) ** 2 * 4) ** (1 / 3)) < 1e-12


def test_sparse_top_k(spark, monkeypatch):
    rng = random.Random(1)
    side = lambda name, n: [(f"{name}{i}", f"f{j}", rng.random()) for i in range(n) for j in sorted(rng.sample(range(30), 6))]
    qs, ss = side("q", 40), side("s", 50)
    want = {}
    for i, f, w in qs:
        for j, g, x in ss:
            if f == g:
                want[i, j] = want.get((i, j), 0) + w * x
    q, s = (spark.createDataFrame(rows, "id string, feature string, w double") for rows in (qs, ss))
    assert {(r.q, r.s): round(r.score, 9) for r in simjoin.sparse_cosine(q, s).collect()} == {k: round(v, 9) for k, v in want.items()}
    best = {i: [j for _, j in sorted((-v, j) for (x, j), v in want.items() if x == i)[:3]] for i in {k[0] for k in want}}
    for block, lane in ((4096, 16384), (7, 5)):
        monkeypatch.setattr(simjoin, "LANE", lane)
        monkeypatch.setattr(simjoin._sparse_blocks, "__defaults__", (block,))
        got = {}
        for r in simjoin.sparse_top_k(q, s, 3).orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append(r.s)
        assert got == best
    assert simjoin.sparse_top_k(q.where("false"), s, 3).count() == 0 == simjoin.sparse_top_k(q, s.where("false"), 3).count()
    assert simjoin.sparse_cosine(s, s).count() > 50
