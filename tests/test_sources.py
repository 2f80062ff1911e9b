"""Vector indexes, services, PDF files and reports."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.operators import confirm, evaluate, ranking, simjoin, vectors
from lexatlas.sources import pdf, report, services, vector_index


def vecs(spark, rows):
    return spark.createDataFrame(rows, "id string, v array<double>")


def test_index_is_resumed_checked_and_merged(spark, tmp_path):
    a, b, out = (str(tmp_path / x) for x in "abc")
    rows = [(f"c{i}", [float(i), 1.0, 0.0]) for i in range(20)]
    assert vector_index.build(vecs(spark, rows[:8] + [rows[0], (None, [0.0] * 3), ("null", None)]), a, "m", 3, shard_rows=5) == 8
    assert vector_index.build(vecs(spark, rows[:12]), a, "m", 3, shard_rows=5) == 4
    assert vector_index.build(vecs(spark, rows[:12]), a, "m", 3) == 0
    assert vector_index.validate(spark, a, 12) == 12 and vector_index.shards(spark, a).count() >= 2
    with pytest.raises(ValueError, match="but there are"):
        vector_index.validate(spark, a, 11)
    for wrong in (lambda: vector_index.build(vecs(spark, rows), a, "other", 3), lambda: vector_index.build(vecs(spark, [("x", [1.0])]), a, "m", 3)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(FileNotFoundError):
        vector_index.read(spark, b)
    vector_index.build(vecs(spark, [("c3", [9.0, 9.0, 9.0]), *rows[12:]]), b, "m", 3)
    assert vector_index.merge(spark, [a, b], out) == 20
    meta = spark.createDataFrame([(f"c{i}", i) for i in range(20)], "chunk_id string, n int")
    got = {r.chunk_id: (r.n, list(r.v)) for r in vector_index.load(spark, out, meta, "m").collect()}
    assert got == {f"c{i}": (i, [float(i), 1.0, 0.0]) for i in range(20)}
    with pytest.raises(ValueError, match="20 vectors for 19"):
        vector_index.load(spark, out, meta.where("n < 19"), "m")
    with pytest.raises(ValueError, match="no index of"):
        vector_index.load(spark, out, meta, "other")
    spark.createDataFrame([("bad", [float("nan")] * 3, 99)], "id string, v array<float>, shard int").write.mode("append").partitionBy("shard").parquet(f"{out}/vectors")
    with pytest.raises(ValueError, match="shard 99"):
        vector_index.validate(spark, out)


def test_paths_move(spark):
    d = spark.createDataFrame([("a/b/x.index",), ("x.index",), ("c\\d\\y",)], "p string")
    assert [r[0] for r in d.select(vector_index.moved(F.col("p"), "/new/")).collect()] == ["/new/x.index", "/new/x.index", "/new/y"]


class Service(BaseHTTPRequestHandler):
    def _say(self, payload):
        body = json.dumps(payload).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        self._say({"status": "ok"})

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/embed":
            self._say({"vectors": [[len(t), t.count(" ")] for t in asked["texts"]]})
        else:
            score = 0.9 if "same people" in asked["messages"][0]["content"] else 0.5
            self._say({"message": {"content": f'Well: {{"score": {score}, "is_likely_source": true, "reasoning": "r"}}'}})

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_services(spark, service):
    assert services.healthy(service) and not services.healthy("http://127.0.0.1:9")
    chunks = spark.createDataFrame([("a", "xx  yy zz"), ("b", None), ("c", "w " * 600)], "chunk_id string, chunk_text string")
    got = {r.id: list(r.v) for r in services.encode(chunks, services.remote_encoder(service), batch=2).collect()}
    assert np.allclose(got["a"], np.array([8, 2]) / np.hypot(8, 2)) and got["b"] == [0, 0] and np.allclose(got["c"], np.array([1023, 511]) / np.hypot(1023, 511))
    pairs = spark.createDataFrame([("a b", "b"), (None, "x")], "suspicious_text string, source_text string")
    scored = services.cross_scores(pairs, lambda batch: [len(x) - len(y) for x, y in batch])
    assert sorted(r.pair_score for r in scored.collect()) == [-1.0, 2.0]


def test_two_stages(spark, service):
    pairs = spark.createDataFrame([(1, 5, 1, "s", "t"), (1, 6, 1, "u", "v"), (2, 5, 1, "w", "x")], "suspicious_doc_id int, source_doc_id int, pair_rank int, suspicious_text string, source_text string")
    ask = services.remote_chat(service, "m")
    sure = lambda p: confirm.model_scores(p, lambda prompts: [0.95 if "Suspicious: s" in x else 0.2 for x in prompts])
    got = {(r.suspicious_doc_id, r.source_doc_id): (r.llm_score, r.stage) for r in confirm.two_stage(pairs, sure, lambda p: confirm.chat_scores(p, ask)).collect()}
    assert got == {(1, 5): (0.95, 1), (1, 6): (0.9, 2), (2, 5): (0.9, 2)}
    down = services.remote_chat("http://127.0.0.1:9", "m")
    with pytest.raises(Exception, match="every call of the scorer failed"):
        confirm.chat_scores(confirm.prompts(pairs, variant="plain"), down).collect()

    def shaky(prompt):
        if "Suspicious: u" in prompt:
            raise OSError("gone")
        return "no json" if "Suspicious: w" in prompt else '{"score": 0.5}'

    got = {(r.suspicious_doc_id, r.source_doc_id): (r.llm_score, r.llm_status) for r in confirm.chat_scores(confirm.prompts(pairs).coalesce(1), shaky).collect()}
    assert got == {(1, 5): (0.5, "ok"), (1, 6): (0.0, "OSError: gone"), (2, 5): (0.0, "no score in the answer")}
    with pytest.raises(Exception, match="every call of the scorer failed"):
        confirm.model_scores(confirm.prompts(pairs), lambda prompts: [0.1] * (len(prompts) + 1)).collect()
    assert all(r.prompt.startswith(v) for k, v in confirm.VARIANTS.items() for r in confirm.prompts(pairs, variant=k).collect())


def test_pdf_round_trip(spark, tmp_path):
    text = "\n".join(f"Line {i} (with) back\\slash é" for i in range(120))
    data = pdf.write_pdf(text)
    assert pdf.read_pdf(data) == text and pdf.page_count(data) == 3
    assert pdf.read_pdf(b"no pdf") == "" and pdf.page_count(None) == 0 and pdf.page_count(pdf.write_pdf("")) == 1
    assert pdf.read_pdf(b"<< /Length 9 >>\nstream\nBT [(ab) -250 (c\\051)] TJ 0 -12 Td (\\144e) ' ET\nendstream") == "abc)\nde"
    made = spark.createDataFrame([(text,), (None,)], "t string").select(pdf.to_pdf("t").alias("x")).collect()
    (tmp_path / "a.pdf").write_bytes(bytes(made[0].x))
    (tmp_path / "b.txt").write_text("x")
    assert [(r.raw_text, r.n_pages) for r in pdf.read_pdf_corpus(spark, str(tmp_path)).collect()] == [(text, 3)]


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a", 30), ("b", 10), (None, 5), ("d", 5)], "k string, n int")
    text = report.run_report(spark, "Run", {"k": 20}, {"docs": df}, {"Kinds": (df, "k")})
    assert "docs" in text and "60.0% " + "#" * 40 in text and "(none)" in text
    assert [r.line.split() for r in report.bars(df, "k", most=1).collect()][1] == ["others", "20"]
    report.write_report(spark, text, str(tmp_path / "log"))
    assert "".join(p.read_text() for p in (tmp_path / "log").glob("part-*")) == text


def test_lsa_equals_dense_svd(spark):
    rng = np.random.default_rng(0)
    rows = [(f"r{i}", f"f{j}", float(rng.random())) for i in range(60) for j in sorted(rng.choice(40, 8, replace=False))]
    w = spark.createDataFrame(rows, "id string, feature string, w double")
    ids, names = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.zeros((len(ids), len(names)))
    for i, f, v in rows:
        x[ids.index(i), names.index(f)] = v
    right = np.linalg.svd(x)[2]
    for k, rounds in ((5, 12), (200, 5)):
        found, projection, vocab = vectors.lsa(w, components=k, rounds=rounds)
        y = x @ right[: min(k, len(names) - 1)].T
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        got = {r.id: np.array(r.v) for r in found.collect()}
        z = np.stack([got[i] for i in ids])
        assert np.abs(z @ z.T - y @ y.T).max() < (0.05 if k == 5 else 1e-9)
    few = w.where("id < 'r2'")  # fewer rows than components: only the directions that they have
    some = sorted({r[0] for r in rows if r[0] < "r2"})
    z = {r.id: np.array(r.v) for r in vectors.lsa(few, components=15)[0].collect()}
    y = x[[ids.index(i) for i in some]]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = np.stack([z[i] for i in some])
    assert z.shape[1] <= len(some) and np.abs(z @ z.T - y @ y.T).max() < 1e-9
    fresh = spark.createDataFrame([("q", "f1", 1.0), ("none", "unseen", 1.0)], "id string, feature string, w double")
    q = {r.id: list(r.v) for r in vectors.project(fresh, projection, vocab).collect()}
    assert abs(np.linalg.norm(q["q"]) - 1) < 1e-9 and not any(q["none"])
    with pytest.raises(ValueError):
        vectors.lsa(w.where("feature in ('f1', 'f2')"))


def test_official_variants(spark):
    schema = "suspicious_doc_id int, source_doc_id int, s0 int, s1 int, r0 int, r1 int"
    docs = spark.createDataFrame([(1,), (2,), (3,)], "suspicious_doc_id int")
    truth = spark.createDataFrame([(1, 9, 0, 100, 0, 100), (1, 9, 200, 300, 200, 300), (2, 9, 0, 50, 0, 50)], schema).withColumn("kind", F.when(F.col("s0") == 200, "low").otherwise("none"))
    found = spark.createDataFrame([(1, 9, 50, 250, 50, 250), (3, 9, 0, 10, 0, 10)], schema)
    got = {r.variant: r for r in evaluate.official_variants(docs, truth, found, "kind").collect()}
    assert (got["all"].n_cases, got["all"].n_detections, got["plagiarised"].n_detections, got["firing"].n_detections) == (3, 2, 1, 2)
    assert got["all"].precision == 0.25 and got["plagiarised"].precision == 0.5 and got["firing"].precision == 0.25 and got["firing"].recall is None
    low, none = got["category_low"], got["category_none"]
    assert (low.precision, low.recall, low.n_cases) == (0.25, 0.5, 1) and (none.precision, none.recall, none.n_cases, none.n_cases_detected) == (0.25, 0.25, 2, 1)


def test_id_filters_and_pairwise(spark):
    d = spark.createDataFrame([("Doc1",), ("doc12",), ("x",), (None,)], "doc_id string")
    assert sorted(r.doc_id for r in ranking.ids_containing(d, "DOC1").collect()) == ["Doc1", "doc12"]
    assert [r.doc_id for r in ranking.first_documents(d.where("doc_id is not null"), 2).collect()] == ["Doc1", "doc12"]
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, -1.0])], "id long, v array<double>")
    assert {(r.q, r.s): r.score for r in simjoin.pairwise(v.where("id = 1"), v, block=1).collect()} == {(1, 1): 5.0, (1, 2): -2.0}
