"""The quality network: scores of whole texts against a plain computation, bounds of its sample, odd labels."""

import numpy as np
import pandas as pd

from lexatlas.llm import quality_cnn as Q


def plain_score(text, model):
    """Every chunk by itself: filters at each of its positions, the largest response of each, mean and maximum over chunks."""
    n = max(1, len(text))
    data = np.frombuffer(text.ljust(n + Q.WIDTH - 1, b"\0"), np.uint8)
    pooled = []
    for a in range(0, max(1, n - (Q.CHUNK - Q.STRIDE)), Q.STRIDE):
        r = [sum(model["filters"][j][data[p + j]] for j in range(Q.WIDTH)) for p in range(a, min(n, a + Q.CHUNK))]
        pooled.append(np.maximum(np.max(r, axis=0) + model["bias"], 0))
    f = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    return 1 / (1 + np.exp(-float(f @ model["out"] + model["out_bias"][0])))


def test_scores_cover_whole_texts():
    rng = np.random.default_rng(3)
    model = {"filters": rng.normal(0, 0.1, (Q.WIDTH, 256, Q.FILTERS)).astype(np.float32), "bias": rng.normal(0, 0.1, Q.FILTERS).astype(np.float32), "out": rng.normal(0, 0.3, 2 * Q.FILTERS).astype(np.float32), "out_bias": np.zeros(1, np.float32)}
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 63, 64, 65, 255, 256, 257, 320, 321, 447, 448, 449, 5000, 9000)]
    got = Q.score_texts(texts, model)
    assert np.allclose(got, [plain_score(t, model) for t in texts], atol=1e-5)


def test_training_reads_all_chunks():
    text = "".join(chr(97 + i % 26) for i in range(20_000))
    rows = pd.concat(Q.training_chunks([pd.DataFrame({"doc_id": [1, 2], "text": [text, None], "label": [1, 0]})]))
    own = rows[rows["doc_id"] == 1]
    assert len(own) == len(range(0, 20_000 - (Q.CHUNK - Q.STRIDE), Q.STRIDE)) and own["n"].iloc[-1] + Q.STRIDE * (len(own) - 1) == 20_000
    assert rows[rows["doc_id"] == 2]["n"].tolist() == [1]


def test_bounds_and_odd_labels(spark, monkeypatch):
    rows = [(i, "x" * (100 * (i % 7 + 1))) for i in range(60)] + [(None, "no id"), (61, None), (62, ""), (5, "x" * 600), (63, "y" * 5000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(64)] + [(5, 1, 0), (7, None, 1), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, text int")
    seen = []
    monkeypatch.setattr(Q, "fit", lambda chunks, seed=7: seen.append(chunks) or {})
    Q.train(docs, labels)
    everything = seen[-1]
    assert everything.groupby("doc_id")["label"].nunique().max() == 1 and set(everything[everything["doc_id"] == 7]["label"]) == {1}
    import zlib

    assert set(everything["doc_id"]) == {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5}
    Q.train(docs, labels, max_bytes=2000)
    some = seen[-1]
    assert 0 < len(set(some["doc_id"])) < len(set(everything["doc_id"])) and 63 not in set(some["doc_id"])
    Q.train(docs, labels, max_rows=3)
    assert len(set(seen[-1]["doc_id"])) == 3
    assert Q.train(docs.where("false"), labels) == {}
