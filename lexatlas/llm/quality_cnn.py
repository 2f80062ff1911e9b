"""Quality classifier: a byte-level convolutional network in numpy.

Filters are learned directly on bytes.  A filter is a table of ``WIDTH x 256`` weights, so its response
at a position is a sum of table rows and no embedding has to be multiplied.  A document is cut into
overlapping chunks that cover all of it, each chunk is max-pooled per filter, and the mean and the
maximum of the pooled chunks are combined into one probability.

Cases: a null or empty text is scored as one zero byte; a null ``doc_id`` is never held out and never
trained on; labels that are null are ignored and repeated labels of a document count by their largest
value; with no usable label every document gets the prior 0.5.  Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, documents, trim

WIDTH, FILTERS, CHUNK, STRIDE = 5, 16, 256, 192
#: Bounds of the sample that is learned from: labelled rows, and bytes of their texts; whole rows in order of an id hash.
MAX_ROWS, MAX_BYTES = 4000, 32 << 20
EPOCHS, BATCH, RATE, DECAY = 14, 32, 0.02, 1e-4
THRESHOLD = 0.3
_BLOCK = 4096


def responses(data: np.ndarray, model: dict) -> np.ndarray:
    """Filter responses at every position of ``data`` (padded by WIDTH - 1 bytes at its end)."""
    w = model["filters"]
    n = len(data) - WIDTH + 1
    out = w[0][data[:n]]
    for j in range(1, WIDTH):
        out += w[j][data[j : j + n]]
    return out


def score_texts(texts: list[bytes], model: dict) -> np.ndarray:
    """Probability of each whole text."""
    if not model:
        return np.full(len(texts), 0.5)
    pooled = np.empty((len(texts), 2 * FILTERS), np.float32)
    for k, text in enumerate(texts):
        n = max(1, len(text))
        data = np.zeros(n + WIDTH - 1, np.uint8)
        data[: len(text)] = np.frombuffer(text, np.uint8)
        # maxima over tiles of CHUNK - STRIDE positions; a chunk is a run of tiles
        tile = CHUNK - STRIDE
        tiles = []
        for a in range(0, n, _BLOCK):
            r = responses(data[a : min(n, a + _BLOCK) + WIDTH - 1], model)
            tiles.append(np.maximum.reduceat(r, np.arange(0, len(r), tile), axis=0))
        tops = np.concatenate(tiles)
        starts = np.arange(0, max(1, len(tops) - 1), STRIDE // tile)
        ends = np.minimum(starts + CHUNK // tile, len(tops))
        chunks = np.stack([tops[a:b].max(axis=0) for a, b in zip(starts, ends)])
        chunks = np.maximum(chunks + model["bias"], 0)
        pooled[k, :FILTERS], pooled[k, FILTERS:] = chunks.mean(axis=0), chunks.max(axis=0)
    z = pooled @ model["out"] + model["out_bias"]
    return 1 / (1 + np.exp(-z.astype(np.float64)))


def training_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All chunks of each labelled text, as they are scored."""
    for pdf in batches:
        rows = []
        for doc_id, text, label in zip(pdf["doc_id"], pdf["text"], pdf["label"]):
            data = (text or "").encode()
            starts = np.arange(0, max(1, len(data) - (CHUNK - STRIDE)), STRIDE)
            for s in starts:
                rows.append((doc_id, int(label), max(1, min(CHUNK, len(data) - int(s))), data[s : s + CHUNK + WIDTH - 1].ljust(CHUNK + WIDTH - 1, b"\0")))
        yield pd.DataFrame(rows, columns=["doc_id", "label", "n", "data"])


def fit(chunks: pd.DataFrame, seed: int = 7) -> dict:
    """Train by Adam on documents' chunks; deterministic for the same rows."""
    if chunks.empty:
        return {}
    chunks = chunks.sort_values(["doc_id", "data"], kind="stable")
    data = np.frombuffer(b"".join(chunks["data"]), np.uint8).reshape(len(chunks), -1)
    count = chunks["n"].to_numpy()
    _, first = np.unique(chunks["doc_id"].to_numpy(), return_index=True)
    ends = np.append(first[1:], len(chunks))
    label = chunks["label"].to_numpy()[first].astype(np.float32)
    rng = np.random.default_rng(seed)
    p = {"filters": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32), "out": rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), "out_bias": np.zeros(1, np.float32)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    t, cols = 0, np.arange(FILTERS)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(first))
        for a in range(0, len(order), BATCH):
            docs = order[a : a + BATCH]
            rows = np.concatenate([np.arange(first[d], ends[d]) for d in docs])
            owner = np.repeat(np.arange(len(docs)), ends[docs] - first[docs])
            x = data[rows]
            r = p["filters"][0][x[:, :CHUNK]]
            for j in range(1, WIDTH):
                r += p["filters"][j][x[:, j : j + CHUNK]]
            r[np.arange(CHUNK)[None, :] >= count[rows][:, None]] = -np.inf
            at = r.argmax(axis=1)
            top = np.take_along_axis(r, at[:, None, :], axis=1)[:, 0] + p["bias"]
            h = np.maximum(top, 0)
            sizes = np.bincount(owner, minlength=len(docs)).astype(np.float32)
            begin = np.r_[0, np.cumsum(sizes)[:-1]].astype(int)
            mean = np.add.reduceat(h, begin, axis=0) / sizes[:, None]
            most = np.maximum.reduceat(h, begin, axis=0)
            f = np.concatenate([mean, most], axis=1)
            y = label[docs]
            prob = 1 / (1 + np.exp(-(f @ p["out"] + p["out_bias"])))
            dz = (prob - y) / len(docs)
            df = dz[:, None] * p["out"]
            hit = h == most[owner]
            hit = hit / np.add.reduceat(hit.astype(np.float32), begin, axis=0)[owner]
            dh = (df[:, :FILTERS] / sizes[:, None])[owner] + df[:, FILTERS:][owner] * hit
            dh *= top > 0
            g = {"out": f.T @ dz, "out_bias": dz.sum(keepdims=True), "bias": dh.sum(axis=0), "filters": np.zeros_like(p["filters"])}
            for j in range(WIDTH):
                np.add.at(g["filters"][j], (np.take_along_axis(x, at + j, axis=1), cols[None, :]), dh)
            t += 1
            for k in p:
                grad = g[k] + DECAY * p[k]
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.01 * (grad * grad - v[k])
                p[k] -= (rate / (1 - 0.9**t) * m[k] / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return p


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> dict:
    """Fit on labelled rows that are not held out: those with the lowest id hash, up to ``max_rows`` and ``max_bytes`` of text.

    A text beyond ``max_bytes`` by itself is passed over; all chunks of the others are learned from.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label is not null and doc_id is not null").where(crc_fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # the sample has max_rows rows of two integers at most, whatever the corpus: its size is proven
    rows = documents(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "label").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    size = {(r["doc_id"], r["n"]): r["times"] for r in rows.groupBy("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).agg(F.count("*").alias("times"), F.min(F.xxhash64("doc_id")).alias("place")).orderBy("place", "doc_id").limit(max_rows).collect()}
    held, taken = 0, []
    for (doc_id, n), times in size.items():
        held += n * times
        if held > max_bytes:
            break
        taken.append(doc_id)
    if held > max_bytes:  # else every row of the sample is taken
        rows = rows.where(F.col("doc_id").isin(taken))
    return fit(rows.mapInPandas(training_chunks, "doc_id long, label int, n int, data binary").toPandas())


def classify(docs: DataFrame, model: dict, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every whole text, and the columns named by ``keep``.

    ``score`` is computed by an Arrow-batched function of the text alone.
    """

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out = pd.Series(score_texts([(x or "").encode() for x in text], model))
        trim()  # workers live on in the stages after this one
        return out

    out = docs.select(F.col("doc_id"), F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"), *(F.col(k).alias(f"kept_{k}") for k in keep))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"), *(F.col(f"kept_{k}").alias(k) for k in keep if k != "doc_id"))
