"""Connectors to encoder, scorer and chat services over HTTP, and their use in partitions."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[tuple[str, str]]], list[float]]


def call(url: str, payload: dict | None = None, timeout: float = 60.0) -> dict:
    """GET, or POST if there is a payload; the answer's JSON object."""
    body = None if payload is None else json.dumps(payload).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read() or b"{}")


def healthy(base: str, timeout: float = 5.0) -> bool:
    try:
        return call(f"{base.rstrip('/')}/health", timeout=timeout).get("status") == "ok"
    except (urllib.error.URLError, OSError, ValueError):
        return False


def remote_encoder(base: str, model: str | None = None, timeout: float = 60.0) -> Encoder:
    """An encoder behind POST /embed, which takes ``texts`` and answers with ``vectors``."""

    def encode(texts: list[str]) -> list[list[float]]:
        vectors = call(f"{base.rstrip('/')}/embed", {"texts": texts, "model": model}, timeout)["vectors"]
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors

    return encode


def remote_chat(base: str, model: str, timeout: float = 120.0) -> Callable[[str], str]:
    """A chat model behind POST /api/chat; temperature 0, so that a prompt has one answer."""

    def ask(prompt: str) -> str:
        payload = {"model": model, "messages": [{"role": "user", "content": prompt}], "stream": False, "options": {"temperature": 0, "seed": 42}}
        return call(f"{base.rstrip('/')}/api/chat", payload, timeout)["message"]["content"]

    return ask


def encode(df: DataFrame, encoder: Encoder, id_col: str = "chunk_id", text_col: str = "chunk_text", max_words: int | None = 512, batch: int = 64) -> DataFrame:
    """``id, v``: unit vectors of texts by ``encoder``, a picklable function that each worker calls with a batch of texts.

    Models take a bounded number of tokens: ``max_words`` leaves that many words (None: all).  Null texts are empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [" ".join((t or "").split()[:max_words]) for t in pdf["text"]]
            out = []
            for a in range(0, len(texts), batch):
                x = np.asarray(encoder(texts[a : a + batch]), np.float64)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                out += list(x / np.where(norm > 0, norm, 1))
            yield pd.DataFrame({"id": pdf["id"], "v": out})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, v array<double>")


def cross_scores(pairs: DataFrame, scorer: Scorer, batch: int = 32) -> DataFrame:
    """``pairs`` with ``pair_score`` by a cross-encoder, a picklable function on batches of (suspicious, source) texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = list(zip(pdf["suspicious_text"].fillna(""), pdf["source_text"].fillna("")))
            scores = [float(x) for a in range(0, len(both), batch) for x in scorer(both[a : a + batch])]
            yield pdf.assign(pair_score=scores)

    return pairs.mapInPandas(run, ", ".join(f"`{n}` {k}" for n, k in pairs.dtypes) + ", pair_score double")


def in_batches(scorer: Scorer, batch: int = 32) -> Callable:
    """A cross-encoder as a scorer of places (``lookup.Matcher.reranked``): (texts, other texts, i, j) to the scores of the pairs of texts i and j."""

    def run(texts: pa.Array, others: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y, scores = texts.to_pylist(), others.to_pylist(), []
        for a in range(0, len(i), batch):
            scores += scorer([(x[m] or "", y[n] or "") for m, n in zip(i[a : a + batch].tolist(), j[a : a + batch].tolist())])
        return np.asarray(scores, float)

    return run
