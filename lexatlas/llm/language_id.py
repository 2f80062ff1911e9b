"""Language identification: sparse multinomial logistic regression on tf-idf character n-grams.

A text is lower-cased, runs of anything but letters become one space, and all its n-grams of 1 to MAX_N code points are hashed into
BUCKETS features: whole texts, sublinear tf, smooth idf, unit length.  Document frequencies are counted over all documents that may be learned from.
Weights are learned by follow-the-regularised-leader (proximal, with a learning rate for each coordinate) under an elastic net: L1 makes
them sparse, L2 keeps them small.  Then one temperature is fitted on sampled rows that the weights have not seen, and divides the scores.

Cases: a null text or one without a letter is ``und`` with score 0; a null language is not learned from; a null ``doc_id`` is neither held out nor
learned from; with no usable row every text is ``und``; with one language, that one has score 1.  Repeated rows are scored each.  Ties go to the first language by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, map_by_id

MAX_N, BUCKETS = 4, 1 << 15
#: Bounds of the sample that weights are learned from: rows of all languages together, and features of them as far as their lengths tell.
MAX_ROWS, MAX_FEATURES = 4000, 24_000_000
FOLDS, HELD_OUT = 4, 2
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.05, 0.01
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)
#: Code points hashed at once; n-grams that cross a block are counted in the block where they start.
_BLOCK = 1 << 18


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and how often each occurs."""
    norm = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    for a in range(0, len(c), _BLOCK):
        b = c[a : a + _BLOCK + MAX_N - 1].astype(np.uint64)
        h = np.zeros(len(b), np.uint64)
        for n in range(1, MAX_N + 1):
            starts = min(_BLOCK, len(b) - n + 1)
            if starts <= 0:
                break
            h = h[: len(b) - n + 1] * _MIX + b[n - 1 :] + np.uint64(n)
            total += np.bincount(((h[:starts] * _SPREAD) >> _SHIFT).astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


def unit(found: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(tf)) * idf[found]
    return w / np.sqrt((w * w).sum())


def fit_ftrl(row: Callable[[int], tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights (BUCKETS + 1, n_labels) from ``row(i)`` (features, values); the last row is the bias, which L1 leaves alone."""
    z, n = np.zeros((BUCKETS + 1, n_labels)), np.zeros((BUCKETS + 1, n_labels))
    l1 = np.full(BUCKETS + 1, L1)
    l1[BUCKETS] = 0
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        zi, li = z[at], l1[at][:, None]
        return -np.sign(zi) * np.maximum(np.abs(zi) - li, 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for r in rng.permutation(len(labels)):
            at, x = row(r)
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[r]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(BUCKETS + 1))


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss between 1/20 and 20, by golden section on its logarithm (the loss is convex in the inverse)."""
    if not len(scores):
        return 1.0

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    a, b, ratio = -np.log(20), np.log(20), (np.sqrt(5) - 1) / 2
    while b - a > 1e-4:
        x, y = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, y) if loss(x) <= loss(y) else (x, b)
    return float(np.exp((a + b) / 2))


def _learnable(docs: DataFrame) -> DataFrame:
    """Rows with a text that has a letter and a language, outside the held-out fold."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    return rows.where("doc_id is not null and text is not null and lang is not null").where(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)


def _document_frequency(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents of each feature, and how many have a letter; BUCKETS + 1 numbers come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                if has_letter(text):
                    df[counts(text)[0]] += 1
                    df[BUCKETS] += 1
        some = np.flatnonzero(df)
        yield pd.DataFrame({"feature": some.astype(np.int32), "df": df[some]})

    total = np.zeros(BUCKETS + 1, np.int64)
    for r in rows.select("text").mapInPandas(run, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        total[r["feature"]] = r["df"]
    return total[:BUCKETS], int(total[BUCKETS])


def _sample(rows: DataFrame, max_rows: int, max_features: int = MAX_FEATURES) -> pd.DataFrame:
    """``lang, feature, tf`` (16-bit and 32-bit numbers as bytes) of at most ``max_rows`` texts, as evenly over the languages as they have rows.

    Texts are chosen by a hash of id and text, whose range is cut by a language's number of rows: no language is gathered anywhere, and copies
    of a row count once.  Rows beyond ``max_features``, in hash order, are left out.
    """
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows).collect()
    each = max_rows // max(1, len(found))
    spark = rows.sparkSession
    share = spark.createDataFrame([(r["lang"], min(1.0, 2.0 * each / r["n"])) for r in found], "lang string, share double")
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11)
    drawn = rows.withColumn("place", place).join(F.broadcast(share), "lang").where(F.col("place") / float(1 << 53) < F.col("share"))  # ``share`` has max_rows rows at most
    # about 2 * each different places a language, of which the first are taken: max_rows rows of three numbers
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    sizes = drawn.groupBy("lang", "place").agg(F.max(F.least(MAX_N * F.length("text").cast("long"), F.lit(BUCKETS))).alias("size"))
    chosen = sorted(sizes.withColumn("r", first).where(F.col("r") <= each).collect(), key=lambda r: (r["place"], r["lang"]))
    fits = np.cumsum([r["size"] for r in chosen]) <= max_features
    taken = spark.createDataFrame([(r["lang"], r["place"]) for r, ok in zip(chosen, fits) if ok], "lang string, place long")
    once = drawn.join(F.broadcast(taken), ["lang", "place"]).groupBy("lang", "place").agg(F.min("text").alias("text"))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[has_letter(t) for t in pdf["text"]]]
            both = [counts(t) for t in pdf["text"]]
            yield pd.DataFrame({"lang": pdf["lang"].to_numpy(), "place": pdf["place"].to_numpy(), "feature": [f.astype(np.uint16).tobytes() for f, _ in both], "tf": [t.astype(np.uint32).tobytes() for _, t in both]})

    got = once.mapInPandas(featured, "lang string, place long, feature binary, tf binary").toPandas()
    return got.sort_values(["place", "lang"], kind="stable").reset_index(drop=True)


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """Idf over all learnable documents, weights from a bounded sample of them, temperature from a fifth of the sample."""
    rows = _learnable(docs)
    sample = _sample(rows, max_rows)
    if sample.empty:
        return {}
    df, n = _document_frequency(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    names, label = np.unique(sample["lang"].to_numpy().astype(str), return_inverse=True)

    def row(i: int) -> tuple[np.ndarray, np.ndarray]:
        found = np.frombuffer(sample["feature"][i], np.uint16).astype(np.int64)
        return found, unit(found, np.frombuffer(sample["tf"][i], np.uint32), idf)

    later = np.arange(len(sample)) % 5 == 4  # rows lie in hash order
    seen, left = np.flatnonzero(~later), np.flatnonzero(later)
    w = fit_ftrl(lambda r: row(seen[r]), label[seen], len(names))
    scores = np.array([v @ w[f] + w[BUCKETS] for f, v in map(row, left)]).reshape(-1, len(names))
    return {"names": names, "weights": w.astype(np.float32), "idf": idf, "temperature": fit_temperature(scores, label[left])}


def predict(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each whole text."""
    names, score = [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not model or not has_letter(text):
            names.append("und")
            continue
        found, tf = counts(text)
        s = (unit(found, tf, model["idf"]) @ model["weights"][found] + model["weights"][BUCKETS]) / model["temperature"]
        p = np.exp(s - s.max())
        best = int(p.argmax())
        names.append(str(model["names"][best]))
        score[i] = p[best] / p.sum()
    return names, score


def classify(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every whole text; only the text is looked at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, score = predict(list(pdf["text"]), model)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": names, "score": score})

    out = map_by_id(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
