"""Document fingerprints: a quartile bucket digest over hashed byte triplets.

Three kinds of byte triplets (adjacent and with one gap) are hashed into 256 buckets.  Each bucket is
encoded by the quartile its count falls into (two bits), preceded by the logarithm of the length and by
the ratios of the quartiles.  Two digests are compared by a difference that is bounded by ``MAX_DIFF``;
likeness is 1 - difference / MAX_DIFF.

Cases: a null text counts as empty; texts under three bytes have all-zero buckets, so that they are alike
if their lengths are; equal texts have equal digests.  ``edited_pairs`` orders by doc_id descending (nulls
last, ties by text) and treats repeated rows as rows of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, documents, map_by_id, parts

BUCKETS = 256
#: Offsets of the bytes of each kind of triplet.
KINDS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: What a bucket adds to the difference if its quartiles are 0 to 3 apart.
STEP = np.array([0, 1, 2, 6], np.int64)
#: The sum that unrelated digests reach on average; larger differences count as this one.
MAX_DIFF = 416
_HEAD = 2  # bytes: length, quartile ratios


def _quartile_codes(counts: np.ndarray) -> tuple[np.ndarray, int]:
    ranked = np.sort(counts)
    q1, q2, q3 = (int(ranked[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    return codes, ((q1 * 15 // q3) << 4 | q2 * 15 // q3) if q3 else 0


def digest(data: bytes) -> bytes:
    """Header and packed quartiles, 66 bytes."""
    counts = np.zeros(BUCKETS, np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    for k, (i, j, l) in enumerate(KINDS):
        n = len(b) - l
        if n > 0:
            h = (b[i : i + n] * np.uint32(0x9E3779B1)) ^ (b[j : j + n] * np.uint32(0x85EBCA6B)) ^ (b[l : l + n] * np.uint32(0xC2B2AE35) + np.uint32(k * 0x27D4EB2F))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    codes, ratios = _quartile_codes(counts)
    q = codes.reshape(-1, 4)
    body = (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8)
    length = min(255, round(float(np.log1p(len(data))) * 12))
    return bytes([length, ratios]) + body.tobytes()


_UNPACK = np.stack([np.arange(256) >> s & 3 for s in (0, 2, 4, 6)], axis=1).astype(np.int64)


def difference(a: bytes, b: bytes) -> int:
    """Bounded difference of two digests: 0 for equal ones, MAX_DIFF at most."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    d = int(STEP[np.abs(_UNPACK[x[_HEAD:]] - _UNPACK[y[_HEAD:]])].sum())
    d += abs(int(x[0]) - int(y[0])) + abs((int(x[1]) >> 4) - (int(y[1]) >> 4)) + abs((int(x[1]) & 15) - (int(y[1]) & 15))
    return min(d, MAX_DIFF)


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - difference(a, b) / MAX_DIFF


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text."""

    @F.pandas_udf("string")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([digest((x or "").encode()).hex() for x in text])

    return documents(docs).select("doc_id", of("text").alias("fingerprint"))


def edit(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many code points of the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by (band, look, doc_id descending, text); the row after the last of a band is a copy with look = 1."""
    held: tuple | None = None

    def row(now: tuple, following: str, next_print: bytes) -> tuple:
        doc_id, text, mark = now
        edited = edit(text, following)
        raw = edited.encode()
        mark_edited = digest(raw)
        return doc_id, len(text), hashlib.sha256(raw).hexdigest(), mark.hex(), mark_edited.hex(), likeness(mark, mark_edited), likeness(mark, next_print)

    for pdf in batches:
        out = []
        for doc_id, text, band, look in zip(pdf["doc_id"].tolist(), pdf["text"], pdf["band"], pdf["look"]):
            text = text or ""
            if held is not None and held[1] != band:
                held = None  # a copy ends each band, so nothing is pending
            mark = None if look and held is None else digest(text.encode())
            if held is not None:
                out.append(row(held[0], text, mark))
            held = None if look else ((doc_id, text, mark), band)
        yield pd.DataFrame(out, columns=_COLUMNS)


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(docs: DataFrame, bands: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness (see ``edit``).

    The next document in descending doc_id order is found without one global sort: quantiles of doc_id
    deal the rows into bands, each band also gets a copy of the first document of the band below (the
    last gets the very first document), and one shuffle of the text by band puts neighbours together.
    """
    docs = documents(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    bands = bands or 3 * parts(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / bands for k in range(1, bands)], 100 * bands)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    def bands_of(ids: pd.Series) -> np.ndarray:
        """Band 0 holds the largest ids; rows without an id come in a last band."""
        ids = ids.to_numpy(np.int64)
        return np.where(ids == NO_ID, len(cuts) + 1, len(cuts) - np.searchsorted(cuts, ids, side="right"))

    @F.pandas_udf("int")
    def band(ids: pd.Series) -> pd.Series:
        return pd.Series(bands_of(ids), dtype="int32")

    solid = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    # at most one row for each band: bounded by the number of bands
    heads = {r["band"]: r["top"] for r in solid.select("doc_id", band("doc_id").alias("band")).groupBy("band").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(heads)
    copies: dict[int, list[int]] = {}
    for i, b in enumerate(order):
        copies.setdefault(heads[order[(i + 1) % len(order)]], []).append(b)

    # only ids go to Python; cuts and copies travel with the function, so the plan doesn't grow with the bands
    @F.pandas_udf("array<struct<band:int,look:int>>")
    def targets(ids: pd.Series) -> pd.Series:
        return pd.Series([[{"band": int(b), "look": 0}, *({"band": x, "look": 1} for x in copies.get(i, ()))] for i, b in zip(ids.tolist(), bands_of(ids))])

    dealt = solid.select("doc_id", "text", F.explode(targets("doc_id")).alias("t")).select(F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), "text", "t.band", "t.look")
    dealt = dealt.repartition(parts(spark), "band").sortWithinPartitions("band", "look", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return map_by_id(dealt, _emit, _SCHEMA)
