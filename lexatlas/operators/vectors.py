"""Vector-space models over long tables (id, feature, weight): no matrix files, no shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking, staging


def counts(chunks: DataFrame, id_col: str, grams: str) -> DataFrame:
    """``id, feature, tf`` from an array column of features."""
    return chunks.select(F.col(id_col).alias("id"), F.explode(grams).alias("feature")).groupBy("id", "feature").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame, n: int | None = None, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """``feature, df, idf`` with smooth idf; limits as in a count vectoriser (corpus frequency breaks the last)."""
    n = tf.select("id").distinct().count() if n is None else n
    df = tf.groupBy("feature").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    if max_features:
        df = df.orderBy(F.desc("total"), "feature").limit(max_features)
    return df.select("feature", "df", (F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """Unit-length rows of sublinear tf times idf; features without idf drop out."""
    w = tf.join(idf.select("feature", "idf"), "feature").select("id", "feature", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return w.select("id", "feature", (F.col("w") / norm).alias("w"))


def hashed_embedding(tf: DataFrame, dims: int = 64) -> DataFrame:
    """Dense unit vectors by signed feature hashing: the offline stand-in for a sentence encoder."""
    h = F.xxhash64("feature")
    slot = tf.select("id", F.pmod(h, F.lit(dims)).cast("int").alias("d"), (F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0) * (1 + F.log("tf"))).alias("x")).groupBy("id", "d").agg(F.sum("x").alias("x"))
    packed = slot.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"))  # ``dims`` entries at most
    v = packed.select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("v"))
    return v.select("id", F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y))).alias("v"))


#: Features of a latent space at most (by corpus frequency), columns beyond the components, and rounds of the subspace iteration.
FEATURES, EXTRA, ROUNDS = 100_000, 10, 5
#: Features of a block of a tall matrix, columns that a task multiplies with at once, and rows of the corpus it takes.
_PART, _COLUMNS, _ROWS = 1024, 32, 16384
_TALL = "part int, data binary"


def _indexed(weights: DataFrame, vocab: list[str]) -> DataFrame:
    """``id, j, w``: rows as arrays of feature numbers and weights; rows without a known feature are empty."""
    places = weights.sparkSession.createDataFrame(pd.DataFrame({"feature": vocab, "place": np.arange(len(vocab), dtype=np.int32)}))
    known = weights.join(F.broadcast(places), "feature", "left")  # FEATURES rows at most
    return known.groupBy("id").agg(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "w"))).alias("fs")).select("id", F.col("fs.place").alias("j"), F.col("fs.w").alias("w"))


def _times(pdf: pd.DataFrame, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows times ``right``; and the rows' entries as (row, feature, weight)."""
    sizes = pdf["j"].map(len).to_numpy()
    row = np.repeat(np.arange(len(pdf)), sizes)
    j = np.concatenate([np.zeros(0, np.int32), *pdf["j"]]).astype(np.int64)
    w = np.concatenate([np.zeros(0), *pdf["w"]])
    out = np.zeros((len(pdf), right.shape[1]))
    step = max(1, (1 << 22) // right.shape[1])  # entries whose products are held at once
    for a in range(0, len(j), step):
        b = row[a : a + step]
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        out[b[first]] += np.add.reduceat(right[j[a : a + step]] * w[a : a + step, None], first, axis=0)
    return out, row, j, w


class Tall:
    """A matrix with a row for each feature, as blocks of _PART rows in a table (part, data); no machine holds all of it."""

    def __init__(self, blocks: DataFrame, height: int, width: int):
        self.blocks, self.height, self.width = blocks, height, width

    def mapped(self, turn: np.ndarray) -> Tall:
        """This times a small matrix."""
        width = self.width

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(data=[(np.frombuffer(x).reshape(-1, width) @ turn).tobytes() for x in pdf["data"]])

        return Tall(self.blocks.mapInPandas(run, _TALL), self.height, turn.shape[1])

    def staged(self) -> Tall:
        return Tall(staging.written(self.blocks, "tall-matrix"), self.height, self.width)

    def by_columns(self, lanes: int) -> DataFrame:
        """``g, lane, part, data``: groups of _COLUMNS columns, once for each lane."""
        width = self.width

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part, data in zip(pdf["part"], pdf["data"]):
                    x = np.frombuffer(data).reshape(-1, width)
                    yield pd.DataFrame([(g, part, x[:, a : a + _COLUMNS].tobytes()) for g, a in enumerate(range(0, width, _COLUMNS))], columns=["g", "part", "data"])

        return self.blocks.mapInPandas(run, "g int, " + _TALL).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def collected(self) -> np.ndarray:
        """All of it on the driver, for small ones."""
        rows = sorted(self.blocks.collect(), key=lambda r: r["part"])
        return np.concatenate([np.frombuffer(r["data"]).reshape(-1, self.width) for r in rows])


def _group(known: pd.DataFrame, height: int, width: int) -> np.ndarray:
    """One group of columns from its blocks."""
    out = np.zeros((height, width))
    for part, data in zip(known["part"], known["data"]):
        x = np.frombuffer(data).reshape(-1, width)
        out[part * _PART : part * _PART + len(x)] = x
    return out


def _lanes(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    lanes = max(1, -(-n // _ROWS))
    return rows.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int")), lanes


def _column_groups(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit((width - 1) // _COLUMNS))))


def _gram_times(rows: DataFrame, n: int, right: Tall) -> Tall:
    """A^T (A right) for the rows A: each task takes a lane of rows and a group of columns; blocks of features are then added up and joined."""
    height, width = right.height, right.width
    dealt, lanes = _lanes(rows, n)

    def multiply(mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(known):
            return pd.DataFrame({"part": [], "g": [], "data": []}, dtype=object)
        g = int(known["g"].iloc[0])
        some = _group(known, height, min(_COLUMNS, width - g * _COLUMNS))
        total = np.zeros_like(some)
        for a in range(0, len(mine), 2048):
            left, row, j, w = _times(mine.iloc[a : a + 2048], some)
            order = np.argsort(j, kind="stable")
            for lo in range(0, len(order), 1 << 16):
                o = order[lo : lo + (1 << 16)]
                first = np.flatnonzero(np.r_[True, j[o][1:] != j[o][:-1]])
                total[j[o][first]] += np.add.reduceat(left[row[o]] * w[o, None], first, axis=0)
        return pd.DataFrame([(k // _PART, g, total[k : k + _PART].tobytes()) for k in range(0, height, _PART)], columns=["part", "g", "data"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = []
        for g, a in enumerate(range(0, width, _COLUMNS)):
            groups.append(sum(np.frombuffer(x) for x in pdf["data"][pdf["g"] == g]).reshape(-1, min(_COLUMNS, width - a)))
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "data": [np.hstack(groups).tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "g": pdf["g"].iloc[:1], "data": [sum(np.frombuffer(x) for x in pdf["data"]).tobytes()]})

    met = _column_groups(dealt, width).groupBy("g", "lane").cogroup(right.by_columns(lanes).groupBy("g", "lane"))
    parts = met.applyInPandas(multiply, "part int, g int, data binary")
    if lanes > 1:
        parts = parts.groupBy("part", "g").applyInPandas(added, "part int, g int, data binary")
    return Tall(parts.groupBy("part").applyInPandas(joined, _TALL), height, width).staged()


def _orthonormal(z: Tall) -> Tall:
    """Orthonormal columns of the same span, fewer where the rank is less: each block is factored where it lies, their small factors on the driver; twice, for accuracy."""
    width = z.width

    for _ in range(2):

        def factor(batches: Iterator[pd.DataFrame], width: int = width) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"r": [np.linalg.qr(np.frombuffer(x).reshape(-1, width), mode="r").tobytes() for x in pdf["data"]]})

        small = [np.frombuffer(r["r"]).reshape(-1, width) for r in z.blocks.mapInPandas(factor, "r binary").toLocalIterator()]  # FEATURES / _PART factors
        _, sizes, turn = np.linalg.svd(np.linalg.qr(np.concatenate(small), mode="r"))
        keep = np.flatnonzero(sizes > 1e-13 * sizes[0]) if sizes[0] > 0 else np.arange(1)  # directions that the rows have
        z = z.mapped(turn[keep].T / np.where(sizes[keep] > 0, sizes[keep], 1)).staged()
        width = z.width
    return z


def _inner(a: Tall, b: Tall) -> np.ndarray:
    """a^T b: a small matrix from each pair of blocks, added up."""
    wide_a, wide_b = a.width, b.width

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [(np.frombuffer(x).reshape(-1, wide_a).T @ np.frombuffer(y).reshape(-1, wide_b)).tobytes() for x, y in zip(pdf["data"], pdf["other"])]})

    both = a.blocks.join(b.blocks.withColumnRenamed("data", "other"), "part").select("data", "other")
    return sum(np.frombuffer(r["x"]).reshape(wide_a, wide_b) for r in both.mapInPandas(product, "x binary").toLocalIterator())


def _start(spark: SparkSession, height: int, width: int, seed: int) -> Tall:
    """Random columns, or all of the identity where there are no more features than columns; each block makes its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in pdf["part"]:
                n = min(_PART, height - part * _PART)
                x = np.eye(height)[part * _PART : part * _PART + n] if width == height else np.random.default_rng([seed, int(part)]).normal(size=(n, width))
                yield pd.DataFrame({"part": [part], "data": [x.tobytes()]})

    parts = spark.range(-(-height // _PART)).select(F.col("id").cast("int").alias("part")).repartition("part")
    return Tall(parts.mapInPandas(run, _TALL), height, width)


def lsa(weights: DataFrame, components: int = 200, features: int = FEATURES, seed: int = 42, rounds: int = ROUNDS) -> tuple[DataFrame, Tall, list[str]]:
    """Latent semantic vectors ``id, v`` (unit length), the projection and its features.

    A randomised subspace iteration on matrices in blocks of features: a task holds a group of columns twice (51 MB at the bound of features),
    the driver the features' names and matrices of (components + EXTRA) columns and rows.
    """
    vocab = [r["feature"] for r in weights.groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature").limit(features).collect()]
    if len(vocab) < 3:
        raise ValueError("LSA needs at least three features")
    k = min(components, len(vocab) - 1)
    rows = staging.written(_indexed(weights, vocab), "latent-rows")
    n = rows.count()
    wide = min(len(vocab), k + EXTRA)
    basis = _start(weights.sparkSession, len(vocab), wide, seed).staged()
    for _ in range(0 if wide == len(vocab) else rounds):
        basis = _orthonormal(_gram_times(rows, n, basis))
    values, turn = np.linalg.eigh(_inner(basis, _gram_times(rows, n, basis)))
    k = min(k, basis.width)
    projection = basis.mapped(turn[:, np.argsort(-values, kind="stable")[:k]]).staged()
    return _projected(rows, n, projection), projection, vocab


def _projected(rows: DataFrame, n: int, projection: Tall) -> DataFrame:
    """Unit vectors: each group of columns is made by itself, the groups of a row are then joined."""
    height, width = projection.height, projection.width
    dealt, lanes = _lanes(rows, n)
    kind = dict(rows.dtypes)["id"]

    def multiply(mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(known):
            return pd.DataFrame({"id": mine["id"].iloc[:0], "g": [], "v": []}, dtype=object)
        g = int(known["g"].iloc[0])
        v = _times(mine, _group(known, height, min(_COLUMNS, width - g * _COLUMNS)))[0]
        return pd.DataFrame({"id": mine["id"].to_numpy(), "g": g, "v": list(v)})

    met = _column_groups(dealt, width).groupBy("g", "lane").cogroup(projection.by_columns(lanes).groupBy("g", "lane"))
    parts = met.applyInPandas(multiply, f"id {kind}, g int, v array<double>").groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("g", "v"))), lambda x: x["v"])).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return parts.select("id", "v", norm.alias("norm")).select("id", F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.col("v")).alias("v"))


def project(weights: DataFrame, projection: Tall, vocab: list[str]) -> DataFrame:
    """Unit vectors ``id, v`` of rows (id, feature, w) in the latent space; rows without a known feature are zero."""
    rows = staging.written(_indexed(weights, vocab), "latent-rows")
    return _projected(rows, rows.count(), projection)


def hashed_index(chunks: DataFrame, id_col: str, text: Column, low: int = 5, high: int = 7, buckets: int = 1 << 20) -> DataFrame:
    """The hashed tf-idf index: unit rows ``id, feature`` (bucket), ``w`` of character n-grams within words."""
    grams = chunks.withColumn("grams", F.transform(chunking.char_ngrams_in_words(T.words(F.lower(text)), low, high), lambda g: chunking.hashed(g, buckets)))
    tf = counts(grams, id_col, "grams")
    return tfidf(tf, document_frequency(tf))
