"""Exact top-k search: a Voronoi kNN join by inner product.

Rows are assigned to the nearest of a number of pivots that grows with the square root of the rows, up to a bound.  Each group is summarised by its count,
its radius and the k + 1 distances nearest to its pivot.  For a query, Cauchy-Schwarz on these summaries
gives a lower bound of its k-th best score and an upper bound of what each group can hold; the query is
sent only to where groups lie that can matter, and these are solved locally.  Small groups share a piece, large ones are
split, so a piece has ``PIECES[0]`` to ``PIECES[1]`` rows whatever the groups (many equal vectors spread over tasks), a query is
one row for each piece rather than for each group, and a task holds one piece and ``QUERIES`` queries.

Cases: vectors that are null, empty or hold null or non-finite components take no part; of vectors of several
lengths, those of the commonest one (the longest of equally common ones) do, as others have no inner product
with them; rows with a null id take no part; ties go to the smaller id; repeated rows count
each as candidates and once as queries (a query excludes every row of its own id; vectors that share a query id
share its ranks).  Fewer than k candidates: all are returned.
Integer scores are exact while dimension * max(component)^2 < 2^53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Pivots at most: so many vectors, and summaries of k + 1 distances, are held by the driver and each task.
MAX_PIVOTS = 4096
#: Rows of a piece, at least and at most; queries that meet a piece in one task; numbers of a matrix that a worker makes at once.
PIECES, QUERIES, ROOM = (4096, 32768), 32768, 1 << 21


def integer_vectors(emb: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v``: components floor(scale * x), x as double, of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return emb.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in col]) if len(col) else np.zeros((0, 1))


def _blocks(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows, so that a matrix of ``width`` numbers a row stays within ROOM."""
    size = max(1, ROOM // max(1, width))
    return (slice(a, a + size) for a in range(0, n, size))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row, and the distance to it."""
    square = (pivots * pivots).sum(axis=1)[None, :]
    g = np.concatenate([np.zeros(0, np.int64), *((square - 2 * x[s] @ pivots.T).argmin(axis=1) for s in _blocks(len(x), len(pivots)))])
    return g, np.sqrt(((x - pivots[g]) ** 2).sum(axis=1))


def _upper(queries: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, ...]:
    """The best score that each group can hold for each query; inner products with the pivots, norms and the rounding allowed for."""
    dot = queries @ pivots.T
    norm = np.sqrt((queries * queries).sum(axis=1))[:, None]
    slack = 1e-6 * (1 + norm * np.sqrt((pivots * pivots).sum(axis=1))[None, :])
    return dot + norm * radius[None, :] + slack, dot, norm, slack


def _reach(queries: np.ndarray, pivots: np.ndarray, summary: list[tuple[int, float, list[float]]], k: int, own: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds (query, group), and what each query's k best rows score at least."""
    upper, dot, norm, slack = _upper(queries, pivots, np.array([s[1] for s in summary]))
    lower = np.concatenate([dot[:, [g]] - norm * np.array(s[2])[None, :] - slack[:, [g]] for g, s in enumerate(summary) if s[2]], axis=1)
    k += own  # the query's own rows may be among them
    if lower.shape[1] < k:
        return upper, np.full(len(queries), -np.inf)
    return upper, np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]


def bounds(queries: np.ndarray, pivots: np.ndarray, summary: list[tuple[int, float, list[float]]], k: int, own: int = 1) -> np.ndarray:
    """Boolean (query, group): whether the group may hold one of the query's k best rows; ``own``: rows of one id at most."""
    upper, least = _reach(queries, pivots, summary, k, own)
    return (upper >= least[:, None]) | np.isneginf(least)[:, None]


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row; ids ascend, so a stable order breaks ties by the smaller id."""
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
    above, level = scores > kth, scores == kth
    above |= level & (np.cumsum(level, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True))
    pick = np.nonzero(above)[1].reshape(len(scores), k)
    return np.take_along_axis(pick, np.argsort(-np.take_along_axis(scores, pick, axis=1), axis=1, kind="stable"), axis=1)


def _placed(counts: list[int], piece: int) -> list[tuple[int, int]]:
    """First piece and number of pieces of each group: small groups share one, each split group has its own."""
    out, at, room = [], -1, 0
    for n in counts:
        many = max(1, -(-n // piece))
        if many > 1 or n > room:
            out.append((at + 1, many))
            at, room = at + many, piece - n if many == 1 else 0
        else:
            out.append((max(at, 0), 1))
            room -= n
    return out


def knn(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int | None = None, piece: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of each query with all other rows.

    ``pivots``: how many, by default the square root of the rows, up to MAX_PIVOTS; ``piece``: rows of a piece, by default a 32nd of all within PIECES.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    lengths = vectors.where("vec_id is not null").groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    common = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["n"]
    vectors = vectors.where((F.size("v") == dim) & F.col("vec_id").isNotNull())
    own = vectors.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    piece = piece or min(max(common["rows"] // 32, PIECES[0]), PIECES[1])
    pivots = pivots or min(MAX_PIVOTS, math.isqrt(common["rows"]) + 1)
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # bounded by ``pivots``
    centre = np.unique(np.array([r["v"] for r in chosen]), axis=0)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                g, d = _nearest(_matrix(pdf["v"]), centre)
                yield pdf.assign(g=g.astype(np.int32), d=d)

    grouped = staged(vectors.select("vec_id", "v", is_query.alias("asks")).mapInPandas(assign, "vec_id long, v array<double>, asks boolean, g int, d double"), "voronoi")
    # one row for each group; the nearest distances by a bounded quantile-free top: k + 1 smallest per group
    small = grouped.groupBy("g").agg(F.count("*").alias("n"), F.max("d").alias("radius"), F.count_if("asks").alias("asks"))
    ranked = grouped.select("g", "d", F.row_number().over(Window.partitionBy("g").orderBy("d")).alias("r")).where(F.col("r") <= k + 1)
    nearest = ranked.groupBy("g").agg(F.sort_array(F.collect_list("d")).alias("near"))
    found = {r["g"]: (r["n"], r["radius"], list(r["near"]), r["asks"]) for r in small.join(nearest, "g").collect()}
    summary = [found.get(g, (0, -np.inf, [], 0)) for g in range(len(centre))]
    places = _placed([s[0] for s in summary], piece)
    blocks = max(1, -(-sum(s[3] for s in summary) // QUERIES))
    # pieces ascend with the groups: where each begins among the groups, those of a split group at the group
    full = [g for g, s in enumerate(summary) if s[0]]
    column = np.array([g for g in full for _ in range(places[g][1])], np.int64)
    number = np.array([places[g][0] + i for g in full for i in range(places[g][1])], np.int64)
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in _blocks(len(whole), len(centre) * (k + 4)):
                pdf = whole.iloc[at]
                upper, least = _reach(_matrix(pdf["v"]), centre, summary, k, own)
                may = (upper >= least[:, None]) | np.isneginf(least)[:, None]
                i, p = np.nonzero(np.logical_or.reduceat(may[:, column], first, axis=1))
                yield pd.DataFrame({"part": number[first][p].astype(np.int32), "block": pdf["block"].to_numpy()[i], "query_id": pdf["vec_id"].to_numpy()[i], "home": pdf["g"].to_numpy()[i], "least": least[i], "q": pdf["v"].to_numpy()[i]})

    radius = np.array([s[1] for s in summary])

    def solve(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")]
        if not len(data) or not len(queries):
            return out[0]
        data = data.sort_values("vec_id", kind="stable")
        queries = queries.sort_values("home", kind="stable")  # neighbours need the same groups
        ids, x = data["vec_id"].to_numpy(), _matrix(data["v"])
        groups, place = np.unique(data["g"].to_numpy(), return_inverse=True)
        del data
        for at in _blocks(len(queries), len(x)):
            part = queries.iloc[at]
            own, q, least = part["query_id"].to_numpy(), _matrix(part["q"]), part["least"].to_numpy()
            need = (_upper(q, centre[groups], radius[groups])[0] >= least[:, None]).any(axis=0) | np.isneginf(least).any()
            rows = slice(None) if need.all() else np.flatnonzero(need[place])
            near = ids[rows]
            if not len(near):
                continue
            s = q @ x[rows].T
            s[own[:, None] == near[None, :]] = -np.inf
            top = _top(s, near, k)
            best = np.take_along_axis(s, top, axis=1)
            keep = np.isfinite(best)
            out.append(pd.DataFrame({"query_id": np.repeat(own, top.shape[1])[keep.ravel()], "vec_id": near[top][keep], "score": best[keep].astype(np.int64)}))
        return pd.concat(out)

    where = F.broadcast(spark.createDataFrame([(g, *places[g]) for g in full], "g int, begin int, pieces int"))
    data = grouped.join(where, "g").select("g", (F.col("begin") + F.pmod(F.xxhash64("vec_id"), F.col("pieces"))).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    asked = grouped.where("asks").select("vec_id", "v", "g").distinct().withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.mapInPandas(route, "part int, block int, query_id long, home int, least double, q array<double>")
    local = data.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.select("query_id", F.row_number().over(best).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
