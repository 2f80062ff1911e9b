"""Similarity joins: top-k and threshold search, sparse and dense, all queries in one job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import staging


def top_k(scored: DataFrame, k: int, by: str = "q", tie: str = "s") -> DataFrame:
    """Rank 1..k by score descending, ties by id."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: Sources of a block and queries of a lane, about: what one task holds.  Groups of blocks that queries are routed by, and numbers in their summary.
BLOCK, LANE, GROUPS, SUMMARY = 4096, 16384, 1024, 1 << 21
#: Sources of a part of a block, whose weights have one bound for each feature; numbers held by a step at once.
SUB, HELD = 32, 1 << 22


def sparse_cosine(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """``q, s, score`` of pairs with a common feature; weights are unit rows (id, feature, w)."""
    return _sparse_blocks(queries, sources, None).select("q", "s", "score")


def sparse_top_k(queries: DataFrame, sources: DataFrame, k: int = 500) -> DataFrame:
    """The ``k`` best sources of each query by sparse cosine, scores above 0 only."""
    found = _sparse_blocks(queries, sources, k).where("score > 0").drop("b", "compared")
    return found if "rank" in found.columns else top_k(found, k)


def _packed(rows: DataFrame) -> DataFrame:
    """One row for each id with its features and weights as arrays, which a text's length bounds."""
    return rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("feature", "w"))).alias("fs")).select("id", F.col("fs.feature").alias("f"), F.col("fs.w").alias("w"))


def _sparse_blocks(queries: DataFrame, sources: DataFrame, k: int | None, block: int = BLOCK) -> DataFrame:
    """Scores of queries against blocks of sources, and the rank where one block holds all sources; of each block the ``k`` best of a query leave the worker (None: all).

    ``compared``: how many sources of the block ``b`` were scored for the query.  Sources whose heaviest feature is the same lie in one block, and near each other in it.  With several blocks a query goes first
    to the group of blocks that can hold the highest score, by the largest weights of hashed features; its k-th score there is the
    floor for the others, and only groups that can reach it are asked.  In a block, see ``_block_scores``.
    """
    # written once, so that neither the counts nor the join make the weights again
    src, asked = staging.written(_packed(sources), "sources"), staging.written(_packed(queries), "queries")
    n = src.count()
    lead = F.array_max(F.transform(F.arrays_zip("w", "f"), lambda x: F.struct(F.abs(x["w"]).alias("w"), x["f"].alias("f"))))["f"]
    # blocks follow the number of sources and lanes that of queries: a task's share of both is bounded
    blocks = max(1, -(-n // max(block, min(16 * block, -(-n // GROUPS)))))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    lanes = max(-(-cores // blocks), -(-asked.count() // LANE))
    src = src.withColumn("lead", lead)
    if blocks == 1 or k is None:
        src = src.withColumn("b", F.pmod(F.xxhash64("lead", "id"), F.lit(blocks)).cast("int"))
        q = asked.withColumn("floor", F.lit(0.0)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return _met(src, q, k, lanes, ranked=blocks == 1 and k is not None)
    ranges = min(blocks, GROUPS)
    inner = -(-blocks // ranges)
    placed = src.repartitionByRange(ranges, "lead", "id").withColumn("g", F.spark_partition_id())
    src = staging.written(placed.withColumn("b", F.col("g") * inner + F.pmod(F.xxhash64("id"), F.lit(inner)).cast("int")), "source-blocks")
    routed = staging.written(_routed(asked, src, ranges), "query-routes")
    to_blocks = F.explode(F.transform(F.sequence(F.lit(0), F.lit(inner - 1)), lambda i: F.col("g") * inner + i.cast("int"))).alias("b")
    first = routed.select("id", "f", "w", F.col("groups")[0]["g"].alias("g"), F.lit(0.0).alias("floor"))
    home = staging.written(top_k(_met(src, first.select("id", "f", "w", "floor", to_blocks), k, lanes, False), k).drop("rank"), "home-scores")
    floors = home.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("q").alias("id"), "least")
    rest = routed.join(floors, "id", "left").withColumn("floor", F.coalesce("least", F.lit(0.0)))
    able = F.filter(F.slice("groups", 2, GROUPS), lambda x: x["bound"] >= F.col("floor"))
    rest = rest.select("id", "f", "w", "floor", F.explode(F.transform(able, lambda x: x["g"])).alias("g")).select("id", "f", "w", "floor", to_blocks)
    return home.unionByName(_met(src, rest, k, lanes, False))


def _routed(asked: DataFrame, src: DataFrame, groups: int) -> DataFrame:
    """Queries with the groups that share a feature with them, by descending bound of the score there."""
    import pyarrow as pa

    width = 1 << max(3, (SUMMARY // groups).bit_length() - 1)
    bucket = lambda f: F.pmod(F.xxhash64(f), F.lit(width)).cast("int")
    entries = src.select("g", F.explode(F.arrays_zip("f", "w")).alias("x")).groupBy("g", bucket(F.col("x.f")).alias("d")).agg(F.max(F.abs(F.col("x.w"))).alias("most"))
    pdf = entries.toPandas()  # SUMMARY rows at most
    most = np.zeros((width, groups))
    most[pdf["d"], pdf["g"]] = pdf["most"]

    def run(batches):
        for b in batches:
            size = np.diff(np.asarray(b.column("d").offsets))
            ends, d, w = np.cumsum(size), b.column("d").flatten().to_numpy(), np.abs(b.column("w").flatten().to_numpy())
            routes = []
            for n, end in zip(size, ends):
                bound = (most[d[end - n : end]] * w[end - n : end, None]).sum(axis=0) * (1 + 1e-9)
                order = np.argsort(-bound, kind="stable")[: max(1, np.count_nonzero(bound))]
                routes.append([{"g": int(g), "bound": float(bound[g])} for g in order])
            kind = pa.list_(pa.struct([("g", pa.int32()), ("bound", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("f"), b.column("w"), pa.array(routes, kind)], ["id", "f", "w", "groups"])

    kinds = dict(asked.dtypes)
    return asked.withColumn("d", F.transform("f", bucket)).mapInArrow(run, f"id {kinds['id']}, f {kinds['f']}, w array<double>, groups array<struct<g:int,bound:double>>")


def _met(src: DataFrame, asked: DataFrame, k: int | None, lanes: int, ranked: bool) -> DataFrame:
    """Every query (id, f, w, floor, b) against the sources of its block b, in ``lanes`` portions of queries."""
    import pyarrow as pa

    s = src.select("id", "f", "w", "lead", "b").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    q = asked.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int"))

    def solve(key: tuple, sp: pa.Table, qp: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(sp) and len(qp):
            parts += _block_scores(sp, qp, k)
        row, at, score, rank, compared = (np.concatenate(x) for x in zip(*parts))
        cols = {"q": _whole(qp, "id").take(pa.array(row)), "s": _whole(sp, "id").take(pa.array(at)), "score": pa.array(score), "b": pa.array(np.full(len(row), key[0].as_py(), np.int32)), "compared": pa.array(compared)}
        return pa.table(cols | ({"rank": pa.array(rank, pa.int32())} if ranked else {}))

    schema = f"q {dict(asked.dtypes)['id']}, s {dict(src.dtypes)['id']}, score double, b int, compared long" + (", rank int" if ranked else "")
    return s.groupBy("b", "lane").cogroup(q.groupBy("b", "lane")).applyInArrow(solve, schema)


def _whole(table, name: str):
    import pyarrow as pa

    c = table.column(name)
    return c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _runs(start, count):
    """The places start, start + 1, ... of ``count`` places each, one run after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _block_scores(sp, qp, k: int | None):
    """(query row, source row, score, rank, sources scored) of portions of queries, the k best of each.

    Postings are ordered by feature and source, and every run of one feature within SUB neighbouring sources has its largest weight.  A sparse
    product of the queries with these gives a bound for each (query, run of sources).  The runs with the highest bounds
    are scored first; those that cannot reach the k-th score so far, or the query's floor, are skipped with their postings.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    by_id = np.asarray(pc.sort_indices(_whole(sp, "id")))
    lead = np.asarray(pc.rank(_whole(sp, "lead"), tiebreaker="dense"))
    id_rank = np.empty(len(sp), np.int64)
    id_rank[by_id] = np.arange(len(sp))
    order = np.lexsort((id_rank, lead))  # neighbours share their heaviest feature
    place = np.empty(len(sp), np.int64)
    place[order] = np.arange(len(sp))
    n, subs = len(sp), -(-len(sp) // SUB)
    lists = _whole(sp, "f")
    size = np.diff(np.asarray(lists.offsets))
    coded = lists.flatten().dictionary_encode()
    code, owner, weight = coded.indices.to_numpy().astype(np.int64), np.repeat(place, size), _whole(sp, "w").flatten().to_numpy()
    o = np.lexsort((owner, code))
    code, owner, weight = code[o], owner[o], weight[o]
    run = code * subs + owner // SUB
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(run)])
    most = np.maximum.reduceat(np.abs(weight), first) if len(run) else np.zeros(0)
    sub = run[first] % subs
    of = np.searchsorted(code[first], np.arange(len(coded.dictionary) + 1))  # runs of each feature
    postings = np.searchsorted(code, np.arange(len(coded.dictionary) + 1))

    lists = _whole(qp, "f")
    sizes = np.diff(np.asarray(lists.offsets))
    known = pc.fill_null(pc.index_in(lists.flatten(), value_set=coded.dictionary), -1).to_numpy()
    row, w, floor = np.repeat(np.arange(len(qp)), sizes), _whole(qp, "w").flatten().to_numpy(), _whole(qp, "floor").to_numpy()
    keep = known >= 0
    known, row, w = known[keep], row[keep], w[keep]
    # portions of rows whose products and scores are held at once
    work = np.bincount(row, weights=postings[known + 1] - postings[known], minlength=len(qp)) + n
    portion = (np.cumsum(work) // HELD).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, portion[1:] != portion[:-1], True])
    edges = np.searchsorted(row, cuts)
    for a, z, lo, hi in zip(cuts[:-1], cuts[1:], edges[:-1], edges[1:]):
        rows, r, f, x = z - a, row[lo:hi] - a, known[lo:hi], w[lo:hi]
        runs_of = of[f + 1] - of[f]
        at = _runs(of[f], runs_of)
        r, x = np.repeat(r, runs_of), np.repeat(x, runs_of)
        cell = r * subs + sub[at]

        def added(todo) -> np.ndarray:
            """Scores of the runs of sources marked in ``todo`` (row, sub)."""
            use = todo.ravel()[cell]
            t, m = at[use], count[at[use]]
            p = _runs(first[t], m)
            return np.bincount(np.repeat(r[use], m) * n + owner[p], weights=np.repeat(x[use], m) * weight[p], minlength=rows * n).reshape(rows, n)

        if k is None or k >= n:
            scores, seen = added(np.ones((rows, subs), bool)), np.full(rows, n)
        else:
            bound = np.bincount(cell, weights=np.abs(x) * most[at], minlength=rows * subs).reshape(rows, subs) * (1 + 1e-9)
            start = min(subs, -(-k // SUB))
            leaders = np.argpartition(-bound, start - 1, axis=1)[:, :start]
            todo = np.zeros((rows, subs), bool)
            np.put_along_axis(todo, leaders, True, axis=1)
            todo &= (bound > 0) & (bound >= floor[a:z, None])
            scores = added(todo)
            least = np.maximum(np.partition(scores, n - k, axis=1)[:, n - k], floor[a:z])
            more = (bound >= least[:, None]) & (bound > 0) & ~todo
            if more.any():
                scores += added(more)
            width = np.full(subs, SUB)
            width[-1] = n - SUB * (subs - 1)
            seen = (todo | more) @ width
        got = scores != 0
        if k is not None and k < n:
            got &= scores >= np.partition(scores, n - k, axis=1)[:, [n - k]]
        i, s = np.nonzero(got)
        value = scores[i, s]
        o = np.lexsort((id_rank[order[s]], -value, i))
        i, s, value = i[o], s[o], value[o]
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        if k is not None:
            keep = rank <= k
            i, s, value, rank = i[keep], s[keep], value[keep], rank[keep]
        yield i + a, order[s], value, rank, seen[i]


def dense_top_k(queries: DataFrame, sources: DataFrame, k: int = 500, block: int = 4096) -> DataFrame:
    """Exact top-k by inner product: sources in blocks, each query meets every block in a matrix product."""
    found = _dense_blocks(queries, sources, k, block)
    return found if "rank" in found.columns else top_k(found, k)


def pairwise(queries: DataFrame, sources: DataFrame, block: int = 4096) -> DataFrame:
    """``q, s, score``: the whole matrix of inner products of a stated query set, in blocks."""
    return _dense_blocks(queries, sources, None, block).select("q", "s", "score")


def _dense_scores(x: np.ndarray, ids: np.ndarray, asked: np.ndarray, vectors: list, k: int | None) -> pd.DataFrame:
    """The ``k`` best of source rows in order of their ids, for some queries."""
    scores = np.stack(vectors).astype(float) @ x.T
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return pd.DataFrame({"q": np.repeat(asked, order.shape[1]), "s": ids[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel(), "rank": np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(order))})


def _dense_blocks(queries: DataFrame, sources: DataFrame, k: int | None, block: int) -> DataFrame:
    """Scores, and the rank where one block holds all sources: it is broadcast and queries stay where they are.  Several blocks are met by queries in lanes, so that no task holds them all."""
    kinds = f"q {dict(queries.dtypes)['id']}, s {dict(sources.dtypes)['id']}, score double"
    n = sources.count()
    if n <= block:
        rows = sources.select("id", "v").toPandas().sort_values("id")  # one block
        known = sources.sparkSession.sparkContext.broadcast((np.stack(rows["v"].to_numpy()).astype(float) if n else None, rows["id"].to_numpy()))

        def scored(batches):
            x, ids = known.value
            for pdf in batches if len(ids) else ():
                for a in range(0, len(pdf), 1024):
                    part = pdf.iloc[a : a + 1024]
                    yield _dense_scores(x, ids, part["id"].to_numpy(), part["v"].to_list(), k)

        return queries.select("id", "v").mapInPandas(scored, kinds + ", rank int")
    blocks, asked = -(-n // block), staging.written(queries.select("id", "v"), "dense-queries")
    lanes = max(1, -(-asked.count() // LANE))
    every = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    s = sources.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), every(lanes, "lane"))
    # names of their own: both sides may come from one table
    q = asked.select(F.col("id").alias("qid"), F.col("v").alias("qv"), every(blocks, "qb"), F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int").alias("ql"))

    def solve(sp: pd.DataFrame, qp: pd.DataFrame) -> pd.DataFrame:
        if not len(sp) or not len(qp):
            return pd.DataFrame({"q": [], "s": [], "score": []})
        sp = sp.sort_values("id")
        x, ids = np.stack(sp["v"].to_numpy()).astype(float), sp["id"].to_numpy()
        parts = (qp.iloc[a : a + 1024] for a in range(0, len(qp), 1024))
        return pd.concat(_dense_scores(x, ids, p["qid"].to_numpy(), p["qv"].to_list(), k)[["q", "s", "score"]] for p in parts)

    return s.groupBy("b", "lane").cogroup(q.groupBy("qb", "ql")).applyInPandas(solve, kinds)


def threshold_search(scored: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    return top_k(scored, k).select("q", "s", F.round("score", 4).alias("score"), "rank").where(F.col("score") >= least)


#: Source texts of a block, query texts of a lane, and ranges of set sizes, of the trigram join.
TEXTS, TEXT_LANE, RANGES = 2048, 4096, 1024


def trigram_best(queries: DataFrame, sources: DataFrame, least: float = 0.12, group: str | None = None, block: int | None = None) -> DataFrame:
    """Best source text of each query text by Jaccard similarity of trigram sets, at least ``least``: ``q, qpos, s, spos, score, compared``.

    Inputs ``id, pos, text`` (lower case); ties go to the smaller (id, pos).  With ``group``, a column of both sides, only texts of the same
    group meet.  Otherwise sources lie in blocks by the size of their sets, and a query visits only blocks of sizes that can reach
    ``least``.  Within a block see ``_trigram_block``; no trigram is ever a row.  ``compared``: sources whose whole sets were compared.
    """
    import pyarrow as pa

    cores = queries.sparkSession.sparkContext.defaultParallelism
    if group is not None:
        # a group with many queries is dealt to several lanes; its sources go to each
        n, q = F.col("_n"), queries.select("id", "pos", "text", F.col(group).alias("b"))
        counts = q.groupBy("b").agg(F.ceil(F.count("*") / TEXT_LANE).cast("int").alias("_n"))
        q = q.join(counts, "b").select("id", "pos", "text", "b", F.pmod(F.xxhash64("id", "pos"), n).cast("int").alias("lane"))
        s = sources.select("id", "pos", "text", F.col(group).alias("b")).join(counts, "b").select("id", "pos", "text", "b", F.explode(F.sequence(F.lit(0), n - 1)).alias("lane"))
    else:
        src = staging.written(_sized(sources.select("id", "pos", "text")).where("n > 0"), "trigram-sources")
        rows = src.count()
        blocks = max(1, -(-rows // (block or TEXTS)))
        ranges = min(blocks, RANGES)
        inner = -(-blocks // ranges)
        src = staging.written(src.repartitionByRange(ranges, "n", "id", "pos").withColumn("g", F.spark_partition_id()), "trigram-blocks")
        bounds = {r["g"]: (r["low"], r["high"]) for r in src.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high")).collect()}  # RANGES rows at most
        low = np.array([bounds.get(g, (1 << 60, 0))[0] for g in range(ranges)])
        high = np.array([bounds.get(g, (1 << 60, 0))[1] for g in range(ranges)])

        def routed(batches):
            for b in batches:
                sizes = b.column("n").to_numpy()
                able = [np.flatnonzero((high >= least * n - 1e-9) & (least * low <= n + 1e-9)).tolist() for n in sizes]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("pos"), b.column("text"), pa.array(able, pa.list_(pa.int32()))], ["id", "pos", "text", "able"])

        kinds = dict(queries.dtypes)
        asked = staging.written(_sized(queries.select("id", "pos", "text")).where("n > 0").mapInArrow(routed, f"id {kinds['id']}, pos {kinds['pos']}, text string, able array<int>"), "trigram-queries")
        lanes = max(-(-cores // blocks), -(-asked.count() // TEXT_LANE))
        every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        s = src.withColumn("b", F.col("g") * inner + F.pmod(F.xxhash64("id", "pos"), F.lit(inner)).cast("int")).select("id", "pos", "text", "b", every(lanes, "lane"))
        q = asked.select("id", "pos", "text", F.explode("able").alias("g")).select("id", "pos", "text", "g", every(inner, "i"))
        q = q.select("id", "pos", "text", (F.col("g") * inner + F.col("i")).alias("b"), F.pmod(F.xxhash64("id", "pos"), F.lit(lanes)).cast("int").alias("lane"))

    def solve(sp: pa.Table, qp: pa.Table) -> pa.Table:
        row, at, score, compared = zip(*_trigram_block(sp, qp, least), (-1, -1, 0.0, 0))
        q, s = pa.array(row[:-1], pa.int64()), pa.array(at[:-1], pa.int64())
        return pa.table({"q": _whole(qp, "id").take(q), "qpos": _whole(qp, "pos").take(q), "s": _whole(sp, "id").take(s), "spos": _whole(sp, "pos").take(s), "score": pa.array(score[:-1], pa.float64()), "compared": pa.array(compared[:-1], pa.int64())})

    kinds = dict(queries.dtypes), dict(sources.dtypes)
    schema = f"q {kinds[0]['id']}, qpos {kinds[0]['pos']}, s {kinds[1]['id']}, spos {kinds[1]['pos']}, score double, compared long"
    met = s.groupBy("b", "lane").cogroup(q.groupBy("b", "lane")).applyInArrow(solve, schema)
    best = F.row_number().over(Window.partitionBy("q", "qpos").orderBy(F.desc("score"), "s", "spos"))
    return met.withColumn("r", best).where("r = 1").drop("r")


def _trigrams(text: str):
    """The distinct trigrams of a text as sorted numbers: three code points of 21 bits each."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else c[:0]


def _sized(texts: DataFrame) -> DataFrame:
    """``texts`` with ``n``, how many different trigrams each has; null texts have none."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            n = [len(_trigrams(t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32())], [*b.schema.names, "n"])

    return texts.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in texts.dtypes) + ", n int")


def _trigram_block(sp, qp, least: float):
    """(query row, source row, score, sources compared) of the best source of each query in a part of the block.

    Trigrams are ordered by how few sources of the part have them; those that none has come first.  A pair that reaches ``least`` has
    an overlap of ``a`` or more, so what is left of both sets after all but their last a - l trigrams shares l of them: only these prefixes
    are indexed and looked up, and only sources with enough hits and a size within reach are compared whole.
    """
    if not len(sp) or not len(qp):
        return
    order = sp.select(["id", "pos"]).append_column("row", [np.arange(len(sp))]).sort_by([("id", "ascending"), ("pos", "ascending")]).column("row").to_numpy()
    texts = sp.column("text").to_pylist()
    sets = [_trigrams(texts[i] or "") for i in order]
    asked = [_trigrams(t or "") for t in qp.column("text").to_pylist()]
    floor = lambda n: np.maximum(np.ceil(least * n - 1e-9).astype(np.int64), 1)
    a = 0
    while a < len(sets):
        z, held, seen = a, 0, 0
        while z < len(sets) and (z == a or (held + len(sets[z])) * (seen + 1) <= 1 << 26):  # what the table of members may take
            held, seen, z = held + len(sets[z]), seen + 1, z + 1
        size = np.array([len(x) for x in sets[a:z]])
        names, code, many = np.unique(np.concatenate(sets[a:z]), return_inverse=True, return_counts=True)
        if len(names):
            rarity = np.empty(len(names), np.int64)
            rarity[np.lexsort((names, many))] = np.arange(len(names))
            owner, token = np.repeat(np.arange(z - a), size), rarity[code]
            o = np.lexsort((token, owner))
            owner, token = owner[o], token[o]
            member = np.zeros((z - a, len(names)), bool)
            member[owner, token] = True
            overlap = floor(size)
            hits = (overlap + 1) // 2
            prefix = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(size - overlap + hits, size)
            owner, token = owner[prefix], token[prefix]
            o = np.argsort(token, kind="stable")
            owner, bound = owner[o], np.searchsorted(token[o], np.arange(len(names) + 1))
            for row, x in enumerate(asked):
                at = np.searchsorted(names, x)
                at[at == len(names)] = 0
                mine = np.sort(rarity[at[names[at] == x]])
                n = len(x)
                need = int(floor(n))
                if not n or len(mine) < need:
                    continue
                enough = (need + 1) // 2
                probe = mine[: max(0, len(mine) - need + enough)]
                found = np.bincount(owner[_runs(bound[probe], bound[probe + 1] - bound[probe])], minlength=z - a)
                able = np.flatnonzero((found >= np.minimum(enough, hits)) & (size >= least * n - 1e-9) & (least * size <= n + 1e-9))
                if len(able):
                    common = member[able[:, None], mine[None, :]].sum(axis=1)
                    score = common / (n + size[able] - common)
                    top = int(score.argmax())  # sources lie in order of their ids
                    if score[top] >= least:
                        yield row, int(order[a + able[top]]), float(score[top]), len(able)
        a = z
