"""MinHash near-dedup with tensored banding.

Documents with equal shingle sets are one class.  A class gets two small collections of ``GROUPS`` band
keys (``ROWS`` minhashes each); table (i, j) is keyed by the pair of the i-th key of the first and the j-th key
of the second collection, so 2 * GROUPS * ROWS minhashes serve GROUPS^2 tables.  A pair of similarity s
meets in some table unless one collection has no common key: with ROWS = 3, GROUPS = 16 a pair at 0.75
is missed with probability 3e-4, one at 0.85 with 1e-7.  A key that only one class has is dropped before pairs of keys are formed.

Classes that meet are gathered into candidate groups (components over tables; nothing is paired up yet).
Within a group every pair is decided on full sets: shingles that only one member has rule out members that
can't reach the threshold, and intersections of the others are counted by products of incidence
matrices.  Large groups are split into blocks and each pair of blocks is a task of its own; a task returns a
spanning forest of its links, never all of them.

Cases: null and empty texts have an empty set and link with nothing; fewer than five words are one
shingle; rows that share a doc_id are one document, whose links are those of all its texts; rows with a
null doc_id link with nothing and are kept; repeated rows are reported each.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, documents, drop_staged, map_by_id, parts, staged, trim

WORDS, SIMILAR = 5, 75
ROWS, GROUPS = 3, 16
#: A block of a candidate group has at most about so many shingles and classes.
BLOCK_SHINGLES, BLOCK_ROWS = 1_500_000, 1536
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, 2 * GROUPS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, 2 * GROUPS * ROWS, dtype=np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``text``."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)
    n = min(words, len(h))
    s = np.full(len(h) - n + 1, np.uint64(n))
    for j in range(n):
        s = _mix(s * _GOLD + h[j : len(h) - n + 1 + j])
    return np.unique(s)


def band_keys(s: np.ndarray) -> np.ndarray:
    """2 * GROUPS keys of a non-empty set: those of the first collection, then those of the second."""
    low = np.full(len(_A), ~np.uint64(0))
    for a in range(0, len(s), 2048):
        low = np.minimum(low, (_A[:, None] * s[None, a : a + 2048] + _B[:, None]).min(axis=1))
    bands = low.reshape(2 * GROUPS, ROWS)
    key = np.arange(1, 2 * GROUPS + 1, dtype=np.uint64) * _GOLD
    for r in range(ROWS):
        key = _mix(key + bands[:, r])
    return key.view(np.int64)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            s = shingle_set(text)
            if len(s):
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                rows.append((doc_id, len(s), (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), band_keys(s)))
            else:
                rows.append((doc_id, 0, 0, 0, None))
        yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "k1", "k2", "keys"])
        del rows
        trim()  # workers live on in the stages after this one


def linked(inter: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * inter >= SIMILAR * (n[:, None] + m[None, :] - inter)


def _intersections(cat: np.ndarray, owner: np.ndarray, rows: np.ndarray, cols: np.ndarray, total: int) -> np.ndarray:
    """Sizes of the intersections of the sets ``rows`` with the sets ``cols``."""
    values, code = np.unique(cat, return_inverse=True)
    out = np.zeros((len(rows), len(cols)), np.float32)
    at_row, at_col = np.full(total, -1), np.full(total, -1)
    at_row[rows], at_col[cols] = np.arange(len(rows)), np.arange(len(cols))
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    step = 4096
    for lo in range(0, len(values), step):
        a, b = np.searchsorted(code, [lo, lo + step])
        width = min(step, len(values) - lo)
        sides = []
        for place, size in ((at_row, len(rows)), (at_col, len(cols))):
            x = np.zeros((size, width), np.float32)
            mine = place[owner[a:b]]
            ok = mine >= 0
            x[mine[ok], code[a:b][ok] - lo] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


def forest(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray) -> list[tuple[int, int]]:
    """Edges (id, id) that span the links among ``sets``.

    ``left``: which sets are in the first of two blocks; if both kinds occur, only links across are looked for.
    """
    cross = left.any() and not left.all()
    alive = np.arange(len(sets))
    while len(alive) > 1:
        sizes = np.array([len(sets[i]) for i in alive])
        cat = np.concatenate([sets[i] for i in alive])
        owner = np.repeat(alive, sizes)
        values, code, count = np.unique(cat, return_inverse=True, return_counts=True)
        common = count[code] > 1
        shared = np.bincount(owner[common], minlength=len(sets))[alive]
        able = 100 * shared >= SIMILAR * sizes
        if able.all():
            break
        alive = alive[able]
    if len(alive) < 2:
        return []
    rows, cols = (alive[left[alive]], alive[~left[alive]]) if cross else (alive, alive)
    if not len(rows) or not len(cols):
        return []
    n = np.array([len(s) for s in sets], np.float64)
    inter = _intersections(cat[common], owner[common], rows, cols, len(sets))
    link = linked(inter, n[rows], n[cols])
    edges, seen_row, seen_col = [], np.zeros(len(rows), bool), np.zeros(len(cols), bool)
    for start in range(len(rows)):
        if seen_row[start]:
            continue
        seen_row[start] = True
        todo = [(True, start)]
        while todo:
            is_row, k = todo.pop()
            hits = link[k] if is_row else link[:, k]
            seen = seen_col if is_row else seen_row
            new = np.flatnonzero(hits & ~seen)
            seen[new] = True
            mine, other = (rows, cols) if is_row else (cols, rows)
            for x in new.tolist():
                if ids[mine[k]] != ids[other[x]]:
                    edges.append((int(ids[mine[k]]), int(ids[other[x]])))
                todo.append((not is_row, x))
    return edges


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    edges = []
    for _, part in pdf.groupby("cluster", sort=False):
        if len(part) > 1:
            sets = [np.frombuffer(b, np.uint64) for b in part["shingles"]]
            edges += forest(part["id"].to_numpy(), sets, (part["block"] == part["i"]).to_numpy() & (part["i"] != part["j"]).to_numpy())
    trim()
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def _shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.drop(columns="text").assign(shingles=[shingle_set(t).tobytes() for t in pdf["text"]])
        del pdf
        trim()


def links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Spanning edges ``a, b`` (smallest doc_ids of their classes) of all links of different sets."""
    spark = docs.sparkSession
    known = signed.where("n_shingles > 0 and doc_id is not null")
    classes = staged(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")
    each = classes.select("id", F.posexplode("keys").alias("pos", "key"))
    again = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = each.join(again, "key")
    first, second = F.col("pos") < GROUPS, F.col("pos") >= GROUPS
    keys = shared.groupBy("id").agg(F.collect_list(F.when(first, F.col("key"))).alias("left"), F.collect_list(F.when(second, F.col("key"))).alias("right"))
    tables = staged(keys.select("id", F.explode(F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: F.xxhash64(a, b))))).alias("table")), "tables")
    heads = tables.groupBy("table").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head < tail").select("table", "head")
    met = tables.join(heads, "table").where("id <> head").groupBy("id").agg(F.array_sort(F.collect_set("head")).alias("heads"))  # GROUPS^2 at most
    # a class needs an edge to its first head only, and that head one to the others: few edges, for heads are few
    star = F.concat(F.array(F.struct(F.col("id").alias("a"), F.element_at("heads", 1).alias("b"))), F.transform(F.slice("heads", 2, GROUPS * GROUPS), lambda h: F.struct(F.element_at("heads", 1).alias("a"), h.alias("b"))))
    cluster = components(met.select(F.explode(star).alias("e")).select("e.a", "e.b")).withColumnRenamed("component", "cluster")
    sized = staged(cluster.join(classes.select("id", "n"), "id"), "sized")
    drop_staged(tables)
    total = sized.groupBy("cluster").agg(F.sum("n").alias("shingles"), F.count("*").alias("rows"))
    total = total.select("cluster", F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int").alias("blocks"))
    weight = sized.agg(F.sum("n")).first()[0] or 0
    bins = max(parts(spark), int(weight // BLOCK_SHINGLES) + 1)
    member = sized.select("id", "cluster").distinct().join(total, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    texts = documents(docs).select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    # merge: the same plan at every size, as the candidates grow with the corpus
    shingled = texts.join(member.hint("merge"), "id").select("id", "cluster", "blocks", "block", "text").mapInPandas(_shingled, "id long, cluster long, blocks int, block int, shingles binary")
    # a small group shares a bin with others; a large one has a task for each pair of its blocks
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(F.least(y, F.col("block")).alias("i"), F.greatest(y, F.col("block")).alias("j")))
    dealt = shingled.withColumn("p", F.explode(pairs)).select("id", "cluster", "block", "p.i", "p.j", "shingles", F.when(F.col("blocks") > 1, F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(bins))).alias("bin"), (F.col("blocks") > 1).alias("large"))
    return dealt.groupBy("large", "bin", "i", "j").applyInPandas(_solve, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    signed = staged(map_by_id(documents(docs), _signatures, "doc_id long, n_shingles long, k1 long, k2 long, keys array<long>"), "signed")
    label = components(links(docs, signed))
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"))
    # a document with several texts belongs to the classes of all of them
    own = signed.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left").withColumn("first_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("first_id")))
    out = own.join(label, own["first_id"] == label["id"], "left")
    component = F.coalesce("component", "first_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
