"""Merkle manifest of a dataset: an associative monoid of sparse forests.

Leaves are dealt to parts by range of (key, order), so a part holds runs of consecutive leaves.  A *forest* is a set of unresolved
nodes keyed by (key, level, index).  ``merged`` unites two forests and hashes every run of siblings that is then complete; the
number of siblings is known from the number of the key's leaves.  The operation is associative and commutative and a
forest of consecutive leaves keeps at most 2 * (ARITY - 1) nodes a level and key, so parts are reduced as a tree: each step merges
FAN neighbouring forests in one task, until one is left.  Runs that complete in this tree are handed back to the parts that lie under them; all
others are remade within their part, so a leaf's proof needs no join by level.

Cases: ``-`` stands for a null field; null keys are a key of their own, which comes first; repeated rows are leaves each, equal ids are
ordered by their leaf digest and equal digests may change places; an empty table has no root and gives no row.  Parts are cut by
rows, never by key, so one key with most rows is spread like any other, and so are repeats of one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, parts, staged

ARITY, FAN = 8, 16
#: Leaves of a part, about: what one task holds at once.
PART = 50_000

#: (level, index) -> (digest, first part, last part)
Forest = dict[tuple[int, int], tuple[str, int, int]]


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def level_sizes(n: int) -> list[int]:
    """Nodes of each level over ``n`` leaves, up to the single top."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def merged(forests: Iterable[Forest], n: int) -> tuple[Forest, list[tuple[int, int, list[str], int, int]]]:
    """The union of disjoint forests over ``n`` leaves with complete sibling runs hashed; and these runs as (level, parent index, digests, first part, last part)."""
    nodes: Forest = {}
    for f in forests:
        nodes.update(f)
    sizes, runs = level_sizes(n), []
    for level in range(len(sizes) - 1):
        families: dict[int, list[int]] = {}
        for at, i in nodes:
            if at == level:
                families.setdefault(i // ARITY, []).append(i)
        for parent, members in families.items():
            if len(members) == min(ARITY, sizes[level] - ARITY * parent):
                children = [nodes.pop((level, i)) for i in sorted(members)]
                first, last = min(c[1] for c in children), max(c[2] for c in children)
                digests = [c[0] for c in children]
                nodes[level + 1, parent] = (digest_of(*digests), first, last)
                runs.append((level, parent, digests, first, last))
    return nodes, runs


def _numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` (key, leaf, ...) with the part they lie in, their place within (part, key), the part's first place in the key and the key's leaves."""
    rows = leaves.count()
    n = max(1, min(rows, max(parts(leaves.sparkSession), -(-rows // PART))))
    # the salt only parts equal rows; a null key comes first, as in Spark's ascending order
    salted = leaves.withColumn("salt", F.monotonically_increasing_id())
    placed = staged(salted.repartitionByRange(n, "key", *order, "leaf", "salt").withColumn("part", F.spark_partition_id()), "merkle-parts")
    spans = placed.groupBy("part", "key").agg(F.count("*").alias("m"))
    # a key has at most one row a part here
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("part", "key", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"), F.sum("m").over(Window.partitionBy("key")).alias("total"))
    return placed.join(spans.withColumnRenamed("part", "p").withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p"))).select(*placed.columns, "first", "total")


def _places(pdf: pd.DataFrame, order: list[str]) -> Iterator[tuple[object, pd.DataFrame]]:
    """(key, its rows in order) of one part."""
    for key, rows in pdf.sort_values([*order, "leaf", "salt"], kind="stable", na_position="first").groupby("key", dropna=False, sort=False):
        yield (None if pd.isna(key) else key), rows


def _local(rows: pd.DataFrame, part: int) -> tuple[Forest, list[tuple[int, int, list[str], int, int]], int]:
    first, total = int(rows["first"].iloc[0]), int(rows["total"].iloc[0])
    forest = {(0, first + i): (leaf, part, part) for i, leaf in enumerate(rows["leaf"])}
    return *merged([forest], total), total


_NODES = "kind string, key string, total long, level int, place long, digests array<string>, first int, last int"


def _rows(key, total: int, nodes: Forest, runs, keep_runs: bool) -> list[tuple]:
    top = len(level_sizes(total)) - 1
    out = [("root" if level == top else "open", key, total, level, i, [d], a, b) for (level, i), (d, a, b) in nodes.items()]
    return out + [("run", key, total, level, i, digests, a, b) for level, i, digests, a, b in runs if keep_runs]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "key", "total", "level", "place", "digests", "first", "last"])


def tree_reduced(numbered: DataFrame, order: list[str]) -> DataFrame:
    """Roots of all keys and the runs that span parts: (kind, key, total, level, place, digests, first, last)."""

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        part, rows = int(pdf["part"].iloc[0]), []
        for key, leaves in _places(pdf, order):
            nodes, _, total = _local(leaves, part)
            rows += _rows(key, total, nodes, [], False)
        return _frame(rows)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key, mine in pdf.groupby("key", dropna=False, sort=False):
            total = int(mine["total"].iloc[0])
            forest = {(int(v), int(i)): (d[0], int(a), int(b)) for v, i, d, a, b in zip(mine["level"], mine["place"], mine["digests"], mine["first"], mine["last"])}
            rows += _rows(None if pd.isna(key) else key, total, *merged([forest], total), True)
        return _frame(rows)

    now = staged(numbered.groupBy("part").applyInPandas(start, _NODES), "merkle-forests")
    done = now.where("kind <> 'open'")
    span = 1
    while not now.where("kind = 'open'").isEmpty():
        span *= FAN
        now = staged(now.where("kind = 'open'").groupBy(F.floor(F.col("first") / span)).applyInPandas(step, _NODES), "merkle-forests")
        done = done.unionByName(now.where("kind <> 'open'"))
    return done


def _path(level: int, place: int, sizes: list[int], runs: dict[tuple[int, int], list[str]], memo: dict) -> tuple[str, tuple[tuple[str, str], ...]]:
    """All siblings from ``level`` up, joined, and per level what stands before and after the node."""
    if level == len(sizes) - 1:
        return "", ()
    if (level, place) not in memo:
        run, at = runs[level, place // ARITY], place % ARITY
        before, after = "".join(run[:at]), "".join(run[at + 1 :])
        siblings, above = _path(level + 1, place // ARITY, sizes, runs, memo)
        memo[level, place] = (before + after + siblings, ((before, after), *above))
    return memo[level, place]


def _proved(numbered: DataFrame, reduced: DataFrame, order: list[str], carry: str, schema: str, row, upper: DataFrame | None = None) -> DataFrame:
    """``row(leaf row, siblings, steps, subroot, upper steps of its key)`` for every leaf, as rows of ``schema``."""
    runs = reduced.where("kind = 'run'").select(F.explode(F.sequence("first", "last")).alias("part"), "kind", "key", "level", "place", "digests")
    roots = reduced.where("kind = 'root'").select("key", F.col("digests")[0].alias("root"))
    spans = numbered.select("part", "key").distinct()
    tops = spans.join(roots.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).select("part", "key", "root")
    if upper is not None:
        tops = tops.join(upper.withColumnRenamed("key", "k2"), F.col("key").eqNullSafe(F.col("k2"))).select("part", "key", "root", "steps", "top")
    else:
        tops = tops.withColumns({"steps": F.array().cast("array<array<string>>"), "top": F.col("root")})
    given = runs.select("part", "kind", "key", "level", "place", "digests", F.lit(None).cast("array<array<string>>").alias("steps"), F.lit(None).cast("string").alias("top"))
    given = given.unionByName(tops.select("part", F.lit("top").alias("kind"), "key", F.lit(0).alias("level"), F.lit(0).cast("long").alias("place"), F.array("root").alias("digests"), "steps", "top"))

    def prove(leaves: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        part, out = int(leaves["part"].iloc[0]), []
        crossing: dict[object, dict] = {}
        tops: dict[object, tuple] = {}
        for kind, key, level, place, digests, steps, top in zip(*(known[c] for c in ("kind", "key", "level", "place", "digests", "steps", "top"))):
            key = None if pd.isna(key) else key
            if kind == "run":
                crossing.setdefault(key, {})[int(level), int(place)] = list(digests)
            else:
                tops[key] = (digests[0], [tuple(s) for s in steps], top)
        for key, rows in _places(leaves, order):
            _, made, total = _local(rows, part)
            runs = crossing.get(key, {}) | {(level, place): digests for level, place, digests, _, _ in made}
            sizes, memo, first = level_sizes(total), {}, int(rows["first"].iloc[0])
            for i, leaf in enumerate(rows[["leaf", *carry.split(", ")]].itertuples(index=False, name=None)):
                out.append(row(key, leaf, *_path(0, first + i, sizes, runs, memo), *tops[key]))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return numbered.groupBy("part").cogroup(given.groupBy("part")).applyInPandas(prove, schema)


def manifest(leaves: DataFrame) -> DataFrame:
    """Proofs of ``leaves`` (doc_id long, key string, leaf, altered): one tree for each key, ordered by doc_id, and one over the keys' roots.

    ``altered`` is the digest of the leaf as it is found again; ``folded_root`` is remade from it and the original siblings.
    """
    order = ["doc_id"]
    # null ids come first, and no pandas column turns into floating point
    numbered = _numbered(leaves.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), *order)
    reduced = staged(tree_reduced(numbered, order), "merkle-runs")
    # the keys' roots are the leaves of one more tree, ordered by key
    keys = reduced.where("kind = 'root'").select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("digests")[0].alias("leaf"))
    ranked = _numbered(keys, "name")
    above = tree_reduced(ranked, ["name"])
    steps = staged(_proved(ranked, above, ["name"], "name", "key string, steps array<array<string>>, top string", lambda _, leaf, siblings, path, root, steps, top: (leaf[1], [list(p) for p in path], top)), "merkle-keys")

    def row(key, leaf, siblings, path, subroot, upper, top):
        digest, doc_id, altered = leaf
        found = altered
        for before, after in (*path, *upper):
            found = digest_of(before, found, after)
        proof = digest_of(siblings, *(x for pair in upper for x in pair))
        return int(doc_id), digest, subroot, top, proof, found, found == top

    out = _proved(numbered, reduced, order, "doc_id, altered", "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", row, steps)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def _field(c: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, key`` (lang) ``, leaf, altered`` of every row of ``documents``; every third crc32 of an id tampers with the text."""

    def leaf(text: Column) -> Column:
        return F.sha2(F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)).cast("binary"), 256)

    tampered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("key"), leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(tampered)).alias("other")).select("doc_id", "key", "leaf", F.coalesce("other", "leaf").alias("altered"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``: leaf, subroot, root, proof, and the check of each tampered row."""
    return manifest(staged(document_leaves(docs), "merkle-leaves"))
