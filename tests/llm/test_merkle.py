"""The manifest against plain recursion, for many shapes of trees; and the laws of the monoid."""

import hashlib
import itertools
import random
import zlib

import pytest

from lexatlas.llm import merkle_manifest as M


def h(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def brute(rows):
    f = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: h(f(r[0]), f(r[3]), f(r[2]), f(r[4]), f(text))
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[lang] = mine, levels([leaf(r, r[1]) for r in mine])
    top = levels([trees[lang][1][-1][0] for lang in langs])
    out = []
    for n, lang in enumerate(langs):
        mine, tree = trees[lang]
        for i, r in enumerate(mine):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            now, siblings = leaf(r, r[1].translate(low) if hit else r[1]), ""
            for levs, at in ((tree, i), (top, n)):
                for lev in levs[:-1]:
                    run = lev[at // 8 * 8 : at // 8 * 8 + 8]
                    siblings += "".join(run[: at % 8] + run[at % 8 + 1 :])
                    now = h(*run[: at % 8], now, *run[at % 8 + 1 :])
                    at //= 8
            out.append((r[0], leaf(r, r[1]), tree[-1][0], top[-1][0], h(siblings), now, now == top[-1][0]))
    return sorted(out, key=repr)


def manifest(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key int, leaf string")
    return sorted((tuple(r) for r in M.document_manifest(df).collect()), key=repr)


@pytest.mark.parametrize("n,langs,part", [(1, 1, 50_000), (9, 1, 3), (64, 2, 7), (700, 3, 11), (60, 60, 4)])
def test_shapes(spark, monkeypatch, n, langs, part):
    monkeypatch.setattr(M, "PART", part)
    monkeypatch.setattr(M, "FAN", 2)
    rng = random.Random(n)
    rows = [(i * 3, f"Text {rng.random()}", f"l{rng.randrange(langs)}", "s", 4) for i in range(n)]
    assert manifest(spark, rows) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "PART", 13)
    rows = [(i, None if i % 7 == 0 else "É " * i, None if i % 3 == 0 else "en", None, None if i % 5 else i) for i in range(90)]
    rows += [(None, "a", "en", "s", 1), (None, "b", "en", "s", 1), (4, "B", "en", "s", 1), (4, "B", "en", "s", 1), (-(1 << 60) - 1, "", "", "", 0), ((1 << 60) + 1, "X" * 1_000_000, "é", "|", 2)]
    rows += [(12, "Same", "en", "s", 4)] * 40  # a third of the rows are one row
    assert manifest(spark, rows) == brute(rows)


def test_empty(spark):
    assert manifest(spark, []) == []


def test_monoid_is_associative_and_commutative():
    rng = random.Random(3)
    for n in (1, 2, 8, 9, 65, 200):
        leaves = {i: h(str(i)) for i in range(n)}
        cuts = sorted(rng.sample(range(1, n), min(n - 1, 4))) if n > 1 else []
        parts = [{(0, i): (leaves[i], k, k) for i in range(a, b)} for k, (a, b) in enumerate(itertools.pairwise([0, *cuts, n]))]
        parts = [M.merged([p], n)[0] for p in parts]
        whole = M.merged(parts, n)[0]
        assert [d for d, _, _ in whole.values()] == levels(list(leaves.values()))[-1]
        for _ in range(10):
            todo = list(parts)
            rng.shuffle(todo)
            while len(todo) > 1:
                a, b = todo.pop(rng.randrange(len(todo))), todo.pop(rng.randrange(len(todo)))
                todo.append(M.merged([a, b], n)[0])
            assert todo[0] == whole
