"""Fingerprints, edits and likeness against a plain computation, over several bands."""

import collections
import hashlib
import math
import random

from lexatlas.llm import quartile_digest as D

M = (1 << 32) - 1


def codes(data):
    counts = [0] * 256
    for k, (i, j, l) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3))):
        for p in range(len(data) - l):
            a, b, c = data[p + i], data[p + j], data[p + l]
            h = (a * 0x9E3779B1 & M) ^ (b * 0x85EBCA6B & M) ^ ((c * 0xC2B2AE35 + k * 0x27D4EB2F) & M)
            h ^= h >> 15
            counts[(h * 0x2C1B3C6D & M) >> 24] += 1
    q = sorted(counts)
    quarter = [q[64 * k - 1] for k in (1, 2, 3)]
    ratios = (quarter[0] * 15 // quarter[2], quarter[1] * 15 // quarter[2]) if quarter[2] else (0, 0)
    return [min(255, round(math.log1p(len(data)) * 12)), *ratios], [sum(c > x for x in quarter) for c in counts]


def packed(head, body):
    out = [head[0], head[1] << 4 | head[2]]
    return bytes(out + [sum(body[4 * k + i] << 2 * i for i in range(4)) for k in range(64)]).hex()


def like(x, y):
    apart = sum((0, 1, 2, 6)[abs(a - b)] for a, b in zip(x[1], y[1])) + sum(abs(a - b) for a, b in zip(x[0], y[0]))
    return 1 - min(apart, D.MAX_DIFF) / D.MAX_DIFF


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = collections.Counter()
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        a, b, c = (codes(x.encode()) for x in (text, edited, following))
        out[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(*a), packed(*b), round(like(a, b), 9), round(like(a, c), 9)] += 1
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abcdefgh é€\n") for _ in range(rng.randint(0, 400)))
    rows = [(rng.randint(-500, 500), text()) for _ in range(120)] + [((1 << 62) + 1, text()), ((1 << 62) + 2, text()), (None, text()), (None, None), (None, text()), (3, None), (4, ""), (5, "ab")]
    rows += [rows[0], rows[0], (rows[0][0], "another text of one id")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, band int, fingerprint string").repartition(5)
    want = brute(rows)
    for bands in (1, 7, 60):
        got = collections.Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, D.edited_pairs(docs, bands).collect()))
        assert got == want


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert [(r.near_next, r.edited_sha256) for r in D.edited_pairs(one).collect()] == [(1.0, hashlib.sha256(b"abcdab").hexdigest())]
    assert D.edited_pairs(one.where("false")).count() == 0


def test_long_text_and_unlike_texts(spark):
    rng = random.Random(2)
    a, b = ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=1_000_000)) for _ in range(2))
    x, y, z = (D.digest(t.encode()) for t in (a, a[:900_000] + b[:100_000], "0123456789" * 1000))
    assert D.likeness(x, y) > D.likeness(x, z) and D.difference(x, z) <= D.MAX_DIFF and len(x) == 66
