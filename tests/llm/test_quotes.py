"""Quotation linking against brute force: nested, re-wrapped, partial, short, hot and cross-conversation quotes."""

import random
import re

import pytest

from lexatlas.llm import quote_linking as Q

MARK = re.compile(r"^((?:[ \t]*>)+)")


def passages(text):
    out, last = [], None
    for line in (text or "").split("\n"):
        m = MARK.match(line)
        level = m[1].count(">") if m else 0
        words = (line[m.end() :] if m else line).split()
        if out and last[0] == level and (level == 0 or (last[1] and words)):
            out[-1][1].extend(words)
        else:
            out.append((level, list(words)))
        last = (level, words)
    return [(k, [w.lower() for w in ws]) for k, ws in out if ws]


def holds(long, short):
    return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))


def brute(rows):
    parts = [(c, t, k, ws) for c, t, _, text in rows if c is not None and t is not None for k, ws in passages(text)]
    plain = [(c, t, ws) for c, t, k, ws in parts if k == 0]
    out = set()
    for c, t, k, ws in parts:
        if k:
            near = min((u for d, u, x in plain if d == c and u < t and holds(x, ws)), default=None)
            far = min(((d, u) for d, u, x in plain if d != c and holds(x, ws)), default=None)
            if near is not None:
                out.add((c, t, k, c, near))
            elif far is not None:
                out.add((c, t, k, *far))
    return out


def conversations():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["ok", "Why?", "yes."]
    rows = []
    for c in range(40):
        texts = []
        for t in range(rng.randint(1, 8)):
            lines = []
            for _ in range(rng.randint(0, 2)):
                pool = texts if texts and rng.random() < 0.8 else [x[3] for x in rows] or [""]
                source = rng.choice(pool) or ""
                if rng.random() < 0.4:  # a whole message, quotes and all
                    lines += ["> " + x for x in source.split("\n")]
                else:  # part of its words, wrapped elsewhere
                    words = [w for w in source.replace(">", " ").split()]
                    a = rng.randint(0, len(words))
                    words = words[a : a + rng.randint(1, 20)]
                    wide = rng.randint(1, 9)
                    lines += [">  " + "  ".join(words[i : i + wide]).upper() for i in range(0, len(words), wide)]
            lines += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 4))]
            if rng.random() < 0.2:
                lines.append("the very same words that everybody says in every conversation")
            if rng.random() < 0.2:
                lines = ["> the very same words that everybody says", *lines]
            texts.append("\n".join(lines))
            rows.append((c, t, "user", texts[-1]))
    return rows + [rows[3], rows[3], (5, 1, "user", "> w1 w2\nsecond text of one turn"), (None, 0, "user", "> ok"), (3, None, "user", "> ok"), (77, 0, None, None), (78, 0, "user", "> > > deep\n>\n> ok \x01 x")]


@pytest.fixture(scope="module")
def rows():
    return conversations()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", 1) for r in rows], "conv_id long, turn long, role string, text string, norm string, level int")


def test_links_equal_brute_force(spark, rows):
    got = {tuple(r) for r in Q.links(frame(spark, rows)).collect()}
    want = brute(rows)
    assert got == want and len(want) > 60
    assert any(c != d for c, _, _, d, _ in want) and any(k > 1 for _, _, k, _, _ in want)


def test_order(spark, rows):
    want = brute(rows)
    got = Q.reply_ordered(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    parent = {}
    for c, t, k, d, u in want:
        if k == 1 and c == d:
            parent[c, t] = max(u, parent.get((c, t), -1))
    for r in got:
        key, depth = (r.conv_id, r.turn), 0
        while key in parent:
            key, depth = (key[0], parent[key]), depth + 1
        assert (r.parent_turn, r.thread, r.depth) == (parent.get((r.conv_id, r.turn)), key[1], depth)
        assert r.n_linked == sum((c, t) == (r.conv_id, r.turn) for c, t, *_ in want) and not re.search(r"(?m)^[ \t]*>", r.text)


def test_short_partial_and_wrapped(spark):
    rows = [(1, 0, "a", "I left early.  Why? Because of\nthe rain"), (1, 1, "b", "> Why?\nso?"), (1, 2, "a", "> because OF the\n> rain\nyes"), (2, 0, "c", "> left early.\nwho?")]
    assert {tuple(r) for r in Q.links(frame(spark, rows)).collect()} == {(1, 1, 1, 1, 0), (1, 2, 1, 1, 0), (2, 0, 1, 1, 0)}


def test_empty(spark, rows):
    assert Q.reply_ordered(frame(spark, rows).where("false")).count() == 0
