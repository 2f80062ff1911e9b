"""Units of lines and sentences against brute force, on odd texts and on the given documents."""

import re

import pytest

from lexatlas.llm import line_dedup
from lexatlas.llm.common import table

LONG = "this sentence has rather more than the fifteen words that a unit needs to stand by itself"
TEXTS = [
    (1, f"{LONG}. One two.\nThree four"), (2, f"Four\n\n{LONG.upper()}.   One  two.\n{LONG}! Tail"), (3, f"One two.\nThree four\n{LONG}.\nOne two. "), (4, "-"), (5, None), (6, ""), (7, " \n "), (8, "-"), (None, f"{LONG}.\nOne two.\n{'a b c. ' * 200_000}"),
    (9, f"{LONG}.\n{LONG}.\n{LONG}. One two.\nThree four"),
]


def pieces(text, pattern):
    ends = [m.end() for m in re.finditer(pattern, text)] + [len(text)]
    return [text[a:b] for a, b in zip([0, *ends], ends) if b > a]


def units(text, pattern, least):
    out, held = [], ""
    for p in pieces(text, pattern):
        held += p
        if len(held.split()) >= least:
            out.append(held)
            held = ""
    if held:
        out[-1:] = ["".join([*out[-1:], held])]
    return out


def brute(rows, pattern=r"[.!?][ \t\n\r\f]+|\n[ \t\n\r\f]*", least=15):
    """(kept text, removed spans, units) of each document."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        kept, gone, at = "", [], 0
        found = units(text or "", pattern, least)
        for u in found:
            norm = " ".join(u.split()).lower()
            if norm and norm in seen:
                gone.append((at, at + len(u)))
            else:
                kept += u
            seen.add(norm)
            at += len(u)
        out[i] = kept, gone, len(found)
    return out


def result(df):
    return {r.doc_id: (r.text, [tuple(x) for x in r.removed], r.n_units) for r in df.collect()}


def test_odd_texts(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in TEXTS], "doc_id long, text string, unit int, removed string")
    want = brute(TEXTS)
    assert result(line_dedup.dedup(docs)) == want
    assert want[8][1] == [(0, 1)] and want[9][1] and not want[3][1]  # a short line joins what follows
    assert result(line_dedup.dedup(docs, "line", 1)) == brute(TEXTS, r"\n[ \t\n\r\f]*", 1)
    assert result(line_dedup.dedup(docs, "paragraph", 3)) == brute(TEXTS, r"\n[ \t\r\f]*\n[ \t\n\r\f]*", 3)
    assert line_dedup.dedup(docs.where("false")).count() == 0


def test_repeated_rows_are_treated_alike(spark):
    docs = spark.createDataFrame([(1, LONG), (1, LONG), (2, LONG), (2, LONG)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup(docs).collect()) == [(1, LONG), (1, LONG), (2, ""), (2, "")]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_rates_on_the_given_documents(spark, sf):
    """Of documents that hold 50 words in a row of an earlier one nearly all lose something, of the others few."""
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    lost = {r.doc_id for r in line_dedup.dedup(docs).where("size(removed) > 0").collect()}
    seen, holds, rest = set(), set(), set()
    for r in docs.orderBy("doc_id").collect():
        w = (r.text or "").lower().split()
        runs = {hash(tuple(w[i : i + 50])) for i in range(len(w) - 49)}
        (holds if runs & seen else rest).add(r.doc_id)
        seen |= runs
    assert len(holds & lost) / len(holds) >= 0.95
    assert len(rest - lost) / len(rest) >= 0.93
