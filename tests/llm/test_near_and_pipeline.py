"""Near duplicates against sets of word tuples, and every stage of the pipeline on odd rows."""

import collections
import random

import pytest

import corpus_pipeline as P
from lexatlas.llm import entropy_secrets, line_dedup, suffix_dedup, tensored_minhash

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def shingles(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_rows():
    rng = random.Random(12)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(6, 120))) for _ in range(25)]
    rows = []
    for i, text in enumerate(base):
        words = text.split()
        for k in range(rng.randint(0, 4)):
            w = list(words)
            for _ in range(k):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((10 * i + k, rng.choice([" ", "\n", " \t"]).join(w)))
    long = " ".join(f"x{i}" for i in range(120_000))
    rows += [(900, long), (901, long.replace("x500 ", "y ")), (902, "z" * 1_000_000), (903, "z" * 1_000_000)]
    rows += [(905, "One two"), (906, "one\x0btwo"), (907, "one\xa0two"), (908, ""), (909, None), (910, "  "), (None, base[0]), (None, base[0])]
    rows += [rows[3], rows[3], (rows[5][0], base[-1]), (911, "É" + base[1][1:]), (912, base[1] + " " + base[2])]
    return rows


def brute(rows):
    by_id = collections.defaultdict(set)
    for i, t in rows:
        if i is not None and shingles(t):
            by_id[i].add(shingles(t))
    label = {i: i for i in by_id}
    links = [(i, j) for i in by_id for j in by_id if i < j and any(100 * len(a & b) >= 75 * len(a | b) for a in by_id[i] for b in by_id[j])]
    for _ in label:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.fixture(scope="module")
def rows():
    return near_rows()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "c") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, component string")


def test_near_duplicates_equal_brute_force(spark, rows):
    label = brute(rows)
    got = tensored_minhash.near_duplicates(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == collections.Counter((i, len(shingles(t)), label.get(i, i), label.get(i, i) == i) for i, t in rows)
    assert len(set(label.values())) < len(label) - 10


def test_stages_keep_columns_and_rows(spark, rows, monkeypatch):
    docs = frame(spark, rows).select(*P.COLUMNS)
    none = docs.where("false")
    for name, stage in P.STAGES[1:4]:
        out = stage(spark, docs, "")
        assert out.columns == list(P.COLUMNS) and stage(spark, none, "").count() == 0, name
        assert all(r.n_chars == len(r.text or "") for r in out.collect()) or name == "near_dedup"
    label = brute(rows)
    kept = {r.doc_id for r in P.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows if label.get(i, i) == i}


def test_quality_stage(spark, tmp_path):
    good = [(i, "a plain and quiet line of text " * 6) for i in range(60)]
    bad = [(i, "A!! B!! " * 20) for i in range(100, 160)]
    rows = good + bad + [good[0], (None, good[1][1]), (7, bad[0][1]), (500, None), (501, "")]
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, rows).select(*P.COLUMNS)
    out = P.quality_filter(spark, docs, str(tmp_path))
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == list(P.COLUMNS) and got[good[0]] == 2 and got[None, good[1][1]] == 1 and not any(t and "!!" in t for _, t in got)


def test_run_over_a_table(spark):
    """All stages on the small table: every stage drops or changes something, and pieces hold what the last one kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = P.staged(stage(spark, docs, sf), name)
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] == seen[3] == seen[4]
    out = P.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.select("doc_id").collect()}
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[0][0] == 0 and sum(n for _, n in x) <= 2048


def test_odd_texts_of_other_operators(spark):
    """A line of a megabyte, repeated rows and one id with two texts."""
    line = "y" * 1_000_000
    rows = [(1, line + "\nshort"), (2, line), (3, "short\nshort"), (3, "short\nshort"), (3, "other\nshort"), (None, "other")]
    docs = spark.createDataFrame([(i, t, 1, [2]) for i, t in rows], "doc_id long, text string, n_units int, removed array<int>")
    got = collections.Counter((r.doc_id, r.text, len(r.removed)) for r in line_dedup.dedup(docs, "line", 1).collect())
    assert got[1, line + "\nshort", 0] == 1 and got[2, "", 1] == 1 and got[3, "", 2] == 2 and got[None, "", 1] == 1
    assert got[3, "other\n", 1] == 1
    assert all(not r.removed for r in line_dedup.dedup(docs).collect())  # texts of fewer words than a unit needs are units by themselves
    cut = collections.Counter((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.dedup(docs).collect())
    assert cut[2, 1_000_000, 1] == 1 and cut[1, 0, 0] == 1
    assert entropy_secrets.report(docs).count() == len(rows)
