"""Language identification: held-out accuracy, calibration, features against plain counting, odd rows."""

import collections
import random
import zlib

import numpy as np
import pytest

from lexatlas.llm import language_id as L
from lexatlas.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_calibration(spark):
    docs = table(spark, SF, "documents")
    model = L.train(docs)
    got = {r["doc_id"]: r for r in L.classify(docs, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(r["lang_pred"] == truth[i], r["score"]) for i, r in got.items() if r["held_out"] and truth[i] is not None]
    right = np.mean([ok for ok, _ in held])
    assert len(held) > 150 and right >= 0.97
    assert abs(np.mean([s for _, s in held]) - right) < 0.05  # a score means a share of right answers
    assert 0.05 <= model["temperature"] <= 20
    assert 0 < (model["weights"] != 0).mean() < 0.5  # the L1 penalty leaves most weights at zero


def slow_counts(text):
    norm = " " + L._NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    out = collections.Counter()
    for n in range(1, L.MAX_N + 1):
        for i in range(len(norm) - n + 1):
            h = 0
            for m, ch in enumerate(norm[i : i + n], 1):
                h = (h * int(L._MIX) + ord(ch) + m) % 2**64
            out[(h * int(L._SPREAD)) % 2**64 >> int(L._SHIFT)] += 1
    return out


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_features_of_whole_texts(monkeypatch, block):
    monkeypatch.setattr(L, "_BLOCK", block)
    for text in ("Déjà vu, 12 times; no more", "a", "日本語 テキスト", "x" * 300, "\U0001d400 \ud800 y"):
        found, tf = L.counts(text)
        assert dict(zip(found.tolist(), tf.tolist())) == slow_counts(text)


def test_ftrl_equals_a_plain_loop():
    rng = random.Random(1)
    rows = [(np.array(sorted(rng.sample(range(50), 5))), np.array([rng.random() for _ in range(5)])) for _ in range(30)]
    labels = np.array([i % 3 for i in range(30)])
    got = L.fit_ftrl(rows.__getitem__, labels, 3, epochs=2)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(j, c):
        l1 = 0 if j == L.BUCKETS else L.L1
        v = z[j, c]
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((L.BETA + np.sqrt(n[j, c])) / L.ALPHA + L.L2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for r in order.permutation(30):
            x = [*zip(rows[r][0].tolist(), rows[r][1].tolist()), (L.BUCKETS, 1.0)]
            w = {(j, c): weight(j, c) for j, _ in x for c in range(3)}
            s = np.array([sum(v * w[j, c] for j, v in x) for c in range(3)])
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            for j, v in x:
                for c in range(3):
                    g = v * (p[c] - (labels[r] == c))
                    z[j, c] += g - (np.sqrt(n[j, c] + g * g) - np.sqrt(n[j, c])) / L.ALPHA * w[j, c]
                    n[j, c] += g * g
    assert all(abs(got[j, c] - weight(j, c)) < 1e-9 for j in [*range(60), L.BUCKETS] for c in range(3))


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 3, 400)
    scores = rng.normal(size=(400, 3)) + 1.5 * np.eye(3)[labels]
    t = L.fit_temperature(8 * scores, labels)
    loss = lambda u: -np.mean([s[k] / u - np.log(np.exp((s / u) - (s / u).max()).sum()) - (s / u).max() for s, k in zip(8 * scores, labels)])
    assert t > 2 and loss(t) <= min(loss(t * 1.05), loss(t / 1.05)) + 1e-9
    assert L.fit_temperature(np.zeros((0, 3)), labels[:0]) == 1.0


def test_odd_rows(spark):
    a, b = "der die das und nicht ", "the and that with not "
    rows = [(i, (a if i % 2 else b) * (1 + i % 3), "de" if i % 2 else "en") for i in range(200)]
    rows += [(500, None, "en"), (501, "", None), (502, "123 -- ²", "de"), (None, a, "de"), (503, a, None), (504, b * 50_000, "en"), (505, "É", "fr"), (1, rows[1][1], "de"), (1, rows[1][1], "de")]
    df = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, lang string, score double, held_out boolean")
    model = L.train(df)
    got = [tuple(r) for r in L.classify(df, model).collect()]
    assert len(got) == len(rows)
    pred = {(i, text): (name, score) for (i, _, name, score), (_, text, _) in zip(sorted(got, key=repr), sorted(rows, key=repr)) if i is not None}
    by_id = {i: (held, name, score) for i, held, name, score in got}
    assert all(by_id[i][1:] == ("und", 0.0) for i in (500, 501, 502))
    assert by_id[None][:2] == (False, "de") and by_id[503][1] == "de" and by_id[504][1] == "en" and by_id[1][1] == "de"
    assert sum(1 for g in got if g[0] == 1) == 3 and pred
    assert all(0 <= g[3] <= 1 for g in got)
    # neither the language nor an id has a part in a prediction
    other = df.withColumn("lang", df["source"] if "source" in df.columns else df["text"]).withColumn("doc_id", df["doc_id"] + 1000)
    assert sorted(r["lang_pred"] for r in L.classify(other, model).collect()) == sorted(g[2] for g in got)
    assert L.train(df.where("false")) == {} and L.classify(df.where("false"), {}).count() == 0
    assert {r["lang_pred"] for r in L.classify(df, {}).collect()} == {"und"}
    one = L.train(df.where("lang = 'en'"))
    assert {(r["lang_pred"], r["score"]) for r in L.classify(df.where("doc_id = 504"), one).collect()} == {("en", 1.0)}


def test_sample_is_bounded_and_holds_rare_languages(spark):
    rows = [(i, "the and that", "en") for i in range(3000)] + [(9000 + i, "der die das", "de") for i in range(30)]
    got = L._sample(L._learnable(spark.createDataFrame(rows, "doc_id long, text string, lang string")), 100)
    n = got["lang"].value_counts()
    assert len(got) <= 100 and n["en"] == 50 and n["de"] >= 15
