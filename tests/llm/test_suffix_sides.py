"""What a passage's surroundings tell before any text is fetched."""

import numpy as np
import pandas as pd
from test_operators import brute_cut

from lexatlas.llm import suffix_dedup


def _text(rng, n):
    return bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()


def test_period_against_single_gram(spark):
    """A text of period 30 holds its smallest gram many times, a later window of it only once: the window goes."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        unit = _text(rng, 30)
        at = int(rng.integers(0, 30))
        rows += [(2 * i, unit * 6), (2 * i + 1, _text(rng, 40) + (unit * 4)[at : at + int(rng.integers(50, 56))] + _text(rng, 40))]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_cut(rows)
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == want and sum(n for n, _ in want.values()) > 0


def test_other_surroundings_are_not_fetched():
    """Documents that share 30 bytes amid other text want nothing; with 50 they do."""
    rng = np.random.default_rng(5)
    for shared, some in ((30, False), (50, True)):
        line = _text(rng, shared)
        raw = [(_text(rng, 60) + line + _text(rng, 60)).encode() for _ in range(50)]
        end = np.cumsum([len(x) for x in raw])
        begin = end - [len(x) for x in raw]
        owner, a, b, h, c, left, right = suffix_dedup.sided_passages(b"".join(raw), begin, end)
        e = {"h": h, "c": c, "doc": owner, "tag": owner, "start": a - begin[owner], "size": b - a, "left": left, "right": right}
        pdf = pd.DataFrame({"rank_id": [0], "tag": [0], "spans": [None], "entries": [suffix_dedup._pack(e, np.arange(len(h)))]})
        assert suffix_dedup._decide(1 << 20)(pdf)["h"].notna().any() == some


def test_each_text_is_fetched_once(spark, monkeypatch):
    """Near copies whose passages lie in many groups: a text is one row of the step that fetches."""
    rng = np.random.default_rng(7)
    base = [_text(rng, 20) for _ in range(120)]
    rows = [(i, "".join(x + _text(rng, 1) if k % 5 == i % 5 else x for k, x in enumerate(base))) for i in range(10)]
    seen = spark.sparkContext.accumulator(0)
    fetch = suffix_dedup._fetch

    def counted(shards):
        run = fetch(shards)

        def count(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield from run([pdf])

        return count

    monkeypatch.setattr(suffix_dedup, "_fetch", counted)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 1000)
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == brute_cut(rows) and 0 < seen.value <= len(rows)
