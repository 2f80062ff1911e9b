"""Repeated rows next to near copies."""

import numpy as np
from test_operators import brute_cut

from lexatlas.llm import suffix_dedup


def test_pack_repeated_rows():
    e = {"h": np.arange(5, dtype=np.uint64), "c": np.arange(5, dtype=np.uint64), "doc": np.array([3, 3, 3, 3, 4]), "tag": np.array([9, 9, 9, 9, 9]), "start": np.array([10, 200, 10, 200, 10]), "size": np.full(5, 60)}
    got = suffix_dedup._unpack(suffix_dedup._pack(e, np.arange(5)))
    assert all((got[x] == e[x]).all() for x in e)
    one = suffix_dedup._unpack(suffix_dedup._pack({**e, "start": np.full(5, 10)}, np.arange(5)))
    assert (one["start"] == 10).all()


def near_rows():
    rng = np.random.default_rng(3)
    text = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    same = [text(70) for _ in range(6)]
    rows = []
    for i in range(6):
        rows += [(i, "".join(x + text(25) for x in same))] * (3 if i % 2 else 1)
    return [*rows, (None, rows[0][1][:200]), (None, rows[0][1][:200])]


def test_repeated_rows(spark):
    rows = near_rows()
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = brute_cut(rows)
    assert len(got) == len(rows) and all((r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)


def hot_rows(n):
    """A line of 49 bytes amid different text in every document, and texts of one period."""
    rng = np.random.default_rng(4)
    text = lambda k: bytes(rng.integers(97, 123, k).astype(np.uint8)).decode()
    line, parts = text(49), [text(12) for _ in range(4)]
    rows = [(i, text(60) + parts[i % 4] + line + parts[i // 4 % 4] + text(60) + line + text(60)) for i in range(n)]
    return [*rows, (n, "ab" * 200), (n + 1, "c" + "ab" * 150), rows[3], rows[3], (None, "ab" * 90 + line)]


def test_hot_hash(spark, monkeypatch):
    rows = hot_rows(60)
    want = brute_cut(rows)
    decide = suffix_dedup._decide
    for hot_bytes, windows in ((0, 70), (2000, 1000)):
        monkeypatch.setattr(suffix_dedup, "_decide", lambda _, least=hot_bytes: decide(least))
        monkeypatch.setattr(suffix_dedup, "WINDOWS", windows)
        got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and all((r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)


def test_hot_hash_is_split():
    """Passages of one hash beyond the bound spread over shards, and equal windows are one entry."""
    import pandas as pd

    rows = hot_rows(300)[:300]
    raw = [t.encode() for _, t in rows]
    end = np.cumsum([len(x) for x in raw])
    begin = end - [len(x) for x in raw]
    owner, a, b, h, c = suffix_dedup.passages(b"".join(raw), begin, end)
    e = {"h": h, "c": c, "doc": owner, "tag": owner, "start": a - begin[owner], "size": b - a}
    pdf = pd.DataFrame({"rank_id": [0], "tag": [0], "spans": [None], "entries": [suffix_dedup._pack(e, np.arange(len(h)))]})
    need = suffix_dedup._decide(8000)(pdf)
    need = need[need["h"].notna()]
    assert any(np.frombuffer(x, bool).any() for x in need["hot"])
    need["text"] = [rows[i][1] for i in need["rank_id"]]
    got = pd.concat(suffix_dedup._fetch(64)([need]))
    load = got[got["data"].notna()].groupby("shard")["data"].agg(lambda x: sum(map(len, x)))
    assert len(load) == 64 and load.max() < 3 * load.mean()


def test_queues_on_disk(tmp_path):
    """A shard whose queues may hold a hundredth of it: the same order, and no file is left behind."""
    from lexatlas.llm import induced_sort

    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(300)]
    data = b" ".join(words[i] for i in rng.integers(0, 300, 20_000))
    size = np.full(len(data) // 200, 200)
    doc = rng.integers(0, 50, len(size))
    data = data[: size.sum()]
    spilled = []
    write = induced_sort.SpillFile.write
    induced_sort.SpillFile.write = lambda self, blocks: spilled.append(sum(len(b[0]) for b in blocks)) or write(self, blocks)
    try:
        t = np.r_[np.frombuffer(data, np.uint8).astype(np.uint16) + 2, 0].astype(np.uint16)
        whole = induced_sort.suffix_order(t, 258, 50)
        few = induced_sort.suffix_order(t, 258, 50, len(data) // 100, folder=str(tmp_path / "q"))
    finally:
        induced_sort.SpillFile.write = write
    assert sum(spilled) > len(data) and (whole[0] == few[0]).all() and (whole[1] == few[1]).all()
    assert list((tmp_path / "q").iterdir()) == []
    uri = induced_sort.suffix_order(t, 258, 50, len(data) // 10, folder=f"file://{tmp_path}/r")
    assert (uri[0] == whole[0]).all()
    first, out = {}, set()
    for k, i in enumerate(doc.tolist()):
        for a in range(151):
            first[data[200 * k + a : 200 * k + a + 50]] = min(i, first.get(data[200 * k + a : 200 * k + a + 50], i))
    for k, i in enumerate(doc.tolist()):
        out |= {(k, a) for a in range(151) if first[data[200 * k + a : 200 * k + a + 50]] < i}
    who, at = suffix_dedup.repeated_windows(data, size, doc, folder=str(tmp_path / "q"))
    assert set(zip(who.tolist(), at.tolist())) == out


def test_may_repeat_loses_nothing():
    """Passages that are left out of a sort have no window that another document has."""
    rng = np.random.default_rng(8)
    left_out = 0
    for _ in range(40):
        shared = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in rng.integers(20, 70, 6)]
        raw = [b"".join([bytes(rng.integers(97, 100, rng.integers(0, 40)).astype(np.uint8)), shared[rng.integers(6)], bytes(rng.integers(97, 100, rng.integers(0, 40)).astype(np.uint8))]) for _ in range(30)]
        raw = [x.ljust(50, b"a") for x in raw] + [b"ab" * 40, b"ab" * 30]
        # as dealt: runs of windows that have their smallest gram in common
        end = np.cumsum([len(x) for x in raw])
        owner, a, b, h, _ = suffix_dedup.passages(b"".join(raw), end - [len(x) for x in raw], end)
        doc = rng.integers(0, 9, len(raw))[owner]
        parts = [b"".join(raw)[x:y] for x, y in zip(a, b)]
        stays = suffix_dedup.may_repeat(b"".join(parts), b - a, doc)
        windows = [{p[i : i + 50] for i in range(len(p) - 49)} for p in parts]
        for i in np.flatnonzero(~stays):
            left_out += 1
            assert not any(windows[i] & windows[j] for j in range(len(parts)) if doc[j] != doc[i])
    assert left_out > 100


def test_induction_by_ranges():
    """Periodic, sorted, constant and random texts, with ranges of a few symbols at every level of names."""
    from lexatlas.llm import induced_sort

    rng = np.random.default_rng(1)
    texts = [np.ones(700), np.tile([1, 2], 300), np.tile([2, 1, 1, 3], 150), np.sort(rng.integers(1, 200, 500)), np.sort(rng.integers(1, 200, 500))[::-1]]
    texts += [rng.integers(1, rng.integers(2, 40), rng.integers(1, 300)) for _ in range(60)]
    for k, t in enumerate(texts):
        t = np.r_[t, 0].astype(np.uint16)
        order, common = induced_sort.suffix_order(t, 258, 50, limit=16, few=1, span=1 + k % 50)
        cut = [tuple(t[i : i + 50]) for i in order]
        assert sorted(order.tolist()) == list(range(len(t))) and cut == sorted(cut)
        for i in range(1, len(cut)):
            n = next((j for j, (x, y) in enumerate(zip(cut[i - 1], cut[i])) if x != y), min(len(cut[i - 1]), len(cut[i])))
            assert common[i] == n


def test_long_runs():
    """Runs of equal symbols shorter and longer than the depth, and two megabytes of runs and periods in a moment."""
    import time

    from lexatlas.llm import induced_sort

    rng = np.random.default_rng(3)
    for k in range(60):
        symbols = rng.integers(1, 5, rng.integers(1, 8))
        t = np.r_[np.repeat(symbols, rng.integers(1, 160, len(symbols))), 0].astype(np.uint16)
        order, common = induced_sort.suffix_order(t, 258, 50, limit=50 if k % 2 else 1 << 20, few=1 if k % 3 else 1024, span=1 + k)
        cut = [tuple(t[i : i + 50]) for i in order]
        assert sorted(order.tolist()) == list(range(len(t))) and cut == sorted(cut)
        assert all(common[i] == next((j for j, (x, y) in enumerate(zip(cut[i - 1], cut[i])) if x != y), min(len(cut[i - 1]), len(cut[i]))) for i in range(1, len(cut)))
    t = np.r_[np.full(1_000_000, 122), 1, np.full(1_000_000, 122), 1, np.tile([97, 98], 300_000), 1, 0].astype(np.uint16)
    began = time.process_time()
    induced_sort.suffix_order(t, 258, 50)
    assert time.process_time() - began < 20
