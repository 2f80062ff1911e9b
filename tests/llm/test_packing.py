"""Packing against the token bound, best fit decreasing, and the tokenizers library."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexatlas.llm import config_lp_packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


def best_fit(count):
    """Number of sequences of best fit decreasing, piece by piece."""
    capacity = len(count) - 1
    rooms = np.zeros(capacity + 1, np.int64)
    n_bins = 0
    for n in range(capacity, 0, -1):
        for _ in range(int(count[n])):
            fit = np.flatnonzero(rooms[n:])
            if len(fit):
                room = n + int(fit[0])
                rooms[room] -= 1
            else:
                room, n_bins = capacity, n_bins + 1
            rooms[room - n] += 1
    return n_bins


def bound(count):
    return -(-int((count * np.arange(len(count))).sum()) // (len(count) - 1))


def check(count, plan):
    held = np.zeros_like(count)
    for config, times in plan:
        assert times > 0 and sum(config) < len(count)
        for n in config:
            held[n] += times
    assert (held == count).all()
    return sum(times for _, times in plan)


@pytest.fixture(scope="module")
def cut(spark):
    return P.pieces(spark.read.parquet(f"{SF}/documents.parquet"), PATH).toPandas()


def subset_sum_plan(count):
    """Sequences of a plan without a linear program: the longest piece and what fills its sequence best, long pieces first."""
    left, used, capacity = count.astype(np.int64).copy(), 0, len(count) - 1
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        room = capacity - first
        reach, mask, tried = 1, (1 << room + 1) - 1, []
        for n in np.flatnonzero(left[: min(room, first) + 1])[::-1].tolist():
            tried.append((n, reach))
            more, step = min(int(left[n]) - (n == first), room // n), 1
            while more > 0:
                reach |= reach << n * min(step, more) & mask
                more, step = more - step, 2 * step
            if reach >> room & 1:
                break
        config, total = [first], reach.bit_length() - 1
        for n, before in reversed(tried):
            while not before >> total & 1:
                config.append(n)
                total -= n
        times = min(int(left[n]) // config.count(n) for n in config)
        for n in config:
            left[n] -= times
        used += times
    return used


def test_few_sequences(cut):
    count = np.bincount(cut["length"], minlength=P.CAPACITY + 1)
    for times, most in ((1, 481), (50, 24_026), (1000, 480_502), (10**6, None)):
        many = count * times
        used = check(many, P.plan(many))
        assert used <= bound(many) * (1 + (0 if times == 1 else 0.0001))
        if times <= 50:
            assert used <= best_fit(many)
        if most is not None:
            assert used <= min(most, subset_sum_plan(many))


def test_every_sequence_is_priced_by_the_program(cut, monkeypatch):
    """A configuration is one of the program's, rounded down, or comes out of a dive at its prices; they hold real shares each."""
    count = np.bincount(cut["length"], minlength=P.CAPACITY + 1) * 1000
    own, dived, prices = {}, set(), []
    solve, dive = P.fractional, P.dive

    def solved(*args, **kw):
        weights, price = solve(*args, **kw)
        if len(args) == 1:
            own.update(weights)
        prices.append(price)
        return weights, price

    def priced(left, price):
        assert any(price is p for p in prices)
        config = dive(left, price)
        dived.add(config)
        return config

    monkeypatch.setattr(P, "fractional", solved)
    monkeypatch.setattr(P, "dive", priced)
    plan = P.plan(count)
    assert len(prices) > 3  # it goes on as the rest shrinks
    assert all(config in own or config in dived for config, _ in plan)
    rounded = sum(times for config, times in plan if config not in dived)
    assert rounded > 0.03 * sum(times for _, times in plan)


def test_words_are_encoded_as_in_their_text():
    library = Tokenizer.from_file(PATH)
    texts = ["", " ", "a  b", "a \n b\t\tc ", "\n\n x", "it's  we'll\r\n", "x\u00a0 y", "a\u2003\n b", "a\x1c!\x1f b", "<|endoftext|> a <|endoftext|>", "é e\u0301 日本語  テ", "12 345  6", "!!! ?!  .", "z" * 300 + " " + "z" * 300, "\x0b a\x0c b", "tail  \n"]
    texts += ["".join(np.random.default_rng(i).choice(list("ab1!' \n\t\r\u00a0é"), 40)) for i in range(300)]
    texts += ["".join(np.random.default_rng(i).choice(list("ab1!'\n é日"), 40)) for i in range(300)]
    for _ in range(2):  # the second time all words are known
        for text, ids in zip(texts, P.token_ids(texts, PATH)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_one_library_makes_the_ids():
    code = open(P.__file__).read()
    assert "tiktoken" not in code and "from tokenizers import Tokenizer" in code


def test_plans_of_odd_histograms():
    rng = np.random.default_rng(1)
    assert P.plan(np.zeros(101, np.int64)) == []
    for _ in range(60):
        count = np.zeros(int(rng.integers(2, 120)), np.int64)
        count[1:] = rng.integers(0, 5, len(count) - 1) * (rng.random(len(count) - 1) < rng.random())
        if rng.random() < 0.3:
            count[rng.integers(1, len(count))] = 10**12
        used = check(count, P.plan(count))
        assert used >= bound(count)
        if count.max() < 10:
            assert used <= best_fit(count) + 1


def test_ids_of_every_text(cut, spark):
    """Ids, places and cuts as the library's own ids give them."""
    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    want = collections.Counter()
    for i, text in zip(docs["doc_id"], docs["text"]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter(tuple(r) for r in cut[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want


def test_slots(spark):
    """Repeated rows, one id with two texts, null ids and texts, clashing columns: every piece once, no gaps, no overlaps."""
    rows = [(1, "a b c " * 90, 0, 0)] * 3 + [(1, "other", 0, 0), (None, "x y", 0, 0), (None, None, 0, 0), (2, "", 0, 0), (3, "word " * 500, 0, 0)] + [(i, "hot length", 0, 0) for i in range(10, 400)]
    docs = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, length int, sequence_id int, piece int, rank int, bucket int")
    got = P.packed(docs, PATH, capacity=128).toPandas()
    want = P.pieces(docs, PATH, capacity=128).toPandas()
    cols = ["piece", "start", "length", "ids_crc32"]
    assert collections.Counter(got[cols].itertuples(index=False, name=None)) == collections.Counter(want[cols].itertuples(index=False, name=None))
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 128
    assert got["sequence_id"].nunique() <= bound(np.bincount(want["length"], minlength=129)) + 1


def test_words_go_to_the_model_once_and_get_the_librarys_ids(monkeypatch):
    """Odd words, marks and white space against whole texts; plain words don't go through the library's splitting."""
    import random

    library = Tokenizer.from_file(PATH)
    library.no_truncation(), library.no_padding()
    rng = random.Random(5)
    odd = ["don't", "it's,", "'tis", "he'll'", "Word", "word.", "WORD!?", "a_b", "x9", "9x.", "\u00e9t\u00e9", "na\u00efve.", "foo.\nBar", "tab\there", "x\n\ny", "a\nb\nc,", "\nq", "q\n", "d.\n'tis", "w\n9", "\u00df\u00ff!", "\u00b5m", "\u00aa", "\u00d7", "", ".", "...", "'s", "end'", "\"q\"", "\x00a", "a\x7f", "\x1cb", "\u4e2d\u6587", "\u00a0z", "<|endoftext|>", "k\u212a", "abc\\", "~", "z" * 300 + "'"]
    texts = [" ".join(rng.choices(odd, k=rng.choice([1, 3, 12]))) for _ in range(400)] + odd + ["", " ", "a ", "a  b", "a \nb", "a\n"]
    for a in range(0, len(texts), P.TEXTS):
        got = P.token_ids(texts[a : a + P.TEXTS], PATH)
        assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts[a : a + P.TEXTS]]

    class Spy:
        model, seen = library.model, []

        def encode(self, text, **options):
            self.seen.append(text)
            return library.encode(text, **options)

    found = P._encoder(PATH)
    monkeypatch.setitem(P._encoders, PATH, (Spy(), {}, *found[2:]))
    text = "Some plain words, and \u00e9t\u00e9.\nAnd caf\u00e9! again: don't"
    assert P.token_ids([text], PATH)[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert Spy.seen == [" don't", "Some"]
