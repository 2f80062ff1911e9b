"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids plus an end id; only those longer than a sequence are cut.  The histogram of
piece lengths (at most ``capacity`` rows, whatever the corpus) goes to the driver.  There the configuration
LP, whose columns are the ways to fill one sequence, is solved by multiplicative weights: prices on
lengths are raised where an average solution covers too little, and a knapsack dynamic program prices
the best configuration through each length.  The solution is rounded down: configurations that fill a sequence
are used in whole numbers, those of long pieces first.  Then the rest is rounded by diving: the longest piece left is fixed, a knapsack bounded
by what is left prices the fullest configuration through it at the program's prices, it is used as often as the supply allows,
and whenever the rest has halved the program goes on from these prices for a few rounds on what is left.
Pieces then take their slots by a rank within their length; that rank is made of bucket counts and a
rank within a bucket, so a length that a third of all pieces share is no single task.

Cases: a null or empty text is one piece of length 1 (the end id); texts longer than a sequence have
their remainder as first or last piece (first here); repeated rows and ids are packed as rows of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_pair_index import byte_alphabet
from .common import documents, map_by_id, parts, staged

CAPACITY, END_ID = 2048, 0
ROUNDS, NEAR = 60, 0.02
#: Texts whose words are looked up together.
TEXTS = 64
#: Rounds that the program goes on for each time the rest has halved, and lengths that a dive's knapsack takes in at once; what
#: a dive charges for a piece, as a share of the highest price: short pieces are left for sequences that nothing else fills.
MORE, CHUNK, CHARGE = 4, 32, 0.1

# The tokenizer gives a word the one space before it, and no word reaches over that space: texts are cut there and words are encoded once.  Where
# a space is followed by more white space or stands last, their run is one; other white space is left to the library, too.
_ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\r"] + [f" {c}" for c in " \t\n\r"]
# Marks in ASCII: after letters they are a word of their own to the tokenizer, and so is one line end between others.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_WORDS = 1 << 19
_SHOWN = {b: c for c, b in byte_alphabet().items()}
_SPACE, _LINE = _SHOWN[32], _SHOWN[10]
_encoders: dict[str, tuple] = {}


def _encoder(path: str):
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        added = {t.content for t in library.get_added_tokens_decoder().values()}
        size = np.zeros(library.get_vocab_size(), np.int64)  # bytes of each token: the vocabulary writes a byte as one character
        for token, i in library.get_vocab().items():
            size[i] = len(token)
        _encoders[path] = library, {}, sorted(added), size
    return _encoders[path]


def _run(text: str) -> bool:
    return text.endswith(" ") or any(c in text for c in _ODD)


def _words_ids(library, words: list[str], size: np.ndarray) -> list[bytes]:
    """Ids of distinct words, each with a space before it.

    Letters and the marks after them go to the library's model as the vocabulary writes them; all others are encoded in one go, and the bytes
    that a token stands for tell where a word's ids end.
    """
    tokenize, marks, out, others = library.model.tokenize, {"": []}, [b""] * len(words), []
    line = [t.id for t in tokenize(_LINE)]
    for i, w in enumerate(words):
        ids: list[int] = []
        before = _SPACE
        for part in w.split("\n"):
            head = part.rstrip(_MARKS)
            if _LETTERS(head) is None:
                others.append(i)
                break
            tail = part[len(head) :]
            if tail not in marks:
                marks[tail] = [t.id for t in tokenize(tail)]
            shown = head if head.isascii() else head.encode().decode("latin-1").translate(_SHOWN)
            ids += line if before == "" else []
            ids += [t.id for t in tokenize(before + shown)]
            ids += marks[tail]
            before = ""
        else:
            out[i] = array("I", ids).tobytes()
    if others:
        rest = [words[i] for i in others]
        ids = np.array(library.encode("".join([f" {w}" for w in rest]), add_special_tokens=False).ids, "<u4")
        ends = (np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(w.encode()) + 1 for w in rest])) + 1).tolist()
        raw = ids.tobytes()
        for i, a, b in zip(others, [0, *ends], ends):
            out[i] = raw[4 * a : 4 * b]
    return out


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids that the tokenizers library gives for ``path``, as unsigned 32-bit numbers; the new words of all ``texts`` are encoded together."""
    library, known, added, size = _encoder(path)
    if len(known) > _WORDS:
        known.clear()
    cut = [None if _run(t) or any(a in t for a in added) else t.split(" ") for t in texts]
    new = list(set().union(*filter(None, cut)).difference(known))  # a dict's keys() would be gone through as a whole
    known.update(zip(new, _words_ids(library, new, size)))
    out = []
    for text, words in zip(texts, cut):
        head = library.encode(text if words is None else words[0], add_special_tokens=False).ids
        rest = b"" if words is None else b"".join(map(known.__getitem__, words[1:]))
        out.append(np.frombuffer(np.array(head, "<u4").tobytes() + rest, "<u4"))
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's tokens, cut only where too long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            found = (x for a in range(0, len(pdf), TEXTS) for x in token_ids([t or "" for t in pdf["text"].iloc[a : a + TEXTS]], path))
            for doc_id, ids in zip(pdf["doc_id"], found):
                ids = np.append(ids, np.array([end_id], "<u4"))
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_by_id(documents(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price of each capacity, and the last length taken (0: none)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(price > 0)
    values = price[lengths]
    for c in range(1, capacity + 1):
        m = np.searchsorted(lengths, c, side="right")
        if m:
            gain = values[:m] + best[c - lengths[:m]]
            k = gain.argmax()
            best[c], took[c] = gain[k], lengths[k]
        if best[c - 1] >= best[c]:
            best[c], took[c] = best[c - 1], -1
    return best, took


def _trace(took: np.ndarray, c: int) -> list[int]:
    out = []
    while c > 0:
        if took[c] == -1:
            c -= 1
        elif took[c] == 0:
            break
        else:
            out.append(int(took[c]))
            c -= int(took[c])
    return out


def fractional(count: np.ndarray, rounds: int = ROUNDS, near: float = NEAR, price: np.ndarray | None = None) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Approximate solution of the configuration LP, weight by configuration (descending lengths), and its prices; ``price``: where to go on from.

    Each round prices all lengths at once: for every length, the best configuration that contains it; those
    near the best value overall are taken in proportion to the demand of their length.
    """
    capacity = len(count) - 1
    lengths = np.flatnonzero(count)
    start, price = price, np.zeros(capacity + 1)
    price[lengths] = lengths / capacity if start is None else start[lengths]
    demand = count.astype(float)
    covered = np.zeros(capacity + 1)
    total: dict[tuple[int, ...], float] = {}
    for t in range(rounds):
        best, took = knapsack(price, capacity)
        through = price[lengths] + best[capacity - lengths]
        for n in lengths[through >= (1 - near) * best[capacity]]:
            config = tuple(sorted([int(n), *_trace(took, capacity - int(n))], reverse=True))
            times = config.count(int(n))
            weight = max(0.0, demand[n] * (t + 1) / rounds - covered[n]) / times
            if weight > 0:
                total[config] = total.get(config, 0.0) + weight
                for x in config:
                    covered[x] += weight
        # over-covered lengths become cheaper, uncovered ones dearer
        gap = covered[lengths] / demand[lengths] - (t + 1) / rounds
        price[lengths] *= np.exp(-0.5 * np.clip(gap, -1, 1))
        price[lengths] = np.clip(price[lengths], 1e-6, None)
        price /= price.max()
    return total, price


def dive(left: np.ndarray, price: np.ndarray) -> tuple[int, ...]:
    """The best-priced of the fullest configurations through the longest piece left that what is left can supply.

    A knapsack on exact sums: long pieces come in first, each as often as it is left, until the sequence can be full; if it can't be, all do.
    """
    capacity = len(left) - 1
    first = int(np.flatnonzero(left)[-1])
    room = capacity - first
    best = np.full(room + 1, -np.inf)
    best[0] = 0.0
    lengths = np.flatnonzero(left[: room + 1])
    lengths = lengths[::-1]  # long ones first: short ones fit anywhere later
    steps: list[tuple[int, int, np.ndarray]] = []
    for a in range(0, len(lengths), CHUNK):
        for n in lengths[a : a + CHUNK].tolist():
            more, step = min(int(left[n]) - (n == first), room // n), 1
            while more > 0:  # any number up to ``more``, by doubling
                k = min(step, more)
                gain = best[: room + 1 - k * n] + k * (price[n] - CHARGE)
                better = gain > best[k * n :]
                best[k * n :][better] = gain[better]
                steps.append((n, k, better))
                more, step = more - k, 2 * step
        if best[room] > -np.inf:
            break
    config, at = [first], int(np.flatnonzero(best > -np.inf)[-1])
    for n, k, better in reversed(steps):
        if at >= k * n and better[at - k * n]:
            config += [n] * k
            at -= k * n
    return tuple(sorted(config, reverse=True))


def plan(count: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole configurations with multiplicities that hold every piece of the histogram exactly once.

    Each dive takes all it can, which uses up a length or leaves less of it than one sequence takes; so the
    number of configurations follows the number of lengths, not that of pieces.
    """
    left = count.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    capacity = len(count) - 1

    def use(config: tuple[int, ...], most: int | None = None) -> None:
        need = {n: config.count(n) for n in config}
        times = min(int(left[n]) // k for n, k in need.items())
        times = times if most is None else min(times, most)
        if times:
            for n, k in need.items():
                left[n] -= k * times
            out.append((config, times))

    if not left.any():
        return out
    weights, price = fractional(left)
    whole: dict[int, list[tuple[tuple[int, ...], float]]] = {}
    for config, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if sum(config) == capacity:
            whole.setdefault(config[0], []).append((config, weight))
    tokens = np.arange(capacity + 1)
    halved = int((left * tokens).sum())
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        for config, weight in whole.pop(longest, ()):
            use(config, int(weight + 1e-9))
        if not left[longest]:
            continue
        if 2 * int((left * tokens).sum()) <= halved and halved > capacity:
            halved = int((left * tokens).sum())
            price = fractional(left, MORE, price=price)[1]
        use(dive(left, price))
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset`` for each piece."""
    spark = cut.sparkSession
    buckets = buckets or max(16, parts(spark))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    count = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        count[r["length"]] = r["count"]
    rows, seq = [], 0
    seen = np.zeros(capacity + 1, np.int64)
    for config, times in plan(count):
        at = 0
        for n in config:
            rows.append((int(n), int(seen[n]), int(seen[n]) + times, seq, at))
            seen[n] += times
            at += n
        seq += times
    # bounded by the histogram, whatever the corpus: at most ROUNDS * capacity configurations and those of ``plan``
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    keys = table[:, 0] << 48 | table[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rank = pdf["rank"].to_numpy()
            k = np.searchsorted(keys, pdf["length"].to_numpy() << 48 | rank, side="right") - 1
            yield pdf.drop(columns="rank").assign(sequence_id=table[k, 3] + rank - table[k, 1], offset=table[k, 4])

    # rank within a length: pieces of lower buckets, and the rank within the bucket
    per = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = per.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("own", own - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own"))
    return map_by_id(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise once (staged, a few dozen bytes for each piece), then plan and place."""
    return pack(staged(pieces(docs, path, capacity), "pieces"), capacity)
