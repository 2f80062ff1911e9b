"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct words of an Arrow batch that the partition hasn't met yet are laid out as one list of
symbols.  An index maps each mergeable pair to all its positions; ranks that are active are taken in
ascending order from a heap, all positions of the pair are merged from left to right, and the lists of the
pairs that arise on either side are updated.  Words are independent, so merging all of them rank by rank
gives what merging each of them alone gives.

Cases: a null text is empty and has no ids; strings of added tokens are cut out first and get their own
ids, as the library does; repeated rows are encoded each.  Very long texts are streamed by word, and the
cache of words is emptied when it holds ``CACHE`` words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import documents, map_by_id

CACHE = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PairIndexBpe:
    """A tokenizer read from a byte-level BPE file of the tokenizers library."""

    #: Fixed value: the word pattern of byte-level pre-tokenisation.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.byte_id = [0] * 256
        self.token: dict[int, bytes] = {}
        for shown, i in vocab.items():
            self.token[i] = bytes(alphabet[c] for c in shown)
            if len(shown) == 1:
                self.byte_id[alphabet[shown]] = i
        #: pair -> (rank, id of the merged symbol)
        self.merge = {(vocab[a] << 32 | vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.pair_of = {rank: (vocab[a], vocab[b], vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.pairs = np.array(sorted(self.merge), np.int64)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token |= {i: text.encode() for text, i in self.added.items()}
        # the library's whitespace leaves out the four separators that Python's \s takes in
        space = r"[\t-\r \x85   -     　]"
        inner, outer = space[1:-1], "[^" + space[1:]
        self.words = regex.compile(self.WORDS.replace(r"[^\s\p{L}\p{N}]", rf"[^{inner}\p{{L}}\p{{N}}]").replace(r"\S", outer).replace(r"\s", space)).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.known: dict[str, list[int]] = {}

    def learn(self, words: list[str]) -> None:
        """Encode distinct words and remember them."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(x) for x in raw], np.int64)
        ends = np.cumsum(lengths)
        sym_array = np.array(self.byte_id, np.int64)[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(sym_array)
        sym = sym_array.tolist()
        nxt = np.arange(1, n + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[ends - lengths] = -1
        # the index: mergeable pairs with their positions in ascending order
        at = np.flatnonzero(nxt >= 0)
        key = sym_array[at] << 32 | sym_array[at + 1]
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        good = self.pairs[place] == key
        at, key = at[good], key[good]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        index: dict[int, list[int]] = {}
        merge = self.merge
        for k, lo, hi in zip(key[first].tolist(), first.tolist(), [*first[1:].tolist(), len(key)]):
            index[merge[k][0]] = at[lo:hi].tolist()
        nxt, prv = nxt.tolist(), prv.tolist()
        active = list(index)
        heapq.heapify(active)
        pop, push, get = heapq.heappop, heapq.heappush, merge.get
        while active:
            rank = pop(active)
            a, b, ab = self.pair_of[rank]
            places = index.pop(rank)
            places.sort()
            for i in places:
                j = nxt[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue
                sym[i], sym[j] = ab, -1
                nxt[i] = k = nxt[j]
                if k >= 0:
                    prv[k] = i
                    if hit := get(ab << 32 | sym[k]):
                        r = hit[0]
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            push(active, r)
                h = prv[i]
                if h >= 0 and (hit := get(sym[h] << 32 | ab)):
                    r = hit[0]
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        push(active, r)
        left = np.array(sym, np.int64)
        alive = left >= 0
        count = np.r_[0, np.cumsum(alive)]
        ids = left[alive].tolist()
        bounds = count[np.r_[0, ends]].tolist()
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        for w, lo, hi in zip(words, bounds, bounds[1:]):
            self.known[w] = ids[lo:hi]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        known, added, find = self.known, self.added, self.words
        split = []
        fresh: dict[str, None] = {}
        for text in texts:
            pieces = self.cut(text) if self.cut and any(x in text for x in added) else (text,)
            words = []
            for p in pieces:
                if p in added:
                    words.append(p)
                elif p:
                    words += find(p)
            split.append((words, len(pieces) > 1))
            for w in words:
                if w not in known:
                    fresh[w] = None
        if fresh:
            # if the cache is emptied now, words of this batch that it held are needed again
            if len(known) + len(fresh) > CACHE:
                known.clear()
                fresh = dict.fromkeys(w for words, _ in split for w in words)
            self.learn(list(fresh))
        out = []
        for words, special in split:
            ids: list[int] = []
            if special:
                for w in words:
                    ids += [added[w]] if w in added else known[w]
            else:
                for w in words:
                    ids += known[w]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        token = self.token
        return b"".join([token[i] for i in ids]).decode("utf-8", "replace")


_loaded: dict[str, PairIndexBpe] = {}


def load(path: str) -> PairIndexBpe:
    """One tokenizer for each worker and file."""
    if path not in _loaded:
        _loaded[path] = PairIndexBpe(path)
    return _loaded[path]


def _in_steps(pdf: pd.DataFrame, chars: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Slices of about ``chars`` characters, so that ids of a batch aren't held all at once."""
    size = pdf["text"].str.len().fillna(0).to_numpy().cumsum() // chars
    for _, part in pdf.groupby(size, sort=True):
        yield part


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for pdf in batches:
            for part in _in_steps(pdf):
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": bpe.encode_batch([x or "" for x in part["text"]])})

    return map_by_id(documents(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` back from ``doc_id, ids``; ids that are null give a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [None if x is None else bpe.decode([int(i) for i in x]) for x in pdf["ids"]]})

    return map_by_id(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` in one pass: ids never leave the worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for pdf in batches:
            rows = []
            for part in _in_steps(pdf):
                encoded = bpe.encode_batch([x or "" for x in part["text"]])
                for doc_id, ids in zip(part["doc_id"], encoded):
                    rows.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_by_id(documents(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
