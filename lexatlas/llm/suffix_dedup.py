"""Suffix-array dedup: remove every byte covered by a string of ``LEAST`` bytes that an earlier document has.

Shards are formed by content.  Each window of LEAST bytes belongs to the smallest hash among its 20-byte
grams; a maximal run of windows of one hash is a passage, and equal windows always come under the same
hash.  So a shard needs only the passages of its hashes, not the corpus:

1. Passages are hashed (position, length, content) and dealt by hash.  Where the same passage occurs in
   several documents, all but those of the smallest doc_id are removed outright; a batch does this before
   the shuffle, so a passage that a third of all documents share is one entry for each batch.
2. Hashes with one document only, nearly all, are done.  Where different passages share a hash, those whose gram
   has other surroundings in every other document are left out, told by two short hashes that come with each
   passage; the bytes of the rest are fetched, each text once, surroundings are compared again by long hashes, and
   each shard sorts the suffixes of the rest by external induced sorting (``induced_sort``: disk-backed
   queues that carry suffix positions and common-prefix values).  Suffixes that agree on LEAST bytes stand
   together in the order; a window is removed if its group has a smaller doc_id.
   Where the passages of one hash exceed SHARD_BYTES, their windows are dealt one by one, by content: equal
   windows still meet, and those that a batch has in several documents are collapsed before the shuffle.
3. The removed windows of a document are merged and cut out of its text.

Windows are judged on the input and never cross documents.  Cases: null texts are empty; documents of
fewer than LEAST bytes lose nothing; a null doc_id counts as the largest; rows of one doc_id never remove
from each other, and rows equal in doc_id and text get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_by_id, parts, release_shuffles, shared_dir, staged, trim
from .induced_sort import suffix_order

LEAST, GRAM = 50, 20
#: Equal windows have LEAST - GRAM more bytes in common around their gram, so at least so many before or behind it.
SIDE = (LEAST - GRAM) // 2
#: Text bytes for each group of hashes, and passage bytes for each sorted shard.
GROUP_BYTES, SHARD_BYTES = 12 << 20, 2 << 20
#: Windows of hot hashes that a worker holds at once; characters whose passages it collapses at once, and hashes at once.
WINDOWS = 1 << 17
COLLAPSED, HASHED = 8 << 20, 1 << 18
#: Suffix tuples that a shard's queues hold in memory; more of them are blocks in the shared folder.
QUEUED = 1 << 20
_LAST = (1 << 63) - 1
_C1, _C2, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _grams(data: bytes) -> np.ndarray:
    """Hash of the GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    gram = np.ndarray((n,), "<u8", data, 0, (1,)) * _C1
    gram ^= np.ndarray((n,), "<u8", data, 8, (1,)) * _C2
    gram ^= (np.ndarray((n,), "<u8", data, GRAM - 8, (1,)) >> np.uint64(1)) * _ODD  # its lowest bits are in the word before
    return _mix(gram)


def passages(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Passages of the documents data[begin:end]: (document, start, end, hash, content hash), places in ``data``."""
    return sided_passages(data, begin, end)[:5]


def _sides(data: bytes, gram: np.ndarray, start: np.ndarray, stop: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16 bits for the SIDE bytes before and behind a passage's gram: 0 if it holds the gram several times, 1 if it has not so many."""
    place, last = start.copy(), stop - GRAM
    for at, step in ((place, 1), (last, -1)):
        todo = np.flatnonzero(gram[at] != h)
        while len(todo):
            at[todo] += step
            todo = todo[gram[at[todo]] != h[todo]]
    word = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    out = []
    for a, ok in ((place - SIDE, place - start >= SIDE), (place + GRAM, place + GRAM + SIDE <= stop)):
        side = np.ones(len(start), np.uint16)
        a = a[ok]
        side[ok] = _mix(_mix(word[a] * _C1) ^ word[a + SIDE - 8] * _C2) % np.uint64(65534) + np.uint64(2)
        side[place != last] = 0
        out.append(side)
    return out[0], out[1]


def sided_passages(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """``passages`` with the two ``_sides`` of each."""
    width = LEAST - GRAM + 1
    n = len(data) - GRAM + 1
    none = np.zeros(0, np.int64)
    nothing = none, none, none, *[none.astype(np.uint64)] * 2, *[none.astype(np.uint16)] * 2
    if n < width:
        return nothing
    gram = _grams(data)
    low, span = gram, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n - width + 1], low[width - span : width - span + n - width + 1])
    # windows start at begin .. end - LEAST of documents that are long enough
    docs = np.flatnonzero(end - begin >= LEAST)
    count = (end - begin - LEAST + 1)[docs]
    if not len(docs):
        return nothing
    valid = np.repeat(begin[docs] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    owner = np.repeat(docs, count)
    h = low[valid]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    start = valid[new]
    stop = valid[np.r_[new[1:], len(valid)] - 1] + LEAST
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, _ODD)])
    total = np.r_[np.uint64(0), np.cumsum(gram * power[:n])]
    back = np.cumprod(np.r_[np.uint64(1), np.full(n, _ODD_INVERSE)])
    content = _mix((total[stop - GRAM + 1] - total[start]) * back[start] + (stop - start).astype(np.uint64))
    return owner[new], start, stop, h[new], content, *_sides(data, gram, start, stop, h[new])


def _spans(doc: np.ndarray, tag: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows (rank_id, tag, intervals) with the merged intervals of each text."""
    order = np.lexsort((a, tag, doc))
    doc, tag, a, b = doc[order], tag[order], a[order].astype(np.int64), b[order].astype(np.int64)
    text = _starts(doc, tag)
    if not len(text):
        return []
    owner = np.repeat(np.arange(len(text)), np.diff(np.r_[text, len(doc)]))
    # furthest end so far within a text: texts are lifted apart so that one running maximum serves all
    lift = owner * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + lift) - lift
    new = np.ones(len(a), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (a[1:] > reach[:-1])
    first = np.flatnonzero(new)
    spans = np.stack([a[first], reach[np.r_[first[1:], len(a)] - 1]], axis=1).astype(np.int32).tobytes()
    cut = (8 * np.searchsorted(first, np.r_[text, len(a)])).tolist()
    return [(d, t, spans[lo:hi]) for d, t, lo, hi in zip(doc[text].tolist(), tag[text].tolist(), cut, cut[1:])]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of intervals as rows (start, end); touching ones are joined."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    if not len(a):
        return np.zeros((0, 2), np.int32)
    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    return np.stack([a[new], b[np.r_[new[1:], len(a)] - 1]], axis=1).astype(np.int32)


_ENTRY = ("h", "c", "doc", "tag", "start", "size", "left", "right")
_SHARDED = "shard int, rank_id long, tag long, spans binary, entries binary"


def _pack(e: dict[str, np.ndarray], at: np.ndarray) -> bytes:
    """Entries ``at`` in about 22 bytes each: 40 bits of the hash, 48 of the content hash, places as differences, sides (0 if not given).

    The hash only forms groups, so cutting it loses nothing; together 88 bits tell passages apart.
    """
    doc, tag, start = e["doc"][at], e["tag"][at], e["start"][at].astype(np.int64)
    step = np.diff(start, prepend=0)
    # equal rows share doc and tag: where places step back, the next row begins
    run = _starts(doc, tag, np.cumsum(step <= 0))
    step[run] = start[run]
    count = np.diff(np.r_[run, len(at)])
    parts = [e["h"][at].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), e["c"][at].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), step.astype("<u4").tobytes(), e["size"][at].astype("<u4").tobytes(), np.diff(doc[run], prepend=0).tobytes(), tag[run].astype("<u4").tobytes(), count.astype("<u4").tobytes()]
    parts += [e[x][at].astype("<u2").tobytes() if x in e else bytes(2 * len(at)) for x in ("left", "right")]
    return np.array([len(at), len(run)], "<u8").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    n, runs = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    raw = zstandard.ZstdDecompressor().decompress(blob[16:])
    at = 0

    def take(size: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, size, at)
        at += out.nbytes
        return out

    def wide(width: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = take(n * width, "u1").reshape(n, width)
        return out.view("<u8").ravel()

    h, c = wide(5), wide(6)
    step, size = take(n, "<u4").astype(np.int64), take(n, "<u4").astype(np.int32)
    doc, tag, count = np.cumsum(take(runs, "<i8")), take(runs, "<u4").astype(np.int64), take(runs, "<u4").astype(np.int64)
    left, right = take(n, "<u2"), take(n, "<u2")
    first = np.repeat(np.cumsum(count) - count, count)
    total = np.cumsum(step)
    return {"h": h, "c": c, "doc": np.repeat(doc, count), "tag": np.repeat(tag, count), "start": (total - total[first] + step[first]).astype(np.int32), "size": size, "left": left, "right": right}


def _leaders(e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of equal passages, those of the smallest document; and those that a smaller one removes."""
    group = _mix(e["h"] + e["c"] * _C2)
    order = np.argsort(group, kind="stable")
    first = _starts(group[order])
    later = np.zeros(len(group), bool)
    if len(first):
        least = np.repeat(np.minimum.reduceat(e["doc"][order], first), np.diff(np.r_[first, len(group)]))
        later[order] = e["doc"][order] > least
    return np.flatnonzero(~later), np.flatnonzero(later)


def _differ(doc: np.ndarray, *key: np.ndarray) -> np.ndarray:
    """Which rows share their key with a row of another document."""
    order = np.lexsort(key)
    first = _starts(*(x[order] for x in key))
    out = np.zeros(len(doc), bool)
    if len(first):
        out[order] = np.repeat(np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first), np.diff(np.r_[first, len(doc)]))
    return out


def _meets(h: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which passages may share a window with another document's passage of the same hash (see ``may_repeat``).

    A passage that holds its gram several times shows no sides, so it stays with all that share its hash.
    """
    out = np.isin(h, h[(left == 0) | (right == 0)])
    for side in (left, right):
        at = np.flatnonzero(side > 1)
        out[at[_differ(doc[at], side[at], h[at])]] = True
    return out


def _removed(e: dict[str, np.ndarray], gone: np.ndarray) -> list[tuple[int, int, bytes]]:
    start = e["start"][gone].astype(np.int64)
    return _spans(e["doc"][gone], e["tag"][gone], start, start + e["size"][gone])


def _portions(pdf: pd.DataFrame, chars: int) -> Iterator[pd.DataFrame]:
    """Consecutive rows of about ``chars`` characters, whole texts each."""
    for _, part in pdf.groupby(pdf["text"].map(len).to_numpy().cumsum() // chars, sort=True):
        yield part


def _deal(groups: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for whole in batches for part in _portions(whole, COLLAPSED)):
            found: list[dict] = []
            for part in _portions(pdf, HASHED):
                raw = [t.encode() for t in part["text"]]
                end = np.cumsum([len(x) for x in raw])
                begin = end - np.array([len(x) for x in raw])
                owner, a, b, h, c, left, right = sided_passages(b"".join(raw), begin, end)
                if len(owner):
                    found.append({"h": h, "c": c, "doc": part["rank_id"].to_numpy()[owner], "tag": part["tag"].to_numpy()[owner], "start": (a - begin[owner]).astype(np.int32), "size": (b - a).astype(np.int32), "left": left, "right": right})
            if not found:
                continue
            e = {x: np.concatenate([f.pop(x) for f in found]) for x in _ENTRY}
            stay, gone = _leaders(e)
            rows: list[tuple] = [(-1, *x, None) for x in _removed(e, gone)]
            shard = (e["h"][stay] % np.uint64(groups)).astype(np.int32)
            e["h"] = e["h"] // np.uint64(groups)
            order = np.argsort(shard, kind="stable")
            stay, shard = stay[order], shard[order]
            cut = _starts(shard).tolist()
            rows += [(int(shard[lo]), 0, 0, None, _pack(e, stay[lo:hi])) for lo, hi in zip(cut, [*cut[1:], len(shard)])]
            del e, found, stay, gone, shard, order
            trim()
            yield pd.DataFrame(rows, columns=["shard", "rank_id", "tag", "spans", "entries"])

    return run


_DECIDED = "rank_id long, tag long, spans binary, h binary, start binary, size binary, hot binary, bytes long"


def _decide(hot_bytes: int):
    """Rows with ``spans`` that are removed outright, and rows with passages (h, start, size, hot) that must be sorted."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = [(d, t, s, None, None, None, None, 0) for d, t, s in zip(pdf["rank_id"], pdf["tag"], pdf["spans"]) if s is not None]
        blobs = [_unpack(b) for b in pdf["entries"] if b is not None]
        if blobs:
            e = {x: np.concatenate([b.pop(x) for b in blobs]) for x in _ENTRY}
            stay, gone = _leaders(e)
            rows += [(*x, None, None, None, None, 0) for x in _removed(e, gone)]
            # different passages of different documents under one hash
            stay = stay[_differ(e["doc"][stay], e["h"][stay])]
            need = stay[_meets(e["h"][stay], e["doc"][stay], e["left"][stay], e["right"][stay])]
            need = need[np.argsort(e["h"][need], kind="stable")]
            h = e["h"][need]
            first = _starts(h)
            hot = np.repeat(np.add.reduceat(e["size"][need].astype(np.int64), first) > hot_bytes, np.diff(np.r_[first, len(h)])) if len(h) else np.zeros(0, bool)
            order = np.lexsort((e["tag"][need], e["doc"][need]))
            need, hot = need[order], hot[order]
            doc, tag = e["doc"][need], e["tag"][need]
            weight = np.where(hot, LEAST * (e["size"][need].astype(np.int64) - LEAST + 1), e["size"][need])
            cut = _starts(doc, tag).tolist()
            for lo, hi in zip(cut, [*cut[1:], len(need)]):
                at = need[lo:hi]
                rows.append((int(doc[lo]), int(tag[lo]), None, e["h"][at].tobytes(), e["start"][at].astype(np.int64).tobytes(), e["size"][at].astype(np.int64).tobytes(), hot[lo:hi].tobytes(), int(weight[lo:hi].sum())))
            del e, blobs
        trim()
        return pd.DataFrame(rows, columns=["rank_id", "tag", "spans", "h", "start", "size", "hot", "bytes"])

    return run


def _window_shards(windows: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of LEAST bytes, by all of them."""
    total = np.zeros(len(windows), np.uint64)
    for k in (*range(0, LEAST - 8, 8), LEAST - 8):
        total = _mix(total * _C1 + np.ascontiguousarray(windows[:, k : k + 8]).view("<u8").ravel())
    return (total % np.uint64(shards)).astype(np.int64)


def _collapsed(found: list[tuple[int, int, int, np.ndarray]], shards: int) -> tuple[list[tuple], list[tuple]]:
    """Of windows (doc, tag, first place, bytes): entries to sort, one for each text and content, and spans removed outright."""
    windows = np.ascontiguousarray(np.concatenate([w for *_, w in found]))
    count = [len(w) for *_, w in found]
    doc, tag = (np.repeat(np.array([f[k] for f in found], np.int64), count) for k in (0, 1))
    place = np.concatenate([np.arange(f[2], f[2] + len(f[3])) for f in found])
    _, one, same = np.unique(windows.view(f"V{LEAST}").ravel(), return_index=True, return_inverse=True)
    least = np.full(len(one), _LAST, np.int64)
    np.minimum.at(least, same, doc)
    later = doc > least[same]
    spans = _spans(doc[later], tag[later], place[later], place[later] + LEAST)
    stay = np.flatnonzero(~later)
    stay = stay[np.lexsort((place[stay], tag[stay], doc[stay], same[stay]))]
    first = _starts(same[stay], doc[stay], tag[stay])
    home = _window_shards(windows[one], shards)[same[stay[first]]]
    entries = [
        (s, doc[x[0]], tag[x[0]], LEAST, place[x], windows[x[0]].tobytes())
        for s, x in zip(home.tolist(), np.split(stay, first[1:]))
    ]
    return entries, spans


def _fetch(shards: int):
    """Entries of each shard: doc, tag, size, number of places, their places, bytes; or spans of a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(found: list[tuple], spans: list[tuple] = ()) -> pd.DataFrame:
            out: dict[int, list] = {}
            for s, *x in found:
                out.setdefault(s, []).append(x)
            rows = []
            for s, x in out.items():
                doc, tag, size, place, raw = zip(*x)
                numbers = doc, tag, size, [len(p) for p in place]
                rows.append((s, *(np.array(y, np.int64).tobytes() for y in numbers), np.concatenate(place).astype(np.int64).tobytes(), b"".join(raw), 0, 0, None))
            rows += [(d % shards, *[None] * 6, d, t, x) for d, t, x in spans]
            return pd.DataFrame(rows, columns=["shard", "doc", "tag", "size", "count", "start", "data", "rank_id", "text_tag", "spans"])

        for pdf in batches:
            found, hot, held = [], [], 0
            for doc, tag, text, hs, starts, sizes, hots in zip(pdf["rank_id"], pdf["tag"], pdf["text"], pdf["h"], pdf["start"], pdf["size"], pdf["hot"]):
                raw = text.encode()
                h, start, size = np.frombuffer(hs, np.uint64), np.frombuffer(starts, np.int64), np.frombuffer(sizes, np.int64)
                for s, a, n, single in zip((_mix(h) % np.uint64(shards)).tolist(), start.tolist(), size.tolist(), np.frombuffer(hots, bool).tolist()):
                    if not single:
                        found.append((s, doc, tag, n, [a], raw[a : a + n]))
                        continue
                    for at in range(a, a + n - LEAST + 1, WINDOWS):  # a passage of a period can be long
                        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8, min(WINDOWS + LEAST - 1, a + n - at), at), LEAST)
                        hot.append((doc, tag, at, windows))
                        held += len(windows)
                        if held >= WINDOWS:
                            yield rows(*_collapsed(hot, shards))
                            hot, held = [], 0
            yield rows(found)
            del found
            trim()
            if hot:
                yield rows(*_collapsed(hot, shards))

    return run


def may_repeat(data: bytes, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which passages can have a window in common with one of another document.

    All windows of a passage hold its gram of the smallest hash.  Equal windows have LEAST - GRAM more bytes in common
    around it, so half as many on one side of it at least: a passage whose gram has the same bytes neither before
    nor behind it in another document is out.  Passages that hold their gram several times stay, and show the
    surroundings of each place to the others.
    """
    side = SIDE
    begin = np.cumsum(size) - size
    gram = _grams(data + b"\0" * 8)[: len(data) - GRAM + 1]
    inside = np.ones(len(data), bool)
    for k in range(1, GRAM):
        inside[begin + size - k] = False
    masked = np.where(inside[: len(gram)], gram, ~np.uint64(0))
    first = np.minimum.reduceat(np.r_[masked, np.full(GRAM - 1, ~np.uint64(0))], begin)
    owner = np.repeat(np.arange(len(size)), size)[: len(gram)]
    hit = np.flatnonzero((masked == first[owner]) & inside[: len(gram)])
    who, at = owner[hit], hit
    count = np.bincount(who, minlength=len(size))
    stays = count != 1
    power = np.cumprod(np.full(side, int(_C1), np.uint64))
    raw = np.frombuffer(data, np.uint8)
    for shift, ok in ((-side, at - begin[who] >= side), (GRAM, at - begin[who] + GRAM + side <= size[who])):
        w, a = who[ok], at[ok] + shift
        key = first[w].copy()
        for k in range(side):
            key += raw[a + k] * power[k]
        key = _mix(key)
        order = np.argsort(key, kind="stable")
        w, key = w[order], key[order]
        run = _starts(key)
        if len(run):
            differ = np.minimum.reduceat(doc[w], run) != np.maximum.reduceat(doc[w], run)
            stays[w[np.repeat(differ, np.diff(np.r_[run, len(w)]))]] = True
    return stays


def repeated_windows(data: bytes, size: np.ndarray, doc: np.ndarray, least: int = LEAST, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(passage, offset) of every window of ``least`` bytes that a passage of a smaller document has too."""
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(size)
    begin = ends - size
    # bytes become 2 to 257, a 1 ends each passage and the only 0 ends the text
    t = np.ones(len(data) + len(size) + 1, np.uint16)
    t[-1] = 0
    shift = np.repeat(np.arange(len(size)), size)
    t[np.arange(len(data)) + shift] = np.frombuffer(data, np.uint8).astype(np.uint16) + 2
    order, common = suffix_order(t, 258, least, QUEUED, folder=folder)
    owner = np.zeros(len(t), np.int64)
    owner[np.arange(len(data)) + shift] = shift
    place = begin + np.arange(len(size))  # of each passage in t
    group = np.cumsum(common < least)
    at = order - place[owner[order]]
    window = (t[order] > 1) & (at + least <= size[owner[order]])
    order, group, at = order[window], group[window], at[window]
    who = owner[order]
    if not len(who):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    smallest = np.repeat(np.minimum.reduceat(doc[who], first), np.diff(np.r_[first, len(who)]))
    gone = doc[who] > smallest
    return who[gone], at[gone]


def _sort_shard(pdf: pd.DataFrame, folder: str | None = None) -> pd.DataFrame:
    known = pdf["spans"].notna()
    rows = list(zip(pdf["rank_id"][known], pdf["text_tag"][known], pdf["spans"][known]))
    pdf = pdf[~known]
    if len(pdf):
        doc, tag, size, count, start = (np.frombuffer(b"".join(pdf[x]), np.int64) for x in ("doc", "tag", "size", "count", "start"))
        data = b"".join(pdf["data"])
        del pdf
        stays = may_repeat(data, size, doc)
        some = np.frombuffer(data, np.uint8)[np.repeat(stays, size)].tobytes()
        place = np.flatnonzero(stays)
        who, at = repeated_windows(some, size[stays], doc[stays], folder=folder)
        who = place[who]
        # a window of several places goes from all of them
        many = count[who]
        last = np.cumsum(many)
        place = start[np.repeat(np.cumsum(count)[who] - last, many) + np.arange(many.sum())] + np.repeat(at, many)
        who = np.repeat(who, many)
        rows += _spans(doc[who], tag[who], place, place + LEAST)
    trim()
    return pd.DataFrame(rows, columns=["rank_id", "tag", "spans"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
            raw = (text or "").encode()
            cut = np.zeros((0, 2), np.int32)
            if spans is not None and len(spans):
                cut = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2)
                cut = merged(cut[:, 0], cut[:, 1])
            kept, at = [], 0
            for a, b in cut.tolist():
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            rows.append((doc_id, len(raw), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in cut.tolist()]))
        trim()
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def whole_characters(text: str, spans: list) -> str:
    """``text`` without the characters that lie wholly in ``spans`` (offsets of bytes)."""
    raw = text.encode()
    kept, at = [], 0
    for x in spans:
        a, b = x["start"], x["end"]
        while a < b and raw[a] & 0xC0 == 0x80:  # a begins inside a character: keep that one
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(raw[at:a])
        at = max(at, b)
    return b"".join([*kept, raw[at:]]).decode()


def removals(rows: DataFrame) -> DataFrame:
    """``rank_id, tag, spans`` (array of binary intervals): what each text of ``keyed`` rows loses."""
    spark = rows.sparkSession
    rows = rows.where("text is not null").select("rank_id", "tag", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(2 * parts(spark), total // GROUP_BYTES + 1)
    dealt = rows.mapInPandas(_deal(groups), _SHARDED)
    dealt = dealt.withColumn("g", F.when(F.col("shard") >= 0, F.col("shard")).otherwise(F.pmod(F.xxhash64("rank_id"), F.lit(groups)).cast("int")))
    decided = staged(dealt.groupBy("g").applyInPandas(_decide(SHARD_BYTES), _DECIDED), "decided")
    del dealt
    release_shuffles(spark)
    wanted = decided.where("h is not null")
    weight = wanted.agg(F.sum("bytes")).first()[0] or 0
    shards = max(parts(spark), int(weight) // SHARD_BYTES + 1)
    folder = f"{shared_dir(spark)}/suffix-queues"
    # each text is sent once, with all that is wanted of it
    wants = wanted.groupBy("rank_id", "tag").agg(F.collect_list(F.struct("h", "start", "size", "hot")).alias("w"))
    wants = wants.select("rank_id", "tag", *(F.aggregate(f"w.{c}", F.lit(b""), lambda a, x: F.concat(a, x)).alias(c) for c in ("h", "start", "size", "hot")))
    # merge: the same plan at every size, as what is wanted grows with the corpus
    fetched = rows.join(wants.hint("merge"), ["rank_id", "tag"]).mapInPandas(_fetch(shards), "shard int, doc binary, tag binary, size binary, count binary, start binary, data binary, rank_id long, text_tag long, spans binary")
    sorted_out = staged(fetched.groupBy("shard").applyInPandas(lambda pdf: _sort_shard(pdf, folder), "rank_id long, tag long, spans binary"), "sorted")
    del fetched
    release_shuffles(spark)
    return decided.where("spans is not null").select("rank_id", "tag", "spans").union(sorted_out).groupBy("rank_id", "tag").agg(F.collect_list("spans").alias("spans"))


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """Rows with what they are ranked by, and a tag that tells texts of one doc_id apart."""
    rows = documents(docs, *extra).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.withColumns({"rank_id": F.coalesce("doc_id", F.lit(_LAST)), "tag": F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))})


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed`` (byte spans of the original text)."""
    rows = keyed(docs)
    out = rows.join(removals(rows).hint("merge"), ["rank_id", "tag"], "left").select("doc_id", "text", "spans")
    return map_by_id(out, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>")


def kept_text(docs: DataFrame, *extra: str) -> DataFrame:
    """``docs`` (with ``extra`` columns) with texts cut; characters that are only partly covered stay."""
    rows = keyed(docs, *extra)

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            if t is not None and s is not None and len(s):
                x = np.frombuffer(b"".join(s), np.int32).reshape(-1, 2)
                t = whole_characters(t, [{"start": a, "end": b} for a, b in merged(x[:, 0], x[:, 1]).tolist()])
            out.append(t)
        return pd.Series(out, dtype=object)

    return rows.join(removals(rows).hint("merge"), ["rank_id", "tag"], "left").select("doc_id", cut("text", "spans").alias("text"), *extra)
