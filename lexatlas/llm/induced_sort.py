"""External induced suffix sorting with common-prefix values.

Suffixes are sorted by induction from the sorted LMS suffixes: in ascending order each suffix hands its
left neighbour, if of type L, to the queue of that neighbour's symbol; then in descending order those of
type S.  A queue is a priority queue over symbols whose entries of one symbol leave in order of arrival; it
holds tuples (position, common prefix with the entry before) as blocks and writes them to disk beyond a
limit.  The common prefix of two induced suffixes is one more than the least one between the suffixes
they come from.  The order of the LMS suffixes comes from their names, by recursion down to names that differ.
Names are many, so at those levels a queue's entries are taken out a range of symbols at a time: what came from other
ranges is in order already, and chains within the range are ranked by pointer jumping.  Orders and common prefixes are
exact up to ``depth`` symbols; suffixes that agree on ``depth`` symbols stand together in any order.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.fs

#: Alphabets up to this size have a queue bucket for each symbol, larger ones (of names) for each range of symbols.
FEW = 1024
_SLICE = 1 << 16
#: Suffixes of a range of symbols, about; a symbol with more of them is a range of its own.
_SPAN = 1 << 16


class SpillFile:
    """One file below a folder that is named by path or URI; without a folder, what is spilled stays in memory."""

    def __init__(self, folder: str | None):
        self.parts: list[bytes] = []
        self.fs = None
        if folder is not None:
            self.fs, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)
            self.fs.create_dir(root, recursive=True)
            self.path, self.files = f"{root}/queue-{uuid.uuid4().hex}", 0

    def write(self, blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
        """Append blocks in one file; each one's (file, offset, entries)."""
        out, at = [], 0
        if self.fs is None:
            self.parts.append(b"".join(x.tobytes() for block in blocks for x in block))
            name = len(self.parts) - 1
        else:
            name = self.files
            self.files += 1
            with self.fs.open_output_stream(f"{self.path}-{name}") as f:
                for block in blocks:
                    for x in block:
                        f.write(np.ascontiguousarray(x).data)
        for pos, _ in blocks:
            out.append((name, at, len(pos)))
            at += 9 * len(pos)
        return out

    def read(self, name: int, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.fs is None:
            raw = self.parts[name][at : at + 9 * n]
        else:
            with self.fs.open_input_file(f"{self.path}-{name}") as f:
                raw = f.read_at(9 * n, at)
        return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, 8 * n)

    def close(self) -> None:
        self.parts = []
        if self.fs is not None:
            for name in range(self.files):
                self.fs.delete_file(f"{self.path}-{name}")


class SymbolQueue:
    """FIFO blocks of (position, common prefix) for each symbol; blocks beyond ``limit`` entries go to ``folder``."""

    def __init__(self, symbols: int, limit: int = 1 << 24, folder: str | None = None):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.limit, self.held, self.folder, self.file = limit, 0, folder, None

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks[symbol].append((pos, lcp))
        self.held += len(pos)
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = SpillFile(self.folder)
        held = [(blocks, k) for blocks in self.blocks for k, block in enumerate(blocks) if isinstance(block[0], np.ndarray)]
        places = self.file.write([(blocks[k][0].astype(np.int64, copy=False), blocks[k][1]) for blocks, k in held])
        for (blocks, k), place in zip(held, places):
            blocks[k] = place
        self.held = 0

    def pop(self, symbol: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """All entries of a symbol in order of arrival, as blocks of _SLICE entries or more where there are as many."""
        out = []
        for block in self.blocks[symbol]:
            if not isinstance(block[0], np.ndarray):
                block = self.file.read(*block)
            else:
                self.held -= len(block[0])
            out.append(block)
        self.blocks[symbol] = []
        whole, part, size = [], [], 0
        for block in out:
            part.append(block)
            size += len(block[0])
            if size >= _SLICE or block is out[-1]:
                whole.append(part[0] if len(part) == 1 else (np.concatenate([b[0] for b in part]), np.concatenate([b[1] for b in part])))
                part, size = [], 0
        return whole

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Minima:
    """Least value of any range of a slice."""

    def __init__(self, values: np.ndarray):
        self.levels, width = [values], 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray, empty: int) -> np.ndarray:
        """Least of values[lo..hi], ``empty`` where hi < lo."""
        size = hi - lo + 1
        out = np.full(len(lo), empty, np.uint8)
        level = np.frexp(np.maximum(size, 1))[1] - 1
        for k in np.unique(level[size > 0]):
            m = (level == k) & (size > 0)
            t = self.levels[k]
            out[m] = np.minimum(t[lo[m]], t[hi[m] - (1 << k) + 1])
        return out


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S (smaller than the suffix after it); the last is S."""
    n = len(t)
    up = np.zeros(n, bool)
    up[-1] = True
    if n == 1:
        return up
    less, equal = t[:-1] < t[1:], t[:-1] == t[1:]
    # a run of equal symbols has the type of its end
    end = np.where(equal, n, np.arange(n - 1))
    nxt = np.minimum.accumulate(end[::-1])[::-1]
    known = nxt < n - 1
    up[:-1][known] = less[nxt[known]]
    up[:-1][~known] = False
    return up


def _scan(t, wanted, pos, lcp, run, cap, queue) -> None:
    """Hand on the left neighbours of the suffixes ``pos``, in this order; ``run``: least common prefix since each symbol's last.

    With ``cap`` 0 common prefixes aren't followed.
    """
    for a in range(0, len(pos), _SLICE):
        p, c = pos[a : a + _SLICE], lcp[a : a + _SLICE]
        left = p - 1
        idx = np.flatnonzero(p > 0)
        idx = idx[wanted[left[idx]]]
        least = int(c.min()) if cap else 0
        if not len(idx):
            np.minimum(run, least, out=run)
            continue
        sym = t[left[idx]]
        order = np.argsort(sym, kind="stable")
        idx, sym = idx[order], sym[order]
        first = np.r_[True, sym[1:] != sym[:-1]]
        begin = np.flatnonzero(first)
        end = np.r_[begin[1:], len(idx)]
        taken = left[idx]
        if not cap:
            for s, lo, hi in zip(sym[begin].tolist(), begin.tolist(), end.tolist()):
                queue.push(s, taken[lo:hi], np.zeros(hi - lo, np.uint8))
            continue
        minima = _Minima(c)
        before = np.where(first, -1, np.r_[-1, idx[:-1]])
        low = minima(before + 1, idx, cap)
        low[first] = np.minimum(low[first], run[sym[first]])
        common = np.minimum(low.astype(np.int64) + 1, cap).astype(np.uint8)
        tail = minima(idx[end - 1] + 1, np.full(len(end), len(c) - 1), cap)
        np.minimum(run, least, out=run)
        run[sym[begin]] = tail
        for s, lo, hi in zip(sym[begin].tolist(), begin.tolist(), end.tolist()):
            queue.push(s, taken[lo:hi], common[lo:hi])


def _direct(t: np.ndarray, a: int, b: int, cap: int) -> int:
    x, y = t[a : a + cap], t[b : b + cap]
    n = min(len(x), len(y))
    d = np.flatnonzero(x[:n] != y[:n])
    return int(d[0]) if len(d) else n


def _run_starts(t: np.ndarray) -> np.ndarray:
    """For each place, where its run of equal symbols begins."""
    new = np.arange(len(t))
    new[1:][t[1:] == t[:-1]] = 0
    return np.maximum.accumulate(new)


def _rest_of_runs(pos: np.ndarray, lcp: np.ndarray, starts: np.ndarray, cap: int) -> tuple[np.ndarray, ...]:
    """All that a run's suffixes still induce in their own bucket, as (positions, common prefixes), and the same of run starts.

    For suffixes that begin with more than ``depth`` equal symbols: their order no longer matters.
    """
    begin = starts[pos]
    size = pos - begin + 1
    last = np.cumsum(size)
    every = np.repeat(pos + (last - size), size) - np.arange(last[-1])
    common = np.full(len(every), cap, np.uint8)
    common[0] = lcp[0]
    ends = np.full(len(begin), cap, np.uint8)
    ends[0] = lcp[0]
    return every, common, begin, ends


def _induce(t, s_type, lms, lms_lcp, symbols, cap, limit, folder, depth):
    """All suffixes in order, with common prefixes, from LMS suffixes in order."""
    n = len(t)
    starts = None
    lower = ~s_type
    bounds = np.searchsorted(t[lms], np.arange(symbols + 1)) if len(lms) else np.zeros(symbols + 1, int)
    run = np.zeros(symbols, np.uint8)
    queue = SymbolQueue(symbols, limit, folder)
    large: list[list] = [[] for _ in range(symbols)]
    for c in range(symbols):
        last, rounds = -1, 0
        while blocks := queue.pop(c):
            rounds += 1  # the entries of a round begin with as many symbols c at least
            for pos, lcp in blocks:
                if last < 0:
                    lcp = lcp.copy()
                    lcp[0] = 0
                if rounds > depth:
                    starts = _run_starts(t) if starts is None else starts
                    every, common, pos, lcp = _rest_of_runs(pos, lcp, starts, cap)
                    large[c].append((every, common))
                    last = int(every[-1])
                else:
                    large[c].append((pos, lcp))
                    last = int(pos[-1])
                _scan(t, lower, pos, lcp, run, cap, queue)
        lo, hi = bounds[c], bounds[c + 1]
        if lo < hi:
            lcp = lms_lcp[lo:hi].copy()
            lcp[0] = _direct(t, last, int(lms[lo]), cap) if last >= 0 else 0
            _scan(t, lower, lms[lo:hi], lcp, run, cap, queue)
    queue.close()
    run[:] = 0
    queue = SymbolQueue(symbols, limit, folder)
    order, common = np.empty(n, np.int64), np.empty(n, np.uint8)
    at = n
    for c in range(symbols - 1, -1, -1):
        small: list = []
        last, rounds = -1, 0
        while blocks := queue.pop(c):
            rounds += 1
            for pos, lcp in blocks:
                if last < 0:
                    lcp = lcp.copy()
                    lcp[0] = 0
                if rounds > depth:
                    starts = _run_starts(t) if starts is None else starts
                    every, common_run, pos, lcp = _rest_of_runs(pos, lcp, starts, cap)
                    small.append((every, common_run))
                    last = int(every[-1])
                else:
                    small.append((pos, lcp))
                    last = int(pos[-1])
                _scan(t, s_type, pos, lcp, run, cap, queue)
        if c == 0 and s_type[n - 1]:
            small.append((np.array([n - 1]), np.zeros(1, np.uint8)))
        between = 0
        if large[c]:
            pos = np.concatenate([b[0] for b in large[c]])
            lcp = np.concatenate([b[1] for b in large[c]])
            between = _direct(t, int(pos[-1]), last, cap) if last >= 0 else 0
            _scan(t, s_type, pos[::-1], np.r_[np.uint8(between), lcp[:0:-1]], run, cap, queue)
        if small:
            sp = np.concatenate([b[0] for b in small])[::-1]
            sl = np.concatenate([b[1] for b in small])[::-1]
            order[at - len(sp) : at] = sp
            common[at - len(sp)] = between
            common[at - len(sp) + 1 : at] = sl[:-1]
            at -= len(sp)
        if large[c]:
            order[at - len(pos) : at] = pos
            common[at - len(pos) : at] = lcp
            at -= len(pos)
            large[c] = []
    queue.close()
    return order, common


def _same(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """Whether t[a : a + size] equals t[b : b + size], as far as ``depth`` symbols and one more."""
    out = np.ones(len(a), bool)
    live = np.arange(len(a))
    j = 0
    while len(live) and j <= depth:
        live = live[size[live] > j]
        bad = t[a[live] + j] != t[b[live] + j]
        out[live[bad]] = False
        live = live[~bad]
        j += 1
    return out


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of the suffixes a and b, up to cap."""
    out = np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    n = len(t)
    for j in range(cap):
        x, y = a[live] + j, b[live] + j
        ok = (x < n) & (y < n)
        live, x, y = live[ok], x[ok], y[ok]
        live = live[t[x] == t[y]]
        if not len(live):
            break
        out[live] = j + 1
    return out


def _ranked(key: np.ndarray, source: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Nodes in order of ``key``, ties among the nodes ``inner`` broken by the order of their sources."""
    _, rank = np.unique(key, return_inverse=True)
    source = source.copy()
    while len(inner) and rank.max() < len(rank) - 1:
        ahead = np.zeros(len(rank), np.int64)
        ahead[inner] = rank[source[inner]]
        _, rank = np.unique(rank << 32 | ahead, return_inverse=True)
        source = source[source]
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    return order


def _bounds(kind: np.ndarray, n: int) -> list[int]:
    """Where each of ``n`` kinds begins in ascending ``kind``, and the end."""
    return np.searchsorted(kind, np.arange(n + 1)).tolist()


def _hand_on(queue, pos: np.ndarray, wanted: np.ndarray, where: np.ndarray, t: np.ndarray, beyond) -> None:
    """Push the left neighbours of ``pos``, in this order, that are ``wanted`` and of a range ``beyond`` the present one."""
    left = pos[pos > 0] - 1
    left = left[wanted[left]]
    target = where[t[left]]
    far = beyond(target)
    left, target = left[far], target[far]
    order = np.argsort(target, kind="stable")
    left, target = left[order], target[order]
    begin = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else []
    for lo, hi in zip(begin, [*begin[1:], len(target)]):
        queue.push(int(target[lo]), left[lo:hi], np.zeros(hi - lo, np.uint8))


def _popped(queue, r: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(pos for pos, _ in queue.pop(r))])


def _induce_ranges(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, symbols: int, limit: int, folder: str | None, span: int) -> np.ndarray:
    """All suffixes in order, from LMS suffixes in order; queue buckets are ranges of symbols.

    In a range, the suffixes of a type are those whose source lies in another range, which the queue hands over in order,
    and those whose source lies in the range itself.  Of one symbol, the former come before the latter for type L
    and after them for type S, and L comes before S.
    """
    total = np.cumsum(np.bincount(t, minlength=symbols))
    where = np.searchsorted(np.unique(total[np.searchsorted(total, np.arange(span, len(t) + span, span)).clip(max=symbols - 1)]), total)
    ranges = int(where[-1]) + 1
    home = where[t]
    members = []
    for kind in (~s_type, s_type):
        pos = np.flatnonzero(kind)
        pos = pos[np.argsort(home[pos], kind="stable")]
        members.append((pos, _bounds(home[pos], ranges)))
    lms_bounds = _bounds(home[lms], ranges)

    def order_of(r: int, mine: np.ndarray, came: np.ndarray, other: np.ndarray, down: bool) -> np.ndarray:
        """Suffixes of range ``r`` in order: ``mine`` (by position) of the type in hand, ``other`` in order already."""
        m = len(mine)
        seq = np.full(m, -1)
        seq[np.searchsorted(mine, came)] = np.arange(len(came))
        inner = np.flatnonzero(seq < 0)
        pos = np.r_[mine, other]
        # the order of classes within a symbol: ascending, L: came, inner, other (S); S: other (L), inner, came
        kind = np.r_[np.where(seq < 0, 1, 2 if down else 0), np.full(len(other), 0 if down else 2)]
        place = np.r_[np.where(seq < 0, 0, len(came) - seq if down else seq), np.arange(len(other))]
        source = np.arange(len(pos))
        if len(inner):
            nxt = mine[inner] + 1
            at = np.searchsorted(mine, nxt)
            same = at < m
            same[same] = mine[at[same]] == nxt[same]
            by = np.argsort(other)
            if len(other):
                at[~same] = m + by[np.searchsorted(other[by], nxt[~same])]
            source[inner] = at
        return pos[_ranked((t[pos].astype(np.int64) * 3 + kind) << 32 | place, source, inner)]

    queue = SymbolQueue(ranges, limit, folder)
    large = []
    pos, bound = members[0]
    for r in range(ranges):
        order = order_of(r, pos[bound[r] : bound[r + 1]], _popped(queue, r), lms[lms_bounds[r] : lms_bounds[r + 1]], False)
        large.append(order[~s_type[order]])
        _hand_on(queue, order, ~s_type, where, t, lambda x, r=r: x > r)
    queue.close()
    queue = SymbolQueue(ranges, limit, folder)
    out = np.empty(len(t), np.int64)
    end = len(t)
    pos, bound = members[1]
    for r in range(ranges - 1, -1, -1):
        came = _popped(queue, r)
        if r == 0:  # the end of the text has no source
            came = np.r_[came, len(t) - 1]
        order = order_of(r, pos[bound[r] : bound[r + 1]], came, large[r], True)
        large[r] = None
        out[end - len(order) : end] = order
        end -= len(order)
        _hand_on(queue, order[::-1], s_type, where, t, lambda x, r=r: x < r)
    queue.close()
    return out


def _lms_order(t: np.ndarray, s_type: np.ndarray, symbols: int, depth: int, limit: int, few: int, folder: str | None, span: int) -> np.ndarray:
    """LMS positions in the order of their suffixes: sorted by their substrings, named, and the names sorted in turn."""
    n = len(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(lms) < 2:
        return lms
    first = _induced(t, s_type, lms[np.argsort(t[lms], kind="stable")], symbols, depth, limit, few, folder, span)
    mark = np.zeros(n, bool)
    mark[lms] = True
    found = first[mark[first]]
    nxt = np.full(n, n, np.int64)
    nxt[lms[:-1]] = lms[1:]
    size = np.minimum(nxt[found] + 1, n) - found
    a, b = found[:-1], found[1:]
    equal = (size[:-1] == size[1:]) & (nxt[a] < n) & (nxt[b] < n)
    equal[equal] = _same(t, a[equal], b[equal], size[:-1][equal], depth)
    if not equal.any():
        return found
    name = np.empty(n, np.int64)
    name[found] = np.r_[0, np.cumsum(~equal)]
    names = name[lms]
    top = int(names.max())
    # the last LMS suffix is the end of the text and so the only name 0; LMS positions are two apart at least
    return lms[_name_order(names, top + 1, depth // 2 + 2, limit, few, folder, span)]


def _induced(t, s_type, lms, symbols: int, depth: int, limit: int, few: int, folder: str | None, span: int) -> np.ndarray:
    if symbols <= few:
        return _induce(t, s_type, lms, np.zeros(len(lms), np.uint8), symbols, 0, limit, folder, depth)[0]
    return _induce_ranges(t, s_type, lms, symbols, limit, folder, span)


def _name_order(t: np.ndarray, symbols: int, depth: int, limit: int, few: int, folder: str | None, span: int) -> np.ndarray:
    """Order of the suffixes of names, by ``depth`` of them at least."""
    s_type = types(t)
    return _induced(t, s_type, _lms_order(t, s_type, symbols, depth, limit, few, folder, span), symbols, depth, limit, few, folder, span)


def suffix_order(t: np.ndarray, symbols: int, depth: int, limit: int = 1 << 24, few: int = FEW, folder: str | None = None, span: int = _SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``t`` in order and each one's common prefix with the one before.

    ``t`` ends with its only 0.  Both are exact up to ``depth`` (255 at most) symbols.  ``limit``: tuples that a queue holds
    in memory, ``folder``: where it writes others; ``few`` and ``span`` set how symbols share buckets.
    """
    s_type = types(t)
    if len(t) == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.uint8)
    lms = _lms_order(t, s_type, symbols, depth, limit, few, folder, span)
    lms_lcp = np.r_[np.uint8(0), _common(t, lms[:-1], lms[1:], depth)]
    return _induce(t, s_type, lms, lms_lcp, symbols, depth, limit, folder, depth)
