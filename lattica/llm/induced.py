"""External induced suffix sorting with common-prefix values.

Suffixes of an integer string are sorted by recursive induction: the substrings between leftmost-S positions are sorted
and named, the string of names is sorted by the same procedure (by prefix doubling once it has at most ``in_memory``
names), and the order of all suffixes is induced in two scans. A priority queue carries tuples (symbol, position, common
prefix with the tuple before it) keyed by symbol and arrival. During a scan symbols only grow (or only fall), so the queue
is a calendar: symbols are parted into ranges of about equal weight, a range is a list of runs, and runs beyond the memory
limit are spilled to disk and read back when the scan gets there. All arrays of a level (text, types, places, names,
order, values) are files beyond ``limit`` items and are worked through in blocks of that size, so memory is a small
multiple of the limit whatever the length of the string.

A range of one symbol is scanned run by run: what it induces into itself is its next run. A range of many symbols (names)
is scanned in batches of whole symbols. What a batch induces into itself is put in and the batch is scanned again until
nothing changes, which takes as many turns as the longest such chain; where that is long, the batch is cut before the
first symbol into which it induces, and a symbol that induces into itself is scanned alone, run by run.

Common prefixes are carried along: two neighbours in a bucket have 1 + the least value scanned between their successors.
Only at the seam between the two parts of a bucket are suffixes compared directly. Order and values are exact up to
``depth`` symbols; longer common prefixes count as ``depth`` and their suffixes stand in any order.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections import defaultdict, deque

import numpy as np

_FEW = 1 << 10  # symbols of a string that has a range for each
_BATCH, _TURNS = 1024, 3  # items of a batch of whole symbols; turns before it is cut


class Space:
    """Arrays in memory up to ``limit`` items, beyond it in files of a scratch folder that goes with the task.

    The folder is where Spark keeps its own spills (SPARK_LOCAL_DIRS); nothing in it outlives the task or is shared."""

    def __init__(self, limit: int):
        self.limit, self.folder, self.count, self.spilled, self.levels = limit, None, 0, 0, 0
        self.files: dict[int, str] = {}  # by address

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)

    def _name(self) -> str:
        if not self.folder:
            at = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            self.folder = tempfile.mkdtemp(prefix="induced-", dir=at if os.path.isdir(at) else None)
        self.count += 1
        return os.path.join(self.folder, f"{self.count}.npy")

    def array(self, n: int, kind) -> np.ndarray:
        if n <= self.limit:
            return np.empty(n, kind)
        self.spilled += n
        name = self._name()
        out = np.asarray(np.lib.format.open_memmap(name, "w+", kind, (n,)))
        self.files[out.ctypes.data] = name
        return out

    def free(self, *arrays: np.ndarray) -> None:
        """Removes the files of arrays that are not needed any more."""
        for a in arrays:
            if name := self.files.pop(a.ctypes.data, None):
                os.remove(name)

    def path(self) -> str:
        """A new file of the folder."""
        return self._name()

    def save(self, block: np.ndarray) -> str:
        self.spilled += block.shape[-1]
        name = self._name()
        np.save(name, block)
        return name

    def blocks(self, n: int):
        """(start, end) of the blocks of n items."""
        return ((a, min(n, a + self.limit)) for a in range(0, n, self.limit))


def _whole(n: int):
    """The narrowest integers that hold places of a string of n symbols."""
    return np.int32 if n < 1 << 31 else np.int64


class BucketQueue:
    """Tuples by range of symbols in order of arrival; the longest runs go to disk when more than ``limit`` items wait in memory."""

    def __init__(self, space: Space):
        self.space, self.runs, self.held = space, defaultdict(deque), 0

    def push(self, at: int, block: np.ndarray) -> None:
        if block.shape[1]:
            self.runs[at].append(block)
            self.held += block.shape[1]
            if self.held > self.space.limit:
                self._spill()

    def _spill(self) -> None:
        waiting = sorted(((sum(b.shape[1] for b in q if not isinstance(b, str)), at) for at, q in self.runs.items()), reverse=True)
        for size, at in waiting:
            if self.held <= self.space.limit // 2 or not size:
                break
            merged: deque = deque()
            waits: list[np.ndarray] = []
            for b in [*self.runs[at], ""]:
                if not isinstance(b, str):
                    waits.append(b)
                    continue
                if waits:
                    self.held -= sum(x.shape[1] for x in waits)
                    merged.append(self.space.save(np.concatenate(waits, 1)))
                    waits = []
                if b:
                    merged.append(b)
            self.runs[at] = merged

    def pop(self, at: int, whole: bool = False) -> np.ndarray | None:
        """The next run of a range, or all of it; None if it is empty."""
        q = self.runs.get(at)
        if not q:
            self.runs.pop(at, None)
            return None
        parts, size = [], 0
        while q and (whole or size <= 1 << 16):
            first = q.popleft()
            if isinstance(first, str):
                name, first = first, np.load(first)
                os.remove(name)
            else:
                self.held -= first.shape[1]
            parts.append(first)
            size += first.shape[1]
        return parts[0] if len(parts) == 1 else np.concatenate(parts, 1)


def _items(kind, sym, pos, lcp) -> np.ndarray:
    """Tuples as the rows symbol, position, common prefix."""
    out = np.empty((3, len(pos)), kind)
    out[0], out[1], out[2] = sym, pos, lcp
    return out


def _types(t: np.ndarray, space: Space) -> np.ndarray:
    """True for S positions; the last place, the sentinel, is S."""
    n = len(t)
    s = space.array(n, bool)
    s[n - 1] = True
    for a, b in reversed(list(space.blocks(n - 1))):
        x = np.asarray(t[a : b + 1])
        falls, same = x[:-1] > x[1:], x[:-1] == x[1:]
        # An equal neighbour's type is that of the next unequal pair, or of what follows the block.
        nxt = np.where(same, b - a, np.arange(b - a))
        nxt = np.minimum.accumulate(nxt[::-1])[::-1]
        s[a:b] = np.where(nxt < b - a, ~np.append(falls, False)[nxt], bool(s[b]))
    return s


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, have: np.ndarray | None = None) -> np.ndarray:
    """Common prefix lengths of suffix pairs by direct comparison, up to ``depth``."""
    n = len(t)
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    out = np.zeros(len(a), np.int64) if have is None else np.minimum(have, depth).astype(np.int64)
    live = np.flatnonzero(out < depth)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = (x < n) & (y < n)
        same = np.zeros(len(live), bool)
        same[inside] = t[x[inside]] == t[y[inside]]
        live = live[same]
        out[live] += 1
        live = live[out[live] < depth]
    return out


def _refine(rank: np.ndarray, key_at, rounds: int) -> np.ndarray:
    """Refines dense group starts ``rank`` by further keys: ``key_at(items, round)`` until groups are single or rounds end."""
    items = np.argsort(rank, kind="stable")
    for r in range(rounds):
        group = rank[items]  # rising; only members of groups of two or more go on
        edge = np.ones(len(items) + 1, bool)
        edge[1:-1] = group[1:] != group[:-1]
        items = items[~(edge[:-1] & edge[1:])]
        key = key_at(items, r) if len(items) else None
        if key is None:
            break
        group = rank[items]
        o = np.lexsort((key, group))
        items, key = items[o], key[o]
        first = np.ones(len(items), bool)
        first[1:] = group[1:] != group[:-1]
        new = first.copy()
        new[1:] |= key[1:] != key[:-1]
        where = np.arange(len(items))
        base = np.maximum.accumulate(np.where(first, where, 0))
        start = np.maximum.accumulate(np.where(new, where, 0))
        rank[items] = group + (start - base)
    return rank


def _group_starts(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    rank = np.empty(len(k), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    return rank


def doubling(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefixes with the suffix before) of a string in memory, by prefix doubling up to ``depth``."""
    n = len(t)
    ranks = [_group_starts(t).astype(_whole(n))]
    k = 1
    while k < depth:
        rank = ranks[-1].copy()
        before = ranks[-1]

        def key_at(items, _, k=k, before=before):
            nxt = items + k
            return np.where(nxt < n, before[np.minimum(nxt, n - 1)] + 1, 0)

        rank = _refine(rank, key_at, 1)
        if (rank == before).all():
            break
        ranks.append(rank)
        k *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n, np.int64)
    got = np.zeros(max(0, n - 1), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r = ranks[level]
        for _ in range(2 if level == len(ranks) - 1 else 1):  # at the top, equal ranks can follow each other
            x, y = a + got, b + got
            same = (x < n) & (y < n)
            same[same] = r[x[same]] == r[y[same]]
            got[same] += 1 << level
    lcp[1:] = np.minimum(got, depth)
    return order, lcp


def _least_between(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(lcp[low..high]) by a sparse table."""
    out = np.empty(len(low), lcp.dtype)
    span = high - low + 1
    level = np.frexp(span.astype(float))[1] - 1
    table, k = lcp, 0
    for want in range(int(level.max(initial=0)) + 1):
        while k < want:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
            k += 1
        here = np.flatnonzero(level == want)
        if len(here):
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << want) + 1])
    return out


def _ranges(t: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """(first symbols of the ranges, whether they hold one symbol): one where it is frequent or symbols are few, else ranges
    of about equal weight."""
    top = max(int(np.asarray(t[a:b]).max()) for a, b in space.blocks(len(t)))
    counts = space.array(top + 1, np.int64)
    counts[:] = 0
    for a, b in space.blocks(len(t)):
        sym, times = np.unique(np.asarray(t[a:b]), return_counts=True)
        counts[sym] += times
    share = max(_BATCH, space.limit // 8)
    starts, single, weight = [], [], 0
    for a, b in space.blocks(top + 1):
        here = np.asarray(counts[a:b])
        sym = np.flatnonzero(here)
        times = here[sym]
        if top < _FEW:
            starts.append(sym + a)
            single.append(np.ones(len(sym), bool))
        elif len(sym):
            total = weight + np.cumsum(times)
            big = times > share // 2
            new = np.concatenate([[True], (total[1:] // share != total[:-1] // share) | big[:-1]]) | big
            first = np.flatnonzero(new)
            starts.append(sym[first] + a)
            single.append(np.diff(np.append(first, len(sym))) == 1)
            weight = int(total[-1])
    space.free(counts)
    return np.concatenate(starts), np.concatenate(single)


class _Scan:
    """One scan over the buckets: ascending symbols induce L suffixes, descending ones S suffixes.

    A bucket has two parts: what the scan induces, then what ``second`` gives (leftmost-S suffixes in sorted order, or the
    L suffixes of the first scan from the last). ``run`` yields items in scan order and a mask of the first part.
    """

    def __init__(self, t, is_s, space: Space, ranges: tuple[np.ndarray, np.ndarray], depth: int, up: bool):
        self.t, self.is_s, self.depth, self.up = t, is_s, depth, up
        (self.starts, self.single), self.sign, self.queue, self.kind = ranges, 1 if up else -1, BucketQueue(space), _whole(len(t))
        self.here, self.inbox = -1, []  # a range of many symbols in hand, and what is induced into it

    def route(self, sym: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Items sorted by symbol go to their ranges."""
        if not len(sym):
            return
        at = np.searchsorted(self.starts, sym, "right") - 1
        cut = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        items = _items(self.kind, sym, pos, lcp)
        for a, b in zip(cut[:-1], cut[1:]):
            if at[a] == self.here:
                self.inbox.append(items[:, a:b])
            else:
                self.queue.push(int(at[a]), items[:, a:b])

    def predecessors(self, pos: np.ndarray, lcp: np.ndarray):
        """(symbol, position, value, first of their symbol, index of the inducing item) of what this scan sorts among the
        items' predecessors, by symbol; the value of a first one counts from the first item."""
        before = np.maximum(pos - 1, 0)
        go = np.flatnonzero((pos > 0) & (self.is_s[before] != self.up))
        prev = before[go]
        target = self.t[prev]
        order = np.argsort(target, kind="stable")
        at, target, prev = go[order], target[order].astype(np.int64), prev[order]
        new = np.ones(len(at), bool)
        new[1:] = target[1:] != target[:-1]
        low = np.zeros(len(at), np.int64)
        low[~new] = at[:-1][~new[1:]] + 1
        value = np.minimum(_least_between(lcp, low, at) + 1, self.depth) if len(at) else low
        return target, prev, value, new, at

    def induce(self, pos: np.ndarray, lcp: np.ndarray, last: dict[int, int]) -> None:
        """Pushes the predecessors of a run of a bucket; ``last``: the least value since the last push, by target."""
        target, prev, value, new, at = self.predecessors(pos, lcp)
        first = np.flatnonzero(new)
        names = target[first].tolist()
        if len(first):
            held = np.array([last.get(c, 0) for c in names], np.int64)
            value[first] = np.minimum(value[first], held + 1)
            self.route(target, prev, value)
        low_all = int(lcp.min())
        for k in last:
            last[k] = min(last[k], low_all)
        if len(first):
            tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.depth)
            last.update(zip(names, tail[at[np.append(first[1:], len(at)) - 1] + 1].tolist(), strict=True))

    def bucket(self, c: int, runs, second):
        """A symbol run by run: ``runs()`` gives the next run of the first part, ``second`` yields (pos, lcp) of the other."""
        last: dict[int, int] = {}
        end = None
        while (block := runs()) is not None:
            pos, lc = block[1].astype(np.int64), block[2].astype(np.int64)
            if end is None:
                lc[0] = 0
            end = int(pos[-1])
            self.induce(pos, lc, last)
            yield np.full(len(pos), c), pos, lc, np.ones(len(pos), bool)
        start = True
        for pos, lc in second:
            if start:
                lc[0] = 0 if end is None else common(self.t, np.array([end]), pos[:1], self.depth)[0]
            start = False
            self.induce(pos, lc, last)
            yield np.full(len(pos), c), pos, lc, np.zeros(len(pos), bool)

    def run(self, second):
        """``second(range)`` yields blocks (sym, pos, lcp) in scan order; values count within a symbol only."""
        ids = range(len(self.starts))
        for r in ids if self.up else reversed(ids):
            if self.single[r]:
                yield from self.bucket(int(self.starts[r]), lambda r=r: self.queue.pop(r), ((pos, lc) for _, pos, lc in second(r)))
            else:
                yield from self._many(r, second)

    def _many(self, r: int, second):
        sign, none = self.sign, np.iinfo(np.int64).max
        self.here, self.inbox = r, []
        above = int(self.starts[r + 1]) if r + 1 < len(self.starts) else none
        end = above if self.up else 1 - int(self.starts[r])
        block = self.queue.pop(r, whole=True)
        a = _items(self.kind, [], [], []) if block is None else block[:, np.argsort(sign * block[0].astype(np.int64), kind="stable")]
        blocks = [_items(self.kind, *x) for x in second(r)]
        b = np.concatenate(blocks, 1) if blocks else _items(self.kind, [], [], [])
        ka, kb = sign * a[0].astype(np.int64), sign * b[0].astype(np.int64)
        while len(ka) or len(kb):
            head = int(min(ka[0] if len(ka) else none, kb[0] if len(kb) else none))
            stop = max(head + 1, min(ka[_BATCH] if len(ka) > _BATCH else none, kb[_BATCH] if len(kb) > _BATCH else none, end))
            na, nb = int(np.searchsorted(ka, stop)), int(np.searchsorted(kb, stop))
            own = _items(self.kind, [], [], [])  # what the batch induces into itself
            self.seams = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for turn in range(_TURNS):
                items, pos, lc, part = self._batch(a[:, :na], own, b[:, :nb])
                target, prev, value, _, _ = self.predecessors(pos, lc)
                inside = sign * target < stop
                if not turn:
                    least = int((sign * target[inside]).min(initial=none))
                was, own = own, _items(self.kind, target[inside], prev[inside], value[inside])
                if sign < 0:
                    own = own[:, np.argsort(-own[0].astype(np.int64), kind="stable")]
                if np.array_equal(was, own):
                    break
            else:
                if least == head:  # the first symbol induces into itself
                    na, nb = int(np.searchsorted(ka, head, "right")), int(np.searchsorted(kb, head, "right"))
                    yield from self._alone(sign * head, a[:, :na], b[:, :nb])
                    a, ka, b, kb = self._with_inbox(a[:, na:], ka[na:], b[:, nb:], kb[nb:])
                    continue
                na, nb = int(np.searchsorted(ka, least)), int(np.searchsorted(kb, least))
                items, pos, lc, part = self._batch(a[:, :na], own[:, :0], b[:, :nb])
                target, prev, value, _, _ = self.predecessors(pos, lc)
                inside = np.zeros(len(target), bool)
            self.route(target[~inside], prev[~inside], value[~inside])
            yield items[0], pos, lc, part
            a, ka, b, kb = self._with_inbox(a[:, na:], ka[na:], b[:, nb:], kb[nb:])
        self.here = -1

    def _batch(self, *parts: np.ndarray):
        """(items in scan order, positions, values, mask of the first part) of whole symbols: first parts, own items, second parts."""
        items = np.concatenate(parts, 1)
        key = self.sign * items[0].astype(np.int64)
        order = np.argsort(key, kind="stable")
        items, key, part = items[:, order], key[order], order < parts[0].shape[1] + parts[1].shape[1]
        pos, lc = items[1].astype(np.int64), items[2].astype(np.int64)
        same = key[1:] == key[:-1]
        lc[:1] = 0
        lc[1:][~same] = 0
        seam = np.flatnonzero(same & part[:-1] & ~part[1:]) + 1
        # Pairs that the turn before has compared are looked up.
        pair = pos[seam - 1] * len(self.t) + pos[seam]
        known, value = self.seams
        at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
        new = known[at] != pair if len(known) else np.ones(len(pair), bool)
        lc[seam[~new]] = value[at[~new]] if len(known) else 0
        lc[seam[new]] = common(self.t, pos[seam[new] - 1], pos[seam[new]], self.depth)
        order = np.argsort(pair)
        self.seams = pair[order], lc[seam][order]
        return items, pos, lc, part

    def _alone(self, c: int, a: np.ndarray, b: np.ndarray):
        """A symbol of a range of many that induces into itself, run by run."""
        waves = deque([a] if a.shape[1] else [])

        def runs():
            rest = []
            for x in self.inbox:
                own = x[0] == c
                if own.any():
                    waves.append(x[:, own])
                if not own.all():
                    rest.append(x[:, ~own])
            self.inbox = rest
            return waves.popleft() if waves else None

        yield from self.bucket(c, runs, [(b[1].astype(np.int64), b[2].astype(np.int64))] if b.shape[1] else [])

    def _with_inbox(self, a, ka, b, kb):
        """The items left of a range, with those that were induced into it behind their symbol's."""
        if self.inbox:
            more = np.concatenate(self.inbox, 1)
            self.inbox = []
            km = self.sign * more[0].astype(np.int64)
            order = np.argsort(km, kind="stable")
            at = np.searchsorted(ka, km[order], "right")
            a, ka = np.insert(a, at, more[:, order], axis=1), np.insert(ka, at, km[order])
        return a, ka, b, kb


def suffix_order(t: np.ndarray, depth: int, space: Space, in_memory: int = 1 << 18):
    """Yields (positions, common prefixes with the suffix yielded before) of all suffixes of ``t``, largest first.

    ``t`` ends with its only smallest symbol.
    """
    n = len(t)
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int64)
        return
    space.levels += 1
    is_s = _types(t, space)
    sorted_lms, lcp = _sorted_lms(t, is_s, depth, space, in_memory)
    m, ranges = len(sorted_lms), _ranges(t, space)
    starts = ranges[0]
    heads = space.array(m, np.int32)
    for a, b in space.blocks(m):
        heads[a:b] = t[sorted_lms[a:b]]

    def seeds(r: int):
        a = int(np.searchsorted(heads, np.int32(starts[r])))
        b = int(np.searchsorted(heads, np.int32(starts[r + 1]))) if r + 1 < len(starts) else m
        for x in range(a, b, space.limit):
            y = min(b, x + space.limit)
            yield np.array(heads[x:y]), sorted_lms[x:y].astype(np.int64), lcp[x:y].astype(np.int64)

    # Ascending scan: L suffixes from sorted leftmost-S suffixes.
    kept = BucketQueue(space)
    for sym, pos, lc, part in _Scan(t, is_s, space, ranges, depth, True).run(seeds):
        if part.any():
            at = int(np.searchsorted(starts, sym[0], "right")) - 1
            kept.push(at, _items(_whole(n), sym[part], pos[part], lc[part]))
    space.free(heads, sorted_lms, lcp)

    def reversed_l(r: int):
        blocks: list = []
        while (block := kept.pop(r)) is not None:
            blocks.append(space.save(block) if block.shape[1] > space.limit // 4 else block)
        carried = 0  # the value between a block and the one after it in ascending order; counts within a symbol only
        for block in reversed(blocks):
            if isinstance(block, str):
                name, block = block, np.load(block)
                os.remove(name)
            up = block[2, ::-1].astype(np.int64)
            lc = np.empty(len(up), np.int64)
            lc[1:], lc[0], carried = up[:-1], carried, up[-1]
            yield block[0, ::-1], block[1, ::-1].astype(np.int64), lc

    # Descending scan: S suffixes from L suffixes; both are yielded. The sentinel is the largest induced of its bucket.
    scan = _Scan(t, is_s, space, ranges, depth, False)
    scan.route(np.array([int(t[n - 1])]), np.array([n - 1]), np.array([0]))
    for _, pos, lc, _ in scan.run(reversed_l):
        yield pos, lc
    space.free(is_s)


def _names(t, is_s, lms, depth: int, space: Space) -> tuple[np.ndarray, bool]:
    """(names, whether they are all unlike) of the leftmost-S substrings: how many substrings are smaller.

    More than ``limit`` substrings are first parted into files by ranges of their next symbols, down to parts that fit.
    """
    m, n = len(lms), len(t)
    top = max(int(np.asarray(t[a:b]).max()) for a, b in space.blocks(n))
    bits = (top * 2 + 2).bit_length()
    pack = 62 // bits

    def length(items):
        nxt = np.minimum(items + 1, m - 1)
        return np.where(items + 1 < m, lms[nxt], n - 1) - lms[items] + 1

    def keys(items, r):
        size, key = length(items), np.zeros(len(items), np.int64)
        if not (size > r * pack).any():
            return None
        first = np.asarray(lms[items], np.int64)
        for j in range(r * pack, (r + 1) * pack):
            inside = j < size
            at = first[inside] + j
            sym = np.zeros(len(items), np.int64)
            sym[inside] = np.asarray(t[at], np.int64) * 2 + is_s[at] + 1
            key = key << bits | sym
        return key

    name, rounds, groups = space.array(m, _whole(m)), (depth + 2) // pack + 2, 0
    todo: list = [(0, 0, None, m)]  # (round, smaller ones, file of items or None for all, how many)
    while todo:
        r, base, file, size = todo.pop()
        if size <= space.limit:
            items = np.arange(m) if file is None else np.load(file)
            key = keys(items, r) if r < rounds else None
            rank = np.zeros(size, np.int64) if key is None else _group_starts(key)
            if key is not None:
                rank = _refine(rank, lambda some, k, items=items, r=r: keys(items[some], r + 1 + k), rounds - r - 1)
            groups += len(np.unique(rank))
            name[items] = base + rank
        else:
            everything = np.load(file, mmap_mode="r") if file else None
            block = lambda a, b, e=everything: np.arange(a, b) if e is None else np.asarray(e[a:b])
            got = [(block(a, b), keys(block(a, b), r) if r < rounds else None) for a, b in space.blocks(min(size, space.limit))]
            if r >= rounds or (got[0][1] is None and all(keys(block(a, b), r) is None for a, b in space.blocks(size))):
                groups += 1
                for a, b in space.blocks(size):
                    name[block(a, b)] = base
            else:
                sample = got[0][1] if got[0][1] is not None else np.zeros(1, np.int64)
                step = max(1, len(sample) * space.limit // (4 * size))
                splits = np.unique(np.sort(sample)[::step])  # parts (.., s0), [s0], (s0, s1), [s1], ...
                files: dict[int, list[str]] = defaultdict(list)
                sizes: dict[int, int] = defaultdict(int)
                for a, b in space.blocks(size):
                    items = block(a, b)
                    key = keys(items, r)
                    key = np.zeros(len(items), np.int64) if key is None else key
                    part = np.searchsorted(splits, key, "left") + np.searchsorted(splits, key, "right")
                    order = np.argsort(part, kind="stable")
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(part)]]).tolist()
                    for x, y in zip(cut[:-1], cut[1:]):
                        p = int(part[order[x]])
                        files[p].append(space.save(items[order[x:y]]))
                        sizes[p] += y - x
                new, smaller = [], base
                for p in sorted(files):
                    joined = space._name()
                    out = np.lib.format.open_memmap(joined, "w+", np.int64, (sizes[p],))
                    at = 0
                    for f in files[p]:
                        piece = np.load(f)
                        out[at : at + len(piece)] = piece
                        at += len(piece)
                        os.remove(f)
                    del out
                    new.append((r + p % 2, smaller, joined, sizes[p]))  # odd parts hold one key: on to the next symbols
                    smaller += sizes[p]
                todo += new
        if file:
            os.remove(file)
    return name, groups == m


def _sorted_lms(t, is_s, depth: int, space: Space, in_memory: int) -> tuple[np.ndarray, np.ndarray]:
    """(leftmost-S positions in the order of their suffixes, common prefix of each with the one before it)."""
    n = len(t)
    spots = lambda a, b: np.flatnonzero(is_s[a:b] & ~np.concatenate([[True] if a == 0 else is_s[a - 1 : a], is_s[a : b - 1]])) + a
    m = sum(len(spots(a, b)) for a, b in space.blocks(n))
    lms, at = space.array(m, _whole(n)), 0
    for a, b in space.blocks(n):
        here = spots(a, b)
        lms[at : at + len(here)] = here
        at += len(here)
    name, unlike = _names(t, is_s, lms, depth, space)
    order, same = space.array(m, _whole(m)), space.array(m + 1, np.int32)
    fewer = depth // 2 + 2  # a name moves on by two symbols at least, so more names than these cover ``depth`` symbols
    if unlike:
        for a, b in space.blocks(m):
            order[name[a:b]] = np.arange(a, b)
            same[a:b] = 0
    elif m <= in_memory:
        order[:], same[:m] = doubling(np.asarray(name, np.int64), fewer)
    else:
        at = m
        for pos, lc in suffix_order(name, fewer, space, in_memory):
            order[at - len(pos) : at] = pos[::-1]
            same[at - len(pos) + 1 : at + 1] = lc[::-1]
            at -= len(pos)
        same[0] = 0
    space.free(name)
    # Equal names cover text; then the first unlike substrings are compared. A name may be shared by substrings that only
    # agree to ``depth``; then the values are at ``depth`` anyway.
    places, lcp = space.array(m, _whole(n)), space.array(m, np.int32)
    for a, b in space.blocks(m):
        places[a:b] = lms[order[a:b]]
        two = np.asarray(order[max(a - 1, 0) : b], np.int64)
        x, y, agree = two[:-1], two[1:], np.asarray(same[b - len(two) + 1 : b], np.int64)
        covered = lms[np.minimum(y + agree, m - 1)] - lms[y]
        lcp[b - len(y) : b] = common(t, lms[x], lms[y], depth, covered)
    lcp[0] = 0
    space.free(order, same, lms)
    return places, lcp


def repeated_starts(t: np.ndarray, depth: int, space: Space, in_memory: int = 1 << 18) -> np.ndarray:
    """True where the next ``depth`` symbols of ``t`` also start elsewhere in ``t``, which ends with its only smallest symbol."""
    found, last = space.array(len(t), bool), -1
    found[:] = False
    for pos, lcp in suffix_order(t, depth, space, in_memory):
        same = np.flatnonzero(lcp >= depth)
        found[pos[same]] = True
        found[pos[same[same > 0] - 1]] = True
        if len(same) and same[0] == 0 and last >= 0:
            found[last] = True
        last = int(pos[-1])
    return found
