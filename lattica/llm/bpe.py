"""Byte-level BPE with vectorised pre-tokenisation.

Boundaries are found without a regular expression. Every code point gets a class (from the Unicode category, and from the
next code point where the split pattern looks ahead). A class acts on the states of a small automaton as a function
state -> state; functions compose associatively, and the functions that can arise form a finite monoid, listed once with
its multiplication table. Texts of a batch are laid end to end, cut into equal blocks, composed within all blocks at
once, scanned over blocks, and replayed from the then known block states. The first code point of a text acts as a
constant function, so texts do not touch.

The slices between boundaries are looked up as dictionary-encoded byte strings; only new slices are merged, many at a
time, and kept in a bounded cache. Byte offsets of the tokens are kept, so that decoding is a gather of token bytes.

Defined results: null and empty texts have no tokens; repeated rows are encoded alike; extra columns are ignored.
Parameters: path of the rank file (never copied into the repository), batch bytes, cache entries.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import heapq
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import by_bytes, byte_view

# Symbols: what a code point is, with what follows it where that matters.
LET, STMD, PAIR, NUM, JOIN, LAST, MID, APO, OTH = range(9)
# States after a code point. FRESH: the next one starts a slice whatever it is.
FRESH, WORD, DIGITS, OTHER, QUOTE, HALF, SPACE, GAP = range(8)
#: The white space of the pattern's \s.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, sym: int) -> tuple[int, int]:
    """(next state, 1 if a slice starts at this code point)."""
    if sym in (LET, STMD, PAIR):
        if state in (WORD, SPACE):
            return WORD, 0
        if state == QUOTE and sym != LET:
            return (FRESH, 0) if sym == STMD else (HALF, 0)
        return (FRESH, 0) if state == HALF else (WORD, 1)
    if sym == NUM:
        return DIGITS, int(state not in (DIGITS, SPACE))
    if sym == APO:
        return (OTHER, 0) if state in (OTHER, SPACE, QUOTE) else (QUOTE, 1)
    if sym == OTH:
        return OTHER, int(state not in (OTHER, SPACE, QUOTE))
    if sym == MID:
        return GAP, int(state != GAP)
    return (SPACE if sym == JOIN else FRESH), 1


@lru_cache(1)
def automaton():
    """(next state by state and symbol, start flags, monoid element of each symbol, multiplication table, state images)."""
    nxt = np.zeros((8, 18), np.uint8)
    start = np.zeros((8, 18), bool)
    for s in range(8):
        for c in range(18):  # 9 + symbol: first of its text, acts from FRESH and always starts a slice
            nxt[s, c], start[s, c] = _step(s if c < 9 else FRESH, c % 9)
    start[:, 9:] = True
    elements: dict[tuple, int] = {tuple(range(8)): 0}
    queue = [tuple(range(8))]
    generators = [tuple(int(x) for x in nxt[:, c]) for c in range(18)]
    for f in queue:
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in elements:
                elements[h] = len(elements)
                queue.append(h)
    images = np.array(queue, np.uint8)
    table = np.array([[elements[tuple(int(x) for x in images[b][images[a]])] for b in range(len(queue))] for a in range(len(queue))], np.uint16)
    return nxt, start, np.array([elements[g] for g in generators], np.uint16), table, images


@lru_cache(1)
def _kinds() -> np.ndarray:
    """LET, NUM, MID (white space) or OTH for every code point."""
    kinds = np.full(sys.maxunicode + 1, OTH, np.uint8)
    by = {"L": LET, "N": NUM}
    for c in range(sys.maxunicode + 1):
        k = by.get(unicodedata.category(chr(c))[0])
        if k is not None:
            kinds[c] = k
    kinds[WHITE] = MID
    kinds[0x27] = APO
    return kinds


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``first`` holds the places where texts begin."""
    sym = _kinds()[points]
    n = len(points)
    follows = np.zeros(n, np.uint32)
    follows[:-1] = points[1:]
    white_next = np.ones(n, bool)  # the end of a text looks like white space to \s+(?!\S)
    white_next[:-1] = sym[1:] == MID
    last = first[first > 0] - 1
    follows[last], white_next[last] = 0, True
    edge = (sym == MID) & ~white_next
    sym[edge] = np.where(points[edge] == 32, JOIN, LAST)
    for ch in "stmd":
        sym[points == ord(ch)] = STMD
    sym[((points == ord("r")) | (points == ord("v"))) & (follows == ord("e"))] = PAIR
    sym[(points == ord("l")) & (follows == ord("l"))] = PAIR
    sym[first] += 9
    return sym


def starts_of(sym: np.ndarray, block: int = 256) -> np.ndarray:
    """Places where slices start, by a blocked scan of transition functions."""
    nxt, start, element, table, images = automaton()
    n = len(sym)
    rows = -(-n // block)
    padded = np.zeros(rows * block, np.uint8)
    padded[:n] = sym
    cols = np.ascontiguousarray(padded.reshape(rows, block).T)
    total = element[cols[0]]
    for j in range(1, block):
        total = table[total, element[cols[j]]]
    if rows > 4 * block:  # scan of the blocks' functions by the same scheme, else one after another
        before = _exclusive(total, table, block)
    else:
        before = np.zeros(rows, np.uint16)
        for r in range(1, rows):
            before[r] = table[before[r - 1], total[r - 1]]
    state = images[before, FRESH]
    flags = np.empty((block, rows), bool)
    for j in range(block):
        flags[j] = start[state, cols[j]]
        state = nxt[state, cols[j]]
    return np.flatnonzero(flags.T.ravel()[:n])


def _exclusive(values: np.ndarray, table: np.ndarray, block: int) -> np.ndarray:
    n = len(values)
    rows = -(-n // block)
    padded = np.zeros(rows * block, np.uint16)
    padded[:n] = values
    cols = np.ascontiguousarray(padded.reshape(rows, block).T)
    total = cols[0]
    for j in range(1, block):
        total = table[total, cols[j]]
    carry = np.zeros(rows, np.uint16)
    for r in range(1, rows):
        carry[r] = table[carry[r - 1], total[r - 1]]
    out = np.empty((block, rows), np.uint16)
    for j in range(block):
        out[j] = carry
        carry = table[carry, cols[j]]
    return out.T.ravel()[:n]


def slices(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets of the slices with the end, number of slices before each text and in all) of texts laid end to end."""
    if len(raw) == 0:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((raw & 0xC0) != 0x80)  # byte place of each code point
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    first = np.searchsorted(at, filled)
    cuts = at[starts_of(symbols(points, first))]
    bounds = np.append(cuts, len(raw))
    return bounds, np.searchsorted(bounds, offsets)


class Merger:
    """Merges byte slices by rank; many at once for short ones, by a heap for long ones. Bounded cache of results."""

    LONG = 48

    def __init__(self, path: str, cache: int = 150_000):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.limit, self.cache = cache, {}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        pairs = {}
        for token, rank in ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.vals = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.vocab = pa.array(self.tokens, pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in range(len(self.tokens))], pa.large_binary())
        self.widths = np.array([len(t) for t in self.tokens], np.int64)

    NONE = np.int32(2**31 - 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (a >= 0) & (b >= 0), self.vals[i], self.NONE)

    def _many(self, pieces: list[bytes], width: int) -> list[bytes]:
        m = len(pieces)
        lens = np.array([len(p) for p in pieces])
        x = np.full((m, width), -1, np.int32)
        cell = np.arange(width) < lens[:, None]
        x[cell] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        right = np.where(np.arange(width) + 1 < lens[:, None], np.arange(width) + 1, -1).astype(np.int32)
        left = np.broadcast_to(np.arange(width, dtype=np.int32) - 1, (m, width)).copy()
        rank = np.full((m, width), self.NONE, np.int32)
        if width > 1:
            rank[:, :-1] = self._rank(x[:, :-1], x[:, 1:])
        live = np.arange(m)
        while len(live):
            j = rank[live].argmin(1)
            best = rank[live, j]
            go = best != self.NONE
            live, j, best = live[go], j[go], best[go]
            if not len(live):
                break
            gone = right[live, j]
            after = right[live, gone]
            x[live, j], x[live, gone] = best, -1
            rank[live, gone] = self.NONE
            right[live, j] = after
            has = after >= 0
            left[live[has], after[has]] = j[has]
            rank[live, j] = np.where(has, self._rank(best, x[live, np.where(has, after, 0)]), self.NONE)
            prev = left[live, j]
            has = prev >= 0
            p, q = live[has], prev[has]
            rank[p, q] = self._rank(x[p, q], best[has])
        flat = x[x >= 0].astype("<i4")
        ends = np.cumsum((x >= 0).sum(1))
        data, a = flat.tobytes(), 0
        out = []
        for b in (ends * 4).tolist():
            out.append(data[a:b])
            a = b
        return out

    def _one(self, piece: bytes) -> bytes:
        ids = [int(self.bytes[b]) for b in piece]
        n = len(ids)
        right, left = list(range(1, n)) + [-1], list(range(-1, n - 1))
        first = self._rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != self.NONE]

        def get(key: int) -> int | None:
            at = bisect.bisect_left(self.keys, key)
            return int(self.vals[at]) if at < len(self.keys) and self.keys[at] == key else None

        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = r, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            for p in (left[i], i):
                if p >= 0 and (q := right[p]) >= 0 and (s := get(ids[p] << 32 | ids[q])) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], "<i4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each slice, as little-endian 32-bit integers."""
        if len(self.cache) > self.limit:
            self.cache.clear()
        out = list(map(self.cache.get, pieces))
        new = [i for i, x in enumerate(out) if x is None]
        new.sort(key=lambda i: len(pieces[i]))
        at = 0
        for width in (4, 8, 12, 16, 24, 32, self.LONG):
            end = at
            while end < len(new) and len(pieces[new[end]]) <= width:
                end += 1
            for a in range(at, end, 8192):
                some = new[a : min(end, a + 8192)]
                for i, ids in zip(some, self._many([pieces[i] for i in some], width)):
                    out[i] = self.cache[pieces[i]] = ids
            at = end
        for i in new[at:]:
            out[i] = self._one(pieces[i])
        return out

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before each text and in all)."""
        bounds, per_text = slices(raw, offsets)
        n = len(bounds) - 1
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        merged = self.merge(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(merged), "<i4")
        size = np.array([len(x) >> 2 for x in merged], np.int64)
        where = np.cumsum(size) - size
        index = coded.indices.to_numpy()
        counts = size[index]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(where[index] - (ends - counts), counts) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[per_text]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all ids, byte offset of each id with the end)."""
        data = self.vocab.take(pa.array(ids)).buffers()[2]
        return (data.to_pybytes() if data is not None else b""), np.concatenate([[0], np.cumsum(self.widths[ids])])


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """One per worker process and rank file."""
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>, ends array<int> (byte offset after each id)."""

    def run(batches):
        m = merger(path)
        for batch in by_bytes(batches, text, 2 << 20):
            ids, cut = m.encode(*byte_view(batch.column(1)))
            ends = np.cumsum(m.widths[ids])
            base = np.concatenate([[0], ends])[cut[:-1]]
            rel = ends - np.repeat(base, np.diff(cut))
            off = pa.array(cut.astype(np.int32))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(off, pa.array(ids)), pa.ListArray.from_arrays(off, pa.array(rel.astype(np.int32)))], names=[key, "ids", "ends"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, ends array<int>")


def decode_documents(coded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, text from key and ids. Bytes that are not UTF-8 (ids that no text gives) become U+FFFD."""

    def run(batches):
        m = merger(path)
        for batch in batches:
            column = batch.column(1)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.cumsum(np.nan_to_num(np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], float)))]).astype(np.int64)
            data, at = m.decode(ids)
            texts = [data[at[a] : at[b]].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = dict(coded.dtypes)[key]
    return coded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of decimal ids, comma-joined), decoded_sha256 (of the bytes decoded from the ids)."""

    def run(batches):
        m = merger(path)
        for batch in by_bytes(batches, text, 2 << 20):
            ids, cut = m.encode(*byte_view(batch.column(1)))
            data, at = m.decode(ids)
            dec = m.decimals.take(pa.array(ids))
            digits = memoryview(dec.buffers()[2] or b"")
            dat = np.frombuffer(dec.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
            whole = memoryview(data)
            sha = hashlib.sha256
            a, b = cut[:-1], cut[1:]
            joined = [sha(digits[x : max(x, y - 1)]).hexdigest() for x, y in zip(dat[a].tolist(), dat[b].tolist())]
            decoded = [sha(whole[x:y]).hexdigest() for x, y in zip(at[a].tolist(), at[b].tolist())]
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(cut)), pa.array(joined, pa.string()), pa.array(decoded, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
