"""Suffix-array dedup of long byte strings across a corpus: every byte covered by a ``depth``-byte string that also starts
elsewhere is removed; matches never cross documents.

A suffix array of the whole corpus does not fit a task, so the work is cut without losing a match. Each ``depth``-byte
window is named by the least hash among its ``GRAM``-byte substrings; equal windows have equal names, wherever they
stand. Maximal runs of windows of one name are segments. Names that occur once hold no match. The segments of a name that
occurs more often go to one shard; equal segments are sent once, with their count. A shard is a string of its segments that
is sorted by external induced sorting with common-prefix values (``induced``): neighbours that agree on ``depth`` symbols
are matches. Shards of ``SHARD_BYTES`` are many times what is held in memory (``MEMORY`` tuples and places): the string and
all arrays of a level are files of the task, and the queues spill. Names are sorted by recursion down to ``NAMES`` of them,
and those by prefix doubling in memory: shards of up to about 3 MB have fewer, larger ones (a name's segments stay
together) recurse, which costs time and scratch disk, not memory. A smaller ``NAMES`` makes every shard recurse.

Documents with equal texts (by SHA-256) are settled by their text alone: such a text of ``depth`` bytes or more goes as a
whole, and one copy stands for all in the search. Equal segments are told by name (64 bits), length and two polynomial
hashes modulo 2^31 - 1, not by comparing bytes. Names that hold more than ``hot`` unlike segments (the surroundings of a
passage that very many documents share) would make one task of a large part of the rows: their windows are spread by a
128-bit hash of the window itself and counted with partial sums; that finds the same windows and needs no group.

Defined results: null and empty texts have no bytes and keep the SHA-256 of nothing; texts shorter than ``depth`` are
kept; repeated rows are copies of each other; rows of one id with unlike texts are told apart; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, byte_view, drop, release, written
from .induced import Space, repeated_starts

GRAM = 50
BROADCAST_ROWS = 200_000
SHARD_BYTES = 2 << 20
MEMORY, NAMES = 1 << 17, 1 << 20
#: Bytes that a task searches at a time.
PIECE = 1 << 19
#: Bytes that a task cuts at a time.
PART = 1 << 21
_P1, _P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_PRIME, _BASES = (1 << 31) - 1, (1_093_720_531, 1_870_365_269)
_MORE = 1 << 10  # what a piece can exceed PIECE by before its powers are computed anew
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64. A worker keeps the powers for one piece: it lives on beside the JVM of its executor."""
    have = _powers.get((base, 0))
    if have is None or len(have) <= n:
        steps = np.full(max(n, PIECE + _MORE) + 1, base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base, 0] = np.cumprod(steps)
    return have[: n + 1]


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _prefix(raw: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(base, len(raw))[: len(raw)], out=out[1:])
    return out


def _hashes(prefix: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges: their polynomial shifted back to exponent 0, mixed."""
    inverse = _power(pow(base, -1, 1 << 64), len(prefix))
    with np.errstate(over="ignore"):
        return _mix((prefix[end] - prefix[start]) * inverse[start])


def _segment_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62 bits of each byte range: two polynomials modulo 2^31 - 1, shifted back to exponent 0. Powers of two as moduli, as
    of the window hashes, would make texts of a known pattern collide."""
    out = np.zeros(len(start), np.int64)
    x = raw.astype(np.uint64) + np.uint64(1)
    for base in _BASES:
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(x * _prime_powers(base, len(raw))[: len(raw)] % np.uint64(_PRIME), out=sums[1:])
        part = (sums[end] - sums[start]) % np.uint64(_PRIME)
        back = _prime_powers(pow(base, -1, _PRIME), len(raw))[start]
        out = out << 31 | (part * back % np.uint64(_PRIME)).astype(np.int64)
    return out


def _prime_powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^31 - 1, by doubling, as 32-bit integers."""
    have = _powers.get((base, _PRIME))
    if have is None or len(have) <= n:
        have, step, size = np.ones(1, np.uint32), base, max(n, PIECE + _MORE) + 1
        while len(have) < size:
            have = np.concatenate([have, (have[: size - len(have)] * np.uint64(step) % np.uint64(_PRIME)).astype(np.uint32)])
            step = step * step % _PRIME
        _powers[base, _PRIME] = have
    return have


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best(x[i : i + w]) for every i, by block-wise running minima or maxima from both sides."""
    n = len(x)
    fill = np.uint64(0) if best is np.maximum else np.uint64(2**64 - 1)
    padded = np.full(-(-n // w) * w + w, fill, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    right = best.accumulate(rows, axis=1).ravel()
    left = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(left[: n - w + 1], right[w - 1 : n])


def segments(raw: np.ndarray, off: np.ndarray, depth: int, gram: int):
    """(document, start in it, length, name, content hash, places of the naming substring) of all segments."""
    none = np.zeros(0, np.int64)
    if len(raw) < depth:
        return none, none, none, none, none, none
    w, n = depth - gram + 1, len(raw) - depth + 1
    prefix = _prefix(raw, _P1)
    with np.errstate(over="ignore"):
        grams = prefix[gram:] - prefix[:-gram]
        grams *= _power(pow(_P1, -1, 1 << 64), len(grams))[: len(grams)]
        grams = _mix(grams)
    del prefix
    least = _sliding(grams, w, np.minimum)  # name of the window that starts here
    # Windows that would cross into the next text are none; at least depth - 1 of them part the texts of a batch.
    cross = np.zeros(len(raw) + 1, np.int8)
    np.add.at(cross, np.maximum(off[1:] - depth + 1, off[:-1]), 1)
    np.add.at(cross, off[1:], -1)
    ok = np.cumsum(cross, dtype=np.int8)[:n] == 0
    edge = least[1:] != least[:-1]
    new, stop = ok.copy(), ok.copy()
    new[1:] &= ~ok[:-1] | edge
    stop[:-1] &= ~ok[1:] | edge
    first, end = np.flatnonzero(new), np.flatnonzero(stop) + depth
    if not len(first):
        return none, none, none, none, none, none
    name = least[first]
    # How often the naming substring stands in its segment: a segment can repeat windows of its own.
    masked = np.zeros(n + 2 * w - 2, np.uint64)
    np.copyto(masked[w - 1 : w - 1 + n], least, where=ok)
    marks = np.flatnonzero(grams == _sliding(masked, w, np.maximum))
    del masked
    seg_of = np.cumsum(new) - 1
    lo = seg_of[np.clip(marks - w + 1, 0, n - 1)].clip(0)
    hi = seg_of[np.clip(marks, 0, n - 1)]
    places = np.zeros(len(first), np.int64)
    for step in range(int((hi - lo).max(initial=0)) + 1):
        s = lo + step
        use = s <= hi
        s, m = s[use], marks[use]
        hit = (name[s] == grams[m]) & (first[s] <= m) & (m + gram <= end[s])
        places += np.bincount(s[hit], minlength=len(first))
    doc = np.searchsorted(off, first, "right") - 1
    return doc, first - off[doc], end - first, name.view(np.int64), _segment_hashes(raw, first, end), places


def _text_key(text: str) -> list[Column]:
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(body).alias("th"), F.crc32(body.cast("binary")).alias("tc")]


def occurrences(docs: DataFrame, depth: int, gram: int) -> DataFrame:
    """th, tc, many, start, len, name, seg, places of every segment of (th, tc, many, body)."""

    def run(batches):
        for batch in by_bytes(batches, "body", PIECE):
            raw, off = byte_view(batch.column(3))
            # A text longer than a piece is searched in pieces that share depth - 1 bytes, so that no window is lost.
            for at in range(0, max(1, len(raw)), PIECE) if batch.num_rows == 1 else (0,):
                part = raw[at : at + PIECE + depth - 1] if batch.num_rows == 1 else raw
                d, start, length, name, seg, places = segments(part, np.array([0, len(part)]) if batch.num_rows == 1 else off, depth, gram)
                take = pa.array(d)
                yield pa.record_batch([*[batch.column(i).take(take) for i in range(3)], pa.array(start + at), pa.array(length), pa.array(name), pa.array(seg), pa.array(places)], names=["th", "tc", "many", "start", "len", "name", "seg", "places"])

    return docs.select("th", "tc", "many", "body").mapInArrow(run, "th long, tc long, many boolean, start long, len long, name long, seg long, places long")


def shard_repeats(rows: DataFrame, shards: int, depth: int) -> DataFrame:
    """name, seg, len, spans (the byte ranges of each segment that its shard's suffix order finds twice or more), spilled,
    levels (items that the shard's sort had on disk, and its levels of recursion).

    rows: name, seg, len, body. A shard is the segments of a range of hashed names.
    """
    memory, names = MEMORY, NAMES

    def run(batches):
        with Space(memory) as space:
            place, keys, sizes = space.path(), [], []
            with open(place, "wb") as text:
                for batch in batches:
                    raw, off = byte_view(batch.column(3))
                    size = np.diff(off)
                    part = np.ones(len(raw) + len(size), np.uint16)  # 1 parts segments; 0 ends the text
                    part[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw.astype(np.uint16) + 2
                    part.tofile(text)
                    keys.append([batch.column(i).to_numpy() for i in range(3)])
                    sizes.append(size)
                np.zeros(1, np.uint16).tofile(text)
            if not keys:
                return
            del batch, raw, part
            found = repeated_starts(np.asarray(np.memmap(place, np.uint16, "r")), depth, space, names)
            at = 0
            for key, size in zip(keys, sizes):
                out: tuple[list, ...] = ([], [], [], [])
                for name, seg, length, n in zip(*(c.tolist() for c in key), size.tolist()):
                    hit = np.flatnonzero(found[at : at + n - depth + 1])
                    at += n + 1
                    if len(hit):
                        edge = np.flatnonzero(np.diff(hit) > 1)
                        spans = [{"s": int(x), "e": int(y) + depth} for x, y in zip(hit[np.concatenate([[0], edge + 1])], hit[np.append(edge, len(hit) - 1)])]
                        for column, v in zip(out, (name, seg, length, spans)):
                            column.append(v)
                kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
                more = [pa.array(np.full(len(out[0]), v)) for v in (space.spilled, space.levels)]
                yield pa.record_batch([*[pa.array(x, k) for x, k in zip(out, kinds)], *more], names=["name", "seg", "len", "spans", "spilled", "levels"])
        del found, keys, sizes
        release()

    placed = rows.repartition(shards, F.xxhash64("name")).sortWithinPartitions("name", "seg")
    return placed.select("name", "seg", "len", "body").mapInArrow(run, "name long, seg long, len long, spans array<struct<s:long,e:long>>, spilled long, levels long")


def window_repeats(rows: DataFrame, depth: int) -> DataFrame:
    """As ``shard_repeats``, for names with very many segments: windows are counted by a 128-bit hash."""

    def run(batches):
        for batch in by_bytes(batches, "body", PIECE):
            raw, off = byte_view(batch.column(3))
            n = np.maximum(np.diff(off) - depth + 1, 0)
            owner = np.repeat(np.arange(len(n)), n)
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = off[:-1][owner] + at
            h = [_hashes(_prefix(raw, p), p, start, start + depth).view(np.int64) for p in (_P1, _P2)]
            take = pa.array(owner)
            yield pa.record_batch([*[batch.column(i).take(take) for i in range(3)], pa.array(at), *map(pa.array, h)], names=["name", "seg", "len", "at", "h1", "h2"])

    each = written(rows.sparkSession, rows.select("name", "seg", "len", "body").mapInArrow(run, "name long, seg long, len long, at long, h1 long, h2 long"), "hot")
    twice = each.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    hit = each.join(twice, ["h1", "h2"])
    spans = F.sort_array(F.collect_list(F.struct(F.col("at").alias("s"), (F.col("at") + depth).alias("e"))))
    return hit.groupBy("name", "seg", "len").agg(spans.alias("spans")).withColumns({"spilled": F.lit(0).cast("long"), "levels": F.lit(0).cast("long")})


def _small(df: DataFrame, lists: str | None = None) -> DataFrame:
    """Broadcast if its rows, or the items of its column of lists, are few enough; else left to a shuffle join."""
    if lists is None:
        few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    else:
        few = (df.agg(F.sum(F.size(lists))).first()[0] or 0) <= BROADCAST_ROWS
    return F.broadcast(df) if few else df


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 200, gram: int = GRAM, hot: int = 5000, with_text: bool = False, report: dict[str, int] | None = None) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes): a row per row of ``docs``.

    ``report`` gets the most items that a shard's sort had on disk, and its most levels of recursion."""
    spark = docs.sparkSession
    base = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("body"), *_text_key(text))
    base = base.withColumn("n", F.octet_length("body").cast("long"))
    copies = base.where(f"n >= {depth}").groupBy("th", "tc", "n", F.sha2(F.col("body").cast("binary"), 256)).agg(F.count(F.lit(1)).alias("c"), F.min(key).alias("rep")).where("c > 1").select(F.col("th").alias("ch"), F.col("tc").alias("cc"), "rep")
    copies = _small(written(spark, copies, "copies"))
    marked = base.join(copies, (F.col("th") == F.col("ch")) & (F.col("tc") == F.col("cc")), "left").withColumn("many", F.col("ch").isNotNull())
    searched = marked.where((F.col("n") >= depth) & (~F.col("many") | F.col(key).eqNullSafe(F.col("rep")))).select("th", "tc", "many", "body")

    found = written(spark, occurrences(searched, depth, gram), "segments")
    weight = F.when(F.col("many"), 2).otherwise(F.col("places"))
    names = found.groupBy("name").agg(F.sum(weight).alias("c"), F.min("seg").alias("a"), F.max("seg").alias("b"), F.max("places").alias("p"), F.min("many").alias("all"))
    # Names that only documents with copies hold decide nothing: those documents go as a whole.
    names = names.where("c > 1 and not all").select("name", (F.col("a").eqNullSafe(F.col("b")) & (F.col("p") < 2)).alias("simple"))
    names = written(spark, names, "names")
    held = written(spark, found.join(names, "name"), "held")
    drop(spark, found)

    distinct = held.where("not simple").groupBy("name", "seg", "len").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("c"), F.min(F.struct("th", "tc", "start")).alias("at"), F.max("places").alias("p"))
    distinct = written(spark, distinct, "distinct")
    open_ = distinct.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("least"), F.max("p").alias("p")).where("least = 1 or p > 1").select("name", "k")
    sent = written(spark, distinct.join(open_, "name").select("name", "seg", "len", "at.th", "at.tc", "at.start", (F.col("k") > hot).alias("hot")), "sent")
    wanted = _small(sent.groupBy(F.col("th").alias("wh"), F.col("tc").alias("wc")).agg(F.collect_list(F.struct("name", "seg", "len", "start", "hot")).alias("want")), "want")
    # One row of each wanted text: several rows may hold it.
    source = searched.join(wanted, (F.col("th") == F.col("wh")) & (F.col("tc") == F.col("wc")))

    def cut(batches):
        for batch in by_bytes(batches, "body", PART):
            raw, off = byte_view(batch.column(0))
            data = memoryview(raw)
            out: tuple[list, ...] = ([], [], [], [], [])
            for a, want in zip(off[:-1].tolist(), batch.column(1).to_pylist()):
                for x in want:
                    for column, v in zip(out, (x["name"], x["seg"], x["len"], x["hot"], data[a + x["start"] : a + x["start"] + x["len"]].tobytes())):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], names=["name", "seg", "len", "hot", "body"])

    bodies = written(spark, source.select("body", "want").mapInArrow(cut, "name long, seg long, len long, hot boolean, body binary"), "bodies")
    size = sent.agg(F.sum("len")).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES), spark.sparkContext.defaultParallelism if size > SHARD_BYTES else 1)
    cool = bodies.where("not hot").dropDuplicates(["name", "seg", "len"])
    spans = shard_repeats(cool, int(shards), depth)
    if sent.where("hot").limit(1).count():
        spans = spans.union(window_repeats(bodies.where("hot").dropDuplicates(["name", "seg", "len"]), depth))
    spans = written(spark, spans, "spans")
    if report is not None:
        most = spans.agg(F.max("spilled"), F.max("levels")).first()
        report |= {"spilled": most[0] or 0, "levels": most[1] or 0}
    spans = spans.drop("spilled", "levels")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("len").alias("e")))
    settled = distinct.where("c > 1").select("name", "seg", "len", whole.alias("spans"))
    mine = held.where("not many")
    ranges = mine.where("not simple").join(settled.union(spans), ["name", "seg", "len"]).select("th", "tc", F.explode("spans").alias("x"), "start")
    ranges = ranges.select("th", "tc", (F.col("start") + F.col("x.s")).alias("s"), (F.col("start") + F.col("x.e")).alias("e"))
    ranges = ranges.union(mine.where("simple").select("th", "tc", F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e")))
    per = ranges.groupBy(F.col("th").alias("rh"), F.col("tc").alias("rc")).agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    per = _small(written(spark, per, "ranges"), "ranges")
    final = marked.select(key, "th", "tc", "many", "body").join(per, (F.col("th") == F.col("rh")) & (F.col("tc") == F.col("rc")), "left").select(key, "body", "many", "ranges")

    def finish(batches):
        for batch in by_bytes(batches, "body", PART):
            raw, off = byte_view(batch.column(1))
            n = np.diff(off)
            ranges = batch.column(3)
            of = np.repeat(off[:-1], pc.fill_null(pc.list_value_length(ranges), 0).to_numpy())
            inner = ranges.flatten()
            many = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            step = np.zeros(len(raw) + 1, np.int32)
            np.add.at(step, np.concatenate([of + inner.field("s").to_numpy(), off[many]]), 1)
            np.add.at(step, np.concatenate([of + inner.field("e").to_numpy(), off[many + 1]]), -1)
            gone = np.cumsum(step[:-1], dtype=np.int32) > 0
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            heads = off[:-1][n > 0]
            starts[heads] = gone[heads]
            removed, runs = (np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[off]) for x in (gone, starts))
            ends = np.cumsum(n - removed)
            kept = memoryview(raw[~gone])
            texts = [kept[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            columns = [pa.array(n), pa.array(removed), pa.array(runs), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
            if with_text:
                columns.append(pa.array([x.tobytes() for x in texts], pa.binary()))
            yield pa.record_batch([batch.column(0), *columns], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5])

    kind = dict(docs.dtypes)[key]
    return final.mapInArrow(finish, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
