"""Near-duplicate documents by MinHash with tensored banding.

Sets are the distinct k-word shingles of a document, as 64-bit hashes. Documents with equal sets form a class, and all
further work is on classes. A class has two small collections of sub-keys: ``first`` of 2 minhashes each and ``second``
of 3 each. Every pair of one from each collection is the key of a table, so 10 + 13 sub-keys (59 minhashes) give 130
tables of 5 minhashes, where separate bands would take 650. At similarity 0.8 the chance that a link has no table in
common is (1 - .8^2)^10 + (1 - .8^3)^13 = 1.3e-4, at 0.9 it is below 1e-6.

Classes that meet in a table are tied to the smallest of them (a star, not all pairs). Ties with fewer than ``shared``
of 23 equal sub-keys are dropped: they are chance (a link at 0.8 has 13 on average and fewer than 5 once in 1e5). The
connected components of the ties are candidate groups. Within a group every pair is decided on full sets. Blocks of
bounded size are compared by an incidence product. Then one member of each confirmed component stands for it in blocks of
their own, round after round while a fifth of the components go, so that a dense group is joined in linear time. Last,
pairs of blocks that still hold more than one component are compared. Only the links of a spanning forest leave a task.
Classes are told apart by 128 bits of a digest; their short ids are 64 bits of it, mended where two classes share them.

Hot tables: sub-keys that many classes share are counted first; a key of two hot sub-keys is salted over 64 partitions
whose centres are tied in a second, small step. The list of hot sub-keys is bounded by 50,000 by its threshold.

Defined results: a document without words, empty or null has an empty set, no links, and is its own component; with
fewer words than k its whole word sequence is the one shingle; repeated rows are copies of each other; a null id is
larger than any id and stays null where it stands alone; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, written
from .components import components

FIRST, FIRST_K, SECOND, SECOND_K = 10, 2, 13, 3
_HASHES = FIRST * FIRST_K + SECOND * SECOND_K
SALTS = 64
MEMBERS, SHINGLES = 400, 400_000  # of a block
BROADCAST_ITEMS = 100_000  #: Rows, or items of their lists, that a broadcast side has at most (about 10 MB).
_rng = np.random.default_rng(20260101)
_MUL = _rng.integers(0, 1 << 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, _HASHES, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets of the texts)."""
    n = len(texts)
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    per = np.concatenate([[0], np.cumsum(full)])[split.offsets.to_numpy() - (split.offsets[0].as_py() if n else 0)]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    base = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    words = base[coded.indices.to_numpy()] if len(base) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(per))
    with np.errstate(over="ignore"):
        starts = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :]) if len(doc) >= k else np.zeros(0, np.int64)
        h = np.full(len(starts), k, np.uint64)
        for j in range(k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[starts + j])
        owner = doc[starts]
        short = np.flatnonzero((np.diff(per) > 0) & (np.diff(per) < k))
        for d in short.tolist():
            seq = np.uint64(1 << 40) + np.uint64(per[d + 1] - per[d])
            whole = np.array([seq], np.uint64)
            for w in words[per[d] : per[d + 1]]:
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + w)
            h, owner = np.append(h, whole), np.append(owner, d)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(n + 1))


def class_ids(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(sets, 2) two halves of a 128-bit digest of the hashes of each set; zeros for empty sets."""
    data = memoryview(h.astype("<u8").tobytes())
    cut = (off * 8).tolist()
    digests = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() if b > a else bytes(16) for a, b in zip(cut[:-1], cut[1:]))
    return np.frombuffer(digests, "<i8").reshape(-1, 2)


def sub_keys(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(sets, FIRST + SECOND) sub-keys; rows of empty sets are of no use."""
    sizes = np.diff(off)
    some = sizes > 0
    low = np.zeros((len(sizes), _HASHES), np.uint64)
    if len(h):
        with np.errstate(over="ignore"):
            for j in range(_HASHES):
                low[some, j] = np.minimum.reduceat(h * _MUL[j] + _ADD[j], off[:-1][some])
    out = np.empty((len(sizes), FIRST + SECOND), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        for s in range(FIRST + SECOND):
            k = FIRST_K if s < FIRST else SECOND_K
            x = np.full(len(sizes), s + 1, np.uint64)
            for j in range(at, at + k):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + low[:, j])
            out[:, s], at = x, at + k
    return out


def signatures(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, th (hash of the text), n_shingles, d1 and d2 (digest of the set, null if empty), subs of every document."""

    def run(batches):
        for batch in by_bytes(batches, text, 3 << 20):
            h, off = shingle_sets(batch.column(2), k)
            ids, none = class_ids(h, off), np.diff(off) == 0
            subs = sub_keys(h, off).view(np.int64)
            cut = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * subs.shape[1])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(off)), *[pa.array(ids[:, j], mask=none) for j in (0, 1)], pa.ListArray.from_arrays(cut, pa.array(subs.ravel()))], names=[key, "th", "n_shingles", "d1", "d2", "subs"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.xxhash64(text).alias("th"), text).mapInArrow(run, f"`{key}` {kind}, th long, n_shingles long, d1 long, d2 long, subs array<long>")


def distinct_sets(signed: DataFrame, key: str) -> DataFrame:
    """cid (a 64-bit id), d1, d2, rep (smallest key), n, subs of every class of equal sets."""
    spark = signed.sparkSession
    classes = signed.where("d1 is not null").groupBy("d1", "d2").agg(F.min(key).alias("rep"), F.first("n_shingles").alias("n"), F.first("subs").alias("subs"))
    classes = written(spark, classes.withColumn("cid", F.col("d1")), "classes")
    twice = lambda: classes.groupBy("cid").count().where("count > 1").select("cid", F.lit(True).alias("twin"))
    if twice().limit(1).count():
        mended = F.when(F.col("twin"), F.xxhash64("d2", "d1")).otherwise(F.col("cid"))
        classes = written(spark, classes.join(written(spark, twice(), "twins"), "cid", "left").withColumn("cid", mended).drop("twin"), "classes")
        if twice().limit(1).count():
            raise RuntimeError("two classes share a 64-bit id after mending")
    return classes


def ties(spark: SparkSession, classes: DataFrame, total: int) -> DataFrame:
    """(a, b): classes that share a table, tied to the table's smallest class."""
    floor = max(20_000, 23 * total // 50_000)
    hot_rows = classes.select(F.explode("subs").alias("s")).groupBy("s").count().where(F.col("count") >= floor).select("s").collect()
    hot = np.sort(np.array([r["s"] for r in hot_rows], np.int64))  # at most 50,000 by the floor

    def emit(batches):
        for batch in batches:
            cid = batch.column(0).to_numpy()
            subs = batch.column(1).flatten().to_numpy().reshape(len(cid), FIRST + SECOND)
            for a in range(0, len(cid), 4096):
                part, x = subs[a : a + 4096], cid[a : a + 4096]
                first, second = part[:, :FIRST, None].view(np.uint64), part[:, None, FIRST:].view(np.uint64)
                with np.errstate(over="ignore"):
                    table = mix(first * np.uint64(0x9E3779B97F4A7C15) + second).view(np.int64)
                salt = np.zeros(table.shape, np.int8)
                if len(hot):
                    warm = np.isin(part, hot)
                    both = warm[:, :FIRST, None] & warm[:, None, FIRST:]
                    salt[both] = (1 + np.broadcast_to((x % SALTS)[:, None, None], table.shape))[both]
                yield pa.record_batch([pa.array(table.ravel()), pa.array(salt.ravel()), pa.array(np.repeat(x, FIRST * SECOND))], names=["t", "salt", "cid"])

    def stars(batches):
        """Rows come sorted by table, salt and class: ties each class to the first of its table; hot tables also keep (class, itself)."""
        last = None
        for batch in batches:
            t, s, c = (batch.column(i).to_numpy() for i in range(3))
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
            if last is not None and last[0] == t[0] and last[1] == s[0]:
                new[0] = False
            where = np.maximum.accumulate(np.where(new, np.arange(len(t)), -1))
            centre = np.where(where >= 0, c[where], last[2] if last is not None else 0)
            last = (t[-1], s[-1], centre[-1])
            keep = (c != centre) | ((s > 0) & new)
            yield pa.record_batch([pa.array(t[keep]), pa.array(s[keep] > 0), pa.array(centre[keep]), pa.array(c[keep])], names=["t", "hot", "a", "b"])

    rows = classes.select("cid", "subs").mapInArrow(emit, "t long, salt byte, cid long")
    found = rows.repartition("t", "salt").sortWithinPartitions("t", "salt", "cid").mapInArrow(stars, "t long, hot boolean, a long, b long")
    if not len(hot):
        return found.select("a", "b").distinct()
    found = written(spark, found.groupBy(F.when(F.col("hot"), F.col("t")).alias("t"), "a", "b").agg(F.lit(1).alias("x")).drop("x"), "stars")
    centres = found.where("t is not null").select("t", "a").distinct()
    least = centres.groupBy("t").agg(F.min("a").alias("m"))
    return found.where("a != b").select("a", "b").union(centres.join(least, "t").where("a != m").select("m", "a")).distinct()


def forest(values: np.ndarray, off: np.ndarray, group: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links (indices) of a spanning forest of all pairs with den * |intersection| >= num * |union|; with ``group`` only pairs of unlike group count."""
    m = len(off) - 1
    size = np.diff(off)
    owner = np.repeat(np.arange(m), size)
    inter = np.zeros((m, m), np.float32)
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    first = np.ones(len(v), bool)
    first[1:] = v[1:] != v[:-1]
    column = np.cumsum(first) - 1
    often = np.bincount(column) > 1 if len(v) else np.zeros(0, bool)
    keep = often[column] if len(v) else np.zeros(0, bool)
    rank = np.cumsum(often) - 1
    column, o = rank[column[keep]], o[keep]
    width, n = 8192, int(often.sum())
    cuts = np.searchsorted(column, np.arange(0, n + width, width))
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        if a < b:
            part = np.zeros((m, min(width, n - k * width)), np.float32)
            part[o[a:b], column[a:b] - k * width] = 1
            inter += part @ part.T
    union = size[:, None] + size[None, :] - inter
    linked = np.triu((den * inter >= num * union) & (inter > 0), 1)
    if group is not None:
        linked &= group[:, None] != group[None, :]
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in np.argwhere(linked).tolist():
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def confirmed(docs: DataFrame, placed: DataFrame, key: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """(a, b) links found within the blocks of ``placed`` (rep, cid, d1, d2, blocks array<struct<g, p>>, comp): sets are made from the texts of the class representatives and sent to their blocks.

    A block is named by the group g and the pair of blocks p; rows of it are compared with each other where comp differs
    (null: with all).
    """
    spark = docs.sparkSession
    few = (placed.agg(F.sum(F.size("blocks"))).first()[0] or 0) <= BROADCAST_ITEMS
    wanted = placed.select(F.col("rep").alias("_rep"), *[F.col(c).alias(f"_{c}") for c in ("cid", "blocks", "comp", "d1", "d2")])
    here = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = here.join(F.broadcast(wanted) if few else wanted, F.col("_key").eqNullSafe(F.col("_rep")))

    def sets(batches):
        for batch in by_bytes(batches, "_text", 3 << 20):
            h, off = shingle_sets(batch.column(0), k)
            ids = class_ids(h, off)
            g, p, c, comp, lists = [], [], [], [], []
            same = (ids[:, 0] == batch.column(4).to_numpy()) & (ids[:, 1] == batch.column(5).to_numpy())  # of a repeated key
            for i, (want, blocks, cc) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if same[i]:
                    for block in blocks:
                        g.append(block["g"]), p.append(block["p"]), c.append(want), comp.append(cc)
                        lists.append(i)
            column = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64))).take(pa.array(lists, pa.int64()))
            yield pa.record_batch([pa.array(g, pa.int64()), pa.array(p, pa.int64()), pa.array(c, pa.int64()), pa.array(comp, pa.int64()), column], names=["g", "p", "cid", "comp", "shingles"])

    spread = rows.select("_text", "_cid", "_blocks", "_comp", "_d1", "_d2").mapInArrow(sets, "g long, p long, cid long, comp long, shingles array<long>")

    def compare(rows: list, name) -> list[tuple[int, int]]:
        seen, cids, comps, parts = set(), [], [], []
        for cid, comp, x in rows:
            if cid not in seen:  # the representative's row may be repeated
                seen.add(cid)
                cids.append(cid), comps.append(comp), parts.append(x)
        if len(cids) < 2:
            return []
        off = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        group = np.array(comps) if comps[0] is not None else None
        return [(cids[x], cids[y]) for x, y in forest(np.concatenate(parts), off, group, num, den)]

    def links(batches):
        name, rows = None, []
        for batch in batches:
            g, p, cid, comp = (batch.column(i).to_pylist() for i in range(4))
            column = batch.column(4)
            flat, cut = column.flatten().to_numpy(), column.offsets.to_numpy()
            cut = cut - cut[0]
            out = []
            for i in range(len(g)):
                if (g[i], p[i]) != name:
                    out += compare(rows, name)
                    name, rows = (g[i], p[i]), []
                rows.append((cid[i], comp[i], flat[cut[i] : cut[i + 1]].copy()))
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
        out = compare(rows, name)
        if out:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    return spread.repartition("g", "p").sortWithinPartitions("g", "p", "cid").mapInArrow(links, "a long, b long")


def _blocks(members: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(members / MEMBERS), F.ceil(shingles / SHINGLES))


def _one_block(label: str, block: Column) -> Column:
    return F.array(F.struct(F.col(label).alias("g"), block.alias("p"))).alias("blocks")


def group_classes(spark: SparkSession, docs: DataFrame, classes: DataFrame, key: str, text: str, k: int, num: int, den: int, shared: int) -> DataFrame:
    """(node, label): confirmed components of the classes that have links."""
    total = classes.count()
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("subs").alias(f"s_{c}"))
    tied = written(spark, ties(spark, classes, total), "ties")
    tied = tied.join(side("a"), "a").join(side("b"), "b").where(F.size(F.array_intersect("s_a", "s_b")) >= shared).select("a", "b")
    candidates = components(written(spark, tied, "tied"))
    # Sums by label are written before they are joined: a label of very many rows is then split by the adaptive join.
    members = written(spark, candidates.join(classes.select(F.col("cid").alias("node"), "d1", "d2", "rep", "n"), "node").withColumnRenamed("node", "cid"), "members")
    sizes = members.groupBy("label").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("nb"))
    members = written(spark, members.join(written(spark, sizes, "sizes"), "label"), "members")
    who = ["rep", "cid", "d1", "d2"]
    first = members.select(*who, _one_block("label", F.pmod(F.xxhash64("cid"), F.col("nb"))), F.lit(None).cast("long").alias("comp"))
    links = written(spark, confirmed(docs, first, key, text, k, num, den), "links")
    large = members.where("nb > 1").drop("nb")
    if not large.limit(1).count():
        return components(links)
    turn, left = 0, float("inf")
    while True:  # one member stands for each component, another one in each turn
        turn += 1
        comp = components(links).select(F.col("node").alias("cid"), F.col("label").alias("comp"))
        many = written(spark, large.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "parts")
        heads = many.groupBy("label", "comp").agg(F.min_by(F.struct(*who, "n"), F.xxhash64("cid", F.lit(turn))).alias("h")).select("label", "comp", "h.*")
        heads = written(spark, heads, "heads")
        apart = heads.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w")).where("c > 1").select("label", _blocks(F.col("c"), F.col("w")).alias("nb"))
        apart = written(spark, apart, "apart")
        if not apart.limit(1).count():
            return components(links)
        placed = heads.join(apart, "label").select(*who, _one_block("label", F.pmod(F.xxhash64("cid", F.lit(turn)), F.col("nb"))), "comp")
        placed = written(spark, placed, "placed")
        last, left = left, placed.count()
        if left > 0.8 * last:  # turns that no longer join much cost a pass each
            break
        links = links.union(written(spark, confirmed(docs, placed, key, text, k, num, den), "links"))
    # What is left of several components: blocks hold one large component each, or several small ones, and only pairs of
    # blocks that could still be linked are formed.
    many = written(spark, many.join(apart, "label"), "apart")
    part = many.groupBy("label", "comp").agg(F.count(F.lit(1)).alias("cm"), F.sum("n").alias("cw"))
    split = F.when((F.col("cm") * 2 > MEMBERS) | (F.col("cw") * 2 > SHINGLES), _blocks(F.col("cm"), F.col("cw"))).otherwise(F.lit(0))
    part = written(spark, part.select("label", "comp", split.alias("split"), "cm", "cw"), "split")
    small = part.where("split = 0").groupBy("label").agg(_blocks(F.sum("cm"), F.sum("cw")).alias("sb"))
    part = written(spark, part.join(written(spark, small, "small"), "label", "left").select("label", "comp", "split", "sb"), "split")
    bin_ = F.when(F.col("split") > 0, F.xxhash64("comp", F.pmod(F.xxhash64("cid"), F.col("split")))).otherwise(F.pmod(F.xxhash64("comp", F.lit(1)), F.col("sb")))
    many = written(spark, many.join(part, ["label", "comp"]).withColumn("bin", bin_), "bins")
    bins = written(spark, many.groupBy("label", "bin").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "bins")
    one, two = bins.toDF("label", "bin", "lo", "hi"), bins.toDF("label", "bin2", "lo2", "hi2")
    pairs = one.join(two, "label").where("bin <= bin2").where("not (lo = hi and lo2 = hi2 and lo = lo2)")
    pairs = pairs.select("label", "bin", "bin2", F.xxhash64("bin", "bin2").alias("p"))
    sent = pairs.select("label", "bin", "p").union(pairs.where("bin != bin2").select("label", "bin2", "p"))
    sent = many.join(written(spark, sent, "pairs"), ["label", "bin"]).groupBy(*who, "comp").agg(F.collect_list(F.struct(F.col("label").alias("g"), "p")).alias("blocks"))
    more = written(spark, confirmed(docs, written(spark, sent, "placed"), key, text, k, num, den), "links")
    return components(links.union(more))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, shared: int = 5) -> DataFrame:
    """key, th (hash of the text), n_shingles, label (component of classes, null for empty sets), component_id, kept: a row per row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(key, text)
    signed = written(spark, signatures(docs, key, text, k), "signed")
    classes = distinct_sets(signed, key)
    found = group_classes(spark, docs, classes, key, text, k, num, den, shared)
    named = written(spark, classes.join(found.select(F.col("node").alias("cid"), "label"), "cid", "left").select("d1", "d2", "rep", F.coalesce("label", "cid").alias("label")), "named")
    least = written(spark, named.groupBy("label").agg(F.min("rep").alias("component_id")), "least")
    named = written(spark, named.join(least, "label").select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "label", "component_id"), "named")
    out = signed.join(named, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
    whole = F.when(F.col("d1").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, "th", "n_shingles", "label", whole.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each near-duplicate component (the smallest id; of equal ids the smallest text hash; of equal rows any one). Documents without words all stay."""
    spark = docs.sparkSession
    found = written(spark, near_duplicates(docs, key, text, k, num, den).where("label is not null").select(F.col(key).alias("_id"), "th", "label"), "members")
    each = found.groupBy("_id", "th", "label").agg(F.count(F.lit(1)).alias("c"))
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("th"))
    best = written(spark, found.groupBy("label").agg(F.min(order).alias("best")), "best")
    each = written(spark, each.join(best, "label").select("_id", "th", "c", (order == F.col("best")).alias("stays")), "choice")
    # Who goes is the smaller side, and only repeated rows of those who stay need a shuffle of their texts.
    here = F.xxhash64(F.col(text))
    gone = _small(each.where("not stays").select(F.col("_id").alias("gi"), F.col("th").alias("gh")))
    left = docs.join(gone, F.col(key).eqNullSafe(F.col("gi")) & (here == F.col("gh")), "left_anti")
    twice = each.where("stays and c > 1").select(F.col("_id").alias("gi"), F.col("th").alias("gh"))
    if not twice.limit(1).count():
        return left
    twice = _small(twice)
    same = F.col(key).eqNullSafe(F.col("gi")) & (here == F.col("gh"))
    names = left.columns
    once = left.join(twice, same, "left_semi").select(F.struct(*names).alias("row"), F.col(key).alias("gi"), here.alias("gh")).groupBy("gi", "gh").agg(F.first("row").alias("row"))
    return left.join(twice, same, "left_anti").union(once.select(*[F.col("row")[c].alias(c) for c in names]))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS else df
