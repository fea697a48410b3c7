"""Content-addressed store of token-id streams.

Format, in the folder given: two Parquet tables and a manifest.

``blocks``   one row per distinct chunk: key (SHA-256 of the payload, first 20 bytes), n (ids), payload (ids as
             little-endian unsigned integers, 2 or 4 bytes wide by the vocabulary).
``recipes``  one row per document, in ascending key order over and within ``range``: document key, n_tokens, chunk keys
             in order, Merkle root over them.
``manifest`` one row per range: number of documents and ids, ids of all ranges before it, Merkle root of its documents.

A rolling hash over the last 16 ids cuts the stream of a document where its low bits are zero, so equal passages give
equal chunks wherever they stand; chunks never cross documents. A chunk of over 2048 ids is cut again from its start.

Reading back checks every chunk against its key and every document against its root. ``documents_of`` derives the
position, length and CRC of each document from the files without moving payloads: the CRC of a whole is composed of its
chunks' CRCs (CRC-32 is linear over GF(2)). ``reconstruct`` returns the ids themselves.

Defined results: null and empty texts have just the end id; repeated rows are separate documents that share chunks;
a null document key sorts first; extra columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, byte_view, drop, new_path

WINDOW, MASK, LONGEST, KEY = 16, 0xFF, 2048, 20
BLOCK = 1 << 16
_POLY = 0xEDB88320
_SEEN = 400_000
#: Slices of at most so many bytes whose ids a worker keeps, and how many of them.
SHORT, KNOWN = 24, 400_000


#: Words of these characters only have slices that can be told by character class and encoded apart from each other: no
#: apostrophe (contractions), no bar (special tokens), no letter that normalisation could join or split.
PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ0-9!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{}~]+$"


#: 1 for letters, 2 for digits, 0 for marks, for the code points of plain words.
_PLAIN_KIND = np.array([2 if 48 <= c <= 57 else int(c >= 0xC0 or chr(c).isalpha()) for c in range(256)], np.uint8)


class WordEncoder:
    """Ids of whole texts by the tokenizers library. White space separates words in its vocabulary's pattern and is
    dropped, and so are letters, digits and marks of plain words: each distinct slice of a batch is encoded once, many
    slices in one call (their ends show in the vocabulary's word-end mark); other words are encoded one by one. Ids of the
    first ``KNOWN`` short slices are kept for the batches and tasks that follow."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known = pa.array([], pa.large_string())  # slices, their ids end to end, number of ids of each
        self.known_ids, self.known_sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _apart(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each), each word by itself."""
        ids = [e.ids for e in self.library.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return np.array([i for x in ids for i in x], "<u4"), np.array([len(x) for x in ids], np.int64)

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, off = byte_view(words)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        kind = _PLAIN_KIND[points]
        starts = kind == 2
        starts[1:] |= kind[1:] != kind[:-1]
        starts[np.searchsorted(at, off[:-1])] = True
        bounds = np.append(at[starts], len(raw))
        slices = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(raw))
        coded = pc.utf8_lower(slices).dictionary_encode()
        flat, size, at = self._slices(coded.dictionary)
        per_slice = np.searchsorted(bounds, off)
        ids, before = _gather(flat, size, at[coded.indices.to_numpy()])
        return ids, np.diff(before[per_slice])

    def _slices(self, some: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each list, place of each slice among the lists) of distinct slices."""
        at = pc.index_in(some, value_set=self.known)
        new = some.filter(pc.is_null(at))
        fresh = at.is_null().to_numpy(zero_copy_only=False)
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        place[fresh] = len(self.known) + np.arange(len(new))
        if not len(new):
            return self.known_ids, self.known_sizes, place
        words = new.to_pylist()
        found = [e.ids for e in self.library.encode_batch_fast([" ".join(words[a : a + 1000]) for a in range(0, len(words), 1000)], add_special_tokens=False)]
        flat = np.concatenate([np.array(x, "<u4") for x in found])
        last = np.flatnonzero(self.ends[flat]) + 1
        if len(last) != len(new):
            raise ValueError("slices and encoded words differ in number")
        size = np.diff(last, prepend=0)
        all_ids, all_sizes = np.concatenate([self.known_ids, flat]), np.concatenate([self.known_sizes, size])
        short = np.flatnonzero(pc.binary_length(new).to_numpy() <= SHORT)[: KNOWN - len(self.known)]
        if len(short):
            self.known_ids = np.concatenate([self.known_ids, _gather(flat, size, short)[0]])
            self.known_sizes = np.concatenate([self.known_sizes, size[short]])
            self.known = pa.concat_arrays([self.known, new.take(pa.array(short))])
        return all_ids, all_sizes, place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before each text and in all)."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        per = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        size, flats = np.zeros(len(words), np.int64), []
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        for where, encode in ((plain, self._plain), (~plain, self._apart)):
            if where.any():
                flat, n = encode(words.filter(pa.array(where)))
                flats.append(flat)
                size[where] = n
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        flat = np.concatenate(flats) if flats else np.zeros(0, "<u4")
        ids, before = _gather(flat, size[order], rank[coded.indices.to_numpy()])
        return ids, before[per - per[0]]


def _gather(flat: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the lists named by ``index``, end to end; number of items before each and in all) of lists given by sizes."""
    counts = size[index]
    ends = np.cumsum(counts)
    n = int(ends[-1]) if len(ends) else 0
    where = (np.cumsum(size) - size)[index]
    at = np.repeat((where - (ends - counts)).astype(np.int32), counts)
    at += np.arange(n, dtype=np.int32)
    return flat[at], np.concatenate([[0], ends]).astype(np.int64)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def chunk_ends(ids: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Ends of the chunks of texts laid end to end; ``cut`` holds the offsets of the texts. Every end of a text is one."""
    marks = []
    for a in range(0, len(ids), BLOCK):  # a block holds the windows that end in it
        low = max(0, a - WINDOW + 1)
        with np.errstate(over="ignore"):
            rolling = (ids[low : a + BLOCK].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            rolling ^= rolling >> np.uint64(29)
            for k in (1, 2, 4, 8):  # sums over windows of 2 k ids from those of k
                rolling[k:] += rolling[:-k] * np.uint64(pow(0xBF58476D1CE4E5B9, k, 1 << 64))
            rolling ^= rolling >> np.uint64(32)
        marks.append(np.flatnonzero((rolling[a - low :] & np.uint64(MASK)) == 0) + a)
    at = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    at = at[at - cut[np.searchsorted(cut, at, "right") - 1] >= WINDOW - 1]  # a window lies within one text
    ends = np.union1d(at + 1, cut[1:])
    starts = np.concatenate([[0], ends[:-1]])
    extra = [np.arange(starts[i] + LONGEST, ends[i], LONGEST) for i in np.flatnonzero(ends - starts > LONGEST)]
    return np.union1d(ends, np.concatenate(extra)) if extra else ends


def merkle(keys: list[bytes]) -> bytes:
    """Root of a binary tree over the keys; an odd node moves up as it is. Leaves and nodes are told apart by a prefix."""
    level = [hashlib.sha256(b"\0" + k).digest() for k in keys] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def write_store(spark: SparkSession, docs: DataFrame, path: str, folder: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encodes ``docs`` by the tokenizer at ``path`` and writes the store into ``folder``."""

    def run(batches):
        enc = encoder(path)
        kind = "<u2" if enc.size <= 1 << 16 else "<u4"
        width = int(kind[-1])
        task, row, seen = TaskContext.get().partitionId(), 0, set()
        for batch in by_bytes(batches, text, 4 << 20):
            bare, per = enc.encode(batch.column(1))
            cut = per + np.arange(len(per))
            ids = np.insert(bare, per[1:], end_id).astype(kind)
            ends = chunk_ends(ids, cut)
            data = ids.tobytes()
            sizes = np.diff(ends, prepend=0)
            keys, a = [], 0
            fresh: tuple[list, list, list] = ([], [], [])
            for b, n in zip((ends * width).tolist(), sizes.tolist()):
                k = hashlib.sha256(data[a:b]).digest()[:KEY]
                keys.append(k)
                if k not in seen:
                    if len(seen) < _SEEN:
                        seen.add(k)
                    fresh[0].append(k), fresh[1].append(n), fresh[2].append(data[a:b])
                a = b
            per_doc = np.searchsorted(ends, cut[1:]) + 1
            names = [b"%d/%d" % (task, row + i) for i in range(batch.num_rows)]
            row += batch.num_rows
            first = np.concatenate([[0], per_doc])
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(keys, pa.binary()))
            roots = [merkle(keys[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
            m, f = batch.num_rows, len(fresh[0])
            yield pa.record_batch(
                [pa.array([0] * m, pa.int8()), pa.array(names, pa.binary()), batch.column(0), pa.array(np.diff(cut)), lists, pa.array(roots, pa.binary())], names=out_names
            )
            yield pa.record_batch(
                [pa.array([1] * f, pa.int8()), pa.array(fresh[0], pa.binary()), pa.nulls(f, batch.column(0).type), pa.array(fresh[1], pa.int64()), pa.nulls(f, lists.type), pa.array(fresh[2], pa.binary())],
                names=out_names,
            )

    out_names = ["kind", "key", "doc", "n", "chunks", "body"]
    doc_type = dict(docs.dtypes)[key]
    rows = docs.select(key, text).mapInArrow(run, f"kind byte, key binary, doc {doc_type}, n long, chunks array<binary>, body binary")
    staged = f"{folder}/staged"
    # Workers have left out most repeated chunks: no combining before the exchange, which would sort all payloads once more.
    rows.repartition("key").dropDuplicates(["key"]).write.partitionBy("kind").option("compression", "zstd").parquet(staged)
    kept = spark.read.schema(f"key binary, doc {doc_type}, n long, chunks array<binary>, body binary, kind byte").parquet(staged)
    # The chunks stay where the shuffle has put them: that part of the staged table is the block table.
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    recipes = (
        kept.where("kind = 0")
        .repartitionByRange("doc")
        .sortWithinPartitions("doc", "body", "key")
        .select(F.col("doc").alias(key), F.col("n").alias("n_tokens"), "chunks", F.col("body").alias("root"), F.col("key").alias("row"), F.spark_partition_id().alias("range"))
    )
    recipes.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    if fs.exists(fs_path(f"{staged}/kind=1")):
        fs.rename(fs_path(f"{staged}/kind=1"), fs_path(f"{folder}/blocks"))
    else:
        spark.createDataFrame([], "key binary, n long, body binary").write.parquet(f"{folder}/blocks")
    drop(spark, staged)

    def roots(batches):
        tops: dict[int, list[bytes]] = {}
        for batch in batches:
            for r, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tops.setdefault(r, []).append(root)
        yield pa.record_batch([pa.array(list(tops), pa.int32()), pa.array([merkle(x) for x in tops.values()], pa.binary())], names=["range", "root"])

    saved = spark.read.parquet(f"{folder}/recipes")
    sums = saved.groupBy("range").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range only
    sums = sums.withColumn("ids_before", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    tops = saved.repartition("range").sortWithinPartitions("range", key, "root", "row").select("range", "root").mapInArrow(roots, "range int, root binary")
    sums.join(tops, "range").write.parquet(f"{folder}/manifest")


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/recipes")


@lru_cache(64)
def _power(k: int) -> int:
    """x^(32 * 2^k) modulo the CRC polynomial, bits reflected."""
    if k == 0:
        p = 0x80000000
        for _ in range(32):
            p = (p >> 1) ^ (_POLY if p & 1 else 0)
        return p
    a = np.array([_power(k - 1)], np.uint32)
    return int(_times(a, a)[0])


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the CRC polynomial."""
    out, b = np.zeros(len(b), np.uint32), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return out


def shift_crc(crc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """CRC-32 values as if so many 32-bit words of the whole followed."""
    crc = crc.astype(np.uint32)
    for k in range(int(words.max(initial=0)).bit_length()):
        move = np.flatnonzero((words >> k) & 1)
        crc[move] = _times(np.full(len(move), _power(k), np.uint32), crc[move])
    return crc


def _checked_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """key, n, crc (of the ids as 32-bit integers) from the block files; a block that doesn't match its key is an error."""

    def run(batches):
        for batch in batches:
            crcs = []
            for k, n, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if hashlib.sha256(body).digest()[:KEY] != k or len(body) % n:
                    raise ValueError(f"block {k.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(body, f"<u{len(body) // n}").astype("<u4")))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["key", "n", "crc"])

    return spark.read.parquet(f"{folder}/blocks").select("key", "n", "body").mapInArrow(run, "key binary, n long, crc long")


def documents_of(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document of the store, read from its files and verified."""
    recipes = _recipes(spark, folder)
    manifest = spark.read.parquet(f"{folder}/manifest").select("range", "ids_before")
    inside = Window.partitionBy("range").orderBy(key, "root", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.select(key, "root", "row", "range", "n_tokens", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("at")).join(manifest, "range")
    parts = (
        recipes.select("row", F.posexplode("chunks").alias("pos", "key"))
        .join(_checked_blocks(spark, folder), "key", "left")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "key", "n", "crc"))).alias("parts"))
    )
    rows = placed.join(parts, "row").select(key, (F.col("ids_before") + F.col("at")).alias("start"), "n_tokens", "root", "parts")

    def run(batches):
        for batch in batches:
            column = batch.column(4)
            per = pc.list_value_length(column).to_numpy()
            flat = column.flatten()
            n, crc, keys = flat.field("n"), flat.field("crc"), flat.field("key").to_pylist()
            if n.null_count:
                raise ValueError("a recipe names a block that the store lacks")
            n, crc = n.to_numpy(), crc.to_numpy()
            ends = np.cumsum(per)
            done = np.cumsum(n)
            after = np.repeat(done[ends - 1], per) - done
            moved = shift_crc(crc, after)
            whole = np.bitwise_xor.reduceat(moved, ends - per) if len(per) else moved
            total = np.add.reduceat(n, ends - per) if len(per) else n
            for root, count, e, c, t in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), ends.tolist(), per.tolist(), total.tolist()):
                if merkle(keys[e - c : e]) != root or count != t:
                    raise ValueError("a document doesn't match its root")
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(whole.astype(np.int64))], names=[key, "start", "n_tokens", "ids_crc32"])

    kind = dict(recipes.dtypes)[key]
    return rows.mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long")


def reconstruct(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """key, row, ids array<long> of every document, put together from its chunks."""
    recipes = _recipes(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks").select("key", "n", "body")
    whole = (
        recipes.select(key, "row", F.posexplode("chunks").alias("pos", "key"))
        .join(blocks, "key")
        .groupBy(key, "row")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "n", "body"))).alias("parts"))
    )

    def run(batches):
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(p["body"], f"<u{len(p['body']) // p['n']}").astype(np.int64) for p in parts]) for parts in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=[key, "row", "ids"])

    kind = dict(recipes.dtypes)[key]
    return whole.mapInArrow(run, f"`{key}` {kind}, row binary, ids array<long>")


def store_and_read(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    write_store(spark, docs, path, folder)
    return documents_of(spark, folder)
