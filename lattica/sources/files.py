"""Readers and writers of sparse formats.

Line formats (triples, MatrixMarket, indexed vectors) are scanned by Spark's text reader in parallel. Text formats whose
meaning depends on the place in the file (compressed rows, block rows, bands, positional vectors) are scanned in parallel
too: ``tokens`` numbers all numbers of a file by prefix sums over its blocks, and the parts of a format are ranges of those
places, joined on them. Binary files and fixed-width cards are parsed by one task per file, read through Spark's
``binaryFile`` source, so any file system that Spark reads will do. Comments are lines that start with %. Positions come
out counted from 0; duplicates are kept unless ``summed``.

Writers order entries globally and write text files of ``LINES`` lines, which follow each other by name; the readers take
such a folder as one file.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import written

ENTRIES, VECTOR = "i long, j long, a double", "i long, x double"
LINES = 4_000_000  #: Of a written file.


# Line formats


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no comments, with their places; of several files the first is the least by name."""
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))
    return spark.read.text(path).select("value", place.alias("_at")).where(~F.ltrim("value").startswith("%") & (F.trim("value") != ""))


def _behind_head(lines: DataFrame, path: str) -> DataFrame:
    """All lines but the first, which holds the sizes."""
    first = lines.agg(F.min("_at").alias("m")).first()["m"]
    if first is None:
        raise ValueError(f"{path} is empty")
    return lines.where(~((F.col("_at.f") == first["f"]) & (F.col("_at.b") == first["b"]) & (F.col("_at.k") == first["k"])))


def _fields(lines: DataFrame, *kinds: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(*[F.get(parts, n).cast(k).alias(f"f{n}") for n, k in enumerate(kinds)])


def read_triples(spark: SparkSession, path: str, base: int | None = 0, symmetric: bool = False, summed: bool = False) -> DataFrame:
    """``m n nnz`` and lines ``i j a``; base None takes 1 if no position is 0. ``symmetric`` mirrors the stored triangle."""
    m = _fields(_behind_head(_lines(spark, path), path), "long", "long", "double").select(F.col("f0").alias("i"), F.col("f1").alias("j"), F.col("f2").alias("a"))
    if base is None:
        base = int(m.agg(F.min(F.least("i", "j"))).first()[0] == 1)
    m = m.select((F.col("i") - base).alias("i"), (F.col("j") - base).alias("j"), "a")
    if symmetric:
        m = m.unionByName(m.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "a"))
    return m.groupBy("i", "j").agg(F.sum("a").alias("a")) if summed else m


def read_matrix_market(spark: SparkSession, path: str, symmetric: bool = False, summed: bool = False) -> DataFrame:
    return read_triples(spark, path, 1, symmetric, summed)


def read_indexed_vector(spark: SparkSession, path: str) -> DataFrame:
    """``n`` and lines ``i x`` counted from 0."""
    return _fields(_behind_head(_lines(spark, path), path), "long", "double").select(F.col("f0").alias("i"), F.col("f1").alias("x"))


# Text formats by place


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(at, v): the numbers of a text file (or of the files of a folder, in order of name), counted from 0."""
    where = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")]
    lines = spark.read.text(path).select("value", *where, F.monotonically_increasing_id().alias("k"))  # ids grow within a block
    lines = lines.where(~F.ltrim("value").startswith("%") & (F.trim("value") != ""))
    lines = lines.select("f", "b", "k", F.split(F.trim(F.translate("value", "Dd", "EE")), r"\s+").alias("t"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = lines.groupBy("f", "b").agg(F.sum(F.size("t")).alias("n"))  # a row per block of a file
    starts = blocks.select("f", "b", before(Window.orderBy("f", "b")).alias("o"))
    placed = lines.withColumn("n", F.size("t")).select("f", "b", "t", before(Window.partitionBy("f", "b").orderBy("k")).alias("s"))
    each = placed.join(starts, ["f", "b"]).select((F.col("s") + F.col("o")).alias("s"), F.posexplode("t").alias("k", "v"))
    return written(each.select((F.col("s") + F.col("k")).alias("at"), "v"), "tokens")


def _ints(t: DataFrame, *places: int) -> list[int]:
    """Numbers at a few places."""
    if not places:
        return []
    found = {r["at"]: int(float(r["v"])) for r in t.where(F.col("at").isin(list(places))).collect()}
    if len(found) < len(set(places)):
        raise ValueError("file ends too early")
    return [found[p] for p in places]


def _part(t: DataFrame, start: int, n: int, kind: str, name: str) -> DataFrame:
    """(p, name): n numbers from a place on."""
    _ints(t, *([start + n - 1] if n else []))  # the last of them has to be there
    return t.where(F.col("at").between(start, start + n - 1)).select((F.col("at") - start).alias("p"), F.col("v").cast("double").cast(kind).alias(name))


def _row_places(starts: DataFrame, rows: int, first: int) -> DataFrame:
    """(p, i): the row of every stored place, from row starts (p, s)."""
    ends = starts.select((F.col("p") - 1).alias("p"), F.col("s").alias("e"))
    return starts.where(F.col("p") < rows).join(ends, "p").where("e > s").select(F.col("p").alias("i"), F.explode(F.sequence(F.col("s") - first, F.col("e") - first - 1)).alias("p"))


def _csr(t: DataFrame, skip: int = 0, header: int = 1, base: int | None = None) -> tuple[DataFrame, int]:
    """(entries, place behind them): row count (and column count), row starts, columns, values; the base is that of the first row start."""
    rows = _ints(t, skip)[0]
    at = skip + header
    first, last = _ints(t, at, at + rows)
    n, after = last - first, at + rows + 1
    i = _row_places(_part(t, at, rows + 1, "long", "s"), rows, first)
    j, a = _part(t, after, n, "long", "j"), _part(t, after + n, n, "double", "a")
    return i.join(j, "p").join(a, "p").select("i", (F.col("j") - (first if base is None else base)).alias("j"), "a"), after + 2 * n


def _bsr(t: DataFrame, skip: int = 0) -> tuple[DataFrame, int]:
    """Block rows as scalar entries (zeros inside blocks are kept): sizes, block size, storage order, then three counted arrays."""
    rows, _, _, nb, order, starts = _ints(t, *range(skip, skip + 6))
    at = skip + 6
    first, n = _ints(t, at, at + starts)
    cells = nb * nb
    i = _row_places(_part(t, at, starts, "long", "s"), rows, first)
    j = _part(t, at + starts + 1, n, "long", "j")
    v = _part(t, at + starts + n + 2, n * cells, "double", "a").select(F.floor(F.col("p") / cells).alias("p"), (F.col("p") % cells).alias("k"), "a")
    r, c = F.floor(F.col("k") / nb), F.col("k") % nb
    r, c = (c, r) if order else (r, c)  # order 1: blocks column by column
    return i.join(j, "p").join(v, "p").select((F.col("i") * nb + r).alias("i"), (F.col("j") * nb + c).alias("j"), "a"), at + starts + n + 2 + n * cells


def _bands(t: DataFrame, skip: int = 0) -> tuple[DataFrame, int]:
    """Bands of a structured grid as scalar entries: grid, block size, bands, the diagonal, then offset and values of each band."""
    nx, ny, nz, nc, bands = _ints(t, *range(skip, skip + 5))
    at, out, n, cells = skip + 5, None, nx * ny * nz, nc * nc
    for k in range(bands + 1):  # as many as there are bands: a handful
        off, size = (0, _ints(t, at)[0]) if k == 0 else _ints(t, at, at + 1)
        at += 1 if k == 0 else 2
        if size != (n - abs(off)) * cells:
            raise ValueError("band length is wrong")
        row = F.floor(F.col("p") / cells) + max(0, -off)
        cell = F.col("p") % cells
        band = _part(t, at, size, "double", "a").select((row * nc + F.floor(cell / nc)).alias("i"), ((row + off) * nc + cell % nc).alias("j"), "a")
        out, at = band if out is None else out.union(band), at + size
    return out, at


def _coo(t: DataFrame, skip: int = 0, shift: int = 0, symmetric: bool = False) -> tuple[DataFrame, int]:
    n = _ints(t, skip + 2)[0]
    place = F.col("p") % 3
    value = lambda k: F.max(F.when(place == k, F.col("x")))
    rows = _part(t, skip + 3, 3 * n, "double", "x").groupBy(F.floor(F.col("p") / 3).alias("q")).agg(value(0).alias("i"), value(1).alias("j"), value(2).alias("a"))
    rows = rows.select((F.col("i") - shift).cast("long").alias("i"), (F.col("j") - shift).cast("long").alias("j"), "a")
    if symmetric:
        rows = rows.unionByName(rows.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "a"))
    return rows, skip + 3 + 3 * n


def _vector(t: DataFrame, skip: int = 0) -> tuple[DataFrame, int]:
    n = _ints(t, skip)[0]
    return _part(t, skip + 1, n, "double", "x").withColumnRenamed("p", "i"), skip + 1 + n


def _indexed(t: DataFrame, skip: int = 0) -> tuple[DataFrame, int]:
    n = _ints(t, skip)[0]
    value = lambda k: F.max(F.when(F.col("p") % 2 == k, F.col("x")))
    rows = _part(t, skip + 1, 2 * n, "double", "x").groupBy(F.floor(F.col("p") / 2).alias("q")).agg(value(0).cast("long").alias("i"), value(1).alias("x"))
    return rows.select("i", "x"), skip + 1 + 2 * n


#: Text formats by the flag of files that name their own.
TEXT_MATRICES: dict[int, Callable] = {0: _csr, 1: _coo, 2: _bsr, 3: _bands, 4: _coo, 5: lambda t, s: _coo(t, s, 1), 6: lambda t, s: _coo(t, s, 1, True)}
TEXT_VECTORS: dict[int, Callable] = {1: _vector, 2: _vector, 3: _indexed, 4: _indexed}


# Whole-file formats


class Binary:
    """Numbers of a binary file in order; the order of bytes is found by the caller."""

    def __init__(self, data: bytes, order: str, ints: int = 4, reals: int = 8, at: int = 0):
        self.data, self.at = data, at
        self.kinds = {int: np.dtype(f"{order}i{ints}"), float: np.dtype(f"{order}f{reals}")}

    def take(self, n: int, kind=int) -> np.ndarray:
        d = self.kinds[kind]
        out = np.frombuffer(self.data, d, n, self.at)
        self.at += n * d.itemsize
        return out.astype(np.float64 if kind is float else np.int64)

    def one(self) -> int:
        return int(self.take(1)[0])


Parsed = Iterator[tuple[np.ndarray, ...]]


def _rows_of(ia: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ia) - 1), np.diff(ia))


def parse_csr(t, header: int = 1, base: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row count (and column count), row starts, columns, values; the base is taken from the first row start."""
    m = int(t.take(header)[0])
    ia = t.take(m + 1)
    base = int(ia[0]) if base is None else base
    ia = ia - ia[0]
    return _rows_of(ia), t.take(int(ia[-1])) - base, t.take(int(ia[-1]), float)


def parse_coo(t, shift: int = 0):
    _, _, n = t.take(3).tolist()
    rows = [(t.one(), t.one(), float(t.take(1, float)[0])) for _ in range(n)]
    i, j, a = (np.array(x) for x in zip(*rows)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return i - shift, j - shift, a


def mirror(i, j, a):
    off = i != j
    return np.concatenate([i, j[off]]), np.concatenate([j, i[off]]), np.concatenate([a, a[off]])


def parse_bsr(t):
    """Block rows as scalar entries (zeros inside blocks are kept): sizes, block size, storage order, then three counted arrays."""
    _, _, _, nb, order = t.take(5).tolist()
    ia = t.take(t.one())
    ja = t.take(t.one())
    vals = t.take(t.one(), float).reshape(-1, nb, nb)
    if order:  # blocks column by column
        vals = vals.transpose(0, 2, 1)
    bi, r, c = _rows_of(ia - ia[0]), *np.indices((nb, nb))
    return (bi[:, None, None] * nb + r).ravel(), (ja[:, None, None] * nb + c).ravel(), vals.ravel()


def parse_str(t):
    """Bands of a structured grid as scalar entries: grid, block size, bands, the diagonal, then offset and values of each band."""
    nx, ny, nz, nc, bands = t.take(5).tolist()
    n = nx * ny * nz
    out = []
    for k in range(bands + 1):
        off = 0 if k == 0 else t.one()
        vals = t.take(t.one(), float).reshape(-1, nc, nc)
        row = np.arange(len(vals)) + max(0, -off)
        r, c = np.indices((nc, nc))
        out.append(((row[:, None, None] * nc + r).ravel(), ((row + off)[:, None, None] * nc + c).ravel(), vals.ravel()))
        if len(vals) != n - abs(off):
            raise ValueError("band length is wrong")
    return tuple(np.concatenate(x) for x in zip(*out))


def parse_vector(t, kind=float):
    n = t.one()
    return np.arange(n), t.take(n, kind).astype(float)


def parse_indexed(t, kind=float):
    n = t.one()
    rows = [(t.one(), float(t.take(1, kind)[0])) for _ in range(n)]
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)


MATRICES: dict[int, Callable] = {
    1: parse_csr, 2: parse_bsr, 3: parse_str, 4: parse_coo, 5: lambda t: parse_coo(t, 1), 6: lambda t: mirror(*parse_coo(t, 1)),
}
VECTORS: dict[int, Callable] = {1: parse_vector, 2: lambda t: parse_vector(t, int), 3: parse_indexed, 4: lambda t: parse_indexed(t, int)}


def _self_describing(data: bytes, kinds: dict[int, Callable]):
    """A binary file that names its own format in two integers."""
    order = "<" if struct.unpack("<i", data[:4])[0] == 1 else ">"
    flag = struct.unpack(f"{order}i", data[4:8])[0]
    return kinds[flag // 100](Binary(data, order, flag // 10 % 10, flag % 10, 8))


def _is_text(spark: SparkSession, path: str) -> bool:
    """Whether a file that names its own format does so in text: by the line 0000."""
    return spark.read.text(path).where(F.trim("value") == "0000").limit(1).count() > 0


def parse_harwell_boeing(data: bytes):
    """Compressed columns in fixed-width cards; symmetric types are mirrored."""
    lines = data.decode().splitlines()
    cards = [int(lines[1][k : k + 14] or 0) for k in range(14, 56, 14)]
    kind = lines[2][:3].upper()
    _, cols_n, nnz = (int(lines[2][k : k + 14]) for k in range(14, 56, 14))
    formats = [lines[3][:16], lines[3][16:32], lines[3][32:52]]
    at = 4 + (1 if len(lines[1]) > 56 and (lines[1][56:70].strip() or "0") != "0" else 0)

    def block(n_cards: int, form: str, n: int, real: bool) -> np.ndarray:
        nonlocal at
        width = int("".join(c for c in form.upper().split("I" if not real else "E" if "E" in form.upper() else "D" if "D" in form.upper() else "F")[-1] if c.isdigit() or c == ".").split(".")[0])
        out: list[str] = []
        for line in lines[at : at + n_cards]:
            out += [line[k : k + width] for k in range(0, len(line.rstrip()), width)]
        at += n_cards
        return np.array([float(x.replace("D", "E").replace("d", "e")) if real else int(x) for x in out if x.strip()][:n])

    ptr, idx = block(cards[0], formats[0], cols_n + 1, False), block(cards[1], formats[1], nnz, False)
    val = block(cards[2], formats[2], nnz, True) if cards[2] else np.ones(nnz)
    out = idx - 1, _rows_of(ptr - 1), val
    return mirror(*out) if kind[1] == "S" else out


def _scan(spark: SparkSession, path: str, parse: Callable[[bytes], tuple[np.ndarray, ...]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                columns = parse(data)
                kinds = [pa.int64()] * (len(names) - 1) + [pa.float64()]
                for a in range(0, len(columns[0]), 1 << 20):
                    yield pa.record_batch([pa.array(c[a : a + (1 << 20)]).cast(k) for c, k in zip(columns, kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    return _csr(tokens(spark, path))[0]


def read_csr_with_rhs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One file: rows and columns, a matrix of compressed rows, then a vector."""
    t = tokens(spark, path)
    m, after = _csr(t, 0, 2)
    return m, _vector(t, after)[0]


def read_csr_pair(spark: SparkSession, matrix: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Two files, the matrix counted from 1."""
    return _csr(tokens(spark, matrix), 0, 1, 1)[0], read_vector(spark, vector)


def read_bsr(spark: SparkSession, path: str) -> DataFrame:
    return _bsr(tokens(spark, path))[0]


def read_str(spark: SparkSession, path: str) -> DataFrame:
    return _bands(tokens(spark, path))[0]


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    return _vector(tokens(spark, path))[0]


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A file that names its own format, in text or binary."""
    if not _is_text(spark, path):
        return _scan(spark, path, lambda d: _self_describing(d, MATRICES), ENTRIES)
    t = tokens(spark, path)
    return TEXT_MATRICES[_ints(t, 1)[0] // 100](t, 2)[0]


def read_any_vector(spark: SparkSession, path: str) -> DataFrame:
    if not _is_text(spark, path):
        return _scan(spark, path, lambda d: _self_describing(d, VECTORS), VECTOR)
    t = tokens(spark, path)
    return TEXT_VECTORS[_ints(t, 1)[0] // 100](t, 2)[0]


def read_harwell_boeing(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, parse_harwell_boeing, ENTRIES)


def read_coo_binary(spark: SparkSession, rows: str, cols: str, vals: str, rhs: str | None = None):
    """Separate files of rows, columns and values, each with a type and a count in front; the vector with a count."""

    def part(kind: str, head: int):
        def parse(d: bytes):
            n = struct.unpack_from("<q", d, 8 * (head - 1))[0]
            v = np.frombuffer(d, kind, n, 8 * head)
            return np.arange(n), v.astype(float)

        return parse

    read = lambda p, kind, name, head=2: _scan(spark, p, part(kind, head), VECTOR).select(F.col("i").alias("k"), F.col("x").alias(name))
    m = read(rows, "<i4", "i").join(read(cols, "<i4", "j"), "k").join(read(vals, "<f8", "a"), "k").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "a")
    return m if rhs is None else (m, read(rhs, "<f8", "x", 1).select(F.col("k").alias("i"), "x"))


# Writers


def write_lines(lines: DataFrame, path: str) -> None:
    """(_p, value) rows in order of _p into text files of about ``LINES`` lines, which follow each other by name."""
    lines = written(lines, "lines")
    lines.repartitionByRange(max(1, -(-lines.count() // LINES)), "_p").sortWithinPartitions("_p").select("value").write.mode("overwrite").text(path)


def _head(spark: SparkSession, *rows: str) -> DataFrame:
    return spark.createDataFrame([(f"0{n:019d}", r) for n, r in enumerate(rows)], "_p string, value string")


def _number(c: str):
    return F.col(c).cast("string")


def write_triples(m: DataFrame, path: str, rows: int, cols: int, base: int = 0, comment: str | None = None) -> None:
    """Triples in order of rows and columns: coordinate text (base 0) or MatrixMarket (base 1)."""
    spark = m.sparkSession
    body = m.select(F.concat(F.lit("1"), F.lpad(F.col("i").cast("string"), 19, "0"), F.lit("/"), F.lpad(F.col("j").cast("string"), 19, "0")).alias("_p"), F.concat_ws(" ", (F.col("i") + base).cast("string"), (F.col("j") + base).cast("string"), _number("a")).alias("value"))
    heads = ([comment] if comment else []) + [f"{rows} {cols} {m.count()}"]
    write_lines(_head(spark, *heads).union(body), path)


def write_matrix_market(m: DataFrame, path: str, rows: int, cols: int) -> None:
    write_triples(m, path, rows, cols, 1, "%%MatrixMarket matrix coordinate real general")


def write_vector(v: DataFrame, path: str, n: int) -> None:
    body = v.select(F.concat(F.lit("1"), F.lpad(F.col("i").cast("string"), 19, "0")).alias("_p"), _number("x").alias("value"))
    write_lines(_head(v.sparkSession, str(n)).union(body), path)


def write_indexed_vector(v: DataFrame, path: str) -> None:
    body = v.select(F.concat(F.lit("1"), F.lpad(F.col("i").cast("string"), 19, "0")).alias("_p"), F.concat_ws(" ", F.col("i").cast("string"), _number("x")).alias("value"))
    write_lines(_head(v.sparkSession, str(v.count())).union(body), path)


def _packed(m: DataFrame, rows: int, base: int) -> list[DataFrame]:
    """Row starts, columns and values of compressed rows as lines."""
    spark = m.sparkSession
    counts = spark.range(rows + 1).select(F.col("id").alias("i")).join(m.groupBy(F.col("i") + 1).count().toDF("i", "c"), "i", "left").fillna(0, ["c"])
    # Row starts are prefix sums: within ranges of rows on top of the sums of the ranges before.
    width = 1 << 14
    ranged = counts.withColumn("_r", F.floor(F.col("i") / width))
    before = ranged.groupBy("_r").agg(F.sum("c").alias("s")).select("_r", F.coalesce(F.sum("s").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    starts = ranged.join(before, "_r").select("i", (F.sum("c").over(Window.partitionBy("_r").orderBy("i")) + F.col("o") + base).alias("s"))
    pad = lambda c: F.lpad(F.col(c).cast("string"), 19, "0")
    key = F.concat(pad("i"), F.lit("/"), pad("j"))
    return [
        starts.select(F.concat(F.lit("1"), pad("i")).alias("_p"), F.col("s").cast("string").alias("value")),
        m.select(F.concat(F.lit("2"), key).alias("_p"), (F.col("j") + base).cast("string").alias("value")),
        m.select(F.concat(F.lit("3"), key).alias("_p"), _number("a").alias("value")),
    ]


def write_csr(m: DataFrame, path: str, rows: int, base: int = 0, cols: int | None = None, rhs: DataFrame | None = None) -> None:
    """Compressed rows; with ``cols`` and ``rhs`` the one-file form with a vector behind the matrix."""
    spark = m.sparkSession
    parts = [_head(spark, str(rows) if cols is None else f"{rows} {cols}"), *_packed(m, rows, base)]
    if rhs is not None:
        parts.append(spark.createDataFrame([("4", str(rows))], "_p string, value string"))
        parts.append(rhs.select(F.concat(F.lit("5"), F.lpad(F.col("i").cast("string"), 19, "0")).alias("_p"), _number("x").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    write_lines(out, path)


def write_self_describing(m: DataFrame, path: str, rows: int, cols: int) -> None:
    """Text with the header 0000 / 400 and triples behind it."""
    body = m.select(F.concat(F.lit("1"), F.lpad(F.col("i").cast("string"), 19, "0"), F.lit("/"), F.lpad(F.col("j").cast("string"), 19, "0")).alias("_p"), F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), _number("a")).alias("value"))
    write_lines(_head(m.sparkSession, "0000", "400", f"{rows} {cols} {m.count()}").union(body), path)


def write_self_describing_vector(v: DataFrame, path: str, n: int) -> None:
    """Text with the header 0000 / 100 and the values behind it."""
    body = v.select(F.concat(F.lit("1"), F.lpad(F.col("i").cast("string"), 19, "0")).alias("_p"), _number("x").alias("value"))
    write_lines(_head(v.sparkSession, "0000", "100", str(n)).union(body), path)


def write_bsr(blocks: DataFrame, path: str, brows: int, bcols: int, nb: int) -> None:
    """Block rows (bi, bj, blk) of nb x nb blocks, stored row by row."""
    spark = blocks.sparkSession
    n = blocks.count()
    scalar = blocks.select(F.col("bi").alias("i"), F.col("bj").alias("j"), F.concat_ws(" ", F.transform("blk", lambda x: x.cast("string"))).alias("a"))
    ia, ja, val = _packed(scalar, brows, 0)
    mark = lambda key, text: spark.createDataFrame([(key, text)], "_p string, value string")
    out = _head(spark, f"{brows} {bcols} {n}", str(nb), "0", str(brows + 1)).union(ia).union(mark("1~", str(n))).union(ja).union(mark("2~", str(n * nb * nb))).union(val)
    write_lines(out, path)


def write_bands(bands: DataFrame, path: str, nx: int, ny: int, nz: int, nc: int) -> None:
    """Bands (off, pos, blk) of a structured grid: the diagonal first, then the others by offset."""
    spark = bands.sparkSession
    offs = sorted({r["off"] for r in bands.select("off").distinct().collect()} - {0})  # a handful of bands
    n = nx * ny * nz
    rank = F.array_position(F.array(*[F.lit(o).cast("long") for o in [0, *offs]]), F.col("off").cast("long"))
    body = bands.select(F.concat(F.lit("1"), F.lpad(rank.cast("string"), 6, "0"), F.lit("/1"), F.lpad(F.col("pos").cast("string"), 19, "0")).alias("_p"), F.concat_ws(" ", F.transform("blk", lambda x: x.cast("string"))).alias("value"))
    heads = [(f"1{k + 1:06d}/0", (f"{o} " if k else "") + str((n - abs(o)) * nc * nc)) for k, o in enumerate([0, *offs])]
    write_lines(_head(spark, f"{nx} {ny} {nz}", str(nc), str(len(offs))).union(spark.createDataFrame(heads, "_p string, value string")).union(body), path)


def write_pattern_picture(image: DataFrame, path: str, size: int) -> None:
    """A portable grey map of (bi, bj, stored) counts, at most size x size: the picture itself is small."""
    cells = {(int(r["bi"]), int(r["bj"])): int(r["stored"]) for r in image.collect()}
    top = max(cells.values(), default=1)
    rows = [" ".join(str(255 - round(255 * cells.get((i, j), 0) / top)) for j in range(size)) for i in range(size)]
    write_lines(_head(image.sparkSession, "P2", f"{size} {size}", "255", *rows), path)
