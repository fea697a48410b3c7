"""Changes between representations of one matrix. The logical form is always entries (i, j, a).

Block rows are (bi, bj, blk array<double>) with blocks row by row; banded structured-grid matrices are (off, pos, blk) with
one row per grid point and band, ``off`` 0 for the diagonal; blocks of matrices are (bi, bj, i, j, a).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def to_rows(m: DataFrame) -> DataFrame:
    """(i, cols, vals): a row of compressed storage per stored row, columns ascending."""
    packed = m.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "a"))).alias("r"))
    return packed.select("i", F.transform("r", lambda x: x["j"]).alias("cols"), F.transform("r", lambda x: x["a"]).alias("vals"))


def from_rows(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("i", F.col("e.cols").alias("j"), F.col("e.vals").alias("a"))


def rows_by_length(m: DataFrame) -> DataFrame:
    """(length, i): rows grouped by how many entries they store."""
    return m.groupBy("i").agg(F.count(F.lit(1)).alias("length")).select("length", "i")


def to_blocks(m: DataFrame, nb: int) -> DataFrame:
    """nb x nb dense blocks; places that are not stored are 0."""
    cell = m.select(F.floor(F.col("i") / nb).alias("bi"), F.floor(F.col("j") / nb).alias("bj"), ((F.col("i") % nb) * nb + F.col("j") % nb).cast("int").alias("k"), "a")
    one = cell.groupBy("bi", "bj", "k").agg(F.sum("a").alias("a")).groupBy("bi", "bj").agg(F.map_from_entries(F.collect_list(F.struct("k", "a"))).alias("e"))
    return one.select("bi", "bj", F.transform(F.sequence(F.lit(0), F.lit(nb * nb - 1)), lambda k: F.coalesce(F.try_element_at(F.col("e"), k), F.lit(0.0))).alias("blk"))


def from_blocks(b: DataFrame, nb: int, zeros: bool = False) -> DataFrame:
    out = b.select("bi", "bj", F.posexplode("blk").alias("k", "a")).select((F.col("bi") * nb + F.floor(F.col("k") / nb)).alias("i"), (F.col("bj") * nb + F.col("k") % nb).alias("j"), "a")
    return out if zeros else out.where("a != 0")


def from_bands(bands: DataFrame, nc: int = 1) -> DataFrame:
    """Entries of a banded matrix (off, pos, blk): block row pos + max(0, -off), block column that plus off."""
    row = F.col("pos") + F.greatest(F.lit(0), -F.col("off"))
    return from_blocks(bands.select(row.alias("bi"), (row + F.col("off")).alias("bj"), "blk"), nc, True)


def to_bands(m: DataFrame, nc: int = 1) -> DataFrame:
    b = to_blocks(m, nc)
    off = F.col("bj") - F.col("bi")
    return b.select(off.alias("off"), (F.col("bi") - F.greatest(F.lit(0), -off)).alias("pos"), "blk")


def bands_to_blocks(bands: DataFrame) -> DataFrame:
    row = F.col("pos") + F.greatest(F.lit(0), -F.col("off"))
    return bands.select(row.alias("bi"), (row + F.col("off")).alias("bj"), "blk")


def from_grid_of_blocks(blocks: DataFrame, row_sizes: DataFrame, col_sizes: DataFrame | None = None) -> DataFrame:
    """One matrix from blocks (bi, bj, i, j, a) and block sizes (b, n): positions move by the sizes before."""
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row per block, not per entry
    offsets = lambda s: s.select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    r = F.broadcast(offsets(row_sizes).select(F.col("b").alias("bi"), F.col("o").alias("_ro")))
    c = F.broadcast(offsets(col_sizes if col_sizes is not None else row_sizes).select(F.col("b").alias("bj"), F.col("o").alias("_co")))
    return blocks.join(r, "bi").join(c, "bj").select((F.col("i") + F.col("_ro")).alias("i"), (F.col("j") + F.col("_co")).alias("j"), "a")


def to_grid_of_blocks(m: DataFrame, size: int) -> DataFrame:
    """Blocks of equal size."""
    return m.select(F.floor(F.col("i") / size).alias("bi"), F.floor(F.col("j") / size).alias("bj"), (F.col("i") % size).alias("i"), (F.col("j") % size).alias("j"), "a")
