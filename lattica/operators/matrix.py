"""Structural operators on sparse matrices.

A matrix is a DataFrame (i long, j long, a double) of stored entries; zeros may be stored, and an entry that is missing is
0. Positions count from 0. A vector is (i long, x double). All operators are projections, filters, equi-joins and
grouped sums, so Catalyst plans them and nothing but scalars reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matrix(df: DataFrame, i: str | Column, j: str | Column, a: str | Column) -> DataFrame:
    """Entries of ``df``; equal positions are summed."""
    return entries(df, i, j, a).groupBy("i", "j").agg(F.sum("a").alias("a"))


def entries(df: DataFrame, i: str | Column, j: str | Column, a: str | Column) -> DataFrame:
    """Entries of ``df`` as they are: positions may repeat."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(i).cast("long").alias("i"), col(j).cast("long").alias("j"), col(a).cast("double").alias("a"))


def constant(spark: SparkSession, n: int, value: float) -> DataFrame:
    """Vector of n equal values."""
    return spark.range(n).select(F.col("id").alias("i"), F.lit(float(value)).alias("x"))


def hashed_vector(spark: SparkSession, n: int) -> DataFrame:
    """A fixed pseudo-random vector in [0, 1): (i * 2654435761 mod 1000003) / 1000003."""
    return spark.range(n).select(F.col("id").alias("i"), (F.pmod(F.col("id") * 2654435761, F.lit(1000003)) / 1000003.0).alias("x"))


def identity(spark: SparkSession, n: int, value: float = 1.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(value)).alias("a"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "a")


def permute(m: DataFrame, perm: DataFrame) -> DataFrame:
    """P A P^T: row and column ``old`` become ``new`` of perm (old, new)."""
    rows = perm.select(F.col("old").alias("i"), F.col("new").alias("_i"))
    cols = perm.select(F.col("old").alias("j"), F.col("new").alias("_j"))
    return m.join(rows, "i").join(cols, "j").select(F.col("_i").alias("i"), F.col("_j").alias("j"), "a")


def permute_vector(v: DataFrame, perm: DataFrame) -> DataFrame:
    return v.join(perm.select(F.col("old").alias("i"), F.col("new").alias("_i")), "i").select(F.col("_i").alias("i"), "x")


def inverse_permutation(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("new").alias("old"), F.col("old").alias("new"))


def submatrix(m: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Rows and columns named by (old, new) tables, renumbered."""
    r = rows.select(F.col("old").alias("i"), F.col("new").alias("_i"))
    c = cols.select(F.col("old").alias("j"), F.col("new").alias("_j"))
    return m.join(r, "i").join(c, "j").select(F.col("_i").alias("i"), F.col("_j").alias("j"), "a")


def sorted_rows(m: DataFrame, diagonal_first: bool = False) -> DataFrame:
    """Rows in order of columns, or with the diagonal entry in front: only what is written or shown has an order."""
    return m.orderBy("i", *([F.col("i") != F.col("j")] if diagonal_first else []), "j")


def entry_rank(m: DataFrame, diagonal_first: bool = False) -> DataFrame:
    """m with ``pos``, the place of an entry in its row."""
    order = [F.col("i") != F.col("j")] if diagonal_first else []
    return m.withColumn("pos", F.row_number().over(Window.partitionBy("i").orderBy(*order, "j")) - 1)


def diagonal(m: DataFrame) -> DataFrame:
    """Stored diagonal entries as a vector."""
    return m.where("i = j").select("i", F.col("a").alias("x"))


def column(m: DataFrame, n: int, rows: DataFrame | None = None) -> DataFrame:
    """Column n as a vector; with ``rows`` (i), zeros for entries that are not stored."""
    got = m.where(F.col("j") == n).select("i", F.col("a").alias("x"))
    return got if rows is None else rows.select("i").join(got, "i", "left").select("i", F.coalesce("x", F.lit(0.0)).alias("x"))


def regularise_diagonal(m: DataFrame, value: float) -> DataFrame:
    """Diagonal entries in [0, 1e-20) become ``value``; a negative one is an error, raised where it is met."""
    bad = F.raise_error(F.concat(F.lit("negative diagonal in row "), F.col("i").cast("string")))
    d = F.when(F.col("a") < 0, bad.cast("double")).when(F.col("a") < 1e-20, F.lit(float(value))).otherwise(F.col("a"))
    return m.select("i", "j", F.when(F.col("i") == F.col("j"), d).otherwise(F.col("a")).alias("a"))


def compress(m: DataFrame, tolerance: float) -> DataFrame:
    """Entries with |a| above the tolerance."""
    return m.where(F.abs("a") > tolerance)


def shift(m: DataFrame, offset: int) -> DataFrame:
    return m.select((F.col("i") + offset).alias("i"), (F.col("j") + offset).alias("j"), "a")


def longest_row(m: DataFrame) -> DataFrame:
    """One row: the most stored entries in a row."""
    return m.groupBy("i").count().agg(F.max("count").alias("longest_row"))


def scale(m: DataFrame, alpha: float) -> DataFrame:
    return m.withColumn("a", F.lit(float(alpha)) * F.col("a"))


def symmetric_diagonal_scaling(m: DataFrame, d: DataFrame) -> DataFrame:
    """D^-1/2 A D^-1/2 with the vector d."""
    return (
        m.join(d.select("i", F.col("x").alias("_di")), "i")
        .join(d.select(F.col("i").alias("j"), F.col("x").alias("_dj")), "j")
        .select("i", "j", (F.col("a") / F.sqrt(F.col("_di") * F.col("_dj"))).alias("a"))
    )


def symmetric_diagonal_scaling_vector(v: DataFrame, d: DataFrame) -> DataFrame:
    return v.join(d.select("i", F.col("x").alias("_d")), "i").select("i", (F.col("x") / F.sqrt("_d")).alias("x"))


def add(m: DataFrame, n: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha A + beta B over the union of the patterns."""
    return scale(m, alpha).unionByName(scale(n, beta)).groupBy("i", "j").agg(F.sum("a").alias("a"))


def symmetric_pattern(m: DataFrame) -> DataFrame:
    """The values of A on the pattern of A and its transpose."""
    return m.unionByName(transpose(m).withColumn("a", F.lit(0.0))).groupBy("i", "j").agg(F.sum("a").alias("a"))


def merge_duplicates(m: DataFrame) -> DataFrame:
    return m.groupBy("i", "j").agg(F.sum("a").alias("a"))


def duplicates(m: DataFrame) -> DataFrame:
    """Positions stored more than once."""
    return m.groupBy("i", "j").count().where("count > 1").select("i", "j", F.col("count").alias("stored"))


def row_scale(m: DataFrame, d: DataFrame) -> DataFrame:
    """diag(d) A."""
    return m.join(d.select("i", F.col("x").alias("_d")), "i").select("i", "j", (F.col("_d") * F.col("a")).alias("a"))


def inverse_diagonal_scaling(m: DataFrame) -> DataFrame:
    """D^-1 A."""
    return row_scale(m, diagonal(m).select("i", (1.0 / F.col("x")).alias("x")))


def row_sums(m: DataFrame, of: Column | None = None) -> DataFrame:
    return m.groupBy("i").agg(F.sum(F.col("a") if of is None else of).alias("x"))


def pattern_image(m: DataFrame, buckets: int) -> DataFrame:
    """Counts of stored entries in a buckets x buckets grid (a picture of the pattern): (bi, bj, stored)."""
    top = m.agg((F.greatest(F.max("i"), F.max("j")) + 1).alias("n"))
    cell = lambda c: F.floor(F.col(c) * buckets / F.col("n")).alias(f"b{c}")
    return m.crossJoin(F.broadcast(top)).select(cell("i"), cell("j")).groupBy("bi", "bj").agg(F.count(F.lit(1)).alias("stored"))


def prolong_renumber(marks: DataFrame) -> DataFrame:
    """(i, new): marked rows (mark = 1) numbered from 0 in order of i, without a single task for all rows.

    Rows are put into ranges of i, ranges are counted, and numbers are given within a range on top of the counts before.
    """
    width = 1 << 16
    one = marks.where("mark = 1").select("i", F.floor(F.col("i") / width).alias("_r"))
    counts = one.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return one.join(offsets, "_r").select("i", (F.row_number().over(Window.partitionBy("_r").orderBy("i")) - 1 + F.col("_o")).alias("new"))
