"""Products of sparse matrices and vectors as equi-joins with grouped sums (partial sums before the shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from . import blocked
from .matrix import matrix, transpose


def spmv(m: DataFrame, v: DataFrame) -> DataFrame:
    """A x; rows without a stored entry are left out."""
    return m.join(v.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("a") * F.col("x")).alias("x"))


def spmv_boolean(m: DataFrame, v: DataFrame) -> DataFrame:
    """A x for a matrix whose stored entries are all 1 (aggregation maps): no multiplication."""
    return m.select("i", "j").join(v.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum("x").alias("x"))


def axpy_spmv(alpha: float, m: DataFrame, v: DataFrame, y: DataFrame) -> DataFrame:
    """y + alpha A x."""
    return y.unionByName(spmv(m, v).select("i", (F.lit(float(alpha)) * F.col("x")).alias("x"))).groupBy("i").agg(F.sum("x").alias("x"))


def bilinear(y: DataFrame, m: DataFrame, x: DataFrame) -> DataFrame:
    """One row: y^T A x."""
    joined = m.join(x.select(F.col("i").alias("j"), F.col("x").alias("_x")), "j").join(y.select("i", F.col("x").alias("_y")), "i")
    return joined.agg(F.coalesce(F.sum(F.col("_y") * F.col("a") * F.col("_x")), F.lit(0.0)).alias("yax"))


def left_spmv(v: DataFrame, m: DataFrame) -> DataFrame:
    """v^T A as a vector over the columns."""
    return m.join(v, "i").groupBy("j").agg(F.sum(F.col("x") * F.col("a")).alias("x")).withColumnRenamed("j", "i")


def left_pattern(v: DataFrame, m: DataFrame) -> DataFrame:
    """Columns that v^T A can fill (the symbolic product): (i)."""
    return m.join(v.select("i"), "i").select(F.col("j").alias("i")).distinct()


def spgemm(m: DataFrame, n: DataFrame) -> DataFrame:
    """A B."""
    right = n.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("a").alias("_b"))
    return m.join(right, m["j"] == right["_k"]).groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("a") * F.col("_b")).alias("a"))


def spgemm_pattern(m: DataFrame, n: DataFrame) -> DataFrame:
    right = n.select(F.col("i").alias("_k"), F.col("j").alias("_j"))
    return m.join(right, m["j"] == right["_k"]).select("i", F.col("_j").alias("j")).distinct()


def sandwich(m: DataFrame, d: DataFrame, n: DataFrame) -> DataFrame:
    """A diag(d) B."""
    scaled = m.join(d.select(F.col("i").alias("j"), F.col("x").alias("_d")), "j").select("i", "j", (F.col("a") * F.col("_d")).alias("a"))
    return spgemm(scaled, n)


def galerkin(r: DataFrame, m: DataFrame, p: DataFrame) -> DataFrame:
    """R A P. (A P) first: P is thin."""
    return spgemm(r, spgemm(m, p))


def galerkin_in_blocks(r: DataFrame, m: DataFrame, p: DataFrame) -> DataFrame:
    """R A P where A P and the result fill up: by ``blocked``. Reads its inputs up to four times."""
    got = blocked.galerkin(r, m, p)
    return galerkin(r, m, p) if got is None else got


def _summed(m: DataFrame) -> DataFrame:
    return written(matrix(m, "i", "j", "a"), "summed")


def _summed_if_repeated(m: DataFrame) -> DataFrame:
    """Summed where the stored entries are over 1.25 times the positions, by estimate; what is not summed is added up in the product."""
    n, positions = m.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("i", "j"))).first()
    return _summed(m) if n > 1.25 * positions else m


def galerkin_of_gram(r: DataFrame, b: DataFrame, p: DataFrame | None = None) -> DataFrame:
    """R (B^T B) P by ``blocked``, P = R^T unless given; entries of equal positions are added up. B^T B is not made as a table:
    this pays off where it has many more entries than B. Reads its inputs up to five times."""
    r, b = _summed_if_repeated(r), _summed_if_repeated(b)
    got = blocked.galerkin(r, b, transpose(r) if p is None else (p := _summed_if_repeated(p)), gram=True)
    if got is None:  # summed, they may have no nulls
        r, b, p = _summed(r), _summed(b), None if p is None else _summed(p)
        got = blocked.galerkin(r, b, transpose(r) if p is None else p, gram=True)
    return galerkin(r, gram(b), transpose(r) if p is None else p) if got is None else got


def ptap(p: DataFrame, m: DataFrame) -> DataFrame:
    """P^T A P; P^T is the same rows read the other way."""
    return galerkin(p.select(F.col("j").alias("i"), F.col("i").alias("j"), "a"), m, p)


def galerkin_boolean(aggregate: DataFrame, m: DataFrame) -> DataFrame:
    """P^T A P for a map (i, agg): renaming both positions and summing, no multiplication."""
    rows = aggregate.select("i", F.col("agg").alias("_i"))
    cols = aggregate.select(F.col("i").alias("j"), F.col("agg").alias("_j"))
    return m.join(rows, "i").join(cols, "j").groupBy(F.col("_i").alias("i"), F.col("_j").alias("j")).agg(F.sum("a").alias("a"))


def gram(m: DataFrame) -> DataFrame:
    """A^T A."""
    return spgemm(m.select(F.col("j").alias("i"), F.col("i").alias("j"), "a"), m)


def schur(d2: DataFrame, m: DataFrame, d1: DataFrame, n: DataFrame) -> DataFrame:
    """diag(d2) - A diag(d1) B, by ``blocked``. Reads its inputs up to four times."""
    top, middle = (d.select("i", F.col("i").alias("j"), F.col("x").alias("a")) for d in (d2, d1))
    got = blocked.galerkin(m, middle, n, plus=top, sign=-1.0)
    if got is not None:
        return got
    low = sandwich(m, d1, n).select("i", "j", (-F.col("a")).alias("a"))
    return top.unionByName(low).groupBy("i", "j").agg(F.sum("a").alias("a"))


def residual(b: DataFrame, m: DataFrame, x: DataFrame) -> DataFrame:
    """b - A x."""
    return axpy_spmv(-1.0, m, x, b)
