"""Small dense blocks as array<double> columns, row by row: native array functions, and Arrow batches for inverses.

Blocks of one column all have the same size nb.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scale(a: Column, alpha: float) -> Column:
    return F.transform(a, lambda x: F.lit(float(alpha)) * x)


def add(a: Column, b: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: F.lit(float(alpha)) * x + F.lit(float(beta)) * y)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def times_vector(a: Column, v: Column, nb: int) -> Column:
    """A v."""
    return F.transform(F.sequence(F.lit(0), F.lit(nb - 1)), lambda r: _sum(F.zip_with(F.slice(a, r * nb + 1, F.lit(nb)), v, lambda x, y: x * y)))


def times(a: Column, b: Column, nb: int) -> Column:
    """A B."""

    def entry(k: Column) -> Column:
        row, col = F.floor(k / nb).cast("int"), k % nb
        return _sum(F.transform(F.sequence(F.lit(0), F.lit(nb - 1)), lambda t: F.get(a, row * nb + t) * F.get(b, t * nb + col)))

    return F.transform(F.sequence(F.lit(0), F.lit(nb * nb - 1)), entry)


def transpose(a: Column, nb: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(nb * nb - 1)), lambda k: F.get(a, (k % nb) * nb + F.floor(k / nb).cast("int")))


def identity(nb: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(nb * nb - 1)), lambda k: F.when(k % (nb + 1) == 0, 1.0).otherwise(0.0))


def norm_inf(a: Column, nb: int) -> Column:
    """Largest row sum of |a|."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(nb - 1)), lambda r: _sum(F.transform(F.slice(a, r * nb + 1, F.lit(nb)), F.abs))))


def norm_one(a: Column, nb: int) -> Column:
    return norm_inf(transpose(a, nb), nb)


def norm_fro(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def norm_max(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def inverse_udf(nb: int):
    """Inverse of each block: one batched LAPACK call per Arrow batch. A singular block gives null."""

    @F.pandas_udf("array<double>")
    def inverse(blocks: pd.Series) -> pd.Series:
        if not len(blocks):
            return blocks
        a = np.stack([np.asarray(x, float) for x in blocks]).reshape(-1, nb, nb)
        try:
            return pd.Series(list(np.linalg.inv(a).reshape(len(a), -1)))
        except np.linalg.LinAlgError:
            ok = np.abs(np.linalg.det(a)) > 0
            return pd.Series([np.linalg.inv(x).ravel() if good else None for x, good in zip(a, ok)])

    return inverse


def solve_udf(nb: int):
    """Solution of A x = b per row, with pivoting."""

    @F.pandas_udf("array<double>")
    def solve(blocks: pd.Series, rhs: pd.Series) -> pd.Series:
        if not len(blocks):
            return rhs
        a = np.stack([np.asarray(x, float) for x in blocks]).reshape(-1, nb, nb)
        b = np.stack([np.asarray(x, float) for x in rhs])
        return pd.Series(list(np.linalg.solve(a, b[..., None])[..., 0]))

    return solve


# Block matrices (bi, bj, blk) and block vectors (b, v array<double>)


def block_spmv(m: DataFrame, v: DataFrame, nb: int) -> DataFrame:
    """A v for block rows: products per block, then sums per place."""
    joined = m.join(v.select(F.col("b").alias("bj"), "v"), "bj").select("bi", F.posexplode(times_vector(F.col("blk"), F.col("v"), nb)).alias("k", "x"))
    summed = joined.groupBy("bi", "k").agg(F.sum("x").alias("x")).groupBy("bi").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("s"))
    return summed.select(F.col("bi").alias("b"), F.transform("s", lambda e: e["x"]).alias("v"))


def block_transpose(m: DataFrame, nb: int) -> DataFrame:
    return m.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), transpose(F.col("blk"), nb).alias("blk"))


def block_compress(m: DataFrame, tolerance: float) -> DataFrame:
    """Blocks with a largest |entry| above the tolerance, and every diagonal block."""
    return m.where((norm_max(F.col("blk")) > tolerance) | (F.col("bi") == F.col("bj")))


def block_diagonal_inverse(m: DataFrame, nb: int) -> DataFrame:
    return m.where("bi = bj").select("bi", inverse_udf(nb)(F.col("blk")).alias("inv"))


def block_inverse_diagonal_scaling(m: DataFrame, nb: int) -> DataFrame:
    """D^-1 A by blocks."""
    return m.join(block_diagonal_inverse(m, nb), "bi").select("bi", "bj", times(F.col("inv"), F.col("blk"), nb).alias("blk"))


def ldu_udf(nb: int):
    """Inverses of L and of U in the form L D U of each block, without pivoting; null where a pivot is 0."""

    @F.pandas_udf("left array<double>, right array<double>")
    def ldu(blocks: pd.Series) -> pd.DataFrame:
        rest = np.stack([np.asarray(x, float) for x in blocks]).reshape(-1, nb, nb) if len(blocks) else np.zeros((0, nb, nb))
        left, good = np.tile(np.eye(nb), (len(rest), 1, 1)), np.ones(len(rest), bool)
        for k in range(nb):
            pivot = rest[:, k, k].copy()
            good &= pivot != 0
            factor = rest[:, k + 1 :, k, None] / np.where(pivot == 0, 1.0, pivot)[:, None, None]
            left[:, k + 1 :] -= factor * left[:, k, None, :]
            rest[:, k + 1 :] -= factor * rest[:, k, None, :]
        rest[~good] = np.eye(nb)
        right = np.linalg.inv(rest) * np.diagonal(rest, axis1=1, axis2=2)[:, None, :]
        return pd.DataFrame({n: [x.ravel() if g else None for x, g in zip(v, good)] for n, v in (("left", left), ("right", right))})

    return ldu


def block_ldu_scaling(m: DataFrame, nb: int) -> DataFrame:
    """L^-1 A U^-1 with L and U of the diagonal blocks, which become diagonal themselves.

    Block rows and columns whose diagonal block is not stored or has no such form keep that side as it is.
    """
    parts = m.where("bi = bj").select(F.col("bi").alias("_b"), ldu_udf(nb)(F.col("blk")).alias("_f")).select("_b", "_f.left", "_f.right")
    rows, cols = parts.select(F.col("_b").alias("bi"), "left"), parts.select(F.col("_b").alias("bj"), "right")
    half = m.join(rows, "bi", "left").select("bi", "bj", F.when(F.col("left").isNull(), F.col("blk")).otherwise(times(F.col("left"), F.col("blk"), nb)).alias("blk"))
    return half.join(cols, "bj", "left").select("bi", "bj", F.when(F.col("right").isNull(), F.col("blk")).otherwise(times(F.col("blk"), F.col("right"), nb)).alias("blk"))


def condense(m: DataFrame, nb: int, norm: str = "fro") -> DataFrame:
    """A scalar matrix of block norms (fro, one, inf, max, or first: the (0, 0) entry)."""
    kinds = {"fro": lambda c: norm_fro(c), "one": lambda c: norm_one(c, nb), "inf": lambda c: norm_inf(c, nb), "max": norm_max, "first": lambda c: F.get(c, 0)}
    return m.select(F.col("bi").alias("i"), F.col("bj").alias("j"), kinds[norm](F.col("blk")).alias("a"))
