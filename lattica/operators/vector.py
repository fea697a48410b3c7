"""Vector operators: projections over equi-joins on the position, and grouped sums. Sparse vectors lack their zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.select("i", F.col("x").alias("_x")).join(y.select("i", F.col("x").alias("_y")), "i", "full").select("i", F.coalesce("_x", F.lit(0.0)).alias("_x"), F.coalesce("_y", F.lit(0.0)).alias("_y"))


def scale(x: DataFrame, a: float) -> DataFrame:
    return x.select("i", (F.lit(float(a)) * F.col("x")).alias("x"))


def axpby(a: float, x: DataFrame, b: float, y: DataFrame) -> DataFrame:
    """a x + b y."""
    return _both(x, y).select("i", (F.lit(float(a)) * F.col("_x") + F.lit(float(b)) * F.col("_y")).alias("x"))


def axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    return axpby(a, x, 1.0, y)


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: the inner product; only positions that both store count."""
    both = x.select("i", F.col("x").alias("_x")).join(y.select("i", F.col("x").alias("_y")), "i")
    return both.agg(F.coalesce(F.sum(F.col("_x") * F.col("_y")), F.lit(0.0)).alias("dot"))


def norms(x: DataFrame) -> DataFrame:
    """One row: norm1, norm2, norminf."""
    return x.agg(F.coalesce(F.sum(F.abs("x")), F.lit(0.0)).alias("norm1"), F.sqrt(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("norm2"), F.coalesce(F.max(F.abs("x")), F.lit(0.0)).alias("norminf"))


def max_difference(x: DataFrame, y: DataFrame) -> DataFrame:
    return _both(x, y).agg(F.max(F.abs(F.col("_x") - F.col("_y"))).alias("max_difference"))


def relative_error(x: DataFrame, y: DataFrame) -> DataFrame:
    """|x - y| / |x|."""
    d = F.col("_x") - F.col("_y")
    return _both(x, y).agg((F.sqrt(F.sum(d * d)) / F.sqrt(F.sum(F.col("_x") * F.col("_x")))).alias("relative_error"))


def has_nan(x: DataFrame) -> DataFrame:
    return x.agg(F.coalesce(F.max(F.isnan("x")), F.lit(False)).alias("has_nan"))


def hadamard(x: DataFrame, y: DataFrame) -> DataFrame:
    return _both(x, y).select("i", (F.col("_x") * F.col("_y")).alias("x"))
