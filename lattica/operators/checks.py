"""Properties of matrices as aggregates of one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import transpose


def diagonal_signs(m: DataFrame) -> DataFrame:
    """n_negative, n_zero (|a| < 1e-20), n_stored diagonal entries."""
    d = m.where("i = j")
    return d.agg(F.count(F.when(F.col("a") < 0, 1)).alias("n_negative"), F.count(F.when(F.abs("a") < 1e-20, 1)).alias("n_zero"), F.count(F.lit(1)).alias("n_stored"))


def weak_rows(m: DataFrame) -> DataFrame:
    """Rows that are not diagonally dominant: a_ii < sum of |a_ij| off it; n_weak of n_rows."""
    per = m.groupBy("i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("a")).otherwise(-F.abs("a"))).alias("s"))
    return per.agg(F.count(F.when(F.col("s") < 0, 1)).alias("n_weak"), F.count(F.lit(1)).alias("n_rows"))


def symmetry(m: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """symmetric_pattern, symmetric_values (relative difference up to the tolerance), largest relative difference."""
    t = transpose(m).select("i", "j", F.col("a").alias("t"))
    both = m.join(t, ["i", "j"], "full")
    gap = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("t", F.lit(0.0)))
    rel = F.when(gap == 0, 0.0).otherwise(gap / (F.abs(F.coalesce("a", F.lit(0.0))) + F.abs(F.coalesce("t", F.lit(0.0)))))
    return both.agg(
        (F.count(F.when(F.col("a").isNull() | F.col("t").isNull(), 1)) == 0).alias("symmetric_pattern"),
        (F.max(rel) <= tolerance).alias("symmetric_values"),
        F.max(rel).alias("largest_difference"),
    )


def validity(m: DataFrame, rows: int, cols: int) -> DataFrame:
    """n_stored, n_outside (positions out of range or null), n_repeated positions, n_empty_rows."""
    outside = F.col("i").isNull() | F.col("j").isNull() | ~F.col("i").between(0, rows - 1) | ~F.col("j").between(0, cols - 1)
    per = m.groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(
        F.sum("c").alias("n_stored"),
        F.coalesce(F.sum(F.when(outside, F.col("c"))), F.lit(0)).alias("n_outside"),
        F.count(F.when(F.col("c") > 1, 1)).alias("n_repeated"),
        (F.lit(rows) - F.countDistinct(F.when(~outside, F.col("i")))).alias("n_empty_rows"),
    )


def row_order(m: DataFrame) -> DataFrame:
    """n_disordered of entries (i, j, a, pos): neighbours in a row whose columns do not ascend."""
    from pyspark.sql.window import Window

    before = F.lag("j").over(Window.partitionBy("i").orderBy("pos"))
    return m.withColumn("_b", before).agg(F.count(F.when(F.col("_b") >= F.col("j"), 1)).alias("n_disordered"))
