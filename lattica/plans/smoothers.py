"""Stationary iterations on distributed vectors: one join and one grouped sum per sweep (or per colour).

Sweeps in a given order are data-dependent; ``colour_sweep`` updates one colour after another, which is exact
Gauss-Seidel for the order (colour, then any order within it) when no two neighbours share a colour. Exact sweeps in
natural order, for systems of bounded size, are in ``local``. A plan reads its vector twice per sweep, so between two
sweeps, colours or steps the vector is written: plans stay of one size whatever the number of sweeps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written

TINY = 1e-20


def split_rows(m: DataFrame, x: DataFrame) -> DataFrame:
    """(i, d, s): the diagonal entry and the sum of a_ij x_j off it, of every row."""
    joined = m.join(x.select(F.col("i").alias("j"), F.col("x").alias("_v")), "j", "left")
    on = F.col("i") == F.col("j")
    return joined.groupBy("i").agg(F.sum(F.when(on, F.col("a"))).alias("d"), F.coalesce(F.sum(F.when(~on, F.col("a") * F.coalesce("_v", F.lit(0.0)))), F.lit(0.0)).alias("s"))


def _update(m: DataFrame, b: DataFrame, x: DataFrame, new: Column, where: DataFrame | None = None) -> DataFrame:
    """x with ``new`` (of d, s, bb, x) in the rows of ``where`` (i), or in all; rows with a tiny diagonal stay."""
    rows = m if where is None else m.join(where.select("i"), "i", "left_semi")
    base = x.join(b.select("i", F.col("x").alias("bb")), "i", "left").join(split_rows(rows, x), "i", "left").fillna(0.0, ["bb"])
    return base.select("i", F.when(F.abs("d") > TINY, new).otherwise(F.col("x")).alias("x"))


def jacobi(m: DataFrame, b: DataFrame, x: DataFrame, omega: float = 1.0, sweeps: int = 1, only: DataFrame | None = None) -> DataFrame:
    """Weighted Jacobi; with ``only`` (i), just those rows change."""
    for k in range(sweeps):
        x = written(x, "sweep") if k else x
        x = _update(m, b, x, (1 - omega) * F.col("x") + omega * (F.col("bb") - F.col("s")) / F.col("d"), only)
    return x


def l1_diagonal(m: DataFrame, b: DataFrame, x: DataFrame, sweeps: int = 1) -> DataFrame:
    """x + (b - A x)_i / sum_j |a_ij|."""
    for k in range(sweeps):
        x = written(x, "sweep") if k else x
        v = x.select(F.col("i").alias("j"), F.col("x").alias("_v"))
        rows = m.join(v, "j", "left").groupBy("i").agg(F.sum(F.col("a") * F.coalesce("_v", F.lit(0.0))).alias("_ax"), F.sum(F.abs("a")).alias("_l1"))
        x = x.join(b.select("i", F.col("x").alias("_b")), "i", "left").join(rows, "i", "left").select("i", F.when(F.col("_l1") > TINY, F.col("x") + (F.coalesce("_b", F.lit(0.0)) - F.col("_ax")) / F.col("_l1")).otherwise(F.col("x")).alias("x"))
    return x


def colour_sweep(m: DataFrame, b: DataFrame, x: DataFrame, colours: DataFrame, omega: float = 1.0, order: list[int] | None = None) -> DataFrame:
    """One Gauss-Seidel (omega 1) or SOR sweep, colour after colour of ``colours`` (i, c)."""
    if order is None:
        order = sorted(r["c"] for r in colours.select("c").distinct().collect())  # as many as there are colours
    for k, c in enumerate(order):
        x = written(x, "sweep") if k else x
        new = (1 - omega) * F.col("x") + omega * (F.col("bb") - F.col("s")) / F.col("d")
        x = _update(m, b, x, new, colours.where(F.col("c") == c))
    return x


def symmetric_sweep(m: DataFrame, b: DataFrame, x: DataFrame, colours: DataFrame, omega: float = 1.0) -> DataFrame:
    """Forward, then backward over the colours: SGS, or SSOR with a weight."""
    order = sorted(r["c"] for r in colours.select("c").distinct().collect())
    return colour_sweep(m, b, written(colour_sweep(m, b, x, colours, omega, order), "sweep"), colours, omega, order[::-1])


def cf_sweep(m: DataFrame, b: DataFrame, x: DataFrame, marks: DataFrame, colours: DataFrame, coarse_first: bool = True, omega: float = 1.0) -> DataFrame:
    """Colour sweep with C points (mark 1) before or after the others."""
    first = F.when(F.col("mark") == 1, 0 if coarse_first else 1).otherwise(1 if coarse_first else 0)
    most = int(colours.agg(F.max("c")).first()[0] or 0) + 1
    both = colours.join(marks.select("i", "mark"), "i").select("i", (first * most + F.col("c")).alias("c"))
    return colour_sweep(m, b, x, both, omega)


def block_jacobi_kaczmarz(m: DataFrame, b: DataFrame, x: DataFrame, omega: float = 1.0, sweeps: int = 1) -> DataFrame:
    """Row projections done for all rows at once and weighted by the rows' hits per column (component-averaged Kaczmarz)."""
    for k in range(sweeps):
        x = written(x, "sweep") if k else x
        v = x.select(F.col("i").alias("j"), F.col("x").alias("_v"))
        rows = m.join(v, "j", "left").groupBy("i").agg(F.sum(F.col("a") * F.coalesce("_v", F.lit(0.0))).alias("_ax"), F.sum(F.col("a") * F.col("a")).alias("_n"))
        pull = rows.join(b.select("i", F.col("x").alias("_b")), "i", "left").where(F.col("_n") > TINY).select("i", ((F.coalesce("_b", F.lit(0.0)) - F.col("_ax")) / F.col("_n")).alias("_k"))
        step = m.join(pull, "i").groupBy(F.col("j").alias("i")).agg((F.sum(F.col("a") * F.col("_k")) / F.count(F.lit(1))).alias("_s"))
        x = x.join(step, "i", "left").select("i", (F.col("x") + omega * F.coalesce("_s", F.lit(0.0))).alias("x"))
    return x


def inverse_norm(m: DataFrame) -> float:
    """1 / |D^-1 A| in the maximum norm (one scalar)."""
    on = F.col("i") == F.col("j")
    rows = m.groupBy("i").agg(F.sum(F.abs("a")).alias("_s"), F.sum(F.when(on, F.col("a"))).alias("_d"))
    return 1.0 / float(rows.agg(F.max(F.col("_s") / F.abs("_d"))).first()[0])


def reciprocal_weights(ratio: float, degree: int) -> tuple[float, list[float]]:
    """(a, weights): sum of weights[n] T_n(s) is the best uniform approximation of degree ``degree`` to 1 / (a + s) on [-1, 1].

    ``ratio`` is the right end over the left end of the interval of t = c + w s (centre c, half width w), so that
    1 / t = 1 / (w (a + s)) with a = c / w. With rho = a - sqrt(a^2 - 1), the Chebyshev series of 1 / (a + s) is
    (1 + 2 sum (-rho)^n T_n) / sqrt(a^2 - 1). Cutting it after T_degree leaves a geometric tail of alternating terms; giving
    the whole tail's weight in steps of two to the last term, a factor 1 / (1 - rho^2), makes the error equioscillate.
    """
    a = (ratio + 1) / (ratio - 1)
    root = math.sqrt(a * a - 1)
    rho = a - root
    weights = [2 * (-rho) ** n / root for n in range(degree + 1)]
    weights[0] /= 2
    weights[degree] = (1 + rho * rho) / (1 - rho * rho) / root if degree == 0 else weights[degree] / (1 - rho * rho)
    return a, weights


def polynomial(m: DataFrame, b: DataFrame, x: DataFrame, degree: int = 2, sweeps: int = 1, shrink: float | None = None) -> DataFrame:
    """x + p(D^-1 A) D^-1 (b - A x), p the best uniform approximation to 1 / t on the upper three quarters of the spectrum.

    The spectrum of D^-1 A ends at most at its maximum norm 1 / ``shrink``; p is summed by Chebyshev's recurrence
    T_{n+1} = 2 S T_n - T_{n-1} for the shifted operator S = (D^-1 A - centre) / half width, a product per degree.
    """
    if degree < 1:
        raise ValueError("degree 1 at least")
    high = 1 / (inverse_norm(m) if shrink is None else shrink)
    low = high / 4
    half, (shift, weights) = (high - low) / 2, reciprocal_weights(high / low, degree)
    scale = written(m.where("i = j").select("i", (1.0 / F.col("a")).alias("_w")), "scale")

    def scaled(v: DataFrame) -> DataFrame:
        """(i, _y): D^-1 A v."""
        return m.join(v.select(F.col("i").alias("j"), F.col("x").alias("_v")), "j").groupBy("i").agg(F.sum(F.col("a") * F.col("_v")).alias("_y")).join(scale, "i").select("i", (F.col("_w") * F.col("_y")).alias("_y"))

    none = F.lit(0.0)
    for k in range(sweeps):
        x = written(x, "sweep") if k else x
        start = F.coalesce(F.col("_w") * F.coalesce("_b", none), none) - F.coalesce("_y", none)
        state = x.join(b.select("i", F.col("x").alias("_b")), "i", "left").join(scale, "i", "left").join(scaled(x), "i", "left").select("i", "x", start.alias("now"), F.lit(0.0).alias("before"))
        state = state.select("i", "x", "now", "before", (weights[0] * F.col("now")).alias("sum"))
        for n in range(1, degree + 1):
            state = written(state, "chebyshev")
            image = (F.coalesce("_y", none) / half - shift * F.col("now")) * (1.0 if n == 1 else 2.0) - F.col("before")
            state = state.join(scaled(state.select("i", F.col("now").alias("x"))), "i", "left").select("i", "x", image.alias("next"), "now", "sum")
            state = state.select("i", "x", F.col("next").alias("now"), F.col("now").alias("before"), (F.col("sum") + weights[n] * F.col("next")).alias("sum"))
        x = state.select("i", (F.col("x") + F.col("sum") / half).alias("x"))
    return x
