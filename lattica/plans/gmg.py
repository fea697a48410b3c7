"""Geometric multigrid for the Poisson equation on tensor grids: vectors are grid tables (x[, y[, z]], u) over interior points.

Stencils are sums over shifted copies of the grid, joined on coordinates; restriction and interpolation are projections of
coordinates. Grids of at most ``LOCAL`` points are arrays. Points run from 1 to n - 1 in each direction, n a power of 2.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written
from .krylov import Control, Problem, Result, Status, cg
from .space import LocalSpace

LOCAL = 2_000_000
AXES = ("x", "y", "z")


def grid(spark: SparkSession, n: int, dim: int, value: str = "0D") -> DataFrame:
    """All interior points with u given as an SQL expression of x, y, z and n."""
    m = n - 1
    cols = [f"cast(id div {m**k} % {m} + 1 as int) as {AXES[k]}" for k in range(dim)]
    return spark.range(m**dim).selectExpr(*cols).selectExpr(*AXES[:dim], f"cast({value.replace('{n}', str(n))} as double) as u")


def apply_stencil(g: DataFrame, dim: int) -> DataFrame:
    """A u of the (2 dim + 1)-point operator: 2 dim u minus the neighbours. One grouped sum over shifted copies."""
    axes = AXES[:dim]
    copies = [F.struct(*[F.col(a) for a in axes], (2 * dim * F.col("u")).alias("v"), F.lit(1).alias("own"))]
    for k, s in itertools.product(range(dim), (-1, 1)):
        copies.append(F.struct(*[(F.col(a) + (s if i == k else 0)).cast("int").alias(a) for i, a in enumerate(axes)], (-F.col("u")).alias("v"), F.lit(0).alias("own")))
    spread = g.select(F.explode(F.array(*copies)).alias("s")).select(*[f"s.{a}" for a in axes], "s.v", "s.own")
    return spread.groupBy(*axes).agg(F.sum("v").alias("u"), F.max("own").alias("own")).where("own = 1").drop("own")


def residual(b: DataFrame, u: DataFrame, dim: int) -> DataFrame:
    axes = list(AXES[:dim])
    image = apply_stencil(u, dim).withColumnRenamed("u", "_au")
    return b.join(image, axes, "left").select(*axes, (F.col("u") - F.coalesce("_au", F.lit(0.0))).alias("u"))


def two_colour_sweep(b: DataFrame, u: DataFrame, dim: int, first: int = 0) -> DataFrame:
    """Red-black Gauss-Seidel: points of even, then of odd coordinate sum (or the other way round)."""
    axes = list(AXES[:dim])
    parity = sum((F.col(a) for a in axes), F.lit(0)) % 2
    for c in (first, 1 - first):
        r = residual(b, u, dim).withColumnRenamed("u", "_r")
        u = u.join(r, axes).select(*axes, F.when(parity == c, F.col("u") + F.col("_r") / (2 * dim)).otherwise(F.col("u")).alias("u"))
    return u


# Arrays of bounded size: the same method


def _image(u: np.ndarray) -> np.ndarray:
    p = np.pad(u, 1)
    out = 2 * u.ndim * u
    mid = (slice(1, -1),) * u.ndim
    for k in range(u.ndim):
        for s in (slice(0, -2), slice(2, None)):
            at = list(mid)
            at[k] = s
            out = out - p[tuple(at)]
    return out


def _smooth(b: np.ndarray, u: np.ndarray, first: int) -> np.ndarray:
    colour = sum(np.ix_(*[np.arange(1, n + 1) for n in u.shape])) % 2
    for c in (first, 1 - first):
        u = np.where(colour == c, u + (b - _image(u)) / (2 * u.ndim), u)
    return u


def _line(n: int) -> np.ndarray:
    """Linear interpolation from n // 2 - 1 to n - 1 interior points."""
    out = np.zeros((n - 1, n // 2 - 1))
    for k in range(n // 2 - 1):
        out[2 * k : 2 * k + 3, k] = (0.5, 1.0, 0.5)
    return out


def _along(t: np.ndarray, u: np.ndarray) -> np.ndarray:
    for k in range(u.ndim):
        u = np.moveaxis(np.tensordot(t, u, (1, k)), 0, k)
    return u


def _vcycle(b: np.ndarray, u: np.ndarray, depth: int = 0) -> np.ndarray:
    n = b.shape[0] + 1
    if n == 2:
        return b / (2 * b.ndim)
    if n % 2:
        raise ValueError("grids must halve evenly")
    sweeps = min(depth + 1, 3)
    for _ in range(sweeps):
        u = _smooth(b, u, 0)
    t = _line(n)
    # The stencil carries no mesh width: a coarse residual is 4 times the full weighting.
    r = _along(t.T / 2, b - _image(u)) * 4
    u = u + _along(t, _vcycle(r, np.zeros_like(r), depth + 1))
    for _ in range(sweeps):
        u = _smooth(b, u, 1)
    return u


def _full(b: np.ndarray) -> np.ndarray:
    n = b.shape[0] + 1
    if n == 2:
        return b / (2 * b.ndim)
    t = _line(n)
    u = _along(t, _full(_along(t.T / 2, b) * 4))
    return _vcycle(b, u)


def to_array(g: DataFrame, n: int, dim: int) -> np.ndarray:
    if (n - 1) ** dim > LOCAL:
        raise ValueError("too large for an array")
    rows = g.toPandas()
    out = np.zeros((n - 1,) * dim)
    out[tuple(rows[a].to_numpy() - 1 for a in AXES[:dim])] = rows["u"].to_numpy()
    return out


def from_array(spark: SparkSession, u: np.ndarray) -> DataFrame:
    import pandas as pd

    at = np.indices(u.shape).reshape(u.ndim, -1) + 1
    frame = pd.DataFrame({**{a: at[k].astype("int32") for k, a in enumerate(AXES[: u.ndim])}, "u": u.ravel()})
    return spark.createDataFrame(frame, ", ".join(f"{a} int" for a in AXES[: u.ndim]) + ", u double")


def restrict(r: DataFrame, dim: int) -> DataFrame:
    """Full weighting onto even points, times 4 for the mesh width."""
    axes = AXES[:dim]
    copies = []
    for shift in itertools.product((-1, 0, 1), repeat=dim):
        w = 4 * math.prod(0.25 if s else 0.5 for s in shift)
        copies.append(F.struct(*[(F.col(a) + s).cast("int").alias(a) for a, s in zip(axes, shift)], (w * F.col("u")).alias("u")))
    even = [F.col(a) % 2 == 0 for a in axes]
    keep = even[0]
    for e in even[1:]:
        keep = keep & e
    spread = r.select(F.explode(F.array(*copies)).alias("s")).select("s.*").where(keep)
    bound = r.agg(F.max(axes[0]).alias("_m"))
    inside = spread.crossJoin(F.broadcast(bound)).where(" and ".join(f"{a} > 0 and {a} <= _m" for a in axes)).drop("_m")
    return inside.groupBy(*axes).agg(F.sum("u").alias("u")).select(*[(F.col(a) / 2).cast("int").alias(a) for a in axes], "u")


def interpolate(e: DataFrame, n: int, dim: int) -> DataFrame:
    """Multilinear interpolation to the grid of n intervals."""
    axes = AXES[:dim]
    copies = []
    for shift in itertools.product((-1, 0, 1), repeat=dim):
        w = math.prod(0.5 if s else 1.0 for s in shift)
        copies.append(F.struct(*[(2 * F.col(a) + s).cast("int").alias(a) for a, s in zip(axes, shift)], (w * F.col("u")).alias("u")))
    spread = e.select(F.explode(F.array(*copies)).alias("s")).select("s.*")
    return spread.where(" and ".join(f"{a} between 1 and {n - 1}" for a in axes)).groupBy(*axes).agg(F.sum("u").alias("u"))


def v_cycle(b: DataFrame, u: DataFrame, n: int, dim: int, depth: int = 0, local: int = LOCAL) -> DataFrame:
    """One V-cycle on a distributed grid; grids of at most ``local`` points are finished as arrays."""
    spark, axes = b.sparkSession, list(AXES[:dim])
    if (n - 1) ** dim <= local:
        return from_array(spark, _vcycle(to_array(b, n, dim), to_array(u, n, dim), depth))
    for _ in range(min(depth + 1, 3)):
        u = written(two_colour_sweep(b, u, dim, 0), "gmg")
    r = written(restrict(residual(b, u, dim), dim), "gmg")
    e = v_cycle(r, r.withColumn("u", F.lit(0.0)), n // 2, dim, depth + 1, local)
    u = written(u.unionByName(interpolate(e, n, dim)).groupBy(*axes).agg(F.sum("u").alias("u")), "gmg")
    for _ in range(min(depth + 1, 3)):
        u = written(two_colour_sweep(b, u, dim, 1), "gmg")
    return u


def solve(b: DataFrame, n: int, dim: int, tol: float = 1e-6, maxit: int = 100, method: str = "v", local: int = LOCAL) -> Result:
    """Poisson on a grid: V-cycles (``v``), full multigrid first (``full``), or CG preconditioned by a V-cycle (``cg``)."""
    spark = b.sparkSession
    if (n - 1) ** dim <= local:
        f = to_array(b, n, dim)
        size = float(np.linalg.norm(f)) or 1.0
        if method == "cg":
            shape = f.shape
            p = Problem(LocalSpace(f.size), lambda v: _image(v.reshape(shape)).ravel(), f.ravel(), lambda v: _vcycle(v.reshape(shape), np.zeros(shape)).ravel())
            got = cg(p, Control(tol=tol, maxit=maxit))
            return Result(from_array(spark, got.x.reshape(shape)), got.iterations, got.status, got.residuals)
        u = _full(f) if method == "full" else np.zeros_like(f)
        history = []
        for it in range(1, maxit + 1):
            if method != "full" or it > 1:
                u = _vcycle(f, u)
            history.append(float(np.linalg.norm(f - _image(u))) / size)
            if history[-1] < tol:
                return Result(from_array(spark, u), it, Status.OK, history)
        return Result(from_array(spark, u), maxit, Status.MAX_ITERATIONS, history)
    if method != "v":
        raise ValueError("distributed grids are solved by V-cycles")
    norm = lambda g: float(g.agg(F.sqrt(F.sum(F.col("u") * F.col("u")))).first()[0] or 0.0)
    size, u, history = norm(b) or 1.0, b.withColumn("u", F.lit(0.0)), []
    for it in range(1, maxit + 1):
        u = v_cycle(b, u, n, dim, 0, local)
        history.append(norm(residual(b, u, dim)) / size)
        if history[-1] < tol:
            return Result(u, it, Status.OK, history)
    return Result(u, maxit, Status.MAX_ITERATIONS, history)
