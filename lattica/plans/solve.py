"""Solver entry points: one call for scalar, block and banded matrices and for bare operators.

``solve`` picks a Krylov method by code or name, builds the preconditioner and runs on distributed vectors, or in memory
when the system has at most ``local_rows`` rows (its size is checked before anything is collected).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense
from ..operators import formats, matrix, products
from . import amg, krylov, local, smoothers
from .krylov import Control, Problem, Result, Status
from .params import SolverParams
from .space import FrameSpace, LocalMatrix, LocalSpace, multiply

LOCAL_ROWS = 20_000


@dataclass
class Solution:
    """x as (i, x), iterations or a negative status, and the residual history."""

    x: DataFrame
    code: int
    residuals: list[float]

    @property
    def converged(self) -> bool:
        return self.code >= 0


def _method(method: int | str) -> tuple[int, Callable, bool]:
    for code, (name, run, safe) in krylov.METHODS.items():
        if method in (code, name):
            return code, run, safe
    raise ValueError(f"no Krylov method {method}")


def diagonal_preconditioner(m: DataFrame | LocalMatrix) -> Callable:
    if isinstance(m, LocalMatrix):
        d = m.diagonal()
        w = np.where(np.abs(d) > local.TINY, 1 / np.where(d == 0, 1, d), 1.0)
        return lambda r: w * r
    d = matrix.diagonal(m).select("i", F.col("x").alias("_d"))
    return lambda r: r.join(d, "i", "left").select("i", F.when(F.abs("_d") > smoothers.TINY, F.col("x") / F.col("_d")).otherwise(F.col("x")).alias("x"))


def block_diagonal_preconditioner(blocks: DataFrame, nb: int) -> Callable:
    """D^-1 r by blocks: inverses once, then a join on the block row."""
    inv = dense.block_diagonal_inverse(blocks, nb)
    cells = inv.select("bi", F.posexplode("inv").alias("k", "w")).select((F.col("bi") * nb + F.floor(F.col("k") / nb)).alias("i"), (F.col("bi") * nb + F.col("k") % nb).alias("j"), F.col("w").alias("a"))
    return lambda r: products.spmv(cells, r)


def ilu_preconditioner(m: LocalMatrix, kind: str = "k", fill: int = 0, drop: float = 1e-3) -> Callable:
    low, up = local.ilu(m, fill) if kind == "k" else local.ilu(m, drop=drop, keep=m.n // 2 + 1)
    return lambda r: local.triangular_solve(low, up, r)


def schwarz_preconditioner(m: LocalMatrix, depth: int = 2, kind: str = "symmetric") -> Callable:
    blocks = local.schwarz_blocks(m, depth)

    def apply(r):
        x = np.zeros(m.n)
        if kind != "backward":
            x = local.schwarz_sweep(m, r, x, blocks)
        return local.schwarz_sweep(m, r, x, blocks, True) if kind != "forward" else x

    return apply


def additive_schwarz(m: DataFrame, balls: DataFrame) -> Callable:
    """Distributed counterpart: blocks (root, i) solve their local systems at once, weighted by how many blocks hold a row."""
    import pandas as pd

    cover = balls.groupBy("i").agg(F.count(F.lit(1)).alias("_c"))
    rows = m.join(balls.select("root", "i"), "i").join(balls.select("root", F.col("i").alias("j")), ["root", "j"]).select("root", "i", "j", "a")

    def apply(r: DataFrame) -> DataFrame:
        rhs = balls.select("root", "i").join(r, "i").select("root", "i", F.col("i").alias("j"), F.col("x").alias("a"), F.lit(1).alias("rhs"))

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            b = pdf[pdf["rhs"] == 1]
            ids = np.sort(b["i"].to_numpy())
            sub = pdf[pdf["rhs"] == 0]
            a = np.zeros((len(ids), len(ids)))
            a[np.searchsorted(ids, sub["i"]), np.searchsorted(ids, sub["j"])] = sub["a"]
            f = np.zeros(len(ids))
            f[np.searchsorted(ids, b["i"])] = b["a"]
            return pd.DataFrame({"i": ids, "x": np.linalg.lstsq(a, f, rcond=None)[0]})

        parts = rows.withColumn("rhs", F.lit(0)).unionByName(rhs).groupBy("root").applyInPandas(block, "i long, x double")
        return parts.join(cover, "i").groupBy("i").agg(F.sum(F.col("x") / F.col("_c")).alias("x"))

    return apply


def _local_preconditioner(m: LocalMatrix, p: SolverParams) -> Callable | None:
    kind = p.preconditioner
    if kind in ("amg", "fmg"):
        h = amg.Hierarchy([amg.LocalLevel(m, param=p.amg)], p.amg)
        _grow(h)
        return amg.as_preconditioner(h, full=kind == "fmg")
    if kind == "ilu":
        return ilu_preconditioner(m, p.ilu.kind, p.ilu.fill, p.ilu.drop)
    if kind == "schwarz":
        return schwarz_preconditioner(m, p.schwarz.depth, p.schwarz.kind)
    return diagonal_preconditioner(m) if kind == "diag" else None


def _grow(h: amg.Hierarchy) -> None:
    q = h.param
    while len(h.levels) < q.max_levels and h.levels[-1].n > max(q.coarse_dof, 20):
        level = h.levels[-1]
        p = amg._local_step(level, len(h.levels) - 1, q)
        if p is None or p.cols < 20 or p.cols > 0.95 * level.n:
            break
        level.p = p
        h.levels.append(amg.LocalLevel(p.transpose().times(level.m).times(p), param=q))


def local_hierarchy(m: LocalMatrix, param: amg.AmgParams) -> amg.Hierarchy:
    h = amg.Hierarchy([amg.LocalLevel(m, param=param)], param)
    _grow(h)
    return h


def solve(m: DataFrame, b: DataFrame, n: int, params: SolverParams = SolverParams(), fmt: str = "csr", local_rows: int = LOCAL_ROWS, preconditioner: Callable | None = None) -> Solution:
    """A x = b for a matrix of n rows. ``fmt`` restricts the methods to those of that storage format."""
    code, run, safe = _method(params.method)
    if code not in krylov.SUPPORT[fmt]:
        return Solution(b.limit(0), int(Status.UNKNOWN_METHOD), [])
    spark = m.sparkSession
    if n <= local_rows:
        a = LocalMatrix.of(m, n)
        rows = b.toPandas()
        f = np.zeros(n)
        f[rows["i"].to_numpy()] = rows["x"].to_numpy()
        got = run(Problem(LocalSpace(n), lambda v: a @ v, f, preconditioner or _local_preconditioner(a, params)), params.control, safe)
        import pandas as pd

        x = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "x": got.x}), "i long, x double")
        return Solution(x, got.code, got.residuals)
    if preconditioner is None:
        if params.preconditioner in ("amg", "fmg"):
            preconditioner = amg.as_preconditioner(amg.setup(m, n, params.amg), full=params.preconditioner == "fmg")
        elif params.preconditioner == "schwarz":
            from ..operators.graph import breadth_levels, independent_set

            roots = independent_set(m, hashed=True).where("picked = 1").select("i")
            preconditioner = additive_schwarz(m, breadth_levels(m, roots, params.schwarz.depth))
        elif params.preconditioner == "ilu":
            raise ValueError("ILU is sequential: use diag, schwarz or amg above local_rows, or raise local_rows")
        elif params.preconditioner == "diag":
            preconditioner = diagonal_preconditioner(m)
    space = FrameSpace(spark.range(n).select(F.col("id").alias("i")))
    got = run(Problem(space, multiply(m), space.vector(b), preconditioner), params.control, safe)
    return Solution(space.frame(got.x), got.code, got.residuals)


def solve_blocks(blocks: DataFrame, b: DataFrame, brows: int, nb: int, params: SolverParams = SolverParams(), **more) -> Solution:
    """Block rows (bi, bj, blk): diagonal preconditioning by blocks, the rest as scalars."""
    m = formats.from_blocks(blocks, nb)
    if params.preconditioner == "diag" and brows * nb > more.get("local_rows", LOCAL_ROWS):
        more["preconditioner"] = block_diagonal_preconditioner(blocks, nb)
    return solve(m, b, brows * nb, params, "bsr", **more)


def solve_grid_of_blocks(blocks: DataFrame, sizes: list[int], b: DataFrame, params: SolverParams = SolverParams(), kind: str = "diag", **more) -> Solution:
    """Blocks of matrices (bi, bj, i, j, a): block diagonal, lower, upper or symmetric Gauss-Seidel preconditioning with exact blocks in memory."""
    spark, n = blocks.sparkSession, sum(sizes)
    table = spark.createDataFrame(list(enumerate(sizes)), "b int, n long")
    m = formats.from_grid_of_blocks(blocks, table)
    if kind != "none":
        if n > LOCAL_ROWS:
            raise ValueError(f"preconditioning by whole blocks works in memory, up to {LOCAL_ROWS} rows: use kind none above")
        more["preconditioner"] = block_preconditioner(LocalMatrix.of(m, n), sizes, kind)
    return solve(m, b, n, params, "blc", **more)


def block_preconditioner(m: LocalMatrix, sizes: list[int], kind: str = "diag") -> Callable:
    """diag, lower, upper or sgs over the diagonal blocks, each solved exactly."""
    ends = np.cumsum(sizes)
    cuts = [slice(e - s, e) for s, e in zip(sizes, ends)]
    full = m.dense()
    solves = [np.linalg.inv(full[c, c]) for c in cuts]

    def sweep(r, z, order):
        for k in order:
            z[cuts[k]] = solves[k] @ (r[cuts[k]] - full[cuts[k]] @ z + full[cuts[k], cuts[k]] @ z[cuts[k]])
        return z

    def apply(r):
        order = range(len(cuts))
        if kind == "diag":
            return np.concatenate([solves[k] @ r[cuts[k]] for k in order])
        z = np.zeros(len(r))
        if kind in ("lower", "sgs"):
            z = sweep(r, z, order)
        return sweep(r, z, list(order)[::-1]) if kind in ("upper", "sgs") else z

    return apply


def solve_bands(bands: DataFrame, b: DataFrame, n: int, nc: int = 1, params: SolverParams = SolverParams(), **more) -> Solution:
    """Banded structured-grid matrix (off, pos, blk)."""
    return solve(formats.from_bands(bands, nc), b, n, params, "str", **more)


def solve_operator(operator: Callable[[DataFrame], DataFrame], b: DataFrame, n: int, method: int | str = 1, control: Control = Control(), preconditioner: Callable | None = None) -> Solution:
    """Matrix-free: ``operator`` maps (i, x) to (i, x)."""
    code, run, safe = _method(method)
    if code not in krylov.SUPPORT["matfree"]:
        return Solution(b.limit(0), int(Status.UNKNOWN_METHOD), [])
    space = FrameSpace(b.sparkSession.range(n).select(F.col("id").alias("i")))
    got = run(Problem(space, operator, space.vector(b), preconditioner), control, safe)
    return Solution(space.frame(got.x), got.code, got.residuals)


def solve_amg(m: DataFrame, b: DataFrame, n: int, param: amg.AmgParams = amg.AmgParams(), full: bool = False) -> Solution:
    """Multigrid cycles as the solver; safe GMRES(20) if no hierarchy can be built."""
    h = amg.setup(m, n, param)
    spark = m.sparkSession
    if isinstance(h.levels[0], amg.LocalLevel):
        rows = b.toPandas()
        f = np.zeros(n)
        f[rows["i"].to_numpy()] = rows["x"].to_numpy()
        if len(h.levels) == 1 and n > 5000:
            a = h.levels[0].m
            got: Result = krylov.gmres(Problem(LocalSpace(n), lambda v: a @ v, f), Control(tol=param.tol, restart=20), safe=True)
        else:
            got = amg.solve(h, f, full=full)
        import pandas as pd

        return Solution(spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "x": got.x}), "i long, x double"), got.code, got.residuals)
    got = amg.solve(h, b, full=full)
    return Solution(got.x, got.code, got.residuals)


def solve_direct(m: DataFrame, b: DataFrame, n: int, most: int = 5000) -> DataFrame:
    """Dense LU of a system of at most ``most`` rows."""
    if n > most:
        raise ValueError(f"direct solves go up to {most} rows")
    a = LocalMatrix.of(m, n)
    rows = b.toPandas()
    f = np.zeros(n)
    f[rows["i"].to_numpy()] = rows["x"].to_numpy()
    import pandas as pd

    return m.sparkSession.createDataFrame(pd.DataFrame({"i": np.arange(n), "x": np.linalg.solve(a.dense(), f)}), "i long, x double")
