"""Algebraic multigrid on distributed matrices, with small levels in local memory.

The relational pieces (strength, splitting, interpolation, truncation, Galerkin products) are DataFrame plans; ``setup``
runs them level by level. A level of at most ``local_rows`` rows is collected once (its size is checked) and continued by
the exact sequential algorithms of ``local``. Cycles treat both kinds of level through one small interface.

On tables, classical splitting (rs, rsp, mis) is ``pmis`` and VMB aggregation is ``root_aggregates``: other algorithms with
the same invariants. What has only one form is refused elsewhere (``refuse``), never swapped for another method: energy
interpolation above 4000 rows, pairwise aggregation on tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matrix, products, vector
from ..operators.graph import colouring
from ..tables import written
from . import krylov, local, smoothers
from .space import FrameSpace, LocalMatrix, LocalSpace, multiply


@dataclass(frozen=True)
class AmgParams:
    """Defaults of the classical method; ``kind`` is classical, sa (smoothed aggregation) or ua (unsmoothed)."""

    kind: str = "classical"
    theta: float = 0.3
    max_row_sum: float = 0.9
    truncation: float = 0.2
    interpolation: str = "direct"  # direct, standard, extended, energy (up to 4000 rows), reduction
    coarsening: str = "rs"  # rs, rsp (|a|), mis, aggressive
    aggressive_levels: int = 1
    aggregation: str = "vmb"  # vmb, pairwise
    coupled: float = 0.08
    max_aggregation: int = 20
    pair_passes: int = 2
    quality_bound: float = 10.0
    tentative_smooth: float = 0.67
    smoother: str = "gs"  # jacobi, gs, sgs, sor, ssor, l1, poly
    relaxation: float = 1.0
    pre: int = 1
    post: int = 1
    degree: int = 3
    cycle: str = "v"  # v, w, vw, wv, amli, kcycle
    amli_degree: int = 2
    coarse_scaling: bool = False
    coarse_dof: int = 500
    max_levels: int = 20
    local_rows: int = 20_000
    tol: float = 1e-6
    maxit: int = 100

    def __post_init__(self):
        for name, known in _KNOWN.items():
            if getattr(self, name) not in known.split():
                raise ValueError(f"{name} {getattr(self, name)!r} is none of {known}")


_KNOWN = {
    "kind": "classical sa ua", "interpolation": "direct standard extended energy reduction", "coarsening": "rs rsp mis aggressive",
    "aggregation": "vmb pairwise", "smoother": "jacobi gs sgs sor ssor l1 poly", "cycle": "v w vw wv amli kcycle",
}
ENERGY_ROWS = 4000


def refuse(q: AmgParams, rows: int, tables: bool) -> None:
    """Raises where a level of so many rows has no form of a method that was asked for."""
    if q.kind == "classical" and q.interpolation == "energy" and (tables or rows > ENERGY_ROWS):
        raise ValueError(f"energy interpolation goes up to {ENERGY_ROWS} rows, not {rows}: use extended, or classical levels of fewer rows")
    if q.kind != "classical" and q.aggregation == "pairwise" and tables:
        raise ValueError(f"pairwise aggregation is sequential: {rows} rows are above local_rows; use vmb or raise local_rows")


# Relational pieces


def strength(m: DataFrame, theta: float = 0.3, max_row_sum: float = 0.9, absolute: bool = False) -> DataFrame:
    """(i, j) strong couplings: see ``local.strength``; one grouped pass per row and a join back."""
    off = F.col("i") != F.col("j")
    rows = m.groupBy("i").agg(F.max(F.when(off, F.abs("a"))).alias("_m"), F.sum(F.abs("a")).alias("_t"), F.sum(F.when(~off, F.abs("a"))).alias("_d"))
    value = F.abs("a") if absolute else -F.col("a")
    keep = off & (value > theta * F.col("_m")) & ~(F.col("_t") < (2 - max_row_sum) * F.coalesce("_d", F.lit(0.0)))
    return m.join(rows, "i").where(keep).select("i", "j")


def distance_two(s: DataFrame, coarse: DataFrame, paths: int = 1) -> DataFrame:
    """(i, j) pairs of coarse rows with at least so many strong paths of length 1 or 2 between them."""
    two = s.join(s.select(F.col("i").alias("j"), F.col("j").alias("k")), "j").where("i != k").select("i", F.col("k").alias("j"), F.col("j").alias("via"))
    every = s.select("i", "j", F.col("j").alias("via")).union(two)
    c = coarse.select("i")
    both = every.join(c, "i", "left_semi").join(c.select(F.col("i").alias("j")), "j", "left_semi")
    return both.groupBy("i", "j").agg(F.countDistinct("via").alias("n")).where(F.col("n") >= paths).select("i", "j")


def pmis(m: DataFrame, s: DataFrame) -> DataFrame:
    """(i, mark): 1 coarse, 0 fine, 2 isolated; parallel rounds: a row whose measure (rows that depend on it, then a hash)
    beats all undecided strong neighbours turns coarse, and its dependants turn fine."""
    edges = written(s.union(s.select("j", "i")).distinct(), "strong")
    measure = s.groupBy(F.col("j").alias("i")).agg(F.count(F.lit(1)).alias("_n"))
    all_rows = m.select("i").distinct()
    has = s.select("i").distinct().withColumn("_h", F.lit(1))
    state = all_rows.join(measure, "i", "left").join(has, "i", "left").select(
        "i", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.xxhash64("i").alias("h"), F.col("i").alias("k")).alias("p"),
        F.when(F.col("_h").isNull() & F.col("_n").isNull(), 2).when(F.col("_n").isNull(), 0).otherwise(-1).alias("mark"),
    )
    state = written(state, "marks")
    while True:  # every round settles the row of largest measure at least
        live = state.where("mark = -1")
        if not live.limit(1).count():
            return state.select("i", "mark")
        rival = edges.join(live.select(F.col("i").alias("j"), F.col("p").alias("q")), "j").groupBy("i").agg(F.max("q").alias("q"))
        won = written(live.join(rival, "i", "left").where(F.col("q").isNull() | (F.col("p") > F.col("q"))).select("i", F.lit(1).alias("w")), "won")
        fine = s.join(won.select(F.col("i").alias("j")), "j", "left_semi").select("i").distinct().withColumn("f", F.lit(1))
        new = F.when(F.col("mark") != -1, F.col("mark")).when(F.col("w") == 1, 1).when(F.col("f") == 1, 0).otherwise(-1)
        state = written(state.join(won, "i", "left").join(fine, "i", "left").select("i", "p", new.alias("mark")), "marks")


def direct_interpolation(m: DataFrame, s: DataFrame, marks: DataFrame) -> DataFrame:
    """P (i, j, a) over coarse numbers: see ``local.direct_interpolation``."""
    number = written(matrix.prolong_renumber(marks), "numbers")
    off = F.col("i") != F.col("j")
    coarse = number.select(F.col("i").alias("j"), F.col("new").alias("_c"))
    tagged = m.join(marks.where("mark = 0").select("i"), "i", "left_semi").join(coarse, "j", "left").join(s.withColumn("_s", F.lit(1)), ["i", "j"], "left")
    pick = off & F.col("_c").isNotNull() & F.col("_s").isNotNull()
    neg, pos = F.col("a") < 0, F.col("a") > 0
    per = tagged.groupBy("i").agg(
        F.sum(F.when(~off, F.col("a"))).alias("d"),
        F.sum(F.when(off & neg, F.col("a"))).alias("n"), F.sum(F.when(pick & neg, F.col("a"))).alias("nc"),
        F.sum(F.when(off & pos, F.col("a"))).alias("p"), F.sum(F.when(pick & pos, F.col("a"))).alias("pc"),
    )
    d = F.col("d") + F.when(F.col("pc").isNull(), F.coalesce("p", F.lit(0.0))).otherwise(0.0)
    factor = F.when(neg, F.col("n") / F.col("nc")).otherwise(F.col("p") / F.col("pc"))
    fine = tagged.where(pick).join(per, "i").select("i", F.col("_c").alias("j"), (-factor * F.col("a") / d).alias("a"))
    return fine.unionByName(number.select("i", F.col("new").alias("j"), F.lit(1.0).alias("a")))


def standard_interpolation(m: DataFrame, s: DataFrame, marks: DataFrame, extended: bool = False) -> DataFrame:
    """P (i, j, a) over coarse numbers: see ``local.standard_interpolation``. Strong fine neighbours are eliminated by one
    sparse product with their rows; ``extended`` leaves out what comes back to the row itself."""
    number = written(matrix.prolong_renumber(marks), "numbers")
    tag = s.withColumn("_s", F.lit(True))
    of = marks.select(F.col("i").alias("j"), F.col("mark").alias("_m")).join(matrix.diagonal(m).select(F.col("i").alias("j"), F.col("x").alias("_d")), "j", "left")
    rows = m.join(marks.where("mark = 0").select("i"), "i", "left_semi").join(tag, ["i", "j"], "left").join(of, "j")
    gone = F.coalesce(F.col("_s"), F.lit(False)) & (F.col("i") != F.col("j")) & (F.col("_m") == 0) & (F.coalesce("_d", F.lit(0.0)) != 0)
    rows = written(rows.select("i", "j", "a", "_s", "_m", "_d", gone.alias("_gone")), "rows")
    out = rows.where("_gone").select("i", "j", (-F.col("a") / F.col("_d")).alias("_share"))
    through = out.join(m.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("a").alias("_u")), "j").where("k != j")
    through = (through.where("k != i") if extended else through).select("i", F.col("k").alias("j"), (F.col("_share") * F.col("_u")).alias("a"))
    kept = rows.where("not _gone").select("i", "j", "a")
    row = kept.unionByName(through).groupBy("i", "j").agg(F.sum("a").alias("a"))
    strong_coarse = s.join(marks.where("mark = 1").select(F.col("i").alias("j")), "j", "left_semi").select("i", "j")
    own = rows.where("_s and _m = 1").select("i", "j")
    wide = own.union(out.select("i", "j").join(strong_coarse.select(F.col("i").alias("j"), F.col("j").alias("k")), "j").select("i", "k")).distinct().withColumn("_c", F.lit(True))
    row = written(row.join(wide, ["i", "j"], "left"), "row")
    off = F.col("i") != F.col("j")
    per = row.groupBy("i").agg(F.sum(F.when(~off, F.col("a"))).alias("_h"), F.sum(F.when(off, F.col("a"))).alias("_t"), F.sum(F.when(off & F.col("_c"), F.col("a"))).alias("_p"))
    w = row.where(off & F.col("_c")).join(per.where("_h != 0 and _p != 0"), "i").select("i", "j", (-F.col("_t") / F.col("_p") * F.col("a") / F.col("_h")).alias("a"))
    w = w.join(number.select(F.col("i").alias("j"), "new"), "j").select("i", F.col("new").alias("j"), "a")
    return w.unionByName(number.select("i", F.col("new").alias("j"), F.lit(1.0).alias("a")))


def reduction_interpolation(m: DataFrame, marks: DataFrame) -> DataFrame:
    """P_ij = -a_ij / ((2 - 1/theta) a_ii), theta the least |a_ii| / sum of |a_ij| over fine columns."""
    number = written(matrix.prolong_renumber(marks), "numbers")
    fine = m.join(marks.where("mark != 1").select("i"), "i", "left_semi")
    cols = marks.select(F.col("i").alias("j"), F.col("mark").alias("_m"))
    tagged = fine.join(cols, "j")
    per = tagged.groupBy("i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("a"))).alias("d"), F.sum(F.when(F.col("_m") != 1, F.abs("a"))).alias("f"))
    theta = float(per.agg(F.min(F.abs("d") / F.col("f"))).first()[0])
    w = tagged.where("_m = 1").join(per, "i").join(number.select(F.col("i").alias("j"), "new"), "j")
    return w.select("i", F.col("new").alias("j"), (-F.col("a") / ((2 - 1 / theta) * F.col("d"))).alias("a")).unionByName(number.select("i", F.col("new").alias("j"), F.lit(1.0).alias("a")))


def truncate(p: DataFrame, level: float = 0.2) -> DataFrame:
    """See ``local.truncate``: one window per row, the sign groups rescaled apart."""
    rows = p.groupBy("i").agg(F.max("a").alias("_hi"), F.min("a").alias("_lo"))
    keep = F.when(F.col("a") >= 0, F.col("a") >= level * F.greatest(F.col("_hi"), F.lit(0.0))).otherwise(F.col("a") <= level * F.least(F.col("_lo"), F.lit(0.0)))
    tagged = p.join(rows, "i").select("i", "j", "a", keep.alias("_k"), F.signum("a").alias("_s"))
    part = tagged.groupBy("i", "_s").agg(F.sum("a").alias("_old"), F.sum(F.when(F.col("_k"), F.col("a"))).alias("_new"))
    return tagged.where("_k").join(part, ["i", "_s"]).select("i", "j", F.when(F.col("_new") != 0, F.col("a") * F.col("_old") / F.col("_new")).otherwise(F.col("a")).alias("a"))


def root_aggregates(m: DataFrame, coupled: float = 0.08, level: int = 0) -> DataFrame:
    """(i, agg): parallel aggregation: an independent set of the distance-two graph gives the roots, rows join the nearest root."""
    from ..operators.graph import breadth_levels, independent_set, neighbours

    d = matrix.diagonal(m)
    eps = (coupled * 0.5**level) ** 2
    strong = m.join(d.select("i", F.col("x").alias("_di")), "i").join(d.select(F.col("i").alias("j"), F.col("x").alias("_dj")), "j").where((F.col("i") == F.col("j")) | (F.col("a") * F.col("a") >= eps * F.abs(F.col("_di") * F.col("_dj")))).select("i", "j")
    strong = written(strong, "near")
    e = neighbours(strong.withColumn("a", F.lit(1.0)))
    two = e.union(e.join(e.select(F.col("i").alias("j"), F.col("j").alias("k")), "j").select("i", F.col("k").alias("j")))
    alone = m.select("i").distinct().select("i", F.col("i").alias("j"))
    roots = independent_set(two.union(alone), hashed=True).where("picked = 1").select("i")
    ball = breadth_levels(strong.withColumn("a", F.lit(1.0)), roots, 2)
    nearest = ball.groupBy("i").agg(F.min(F.struct("hops", "root")).alias("b")).select("i", F.col("b.root").alias("root"))
    names = matrix.prolong_renumber(roots.withColumn("mark", F.lit(1))).select(F.col("i").alias("root"), F.col("new").alias("agg"))
    return nearest.join(names, "root").select("i", "agg")


def smoothed_prolongator(m: DataFrame, aggregate: DataFrame, omega: float = 0.67) -> DataFrame:
    """(I - omega D^-1 A) P for the map (i, agg)."""
    p = aggregate.select("i", F.col("agg").alias("j"), F.lit(1.0).alias("a"))
    image = products.spgemm(matrix.inverse_diagonal_scaling(m), p)
    return matrix.add(p, image, 1.0, -omega)


# Levels


@dataclass
class FrameLevel:
    """A distributed level; vectors are (i, x)."""

    m: DataFrame
    n: int
    p: DataFrame | None = None
    colours: DataFrame | None = None
    marks: DataFrame | None = None
    param: AmgParams = field(default_factory=AmgParams)

    @property
    def nnz(self) -> int:
        return self.m.count()

    def zero(self) -> DataFrame:
        return matrix.constant(self.m.sparkSession, self.n, 0.0)

    def smooth(self, b: DataFrame, x: DataFrame, post: bool) -> DataFrame:
        q = self.param
        for _ in range(q.post if post else q.pre):
            if q.smoother == "l1":
                x = smoothers.l1_diagonal(self.m, b, x)
            elif q.smoother == "poly":
                x = smoothers.polynomial(self.m, b, x, q.degree)
            elif q.smoother == "jacobi" or self.colours is None:
                x = smoothers.jacobi(self.m, b, x, q.relaxation if q.relaxation != 1.0 else 2 / 3)
            elif q.smoother in ("sgs", "ssor"):
                x = smoothers.symmetric_sweep(self.m, b, x, self.colours, q.relaxation)
            elif self.marks is not None:
                x = smoothers.cf_sweep(self.m, b, x, self.marks, self.colours, not post, q.relaxation)
            else:
                x = smoothers.colour_sweep(self.m, b, x, self.colours, q.relaxation)
            x = written(x, "smooth")
        return x

    def residual(self, b: DataFrame, x: DataFrame) -> DataFrame:
        return products.residual(b, self.m, x)

    def restrict(self, r: DataFrame) -> DataFrame:
        return written(products.spmv(matrix.transpose(self.p), r), "restrict")

    def prolong(self, x: DataFrame, e: DataFrame, scale: float = 1.0) -> DataFrame:
        step = products.spmv(self.p, e).select("i", (scale * F.col("x")).alias("x"))
        return written(x.unionByName(step).groupBy("i").agg(F.sum("x").alias("x")), "prolong")


@dataclass
class LocalLevel:
    """A level in memory; vectors are arrays."""

    m: LocalMatrix
    p: LocalMatrix | None = None
    order: np.ndarray | None = None  # C rows first
    param: AmgParams = field(default_factory=AmgParams)

    @property
    def n(self) -> int:
        return self.m.n

    @property
    def nnz(self) -> int:
        return len(self.m.a)

    def zero(self) -> np.ndarray:
        return np.zeros(self.n)

    def smooth(self, b: np.ndarray, x: np.ndarray, post: bool) -> np.ndarray:
        q = self.param
        for _ in range(q.post if post else q.pre):
            if q.smoother == "poly":
                x = local.polynomial_sweep(self.m, b, x, q.degree)
            elif q.smoother == "jacobi":
                w = q.relaxation if q.relaxation != 1.0 else 2 / 3
                x = x + w * (b - self.m @ x) / self.m.diagonal()
            elif q.smoother == "l1":
                x = x + (b - self.m @ x) / np.bincount(self.m.i, np.abs(self.m.a), self.n)
            else:
                order = self.order if self.order is not None else np.arange(self.n)
                x = local.gauss_seidel(self.m, b, x, order[::-1] if post else order, q.relaxation)
                if q.smoother in ("sgs", "ssor"):
                    x = local.gauss_seidel(self.m, b, x, order if post else order[::-1], q.relaxation)
        return x

    def residual(self, b: np.ndarray, x: np.ndarray) -> np.ndarray:
        return b - self.m @ x

    def restrict(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.p.j, self.p.a * r[self.p.i], self.p.cols)

    def prolong(self, x: np.ndarray, e: np.ndarray, scale: float = 1.0) -> np.ndarray:
        return x + scale * (self.p @ e)


@dataclass
class Hierarchy:
    levels: list
    param: AmgParams
    top: np.ndarray | None = None  # dense coarsest matrix

    def complexity(self) -> tuple[float, float]:
        """(grid, operator) complexity."""
        rows, nnz = [x.n for x in self.levels], [x.nnz for x in self.levels]
        return sum(rows) / rows[0], sum(nnz) / nnz[0]

    def coarse_solve(self, b):
        """The coarsest level: dense up to 5000 rows in memory, else (also where coarsening stalled on a table) safe
        conjugate gradients, and GMRES where those do not converge."""
        level = self.levels[-1]
        tables = isinstance(level, FrameLevel)
        if tables or level.n > 5000:
            space = FrameSpace(level.m.sparkSession.range(level.n).select(F.col("id").alias("i"))) if tables else LocalSpace(level.n)
            problem = krylov.Problem(space, multiply(level.m) if tables else lambda v: level.m @ v, space.vector(b))
            got = krylov.cg(problem, krylov.Control(tol=1e-10, maxit=1000), safe=True)
            if got.status != krylov.Status.OK:
                got = krylov.gmres(problem, krylov.Control(tol=1e-10, maxit=1000, restart=20), safe=True)
            return written(space.frame(got.x), "coarse") if tables else got.x
        if self.top is None:
            self.top = self.levels[-1].m.dense()
        try:
            return np.linalg.solve(self.top, b)
        except np.linalg.LinAlgError:
            return np.linalg.lstsq(self.top, b, rcond=None)[0]

    def cross(self, k: int, r):
        """A restricted residual in the vectors of level k + 1: distributed above, an array below."""
        if isinstance(self.levels[k], FrameLevel) and isinstance(self.levels[k + 1], LocalLevel):
            out = np.zeros(self.levels[k + 1].n)
            rows = r.toPandas()  # at most local_rows values
            out[rows["i"].to_numpy()] = rows["x"].to_numpy()
            return out
        return r

    def back(self, k: int, e):
        if isinstance(self.levels[k], FrameLevel) and isinstance(e, np.ndarray):
            import pandas as pd

            return self.levels[k].m.sparkSession.createDataFrame(pd.DataFrame({"i": np.arange(len(e)), "x": e}), "i long, x double")
        return e


def _local_step(level: LocalLevel, depth: int, q: AmgParams) -> LocalMatrix | None:
    m = level.m
    refuse(q, m.n, False)
    if q.kind == "classical":
        s = local.strength(m, q.theta, q.max_row_sum, q.coarsening == "rsp")
        mark = local.independent_split(s) if q.coarsening == "mis" else local.classical_split(s)
        if q.coarsening == "aggressive" and depth < q.aggressive_levels:
            mark = local.aggressive_split(s, mark)
        if not (mark == 1).any():
            return None
        level.order = np.concatenate([np.flatnonzero(mark == 1), np.flatnonzero(mark != 1)])
        if q.interpolation == "energy":
            return local.energy_interpolation(m, s, mark)
        if q.interpolation in ("standard", "extended"):
            p = local.standard_interpolation(m, s, mark, q.interpolation == "extended")
        else:
            p = local.reduction_interpolation(m, mark) if q.interpolation == "reduction" else local.direct_interpolation(m, s, mark)
        return local.truncate(p, q.truncation)
    agg = local.repeated_pairwise(m, q.pair_passes, q.quality_bound) if q.aggregation == "pairwise" else local.vmb_aggregates(m, depth, q.coupled, q.max_aggregation)
    if agg.max(initial=-1) < 0:
        return None
    p = local.map_matrix(agg)
    return local.smoothed_prolongator(m, p, depth, q.coupled, q.tentative_smooth) if q.kind == "sa" else p


def _frame_step(level: FrameLevel, depth: int, q: AmgParams) -> DataFrame | None:
    m = level.m
    refuse(q, level.n, True)
    if q.kind == "classical":
        s = written(strength(m, q.theta, q.max_row_sum, q.coarsening == "rsp"), "strength")
        level.marks = pmis(m, s)
        if q.coarsening == "aggressive" and depth < q.aggressive_levels:
            coarse = level.marks.where("mark = 1")
            far = pmis(coarse.select("i", F.col("i").alias("j"), F.lit(1.0).alias("a")), distance_two(s, coarse))
            level.marks = written(level.marks.join(far.select("i", F.col("mark").alias("_f")), "i", "left").select("i", F.when(F.col("_f") == 0, 0).otherwise(F.col("mark")).alias("mark")), "marks")
        if not level.marks.where("mark = 1").limit(1).count():
            return None
        if q.interpolation in ("standard", "extended"):
            p = standard_interpolation(m, s, level.marks, q.interpolation == "extended")
        else:
            p = reduction_interpolation(m, level.marks) if q.interpolation == "reduction" else direct_interpolation(m, s, level.marks)
        return written(truncate(p, q.truncation), "prolong")
    agg = root_aggregates(m, q.coupled, depth)
    if q.kind == "sa":
        return written(smoothed_prolongator(m, agg, q.tentative_smooth), "prolong")
    return written(agg.select("i", F.col("agg").alias("j"), F.lit(1.0).alias("a")), "prolong")


def setup(m: DataFrame, n: int, param: AmgParams = AmgParams()) -> Hierarchy:
    """The hierarchy of a matrix of n rows."""
    q = param
    level: FrameLevel | LocalLevel = FrameLevel(m, n, param=q) if n > q.local_rows else LocalLevel(LocalMatrix.of(m, n), param=q)
    levels = [level]
    while len(levels) < q.max_levels and level.n > max(q.coarse_dof, 20):
        if isinstance(level, FrameLevel):
            if q.smoother in ("gs", "sgs", "sor", "ssor"):
                level.colours = written(colouring(level.m), "colours")
            p = _frame_step(level, len(levels) - 1, q)
            size = 0 if p is None else int(p.agg(F.max("j")).first()[0] or -1) + 1
            if size < 20 or size > 0.95 * level.n:
                break
            level.p = p
            a = written(products.ptap(p, level.m), "galerkin")
            level = FrameLevel(a, size, param=q) if size > q.local_rows else LocalLevel(LocalMatrix.of(a, size), param=q)
        else:
            p = _local_step(level, len(levels) - 1, q)
            if p is None or p.cols < 20 or p.cols > 0.95 * level.n:
                break
            level.p = p
            level = LocalLevel(p.transpose().times(level.m).times(p), param=q)
        levels.append(level)
    return Hierarchy(levels, q)


# Cycles


def cycle(h: Hierarchy, k: int, b, x, kind: str | None = None):
    """One multigrid cycle on level k."""
    level, kind = h.levels[k], kind or h.param.cycle
    if k == len(h.levels) - 1:
        return h.coarse_solve(b)
    x = level.smooth(b, x, False)
    r = h.cross(k, level.restrict(level.residual(b, x)))
    low = h.levels[k + 1]
    tables = isinstance(low, FrameLevel)
    if kind == "kcycle" and k + 1 < len(h.levels) - 1:
        space = FrameSpace(low.m.sparkSession.range(low.n).select(F.col("id").alias("i"))) if tables else LocalSpace(low.n)
        p = krylov.Problem(space, multiply(low.m) if tables else lambda v: low.m @ v, space.vector(r), lambda v: cycle(h, k + 1, v, low.zero(), kind))
        e = krylov.gcr(p, krylov.Control(tol=0.2, maxit=2, restart=2)).x
        e = written(space.frame(e), "kcycle") if tables else e
    elif kind == "amli" and k + 1 < len(h.levels) - 1:
        e = _amli(h, k + 1, r)
    else:
        times = {"v": 1, "w": 2, "vw": 1 + k % 2, "wv": 2 - k % 2}.get(kind, 1)
        e = low.zero()
        for _ in range(times):
            e = cycle(h, k + 1, r, e, kind)
    scale = 1.0
    if h.param.coarse_scaling:
        if tables:
            e = written(e, "correction")
            energy, gain = (float(vector.dot(e, v).first()[0] or 0.0) for v in (products.spmv(low.m, e), r))
        else:
            energy, gain = float(e @ (low.m @ e)), float(e @ r)
        scale = min(1.0, gain / energy) if energy > 0 else 1.0
    x = level.prolong(x, h.back(k, e), scale)
    return level.smooth(b, x, True)


def amli_coefficients(lambda_max: float, lambda_min: float, degree: int) -> list[float]:
    """Coefficients of the polynomial q with 1 - t q(t) the scaled Chebyshev polynomial on [lambda_min, lambda_max]."""
    centre, width = (lambda_max + lambda_min) / 2, (lambda_max - lambda_min) / 2
    cheb = np.polynomial.Chebyshev([0] * (degree + 1) + [1]).convert(kind=np.polynomial.Polynomial)
    shifted = cheb(np.polynomial.Polynomial([centre / width, -1 / width]))
    one_minus = np.polynomial.Polynomial([1.0]) - shifted / shifted(0.0)
    return [float(c) for c in one_minus.coef[1:]]


def _amli(h: Hierarchy, k: int, r):
    """A polynomial of cycles applied to r by Horner's rule."""
    low, q = h.levels[k], amli_coefficients(2.0, 0.5, h.param.amli_degree)
    e = None
    for c in reversed(q):
        if isinstance(low, LocalLevel):
            rhs = c * r if e is None else c * r + low.m @ e
        else:
            scaled = r.select("i", (c * F.col("x")).alias("x"))
            rhs = scaled if e is None else written(products.axpy_spmv(1.0, low.m, e, scaled), "amli")
        e = cycle(h, k, rhs, low.zero(), "amli")
    return e


def full_cycle(h: Hierarchy, b):
    """Nested iteration: restrict the right-hand side to the coarsest level, then solve and interpolate upwards with a cycle each."""
    rhs = [b]
    for k in range(len(h.levels) - 1):
        rhs.append(h.cross(k, h.levels[k].restrict(rhs[-1])))
    x = h.coarse_solve(rhs[-1])
    for k in range(len(h.levels) - 2, -1, -1):
        x = h.levels[k].prolong(h.levels[k].zero(), h.back(k, x))
        x = cycle(h, k, rhs[k], x, "v")
    return x


def norm(v) -> float:
    return float(np.linalg.norm(v)) if isinstance(v, np.ndarray) else float(v.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 0.0)


def solve(h: Hierarchy, b, x=None, full: bool = False) -> krylov.Result:
    """Cycles until |b - A x| / |b| is below the tolerance."""
    top = h.levels[0]
    size = norm(b)
    x = top.zero() if x is None else x
    if size == 0.0:
        return krylov.Result(top.zero(), 0, krylov.Status.OK, [0.0])
    history = []
    for it in range(1, h.param.maxit + 1):
        if full and it == 1:
            x = full_cycle(h, b)
        else:
            x = cycle(h, 0, b, x)
        history.append(norm(top.residual(b, x)) / size)
        if history[-1] < h.param.tol:
            return krylov.Result(x, it, krylov.Status.OK, history)
    return krylov.Result(x, h.param.maxit, krylov.Status.MAX_ITERATIONS, history)


def as_preconditioner(h: Hierarchy, cycles: int = 1, full: bool = False):
    """z = cycles from zero guess on A z = r, in the vectors of the finest level."""

    def apply(r):
        if full:
            return full_cycle(h, r)
        z = h.levels[0].zero()
        for _ in range(cycles):
            z = cycle(h, 0, r, z)
        return z

    return apply


def with_kernel(apply, kernel):
    """A preconditioner with an extra correction along a near-kernel vector before and after: arrays only."""

    def both(r):
        m, v, ev = kernel
        z = v * (v @ r) / ev
        z = z + apply(r - m @ z)
        return z + v * (v @ (r - m @ z)) / ev

    return both


def tuned(param: AmgParams, **changes) -> AmgParams:
    return replace(param, **changes)
