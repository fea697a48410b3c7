"""Vector spaces on which the iterative methods run.

A method sees vectors as values: it may combine them, apply an operator, and ask for several inner products at once. Two
spaces implement that. ``FrameSpace`` keeps all live vectors as columns of one table (i, c0, c1, ...), so combinations are
lazy projections without a join, a round of inner products is one aggregate, and applying an operator is one join and one
grouped sum whose result becomes a further column; the table is then written in the shared folder, which cuts lineage.
``LocalSpace`` holds numpy arrays for systems of bounded size (coarse levels).
"""

from __future__ import annotations

import weakref
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.products import spmv
from ..tables import drop, written


class Vec:
    """A linear combination of stored columns."""

    __slots__ = ("__weakref__", "space", "terms")

    def __init__(self, space: FrameSpace, terms: dict[str, float]):
        self.space, self.terms = space, terms
        space.live.add(self)

    def expr(self) -> Column:
        parts = [F.col(c) if k == 1.0 else F.lit(float(k)) * F.col(c) for c, k in self.terms.items()]
        out = F.lit(0.0)
        for n, p in enumerate(parts):
            out = p if n == 0 else out + p
        return out


class FrameSpace:
    """Vectors over the positions of ``table`` (i); operators map (i, x) to (i, x)."""

    MOST = 2  # terms of a live combination that survive a rewrite: expressions stay short whatever the number of steps

    def __init__(self, positions: DataFrame):
        self.table, self.owned, self.count = positions.select("i"), None, 0
        self.live: weakref.WeakSet[Vec] = weakref.WeakSet()

    def _add(self, table: DataFrame, name: str, rewrite: bool = True) -> Vec:
        vec = Vec(self, {name: 1.0})
        new = written(table, "vectors") if rewrite else table
        old, self.table = self.owned, new
        self.owned = new if rewrite else self.owned
        if rewrite and old is not None:
            drop(old)
        return vec

    def _name(self) -> str:
        self.count += 1
        return f"c{self.count}"

    def _needed(self) -> DataFrame:
        """The table with the columns that live vectors need; combinations of more than ``MOST`` become a column of their own."""
        long = [(v, self._name()) for v in list(self.live) if len(v.terms) > self.MOST]
        short = {c for v in self.live if len(v.terms) <= self.MOST for c in v.terms}
        table = self.table.select("i", *sorted(short, key=lambda c: int(c[1:])), *[v.expr().alias(n) for v, n in long])
        for v, n in long:
            v.terms = {n: 1.0}
        return table

    def vector(self, df: DataFrame) -> Vec:
        """A vector from (i, x); positions that it lacks are 0."""
        name = self._name()
        table = self._needed().join(df.select("i", F.col("x").alias(name)), "i", "left").fillna(0.0, [name])
        return self._add(table, name)

    def zero(self) -> Vec:
        return Vec(self, {})

    def combine(self, *terms: tuple[float, Vec]) -> Vec:
        out: dict[str, float] = {}
        for k, v in terms:
            for c, w in v.terms.items():
                out[c] = out.get(c, 0.0) + k * w
        return Vec(self, {c: w for c, w in out.items() if w != 0.0})

    def apply(self, operator: Callable[[DataFrame], DataFrame], v: Vec) -> Vec:
        return self.vector(operator(self.frame(v)))

    def dots(self, *pairs: tuple[Vec, Vec]) -> list[float]:
        got = self.table.agg(*[F.sum(a.expr() * b.expr()).alias(f"d{n}") for n, (a, b) in enumerate(pairs)]).first()
        return [float(x or 0.0) for x in got]

    def largest(self, v: Vec) -> float:
        return float(self.table.agg(F.max(F.abs(v.expr()))).first()[0] or 0.0)

    def frame(self, v: Vec) -> DataFrame:
        return self.table.select("i", v.expr().alias("x"))


class LocalSpace:
    """The same interface on arrays; operators map arrays to arrays."""

    def __init__(self, n: int):
        self.n = n

    def vector(self, x) -> np.ndarray:
        return np.asarray(x, float)

    def zero(self) -> np.ndarray:
        return np.zeros(self.n)

    def combine(self, *terms: tuple[float, np.ndarray]) -> np.ndarray:
        out = np.zeros(self.n)
        for k, v in terms:
            out += k * v
        return out

    def apply(self, operator: Callable, v: np.ndarray) -> np.ndarray:
        return operator(v)

    def dots(self, *pairs) -> list[float]:
        return [float(a @ b) for a, b in pairs]

    def largest(self, v: np.ndarray) -> float:
        return float(np.abs(v).max(initial=0.0))

    def frame(self, v: np.ndarray) -> np.ndarray:
        return v


class LocalMatrix:
    """Compressed rows in numpy, for levels whose size has been checked."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, a: np.ndarray, cols: int | None = None):
        order = np.lexsort((j, i))
        self.i, self.j, self.a = np.asarray(i)[order].astype(np.int64), np.asarray(j)[order].astype(np.int64), np.asarray(a, float)[order]
        self.n, self.cols = n, n if cols is None else cols
        self.ptr = np.searchsorted(self.i, np.arange(n + 1))

    @classmethod
    def of(cls, m: DataFrame, n: int, most: int = 4_000_000) -> LocalMatrix:
        """Collects a matrix of at most ``most`` entries."""
        rows = m.select("i", "j", "a").limit(most + 1).toPandas()
        if len(rows) > most:
            raise ValueError(f"more than {most} entries: not a local matrix")
        return cls(n, rows["i"].to_numpy(), rows["j"].to_numpy(), rows["a"].to_numpy())

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.i, self.a * x[self.j], self.n)

    def transpose(self) -> LocalMatrix:
        return LocalMatrix(self.cols, self.j, self.i, self.a, self.n)

    def diagonal(self) -> np.ndarray:
        d = np.zeros(self.n)
        on = self.i == self.j
        d[self.i[on]] = self.a[on]
        return d

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.cols))
        np.add.at(out, (self.i, self.j), self.a)
        return out

    def times(self, other: LocalMatrix) -> LocalMatrix:
        """Sparse product by expanding rows and summing equal positions."""
        size = other.ptr[self.j + 1] - other.ptr[self.j]
        ends = np.cumsum(size)
        at = np.repeat(other.ptr[self.j] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        key = np.repeat(self.i, size) * other.cols + other.j[at]
        spots, where = np.unique(key, return_inverse=True)
        return LocalMatrix(self.n, spots // other.cols, spots % other.cols, np.bincount(where, np.repeat(self.a, size) * other.a[at], len(spots)), other.cols)

    def row(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        return self.j[self.ptr[r] : self.ptr[r + 1]], self.a[self.ptr[r] : self.ptr[r + 1]]


def multiply(m: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The operator of a matrix."""
    return lambda v: spmv(m, v)


Space = FrameSpace | LocalSpace
Pairs = Sequence
