"""Graph operators on the pattern of a matrix: independent sets, colourings, levels, orderings.

The distributed forms work in rounds of joins and grouped minima, each round written in the shared folder. Priorities are
the positions themselves (which gives the greedy result in index order; as many rounds as its longest chain of decisions)
or a hash of them (rounds grow with the logarithm). Every round settles some row, so the loops run until all are settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import drop, written


def neighbours(m: DataFrame) -> DataFrame:
    """Undirected edges (i, j) without loops, both ways."""
    off = m.where("i != j").select("i", "j")
    return off.union(off.select("j", "i")).distinct()


def nodes(m: DataFrame) -> DataFrame:
    return m.select("i").union(m.select("j")).distinct()


def independent_set(m: DataFrame, hashed: bool = False) -> DataFrame:
    """(i, picked): a maximal independent set; with index priorities it is that of the greedy pass in index order."""
    edges = written(neighbours(m), "edges")
    rank: Column = F.struct(F.xxhash64("i"), F.col("i")) if hashed else F.struct(F.col("i"))
    state = written(nodes(m).select("i", F.lit(-1).alias("s"), rank.alias("p")), "mis")  # -1 open, 0 out, 1 in
    while True:
        live = state.where("s = -1")
        if not live.limit(1).count():
            return state.select("i", F.col("s").cast("int").alias("picked"))
        rival = edges.join(live.select(F.col("i").alias("j"), F.col("p").alias("q")), "j").groupBy("i").agg(F.min("q").alias("q"))
        won = live.join(rival, "i", "left").where(F.col("q").isNull() | (F.col("p") < F.col("q"))).select("i", F.lit(1).alias("w"))
        won = written(won, "won")
        lost = edges.join(won.select("i"), "i", "left_semi").select(F.col("j").alias("i")).distinct().withColumn("l", F.lit(1))
        new = state.join(won, "i", "left").join(lost, "i", "left").select("i", F.when(F.col("s") >= 0, F.col("s")).when(F.col("w") == 1, 1).when(F.col("l") == 1, 0).otherwise(-1).alias("s"), "p")
        old, state = state, written(new, "mis")
        drop(old)
        drop(won)


def colouring(m: DataFrame, hashed: bool = True) -> DataFrame:
    """(i, c): colours from 0, no two neighbours alike: colour k is the independent set of round k."""
    left, out, c = m, None, 0
    rest = written(nodes(m), "rest")
    while rest.limit(1).count():
        alone = rest.select("i", F.col("i").alias("j"))
        picked = independent_set(left.select("i", "j").union(alone), hashed).where("picked = 1").select("i")
        mine = picked.withColumn("c", F.lit(c))
        c += 1
        out = mine if out is None else out.union(mine)
        rest = written(rest.join(picked, "i", "left_anti"), "rest")
        left = written(m.select("i", "j").join(rest, "i", "left_semi").join(rest.select(F.col("i").alias("j")), "j", "left_semi"), "left")
    return out if out is not None else rest.withColumn("c", F.lit(0))


def strong_pattern(m: DataFrame, theta: float) -> DataFrame:
    """Entries with |a_ij| above theta times the row's sum of |a|, and the diagonal."""
    total = m.groupBy("i").agg(F.sum(F.abs("a")).alias("_t"))
    return m.join(total, "i").where((F.col("i") == F.col("j")) | (F.abs("a") > theta * F.col("_t"))).select("i", "j", "a")


def levels(m: DataFrame, lower: bool = True) -> DataFrame:
    """(i, level) of a triangular solve: 0 without predecessors, else 1 + the largest level of a predecessor; a round per level."""
    side = "j < i" if lower else "j > i"
    before = written(m.where(side).select("i", "j").distinct(), "before")
    state = written(nodes(m).select("i", F.lit(0).alias("level")), "levels")
    while True:
        up = before.join(state.select(F.col("i").alias("j"), F.col("level").alias("_l")), "j").groupBy("i").agg((F.max("_l") + 1).alias("_n"))
        new = written(state.join(up, "i", "left").select("i", F.greatest(F.col("level"), F.coalesce("_n", F.lit(0))).alias("level"), F.col("level").alias("was")), "levels")
        changed = new.where("level != was").limit(1).count()
        drop(state)
        state = new.select("i", "level")
        if not changed:
            return state


def breadth_levels(m: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, i, hops): nodes within ``depth`` hops of each root (balls for block methods)."""
    edges = written(neighbours(m), "edges")
    ball = roots.select(F.col("i").alias("root"), "i", F.lit(0).alias("hops"))
    for h in range(1, depth + 1):
        step = ball.join(edges, "i").select("root", F.col("j").alias("i"), F.lit(h).alias("hops"))
        ball = written(ball.union(step).groupBy("root", "i").agg(F.min("hops").alias("hops")), "ball")
    return ball


def cuthill_mckee(m: DataFrame, reverse: bool = False, most_rows: int = 2_000_000) -> DataFrame:
    """(old, new): breadth-first order by increasing degree. Sequential, so done in one task for at most ``most_rows`` entries."""
    import pandas as pd

    pattern = neighbours(m)
    if pattern.limit(most_rows + 1).count() > most_rows:
        raise ValueError("too large for one task; use breadth_levels for a level order")
    everything = pattern.select("i", "j").union(nodes(m).select("i", F.lit(None).cast("long")))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {int(i): [] for i in pdf["i"].unique()}
        for i, j in pdf.dropna().astype("int64").itertuples(index=False):
            near[i].append(j)
        degree = {i: len(v) for i, v in near.items()}
        todo, seen = [], set()
        for start in sorted(near, key=lambda i: (degree[i], i)):
            if start in seen:
                continue
            seen.add(start)
            queue, at = [start], 0
            while at < len(queue):
                here = queue[at]
                at += 1
                fresh = sorted({j for j in near[here] if j not in seen}, key=lambda i: (degree[i], i))
                seen.update(fresh)
                queue.extend(fresh)
            todo.extend(queue)
        if reverse:
            todo.reverse()
        return pd.DataFrame({"old": todo, "new": range(len(todo))})

    return everything.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(lambda pdf: order(pdf[["i", "j"]]), "old long, new long")


def top_k(m: DataFrame, k: int) -> DataFrame:
    """The k largest |a| of each row; ties by column."""
    from pyspark.sql.window import Window

    return m.withColumn("_r", F.row_number().over(Window.partitionBy("i").orderBy(F.abs("a").desc(), "j"))).where(F.col("_r") <= k).drop("_r")


def power_iteration(m: DataFrame, start: DataFrame, steps: int) -> tuple[DataFrame, float]:
    """(vector, Rayleigh quotient) after ``steps`` normalised products."""
    from .products import spmv

    v, value = start, 0.0
    for _ in range(steps):
        w = written(spmv(m, v).join(v.select("i", F.col("x").alias("_v")), "i", "left"), "power")
        s = w.agg(F.sum(F.col("x") * F.col("x")).alias("n"), F.sum(F.col("x") * F.coalesce("_v", F.lit(0.0))).alias("r"), F.sum(F.col("_v") * F.col("_v")).alias("o")).first()
        value = float(s["r"] / s["o"]) if s["o"] else 0.0
        v = w.select("i", (F.col("x") / (s["n"] ** 0.5)).alias("x"))
    return v, value


def largest_eigenvalue(m: DataFrame, tol: float = 1e-6, steps: int = 1000) -> float:
    """The eigenvalue of largest size of a symmetric matrix: products until the quotient changes by at most ``tol`` of itself."""
    v = nodes(m).select("i", (1.0 + F.pmod(F.col("i") * 2654435761, F.lit(1000003)) / 1000003.0).alias("x"))
    last = None
    for _ in range(steps):
        v, value = power_iteration(m, v, 1)
        if last is not None and abs(value - last) <= tol * abs(value):
            return value
        last = value
    raise RuntimeError(f"no eigenvalue within {tol} after {steps} products")
