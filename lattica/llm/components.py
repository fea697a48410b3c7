"""Connected components of a graph given as edges, on tables.

An edge is stored once, from its smaller node u to its larger node v. Wherever edges are written, each task first puts
stars in the place of what it holds: its edges, up to ``CHUNK`` at a time, give way to one edge from the smallest node of
each of their components to every other node of it. That keeps what is connected, needs no shuffle, and leaves no loops,
no repeats among them and short paths. In a round every node that is some edge's v takes the smallest of its neighbours (a
grouped minimum, combined before the shuffle), the trees that arise are flattened by pointer jumping, and the edges are
contracted: both ends are replaced by their roots. What a node became is kept apart, and the rounds are put together at
the end, from the last to the first. A node that takes nothing in a round is joined by a neighbour in it or has a smaller
neighbour in the next, so the nodes left halve at least every two rounds. A star has fewer edges than nodes, so the edges
of a task shrink with them; only repeats between tasks stay. No neighbourhood is gathered; every join has plain written
tables on both sides, so a node that very many edges share is split by the adaptive skew join. Each step is written in the
shared folder. Edges that come out of a shuffle are best written before they are given here: they are then read, and put in
stars, by fewer tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

CHUNK = 1 << 18  #: Edges that a task holds at once.


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) of the graph with edges u, v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        np.minimum.at(root, b, a)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return nodes, nodes[root]


def _stars(batches):
    def out(held):
        u, v = (np.concatenate([h.column(i).to_numpy(zero_copy_only=False) for h in held]) for i in range(2))
        node, least = smallest(u, v)
        kept = node != least
        return pa.record_batch([pa.array(x[kept], held[0].column(0).type) for x in (least, node)], names=["u", "v"])

    held = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(h.num_rows for h in held) >= CHUNK:
            yield out(held)
            held = []
    if held:
        yield out(held)


def _contracted(edges: DataFrame) -> DataFrame:
    plain = edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return plain.mapInArrow(_stars, ", ".join(f"{name} {kind}" for name, kind in plain.dtypes))


def _flat(hooks: DataFrame) -> DataFrame:
    """(v, up) with ``up`` the root of v's tree, from (v, up) with any smaller node of it."""
    spark = hooks.sparkSession
    while True:
        above = hooks.select(F.col("v").alias("up"), F.col("up").alias("top"))
        new = written(spark, hooks.join(above, "up", "left").select("v", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "jumps")
        drop(spark, hooks)
        hooks = new
        if not hooks.where("moved").limit(1).count():
            return hooks.drop("moved")
        hooks = hooks.drop("moved")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``: label is the smallest node of its component. Nulls are not nodes."""
    spark = edges.sparkSession
    there = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    left, rounds = written(spark, _contracted(there), "edges"), []
    while left.limit(1).count():
        root = _flat(written(spark, left.groupBy("v").agg(F.min("u").alias("up")), "hooks"))
        rounds.append(root)
        ends = left.join(root.select(F.col("v").alias("u"), F.col("up").alias("ru")), "u", "left").join(root.select("v", F.col("up").alias("rv")), "v")
        new = written(spark, _contracted(ends.select(F.coalesce("ru", "u").alias("u"), F.col("rv").alias("v"))), "edges")
        drop(spark, left)
        left = new
    if not rounds:
        return left.select(F.col("u").alias("node"), F.col("v").alias("label"))
    label = rounds.pop().select(F.col("v").alias("node"), F.col("up").alias("label"))
    while rounds:
        # Nodes of later rounds are roots of this one, so no node is in both parts.
        early = rounds.pop().join(label.select(F.col("node").alias("up"), F.col("label").alias("last")), "up", "left")
        new = written(spark, early.select(F.col("v").alias("node"), F.coalesce("last", "up").alias("label")).union(label), "labels")
        drop(spark, label)
        label = new
    return label.union(label.select(F.col("label").alias("node"), "label").distinct())
