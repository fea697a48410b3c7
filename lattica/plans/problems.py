"""Model problems as tables: finite differences on grids, and P1 finite elements on triangle meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def poisson(spark: SparkSession, n: int, dim: int = 2, shift: float = 0.0) -> DataFrame:
    """(2 dim + 1)-point Laplacian on n^dim interior points, Dirichlet, plus ``shift`` on the diagonal (a time step)."""
    total, ids = n**dim, F.col("id")
    moves = [F.struct(F.lit(0).alias("k"), F.lit(0).alias("s"), F.lit(2.0 * dim + shift).alias("a"))]
    moves += [F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(-1.0).alias("a")) for k in range(dim) for s in (-1, 1)]
    rows = spark.range(total).select(ids, F.explode(F.array(*moves)).alias("m"))
    inside, step = F.lit(True), F.lit(0).cast("long")
    for k in range(dim):
        here = F.col("m.k") == k
        at = F.floor(ids / n**k) % n + F.when(here, F.col("m.s")).otherwise(0)
        inside = inside & at.between(0, n - 1)
        step = step + F.when(here, F.col("m.s") * F.lit(n**k)).otherwise(0)
    return rows.where(inside).select(ids.alias("i"), (ids + step).alias("j"), F.col("m.a").alias("a"))


def convection(spark: SparkSession, n: int, speed: float = 0.5) -> DataFrame:
    """2-D Laplacian with an upwind term: not symmetric."""
    return poisson(spark, n, 2).select("i", "j", (F.col("a") + F.when(F.col("i") == F.col("j"), speed).when(F.col("j") == F.col("i") - 1, -speed).otherwise(0.0)).alias("a"))


def red_black(spark: SparkSession, n: int, dim: int = 2) -> DataFrame:
    """(i, c): parity of the coordinate sum on the grid of ``poisson``; its neighbours have the other colour."""
    parity = sum((F.floor(F.col("id") / n**k) % n for k in range(dim)), F.lit(0)) % 2
    return spark.range(n**dim).select(F.col("id").alias("i"), parity.cast("int").alias("c"))


def eight_classes(spark: SparkSession, n: int) -> DataFrame:
    """(i, c): classes by the parities of the three coordinates."""
    at = lambda k: F.floor(F.col("id") / n**k) % 2
    return spark.range(n**3).select(F.col("id").alias("i"), (at(0) + 2 * at(1) + 4 * at(2)).cast("int").alias("c"))


def block_matrix(m: DataFrame, block: list[list[float]]) -> DataFrame:
    """Kronecker product with a small dense block, as entries."""
    nb = len(block)
    cells = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(float(v)).alias("v")) for r, row in enumerate(block) for c, v in enumerate(row)])
    return m.select("i", "j", "a", F.explode(cells).alias("b")).select((F.col("i") * nb + F.col("b.r")).alias("i"), (F.col("j") * nb + F.col("b.c")).alias("j"), (F.col("a") * F.col("b.v")).alias("a"))


# P1 finite elements


def unit_square_mesh(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """nodes (id, x, y, boundary) and elements (e, v0, v1, v2): n x n squares cut along one diagonal."""
    k = n + 1
    nodes = spark.range(k * k).select("id", (F.col("id") % k / n).alias("x"), (F.floor(F.col("id") / k) / n).alias("y"))
    nodes = nodes.withColumn("boundary", (F.col("x") == 0) | (F.col("x") == 1) | (F.col("y") == 0) | (F.col("y") == 1))
    corner = F.floor(F.col("id") / n) * k + F.col("id") % n
    cells = spark.range(n * n).select("id", corner.alias("c"))
    low = cells.select((2 * F.col("id")).alias("e"), F.col("c").alias("v0"), (F.col("c") + 1).alias("v1"), (F.col("c") + k + 1).alias("v2"))
    high = cells.select((2 * F.col("id") + 1).alias("e"), F.col("c").alias("v0"), (F.col("c") + k + 1).alias("v1"), (F.col("c") + k).alias("v2"))
    return nodes, low.union(high)


def refine(nodes: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every triangle into four by edge midpoints. Midpoints are named by their edge (a pair of ids), then numbered."""
    from ..operators.matrix import prolong_renumber

    first = int(nodes.agg(F.max("id")).first()[0]) + 1
    edge = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    pairs = elements.select("e", F.explode(F.array(edge("v0", "v1"), edge("v1", "v2"), edge("v2", "v0"))).alias("p")).select("p.a", "p.b")
    shared = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("uses")).withColumn("key", F.col("a") * first + F.col("b"))
    number = prolong_renumber(shared.select(F.col("key").alias("i"), F.lit(1).alias("mark"))).select(F.col("i").alias("key"), (F.col("new") + first).alias("id"))
    mids = shared.join(number, "key")
    at = lambda s: nodes.select(F.col("id").alias(s), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    new = mids.join(at("a"), "a").join(at("b"), "b").select("id", ((F.col("xa") + F.col("xb")) / 2).alias("x"), ((F.col("ya") + F.col("yb")) / 2).alias("y"), (F.col("uses") == 1).alias("boundary"))
    out = elements
    for k, (u, v) in enumerate((("v0", "v1"), ("v1", "v2"), ("v2", "v0"))):
        out = out.withColumn("key", F.least(u, v) * first + F.greatest(u, v)).join(number.select("key", F.col("id").alias(f"m{k}")), "key").drop("key")
    tri = F.array(*[F.struct((4 * F.col("e") + n).alias("e"), *[F.col(c).alias(f"v{k}") for k, c in enumerate(t)]) for n, t in enumerate((("v0", "m0", "m2"), ("m0", "v1", "m1"), ("m2", "m1", "v2"), ("m0", "m1", "m2")))])
    return nodes.select("id", "x", "y", "boundary").unionByName(new), out.select(F.explode(tri).alias("t")).select("t.*")


def with_corners(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements with corner coordinates and twice the signed area."""
    out = elements
    for k in range(3):
        out = out.join(nodes.select(F.col("id").alias(f"v{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), f"v{k}")
    return out.withColumn("area2", F.expr("(x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)"))


def stiffness(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Stiffness matrix of P1 elements: nine local entries per triangle, summed."""
    el = with_corners(nodes, elements)
    cells = []
    for r in range(3):
        for c in range(3):
            a, b, p, q = (r + 1) % 3, (r + 2) % 3, (c + 1) % 3, (c + 2) % 3
            value = f"((y{a} - y{b}) * (y{p} - y{q}) + (x{b} - x{a}) * (x{q} - x{p})) / (2 * abs(area2))"
            cells.append(F.struct(F.col(f"v{r}").alias("i"), F.col(f"v{c}").alias("j"), F.expr(value).alias("a")))
    return el.select(F.explode(F.array(*cells)).alias("m")).select("m.*").groupBy("i", "j").agg(F.sum("a").alias("a"))


def mass(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    el = with_corners(nodes, elements)
    cells = [F.struct(F.col(f"v{r}").alias("i"), F.col(f"v{c}").alias("j"), F.expr(f"abs(area2) / {12 if r == c else 24}").alias("a")) for r in range(3) for c in range(3)]
    return el.select(F.explode(F.array(*cells)).alias("m")).select("m.*").groupBy("i", "j").agg(F.sum("a").alias("a"))


def load(nodes: DataFrame, elements: DataFrame, f: str) -> DataFrame:
    """Load vector by the edge-midpoint rule (exact for quadratics) of f, an SQL expression of x and y."""
    el = with_corners(nodes, elements)
    parts = []
    for r in range(3):
        terms = []
        for a, b in ((r, (r + 1) % 3), (r, (r + 2) % 3)):
            expr = f.replace("x", "\0").replace("y", "\1").replace("e\0p", "exp").replace("\0", f"((x{a} + x{b}) / 2)").replace("\1", f"((y{a} + y{b}) / 2)")
            terms.append(f"({expr})")
        parts.append(F.struct(F.col(f"v{r}").alias("i"), F.expr(f"abs(area2) / 12 * ({' + '.join(terms)})").alias("x")))
    return el.select(F.explode(F.array(*parts)).alias("m")).select("m.*").groupBy("i").agg(F.sum("x").alias("x"))


def dirichlet(m: DataFrame, b: DataFrame, nodes: DataFrame, value: str = "0.0") -> tuple[DataFrame, DataFrame]:
    """Interior part of a system; known boundary values (an SQL expression of x and y) move to the right-hand side."""
    free = nodes.where("not boundary").select(F.col("id").alias("i"))
    fixed = nodes.where("boundary").select(F.col("id").alias("j"), F.expr(value).cast("double").alias("_g"))
    rows = m.join(free, "i", "left_semi")
    inner = rows.join(free.select(F.col("i").alias("j")), "j", "left_semi").select("i", "j", "a")
    moved = rows.join(fixed, "j").groupBy("i").agg(F.sum(F.col("a") * F.col("_g")).alias("_m"))
    return inner, b.join(free, "i", "left_semi").join(moved, "i", "left").select("i", (F.col("x") - F.coalesce("_m", F.lit(0.0))).alias("x"))


def l2_error(nodes: DataFrame, elements: DataFrame, u: DataFrame, exact: str) -> DataFrame:
    """One row: L2 norm of u - exact by the edge-midpoint rule; u (i, x) over nodes."""
    el = with_corners(nodes, elements)
    for k in range(3):
        el = el.join(u.select(F.col("i").alias(f"v{k}"), F.col("x").alias(f"u{k}")), f"v{k}", "left").fillna(0.0, [f"u{k}"])
    terms = []
    for a, b in ((0, 1), (1, 2), (2, 0)):
        expr = exact.replace("x", "\0").replace("y", "\1").replace("e\0p", "exp").replace("\0", f"((x{a} + x{b}) / 2)").replace("\1", f"((y{a} + y{b}) / 2)")
        terms.append(f"pow((u{a} + u{b}) / 2 - ({expr}), 2)")
    return el.agg(F.sqrt(F.sum(F.expr(f"abs(area2) / 6 * ({' + '.join(terms)})"))).alias("l2_error"))
