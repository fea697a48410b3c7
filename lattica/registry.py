"""Registered queries of the sparse engine: each applies an operator to matrices derived from the driver's tables or to a
model problem, with the SQL that states the same rows. Values are rounded to 6 digits on both sides, since parallel sums
reorder. Iterative methods solve systems of known solution, which the SQL states.

Matrices: B (order x part, summed quantity), G = B^T B, L = the graph Laplacian of G plus the identity, T (event
transitions of users), and ``poisson``: the 5-point Laplacian on 20 x 20 points with the right-hand side ``rhs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import dense
from .operators import checks, formats, graph, matrix, products, vector
from .plans import amg, gmg, krylov, problems, smoothers, solve
from .plans.params import SolverParams
from .sources import files
from .tables import new_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
N = 20  # grid of the model problem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.matrix(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey", "l_partkey", "l_quantity")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("i"), F.col("p_retailprice").cast("double").alias("x"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("i"), F.col("o_totalprice").cast("double").alias("x"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier x part: how often."""
    return matrix.matrix(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey", F.lit(1.0))


def galerkin_factors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Supplier x part and B, straight from the rows of lineitem: equal positions are not yet summed."""
    items = table(spark, sf_dir, "lineitem")
    return matrix.entries(items, "l_suppkey", "l_partkey", F.lit(1.0)), matrix.entries(items, "l_orderkey", "l_partkey", "l_quantity")


def nation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("agg"))


def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.gram(incidence(spark, sf_dir))


def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of G off its diagonal, plus 1, minus G off its diagonal."""
    g = written(gram(spark, sf_dir), "gram")
    off = g.where("i != j")
    return off.select("i", "j", (-F.col("a")).alias("a")).unionByName(g.groupBy("i").agg((F.coalesce(F.sum(F.when(F.col("i") != F.col("j"), F.col("a"))), F.lit(0.0)) + 1.0).alias("a")).select("i", F.col("i").alias("j"), "a"))


B_SQL = "b AS (SELECT CAST(l_orderkey AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j, CAST(sum(l_quantity) AS DOUBLE) AS a FROM lineitem GROUP BY 1, 2)"
S_SQL = "s AS (SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS a FROM lineitem GROUP BY 1, 2)"
X_SQL = "x AS (SELECT CAST(p_partkey AS BIGINT) AS i, CAST(p_retailprice AS DOUBLE) AS x FROM part)"
Y_SQL = "y AS (SELECT CAST(o_orderkey AS BIGINT) AS i, CAST(o_totalprice AS DOUBLE) AS x FROM orders)"
G_SQL = f"{B_SQL}, g AS MATERIALIZED (SELECT p.j AS i, q.j AS j, sum(p.a * q.a) AS a FROM b p JOIN b q ON p.i = q.i GROUP BY 1, 2)"
L_SQL = f"{G_SQL}, l AS MATERIALIZED (SELECT i, j, -a AS a FROM g WHERE i <> j UNION ALL SELECT i, i, coalesce(sum(CASE WHEN i <> j THEN a END), 0) + 1 FROM g GROUP BY i)"
P_SQL = f"""n AS (SELECT CAST(range AS BIGINT) AS i, range % {N} AS u, range // {N} AS v FROM range({N * N})),
 p AS (SELECT i, i AS j, 4.0::DOUBLE AS a FROM n UNION ALL SELECT i, i - 1, -1.0 FROM n WHERE u > 0 UNION ALL SELECT i, i + 1, -1.0 FROM n WHERE u < {N - 1}
  UNION ALL SELECT i, i - {N}, -1.0 FROM n WHERE v > 0 UNION ALL SELECT i, i + {N}, -1.0 FROM n WHERE v < {N - 1}),
 f AS (SELECT i, (i * 2654435761 % 1000003) / 1000003.0 AS x FROM n)"""


def poisson(spark: SparkSession) -> DataFrame:
    return problems.poisson(spark, N, 2)


def rhs(spark: SparkSession) -> DataFrame:
    return matrix.hashed_vector(spark, N * N)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sql_rounded(body: str, keys: list[str], values: list[str]) -> str:
    return f"SELECT {', '.join(keys + [f'round({v}, 6) + 0.0 AS {v}' for v in values])} FROM ({body})"


def query(name: str, keys: list[str] | None = None, values: list[str] | None = None, sql: str | None = None, ctes: str = ""):
    """Registers a query; with SQL, its outer select rounds the value columns."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = (f"WITH {ctes} " if ctes else "") + _sql_rounded(sql, keys or [], values or [])
        return f

    return add


M, V = ["i", "j"], ["i"]

# Products

query("spmv", V, ["x"], "SELECT b.i, sum(a * x) AS x FROM b JOIN x ON b.j = x.i GROUP BY 1", f"{B_SQL}, {X_SQL}")(lambda s, d: products.spmv(incidence(s, d), prices(s, d)))
query("spmv_boolean", V, ["x"], "SELECT s_nationkey::BIGINT AS i, sum(s_acctbal) AS x FROM supplier GROUP BY 1")(
    lambda s, d: products.spmv_boolean(nation_map(s, d).select(F.col("agg").alias("i"), F.col("i").alias("j")), table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("i"), F.col("s_acctbal").cast("double").alias("x")))
)
query("axpy_spmv", V, ["x"], "SELECT i, sum(x) AS x FROM (SELECT i, x FROM y UNION ALL SELECT b.i, -0.5 * a * x FROM b JOIN x ON b.j = x.i) GROUP BY 1", f"{B_SQL}, {X_SQL}, {Y_SQL}")(
    lambda s, d: products.axpy_spmv(-0.5, incidence(s, d), prices(s, d), totals(s, d))
)
query("bilinear", [], ["yax"], "SELECT sum(y.x * a * x.x) / 1e9 AS yax FROM b JOIN x ON b.j = x.i JOIN y ON b.i = y.i", f"{B_SQL}, {X_SQL}, {Y_SQL}")(
    lambda s, d: products.bilinear(totals(s, d), incidence(s, d), prices(s, d)).select((F.col("yax") / 1e9).alias("yax"))
)
query("left_spmv", V, ["x"], "SELECT b.j AS i, sum(y.x * a) AS x FROM b JOIN y ON b.i = y.i GROUP BY 1", f"{B_SQL}, {Y_SQL}")(lambda s, d: products.left_spmv(totals(s, d), incidence(s, d)))
query("left_pattern", V, [], "SELECT DISTINCT b.j AS i FROM b JOIN y ON b.i = y.i WHERE y.x > 300000", f"{B_SQL}, {Y_SQL}")(lambda s, d: products.left_pattern(totals(s, d).where("x > 300000"), incidence(s, d)))
query("gram", M, ["a"], "SELECT * FROM g", G_SQL)(gram)
query("spgemm", M, ["a"], "SELECT s.i, b.i AS j, sum(s.a * b.a) AS a FROM s JOIN b ON s.j = b.j GROUP BY 1, 2", f"{B_SQL}, {S_SQL}")(
    lambda s, d: products.spgemm(suppliers(s, d), matrix.transpose(incidence(s, d)))
)
query("spgemm_pattern", M, [], "SELECT DISTINCT p.i, q.i AS j FROM s p JOIN s q ON p.j = q.j", S_SQL)(lambda s, d: products.spgemm_pattern(suppliers(s, d), matrix.transpose(suppliers(s, d))))
query("sandwich", M, ["a"], "SELECT p.i, q.i AS j, sum(p.a * x * q.a) AS a FROM s p JOIN x ON p.j = x.i JOIN s q ON p.j = q.j GROUP BY 1, 2", f"{S_SQL}, {X_SQL}")(
    lambda s, d: products.sandwich(suppliers(s, d), prices(s, d), matrix.transpose(suppliers(s, d)))
)
GS_SQL = "gs AS (SELECT g.i, q.i AS j, sum(g.a * q.a) AS a FROM g JOIN s q ON g.j = q.j GROUP BY 1, 2)"
query("galerkin", M, ["a"], "SELECT p.i, gs.j, sum(p.a * gs.a) AS a FROM s p JOIN gs ON p.j = gs.i GROUP BY 1, 2", f"{G_SQL}, {S_SQL}, {GS_SQL}")(
    lambda s, d: products.galerkin_of_gram(*galerkin_factors(s, d))
)
query("galerkin_boolean", M, ["a"], "SELECT p.s_nationkey::BIGINT AS i, q.s_nationkey::BIGINT AS j, sum(ss.a) AS a FROM ss JOIN supplier p ON ss.i = p.s_suppkey JOIN supplier q ON ss.j = q.s_suppkey GROUP BY 1, 2", f"{S_SQL}, ss AS (SELECT p.i, q.i AS j, sum(p.a * q.a) AS a FROM s p JOIN s q ON p.j = q.j GROUP BY 1, 2)")(
    lambda s, d: products.galerkin_boolean(nation_map(s, d), products.spgemm(suppliers(s, d), matrix.transpose(suppliers(s, d))))
)
query("schur", M, ["a"], "SELECT i, j, sum(a) AS a FROM (SELECT s_suppkey::BIGINT AS i, s_suppkey::BIGINT AS j, s_acctbal AS a FROM supplier UNION ALL SELECT p.i, q.i, -p.a * x * q.a FROM s p JOIN x ON p.j = x.i JOIN s q ON p.j = q.j) GROUP BY 1, 2", f"{S_SQL}, {X_SQL}")(
    lambda s, d: products.schur(table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("i"), F.col("s_acctbal").cast("double").alias("x")), b := written(suppliers(s, d), "suppliers"), prices(s, d), matrix.transpose(b))
)
query("residual", V, ["x"], "SELECT f.i, f.x - sum(p.a * g.x) AS x FROM f JOIN p ON p.i = f.i JOIN f g ON g.i = p.j GROUP BY f.i, f.x", P_SQL)(lambda s, d: products.residual(rhs(s), poisson(s), rhs(s)))

# Vectors

query("dot", [], ["dot"], "SELECT sum(p.x * q.x) / 1e6 AS dot FROM x p JOIN (SELECT j AS i, sum(a) AS x FROM b GROUP BY 1) q ON p.i = q.i", f"{B_SQL}, {X_SQL}")(
    lambda s, d: vector.dot(prices(s, d), matrix.row_sums(matrix.transpose(incidence(s, d)))).select((F.col("dot") / 1e6).alias("dot"))
)
query("norms", [], ["norm1", "norm2", "norminf"], "SELECT sum(abs(x)) AS norm1, sqrt(sum(x * x)) AS norm2, max(abs(x)) AS norminf FROM x", X_SQL)(lambda s, d: vector.norms(prices(s, d)))
query("axpby", V, ["x"], "SELECT coalesce(x.i, y.i) AS i, 2 * coalesce(x.x, 0) - 0.25 * coalesce(y.x, 0) AS x FROM x FULL JOIN y ON x.i = y.i", f"{X_SQL}, {Y_SQL}")(lambda s, d: vector.axpby(2.0, prices(s, d), -0.25, totals(s, d)))
query("max_difference", [], ["max_difference"], "SELECT max(abs(coalesce(x.x, 0) - coalesce(y.x, 0))) AS max_difference FROM x FULL JOIN y ON x.i = y.i", f"{X_SQL}, {Y_SQL}")(lambda s, d: vector.max_difference(prices(s, d), totals(s, d)))
query("relative_error", [], ["relative_error"], "SELECT sqrt(sum((p.x - q.x) ** 2)) / sqrt(sum(p.x ** 2)) AS relative_error FROM x p JOIN (SELECT i, round(x) AS x FROM x) q ON p.i = q.i", X_SQL)(
    lambda s, d: vector.relative_error(prices(s, d), prices(s, d).select("i", F.round("x").alias("x")))
)
query("has_nan", ["has_nan"], [], "SELECT bool_or(isnan(x)) AS has_nan FROM x", X_SQL)(lambda s, d: vector.has_nan(prices(s, d)))
query("vector_scale", V, ["x"], "SELECT i, 1.5 * x AS x FROM x", X_SQL)(lambda s, d: vector.scale(prices(s, d), 1.5))
query("hashed_vector", V, ["x"], "SELECT i, x FROM f", P_SQL)(lambda s, d: rhs(s))
query("constant_vector", V, ["x"], f"SELECT CAST(range AS BIGINT) AS i, 2.5 AS x FROM range({N})")(lambda s, d: matrix.constant(s, N, 2.5))

# Structure

query("transpose", M, ["a"], "SELECT j AS i, i AS j, a FROM b", B_SQL)(lambda s, d: matrix.transpose(incidence(s, d)))
PERM_SQL = "m AS (SELECT CAST(p_partkey AS BIGINT) AS old, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS new FROM part)"


def price_order(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").cast("long").alias("old"), (F.row_number().over(Window.orderBy("p_retailprice", "p_partkey")) - 1).cast("long").alias("new"))


query("permute", M, ["a"], "SELECT p.new AS i, q.new AS j, a FROM g JOIN m p ON g.i = p.old JOIN m q ON g.j = q.old", f"{G_SQL}, {PERM_SQL}")(lambda s, d: matrix.permute(gram(s, d), price_order(s, d)))
query("permute_vector", V, ["x"], "SELECT m.new AS i, x FROM x JOIN m ON x.i = m.old", f"{X_SQL}, {PERM_SQL}")(lambda s, d: matrix.permute_vector(prices(s, d), price_order(s, d)))
query("submatrix", M, ["a"], "SELECT p.new AS i, q.new AS j, a FROM g JOIN m p ON g.i = p.old JOIN m q ON g.j = q.old WHERE p.new < 50 AND q.new < 30", f"{G_SQL}, {PERM_SQL}")(
    lambda s, d: matrix.submatrix(gram(s, d), price_order(s, d).where("new < 50"), price_order(s, d).where("new < 30"))
)
query("diagonal", V, ["x"], "SELECT i, a AS x FROM g WHERE i = j", G_SQL)(lambda s, d: matrix.diagonal(gram(s, d)))
query("column", V, ["x"], "SELECT x.i, coalesce(g.a, 0) AS x FROM x LEFT JOIN g ON g.i = x.i AND g.j = 7", f"{G_SQL}, {X_SQL}")(lambda s, d: matrix.column(gram(s, d), 7, prices(s, d)))
query("regularise_diagonal", M, ["a"], "SELECT i, j, CASE WHEN i = j AND a <= 200 THEN 3.0 ELSE a END AS a FROM g", G_SQL)(
    lambda s, d: matrix.regularise_diagonal(gram(s, d).withColumn("a", F.when((F.col("i") == F.col("j")) & (F.col("a") <= 200), 0.0).otherwise(F.col("a"))), 3.0)
)
query("compress", M, ["a"], "SELECT * FROM g WHERE abs(a) > 1500", G_SQL)(lambda s, d: matrix.compress(gram(s, d), 1500.0))
query("shift", M, ["a"], "SELECT i + 1 AS i, j + 1 AS j, a FROM s", S_SQL)(lambda s, d: matrix.shift(suppliers(s, d), 1))
query("longest_row", ["longest_row"], [], "SELECT max(c) AS longest_row FROM (SELECT count(*) AS c FROM g GROUP BY i)", G_SQL)(lambda s, d: matrix.longest_row(gram(s, d)))
query("symmetric_diagonal_scaling", M, ["a"], "SELECT l.i, l.j, l.a / sqrt(p.a * q.a) AS a FROM l JOIN (SELECT i, a FROM l WHERE i = j) p ON l.i = p.i JOIN (SELECT i, a FROM l WHERE i = j) q ON l.j = q.i", L_SQL)(
    lambda s, d: (lambda m: matrix.symmetric_diagonal_scaling(m, matrix.diagonal(m)))(laplacian(s, d))
)
query("matrix_add", M, ["a"], "SELECT i, j, sum(a) AS a FROM (SELECT i, j, 2 * a AS a FROM s UNION ALL SELECT i, j, -1 * a FROM b) GROUP BY 1, 2", f"{B_SQL}, {S_SQL}")(lambda s, d: matrix.add(suppliers(s, d), incidence(s, d), 2.0, -1.0))
query("symmetric_pattern", M, ["a"], "SELECT i, j, sum(a) AS a FROM (SELECT * FROM s UNION ALL SELECT j, i, 0 FROM s) GROUP BY 1, 2", S_SQL)(lambda s, d: matrix.symmetric_pattern(suppliers(s, d)))
query("merge_duplicates", M, ["a"], "SELECT l_suppkey::BIGINT AS i, l_partkey::BIGINT AS j, sum(l_quantity) AS a FROM lineitem GROUP BY 1, 2")(
    lambda s, d: matrix.merge_duplicates(table(s, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("j"), F.col("l_quantity").cast("double").alias("a")))
)
query("duplicates", [*M, "stored"], [], "SELECT l_suppkey::BIGINT AS i, l_partkey::BIGINT AS j, count(*) AS stored FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(
    lambda s, d: matrix.duplicates(table(s, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("j")))
)
# Quotients of small integers end in rounding ties, which the engines may round apart: both sides add 3e-8 to what is shown.
query("inverse_diagonal_scaling", M, ["a"], "SELECT l.i, l.j, l.a / p.a + 3e-8 AS a FROM l JOIN (SELECT i, a FROM l WHERE i = j) p ON l.i = p.i", L_SQL)(
    lambda s, d: matrix.inverse_diagonal_scaling(laplacian(s, d)).withColumn("a", F.col("a") + 3e-8)
)
query("entry_rank", [*M, "pos"], ["a"], "SELECT i, j, a, row_number() OVER (PARTITION BY i ORDER BY i <> j, j) - 1 AS pos FROM g", G_SQL)(lambda s, d: matrix.entry_rank(gram(s, d), True).withColumn("pos", F.col("pos").cast("long")))
query("pattern_image", ["bi", "bj", "stored"], [], "SELECT CAST(floor(i * 16 / n) AS BIGINT) AS bi, CAST(floor(j * 16 / n) AS BIGINT) AS bj, count(*) AS stored FROM (SELECT i, j, (SELECT greatest(max(i), max(j)) + 1 FROM g)::DOUBLE AS n FROM g) GROUP BY 1, 2", G_SQL)(lambda s, d: matrix.pattern_image(gram(s, d), 16))
query("top_k_per_row", M, ["a"], "SELECT i, j, a FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY abs(a) DESC, j) AS r FROM g) WHERE r <= 5", G_SQL)(lambda s, d: graph.top_k(gram(s, d), 5))

# Formats

query("compressed_rows", ["i", "n", "first", "last"], [], "SELECT i, count(*) AS n, min(j) AS first, max(j) AS last FROM g GROUP BY 1", G_SQL)(
    lambda s, d: formats.to_rows(gram(s, d)).select("i", F.size("cols").cast("long").alias("n"), F.element_at("cols", 1).alias("first"), F.element_at("cols", -1).alias("last"))
)
query("rows_by_length", ["length", "i"], [], "SELECT count(*) AS length, i FROM g GROUP BY i", G_SQL)(lambda s, d: formats.rows_by_length(gram(s, d)))
query("block_round_trip", M, ["a"], "SELECT * FROM g WHERE a <> 0", G_SQL)(lambda s, d: formats.from_blocks(formats.to_blocks(gram(s, d), 4), 4))
query("bands_round_trip", M, ["a"], "SELECT * FROM p", P_SQL)(lambda s, d: formats.from_bands(formats.to_bands(poisson(s))))
query("grid_of_blocks_round_trip", M, ["a"], "SELECT * FROM p", P_SQL)(
    lambda s, d: formats.from_grid_of_blocks(formats.to_grid_of_blocks(poisson(s), N * N // 4), s.createDataFrame([(k, N * N // 4) for k in range(4)], "b int, n long"))
)

# Checks

query("check_diagonal", ["n_negative", "n_zero", "n_stored"], [], "SELECT count(*) FILTER (a < 0) AS n_negative, count(*) FILTER (abs(a) < 1e-20) AS n_zero, count(*) AS n_stored FROM l WHERE i = j", L_SQL)(lambda s, d: checks.diagonal_signs(laplacian(s, d)))
query("check_dominance", ["n_weak", "n_rows"], [], "SELECT count(*) FILTER (s < 0) AS n_weak, count(*) AS n_rows FROM (SELECT sum(CASE WHEN i = j THEN a ELSE -abs(a) END) AS s FROM g GROUP BY i)", G_SQL)(lambda s, d: checks.weak_rows(gram(s, d)))
query("check_symmetry", ["symmetric_pattern", "symmetric_values"], ["largest_difference"], "SELECT count(*) FILTER (p.a IS NULL OR q.a IS NULL) = 0 AS symmetric_pattern, max(abs(coalesce(p.a, 0) - coalesce(q.a, 0))) = 0 AS symmetric_values, max(CASE WHEN coalesce(p.a, 0) = coalesce(q.a, 0) THEN 0 ELSE abs(coalesce(p.a, 0) - coalesce(q.a, 0)) / (abs(coalesce(p.a, 0)) + abs(coalesce(q.a, 0))) END) AS largest_difference FROM s p FULL JOIN s q ON p.i = q.j AND p.j = q.i", S_SQL)(
    lambda s, d: checks.symmetry(suppliers(s, d))
)
query("check_validity", ["n_stored", "n_outside", "n_repeated", "n_empty_rows"], [], "SELECT count(*) AS n_stored, count(*) FILTER (i > 99 OR j > 99) AS n_outside, 0::BIGINT AS n_repeated, 100 - count(DISTINCT CASE WHEN i <= 99 AND j <= 99 THEN i END) AS n_empty_rows FROM g", G_SQL)(lambda s, d: checks.validity(gram(s, d), 100, 100))
query("check_row_order", ["n_disordered"], [], "SELECT 0::BIGINT AS n_disordered")(lambda s, d: checks.row_order(matrix.entry_rank(gram(s, d))))

# Blocks: products of embedding vectors as 2 x 2 blocks

E_SQL = "e AS (SELECT vec_id::BIGINT AS i, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings)"


def embedding_blocks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("i"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("m"))


def _cells(df: DataFrame, value) -> DataFrame:
    return df.select("i", *[F.get(value, k).alias(f"m{k}") for k in range(4)])


query("dense_times", V, ["m0", "m1", "m2", "m3"], "SELECT i, a * a + b * c AS m0, a * b + b * d AS m1, c * a + d * c AS m2, c * b + d * d AS m3 FROM e", E_SQL)(lambda s, d: _cells(embedding_blocks(s, d), dense.times(F.col("m"), F.col("m"), 2)))
query("dense_vector", V, ["m0", "m1"], "SELECT i, a * 2 - b AS m0, c * 2 - d AS m1 FROM e", E_SQL)(lambda s, d: embedding_blocks(s, d).withColumn("v", dense.times_vector(F.col("m"), F.array(F.lit(2.0), F.lit(-1.0)), 2)).select("i", F.get("v", 0).alias("m0"), F.get("v", 1).alias("m1")))
query("dense_add", V, ["m0", "m1", "m2", "m3"], "SELECT i, 2 * a + 1 AS m0, 2 * b AS m1, 2 * c AS m2, 2 * d + 1 AS m3 FROM e", E_SQL)(lambda s, d: _cells(embedding_blocks(s, d), dense.add(F.col("m"), dense.identity(2), 2.0, 1.0)))
query("dense_norms", V, ["fro", "one", "inf", "biggest"], "SELECT i, sqrt(a * a + b * b + c * c + d * d) AS fro, greatest(abs(a) + abs(c), abs(b) + abs(d)) AS one, greatest(abs(a) + abs(b), abs(c) + abs(d)) AS inf, greatest(abs(a), abs(b), abs(c), abs(d)) AS biggest FROM e", E_SQL)(
    lambda s, d: embedding_blocks(s, d).select("i", dense.norm_fro(F.col("m")).alias("fro"), dense.norm_one(F.col("m"), 2).alias("one"), dense.norm_inf(F.col("m"), 2).alias("inf"), dense.norm_max(F.col("m")).alias("biggest"))
)
DOMINANT_SQL = "SELECT i, (d + 9) / q AS m0, -b / q AS m1, -c / q AS m2, (a + 9) / q AS m3 FROM (SELECT *, (a + 9) * (d + 9) - b * c AS q FROM e)"
query("dense_inverse", V, ["m0", "m1", "m2", "m3"], DOMINANT_SQL, E_SQL)(lambda s, d: _cells(embedding_blocks(s, d).withColumn("v", dense.inverse_udf(2)(dense.add(F.col("m"), dense.identity(2), 1.0, 9.0))), F.col("v")))
query("dense_solve", V, ["m0", "m1"], "SELECT i, ((d + 9) * 1 - b * 2) / q AS m0, ((a + 9) * 2 - c * 1) / q AS m1 FROM (SELECT *, (a + 9) * (d + 9) - b * c AS q FROM e)", E_SQL)(
    lambda s, d: embedding_blocks(s, d).withColumn("v", dense.solve_udf(2)(dense.add(F.col("m"), dense.identity(2), 1.0, 9.0), F.array(F.lit(1.0), F.lit(2.0)))).select("i", F.get("v", 0).alias("m0"), F.get("v", 1).alias("m1"))
)
query("block_spmv", V, ["x"], "SELECT p.i, sum(p.a * f.x) AS x FROM p JOIN f ON p.j = f.i GROUP BY 1", P_SQL)(
    lambda s, d: dense.block_spmv(formats.to_blocks(poisson(s), 4), rhs(s).groupBy(F.floor(F.col("i") / 4).alias("b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v")), 4).select("b", F.posexplode("v").alias("k", "x")).select((F.col("b") * 4 + F.col("k")).alias("i"), "x")
)
query("block_transpose", M, ["a"], "SELECT l_partkey::BIGINT AS i, l_suppkey::BIGINT AS j, count(*)::DOUBLE AS a FROM lineitem GROUP BY 1, 2")(lambda s, d: formats.from_blocks(dense.block_transpose(formats.to_blocks(suppliers(s, d), 3), 3), 3))
LDU_SQL = "w AS (SELECT i, i AS k, 1.0::DOUBLE AS w FROM n UNION ALL SELECT i, i - 1, 0.25 FROM n WHERE i % 2 = 1)"  # L^-1 of the blocks ((4, -1), (-1, 4))
query("block_ldu_scaling", M, ["a"], "SELECT l.i, u.i AS j, sum(l.w * p.a * u.w) AS a FROM p JOIN w l ON l.k = p.i JOIN w u ON u.k = p.j GROUP BY 1, 2 HAVING abs(sum(l.w * p.a * u.w)) > 1e-9", P_SQL + ", " + LDU_SQL)(
    lambda s, d: formats.from_blocks(dense.block_ldu_scaling(formats.to_blocks(poisson(s), 2), 2), 2).where("abs(a) > 1e-9")
)
query("condense", M, ["a"], "SELECT i // 2 AS i, j // 2 AS j, sqrt(sum(a * a)) AS a FROM p GROUP BY 1, 2", P_SQL)(lambda s, d: dense.condense(formats.to_blocks(poisson(s), 2), 2))
query("block_compress", M, ["a"], "SELECT p.i, p.j, p.a FROM p WHERE i // 2 = j // 2", P_SQL)(lambda s, d: formats.from_blocks(dense.block_compress(formats.to_blocks(poisson(s), 2), 1.5), 2))
query("block_inverse_diagonal_scaling", M, ["a"], "SELECT i, j, sum(a) AS a FROM (SELECT r.i, p.j, r.w * p.a AS a FROM p JOIN (SELECT i, i AS k, 4.0 / 15 AS w FROM n UNION ALL SELECT i, CASE WHEN i % 2 = 0 THEN i + 1 ELSE i - 1 END, 1.0 / 15 FROM n) r ON r.k = p.i) GROUP BY 1, 2 HAVING abs(sum(a)) > 1e-9", P_SQL)(
    lambda s, d: formats.from_blocks(dense.block_inverse_diagonal_scaling(formats.to_blocks(poisson(s), 2), 2), 2).where("abs(a) > 1e-9")
)

# Smoothers on the model problem, from zero guess

JACOBI = "z AS (SELECT f.i, 0.8 * f.x / 4 AS x FROM f)"
query("jacobi", V, ["x"], "SELECT z.i, 0.2 * z.x + 0.8 * (f.x - coalesce(s.v, 0)) / 4 AS x FROM z JOIN f ON z.i = f.i LEFT JOIN (SELECT p.i, sum(p.a * z.x) AS v FROM p JOIN z ON p.j = z.i WHERE p.i <> p.j GROUP BY 1) s ON s.i = z.i", f"{P_SQL}, {JACOBI}")(
    lambda s, d: smoothers.jacobi(poisson(s), rhs(s), matrix.constant(s, N * N, 0.0), 0.8, 2)
)
query("l1_diagonal", V, ["x"], "SELECT f.i, f.x / q.w AS x FROM f JOIN (SELECT i, sum(abs(a)) AS w FROM p GROUP BY 1) q ON f.i = q.i", P_SQL)(lambda s, d: smoothers.l1_diagonal(poisson(s), rhs(s), matrix.constant(s, N * N, 0.0)))
RED = f"n2 AS (SELECT i, (u + v) % 2 AS c FROM n), red AS (SELECT f.i, CASE WHEN c = 0 THEN f.x / 4 ELSE 0 END AS x FROM f JOIN n2 ON f.i = n2.i)"
query("red_black_gauss_seidel", V, ["x"], "SELECT f.i, CASE WHEN c = 0 THEN f.x / 4 ELSE (f.x - coalesce(s.v, 0)) / 4 END AS x FROM f JOIN n2 ON f.i = n2.i LEFT JOIN (SELECT p.i, sum(p.a * red.x) AS v FROM p JOIN red ON p.j = red.i WHERE p.i <> p.j GROUP BY 1) s ON s.i = f.i", f"{P_SQL}, {RED}")(
    lambda s, d: smoothers.colour_sweep(poisson(s), rhs(s), matrix.constant(s, N * N, 0.0), problems.red_black(s, N))
)
query("kaczmarz_averaged", V, ["x"], "SELECT p.j AS i, sum(p.a * f.x / q.w) / count(*) AS x FROM p JOIN f ON p.i = f.i JOIN (SELECT i, sum(a * a) AS w FROM p GROUP BY 1) q ON q.i = p.i GROUP BY 1", P_SQL)(
    lambda s, d: smoothers.block_jacobi_kaczmarz(poisson(s), rhs(s), matrix.constant(s, N * N, 0.0))
)
OFF = "SELECT p.i, sum(p.a * {0}.x) AS v FROM p JOIN {0} ON p.j = {0}.i WHERE p.i <> p.j GROUP BY 1"
SOR = f"n2 AS (SELECT i, (u + v) % 2 AS c FROM n), red AS (SELECT f.i, CASE WHEN c = 0 THEN 1.5 * f.x / 4 ELSE 0 END AS x FROM f JOIN n2 ON f.i = n2.i), so AS ({OFF.format('red')})"
query("sor_sweep", V, ["x"], "SELECT f.i, CASE WHEN c = 0 THEN red.x ELSE 1.5 * (f.x - coalesce(so.v, 0)) / 4 END AS x FROM f JOIN n2 ON f.i = n2.i JOIN red ON red.i = f.i LEFT JOIN so ON so.i = f.i", f"{P_SQL}, {SOR}")(
    lambda s, d: smoothers.colour_sweep(poisson(s), rhs(s), matrix.constant(s, N * N, 0.0), problems.red_black(s, N), 1.5)
)
SGS = f"""{RED}, s0 AS ({OFF.format("red")}), black AS (SELECT f.i, CASE WHEN c = 0 THEN red.x ELSE (f.x - coalesce(s0.v, 0)) / 4 END AS x FROM f JOIN n2 ON f.i = n2.i JOIN red ON red.i = f.i LEFT JOIN s0 ON s0.i = f.i),
 s1 AS ({OFF.format("black")})"""
query("symmetric_gauss_seidel", V, ["x"], "SELECT f.i, CASE WHEN c = 1 THEN black.x ELSE (f.x - coalesce(s1.v, 0)) / 4 END AS x FROM f JOIN n2 ON f.i = n2.i JOIN black ON black.i = f.i LEFT JOIN s1 ON s1.i = f.i", f"{P_SQL}, {SGS}")(
    lambda s, d: smoothers.symmetric_sweep(poisson(s), rhs(s), matrix.constant(s, N * N, 0.0), problems.red_black(s, N))
)
# Degree 3 on [1/2, 2]: the weights of T_0 .. T_3 are 1, -2/3, 2/9, -1/12, and S v = (A v / 4 - 5/4 v) / (3/4).
SHIFTED = "SELECT p.i, sum(p.a * {0}.x) / 3 AS y FROM p JOIN {0} ON p.j = {0}.i GROUP BY 1"
POLY = f"""t0 AS (SELECT i, x / 4 AS x FROM f), y0 AS ({SHIFTED.format("t0")}), t1 AS (SELECT t0.i, y - 5 * x / 3 AS x FROM t0 JOIN y0 ON t0.i = y0.i),
 y1 AS ({SHIFTED.format("t1")}), t2 AS (SELECT t1.i, 2 * (y - 5 * t1.x / 3) - t0.x AS x FROM t1 JOIN y1 ON t1.i = y1.i JOIN t0 ON t0.i = t1.i),
 y2 AS ({SHIFTED.format("t2")}), t3 AS (SELECT t2.i, 2 * (y - 5 * t2.x / 3) - t1.x AS x FROM t2 JOIN y2 ON t2.i = y2.i JOIN t1 ON t1.i = t2.i)"""
query("polynomial_smoother", V, ["x"], "SELECT t0.i, t0.x - 2 * t1.x / 3 + 2 * t2.x / 9 - t3.x / 12 AS x FROM t0 JOIN t1 ON t1.i = t0.i JOIN t2 ON t2.i = t0.i JOIN t3 ON t3.i = t0.i", f"{P_SQL}, {POLY}")(
    lambda s, d: smoothers.polynomial(poisson(s), rhs(s), matrix.constant(s, N * N, 0.0), 3, 1, 1 / 2.0)
)
CUBE = """n3 AS (SELECT CAST(range AS BIGINT) AS i, range % 6 AS u, range // 6 % 6 AS v, range // 36 AS w FROM range(216)), f3 AS (SELECT i, (i * 2654435761 % 1000003) / 1000003.0 AS x FROM n3),
 o3 AS (SELECT p.i, q.i AS j FROM n3 p JOIN n3 q ON abs(p.u - q.u) + abs(p.v - q.v) + abs(p.w - q.w) = 1), c3 AS (SELECT i, u % 2 + 2 * (v % 2) + 4 * (w % 2) AS c FROM n3), z0 AS (SELECT i, 0.0::DOUBLE AS x FROM n3)""" + "".join(
    f", z{c + 1} AS (SELECT z{c}.i, CASE WHEN c = {c} THEN (f3.x + coalesce(s.v, 0)) / 6 ELSE z{c}.x END AS x FROM z{c} JOIN f3 ON f3.i = z{c}.i JOIN c3 ON c3.i = z{c}.i LEFT JOIN (SELECT o3.i, sum(z{c}.x) AS v FROM o3 JOIN z{c} ON o3.j = z{c}.i GROUP BY 1) s ON s.i = z{c}.i)"
    for c in range(8)
)
query("eight_class_gauss_seidel", V, ["x"], "SELECT i, x FROM z8", CUBE)(
    lambda s, d: smoothers.colour_sweep(problems.poisson(s, 6, 3), matrix.hashed_vector(s, 216), matrix.constant(s, 216, 0.0), problems.eight_classes(s, 6), order=list(range(8)))
)

# Multigrid pieces

STRONG = "st AS (SELECT l.i, l.j FROM l JOIN (SELECT i, max(CASE WHEN i <> j THEN abs(a) END) AS m, sum(abs(a)) AS t, sum(CASE WHEN i = j THEN abs(a) END) AS d FROM l GROUP BY 1) r ON l.i = r.i WHERE l.i <> l.j AND -l.a > 0.3 * m AND NOT t < 1.1 * d)"
query("amg_strength", M, [], "SELECT * FROM st", f"{L_SQL}, {STRONG}")(lambda s, d: amg.strength(laplacian(s, d)))


def even_marks(s: SparkSession) -> DataFrame:
    return s.range(N * N).select(F.col("id").alias("i"), F.when((F.col("id") % N + F.floor(F.col("id") / N)) % 2 == 0, 1).otherwise(0).alias("mark"))


INTERP = f"""k AS (SELECT i, CASE WHEN (u + v) % 2 = 0 THEN 1 ELSE 0 END AS mark FROM n), num AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS c FROM k WHERE mark = 1),
 pi AS (SELECT p.i, num.c AS j, -(q.t / q.s) * p.a / 4 AS a FROM p JOIN k ON k.i = p.i AND k.mark = 0 JOIN num ON num.i = p.j JOIN (SELECT i, sum(a) AS t, sum(a) AS s FROM p WHERE i <> j GROUP BY 1) q ON q.i = p.i WHERE p.i <> p.j UNION ALL SELECT i, c, 1.0 FROM num)"""
query("amg_direct_interpolation", M, ["a"], "SELECT * FROM pi", f"{P_SQL}, {INTERP}")(lambda s, d: amg.direct_interpolation(poisson(s), amg.strength(poisson(s), 0.25, 2.0), even_marks(s)))
query("amg_truncation", M, ["a"], "SELECT g.i, g.j, g.a * r.t / (SELECT sum(a) FROM g h WHERE h.i = g.i AND h.a >= 0.2 * r.m) AS a FROM g JOIN (SELECT i, max(a) AS m, sum(a) AS t FROM g GROUP BY 1) r ON g.i = r.i WHERE g.a >= 0.2 * r.m", G_SQL)(lambda s, d: amg.truncate(gram(s, d), 0.2))
query("amg_galerkin", M, ["a"], "SELECT x.j AS i, y.j AS j, sum(x.a * p.a * y.a) AS a FROM pi x JOIN p ON x.i = p.i JOIN pi y ON y.i = p.j GROUP BY 1, 2", f"{P_SQL}, {INTERP}")(
    lambda s, d: products.ptap(amg.direct_interpolation(poisson(s), amg.strength(poisson(s), 0.25, 2.0), even_marks(s)), poisson(s))
)
query("amg_distance_two", M, [], "SELECT p.i, q.j FROM e p JOIN e q ON p.j = q.i JOIN k x ON x.i = p.i AND x.mark = 1 JOIN k y ON y.i = q.j AND y.mark = 1 WHERE p.i <> q.j GROUP BY 1, 2 HAVING count(DISTINCT p.j) >= 2", f"{P_SQL}, {INTERP}, e AS (SELECT i, j FROM p WHERE i <> j)")(
    lambda s, d: amg.distance_two(poisson(s).where("i != j").select("i", "j"), even_marks(s).where("mark = 1"), 2)
)
query("amg_smoothed_prolongator", M, ["a"], "SELECT i, j, sum(a) AS a FROM (SELECT i, i // 4 AS j, 1.0 AS a FROM n UNION ALL SELECT i, j // 4, -0.67 * a / 4 FROM p) GROUP BY 1, 2", P_SQL)(
    lambda s, d: amg.smoothed_prolongator(poisson(s), s.range(N * N).select(F.col("id").alias("i"), F.floor(F.col("id") / 4).alias("agg")))
)
query("amg_reduction_interpolation", M, ["a"], "SELECT p.i, num.c AS j, -p.a / ((2 - 1.0) * 4) AS a FROM p JOIN k ON k.i = p.i AND k.mark = 0 JOIN num ON num.i = p.j WHERE p.i <> p.j UNION ALL SELECT i, c, 1.0 FROM num", f"{P_SQL}, {INTERP}")(lambda s, d: amg.reduction_interpolation(poisson(s), even_marks(s)))
query("gmg_stencil", ["x", "y"], ["u"], "SELECT g.x, g.y, 4 * g.x * g.y - CASE WHEN g.x > 1 THEN (g.x - 1) * g.y ELSE 0 END - CASE WHEN g.x < 15 THEN (g.x + 1) * g.y ELSE 0 END - CASE WHEN g.y > 1 THEN g.x * (g.y - 1) ELSE 0 END - CASE WHEN g.y < 15 THEN g.x * (g.y + 1) ELSE 0 END + 0.0::DOUBLE AS u FROM (SELECT (range % 15 + 1)::INT AS x, (range // 15 + 1)::INT AS y FROM range(225)) g")(
    lambda s, d: gmg.apply_stencil(gmg.grid(s, 16, 2, "x * y"), 2)
)
query("gmg_restrict", ["x", "y"], ["u"], "SELECT (x // 2)::INT AS x, (y // 2)::INT AS y, 4.0::DOUBLE * x * y AS u FROM (SELECT range % 15 + 1 AS x, range // 15 + 1 AS y FROM range(225)) WHERE x % 2 = 0 AND y % 2 = 0")(lambda s, d: gmg.restrict(gmg.grid(s, 16, 2, "x * y"), 2))
query("gmg_interpolate", ["x", "y"], ["u"], "SELECT x::INT AS x, y::INT AS y, (CASE WHEN x < 15 THEN x / 2 ELSE 3.5 END) * (CASE WHEN y < 15 THEN y / 2 ELSE 3.5 END) AS u FROM (SELECT range % 15 + 1 AS x, range // 15 + 1 AS y FROM range(225))")(lambda s, d: gmg.interpolate(gmg.grid(s, 8, 2, "x * y"), 16, 2))

# Model problems and elements

query("poisson_matrix", M, ["a"], "SELECT * FROM p", P_SQL)(lambda s, d: poisson(s))
query("fem_stiffness", M, ["a"], f"SELECT i, j, a FROM (SELECT i, j, CASE WHEN i = j THEN 4.0 ELSE -1.0 END AS a FROM (SELECT r.i, c.i AS j FROM q r JOIN q c ON abs(r.u - c.u) + abs(r.v - c.v) <= 1 WHERE r.u BETWEEN 1 AND 7 AND r.v BETWEEN 1 AND 7))", "q AS (SELECT CAST(range AS BIGINT) AS i, range % 9 AS u, range // 9 AS v FROM range(81))")(
    lambda s, d: (lambda n, e: problems.stiffness(n, e).join(n.where("not boundary").select(F.col("id").alias("i")), "i", "left_semi").where("abs(a) > 1e-12"))(*problems.unit_square_mesh(s, 8))
)
query("fem_mass_rows", V, ["x"], "SELECT CAST(range AS BIGINT) AS i, 1 / 64.0 AS x FROM range(81) WHERE range % 9 BETWEEN 1 AND 7 AND range // 9 BETWEEN 1 AND 7")(
    lambda s, d: (lambda n, e: matrix.row_sums(problems.mass(n, e)).join(n.where("not boundary").select(F.col("id").alias("i")), "i", "left_semi"))(*problems.unit_square_mesh(s, 8))
)
query("fem_load", V, ["x"], "SELECT CAST(range AS BIGINT) AS i, 1 / 64.0 AS x FROM range(81) WHERE range % 9 BETWEEN 1 AND 7 AND range // 9 BETWEEN 1 AND 7")(
    lambda s, d: (lambda n, e: problems.load(n, e, "1.0").join(n.where("not boundary").select(F.col("id").alias("i")), "i", "left_semi"))(*problems.unit_square_mesh(s, 8))
)

# Graphs

TRANS = "tr AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)"
query("event_transitions", ["src", "dst"], ["p"], "SELECT a AS src, b AS dst, count(*) / sum(count(*)) OVER (PARTITION BY a) AS p FROM tr WHERE b IS NOT NULL GROUP BY 1, 2", TRANS)(
    lambda s, d: table(s, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst")).where("dst is not null").groupBy("src", "dst").count().select("src", "dst", (F.col("count") / F.sum("count").over(Window.partitionBy("src"))).alias("p"))
)
query("triangular_levels", ["i", "level"], [], "SELECT i, (u + v)::INT AS level FROM n", P_SQL)(lambda s, d: graph.levels(poisson(s)))
query("independent_set", ["n_nodes", "n_picked", "n_conflicts", "n_uncovered"], [], "SELECT 400::BIGINT AS n_nodes, 200::BIGINT AS n_picked, 0::BIGINT AS n_conflicts, 0::BIGINT AS n_uncovered")(
    lambda s, d: (lambda e, p: p.join(e.join(p.where("picked = 1").select(F.col("i").alias("j")), "j", "left_semi").select("i").distinct().withColumn("near", F.lit(1)), "i", "left").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("picked").cast("long").alias("n_picked"), F.count(F.when((F.col("picked") == 1) & (F.col("near") == 1), 1)).alias("n_conflicts"), F.count(F.when((F.col("picked") == 0) & F.col("near").isNull(), 1)).alias("n_uncovered")))(graph.neighbours(poisson(s)), graph.independent_set(poisson(s)))
)
query("breadth_levels", ["root", "i", "hops"], [], "SELECT 0::BIGINT AS root, i, (u + v)::INT AS hops FROM n WHERE u + v <= 4", P_SQL)(lambda s, d: graph.breadth_levels(poisson(s), s.range(1).select(F.col("id").alias("i")), 4))
query("strong_pattern", M, ["a"], "SELECT g.i, g.j, g.a FROM g JOIN (SELECT i, sum(abs(a)) AS t FROM g GROUP BY 1) r ON g.i = r.i WHERE g.i = g.j OR abs(g.a) > 0.02 * t", G_SQL)(lambda s, d: graph.strong_pattern(gram(s, d), 0.02))

# Files: written and read back


def _through(s: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    path = new_path(s, "file")
    write(path)
    return read(path)


query("file_coordinate", M, ["a"], "SELECT * FROM s", S_SQL)(lambda s, d: _through(s, lambda p: files.write_triples(suppliers(s, d), p, 10**6, 10**6), lambda p: files.read_triples(s, p)))
query("file_matrix_market", M, ["a"], "SELECT * FROM s", S_SQL)(lambda s, d: _through(s, lambda p: files.write_matrix_market(suppliers(s, d), p, 10**6, 10**6), lambda p: files.read_matrix_market(s, p)))
query("file_matrix_market_symmetric", M, ["a"], "SELECT * FROM p", P_SQL)(lambda s, d: _through(s, lambda p: files.write_matrix_market(poisson(s).where("j <= i"), p, N * N, N * N), lambda p: files.read_matrix_market(s, p, True)))
query("file_compressed_rows", M, ["a"], "SELECT * FROM p", P_SQL)(lambda s, d: _through(s, lambda p: files.write_csr(poisson(s), p, N * N), lambda p: files.read_csr(s, f"{p}/part-*")))
query("file_rows_and_vector", V, ["x"], "SELECT i, x FROM f", P_SQL)(lambda s, d: _through(s, lambda p: files.write_csr(poisson(s), p, N * N, 1, N * N, rhs(s)), lambda p: files.read_csr_with_rhs(s, f"{p}/part-*")[1]))
query("file_blocks", M, ["a"], "SELECT * FROM p", P_SQL)(lambda s, d: _through(s, lambda p: files.write_bsr(formats.to_blocks(poisson(s), 2), p, N * N // 2, N * N // 2, 2), lambda p: files.read_bsr(s, f"{p}/part-*").where("a != 0")))
query("file_bands", M, ["a"], "SELECT * FROM p", P_SQL)(
    lambda s, d: _through(s, lambda p: files.write_bands(_full_bands(s), p, N, N, 1, 1), lambda p: files.read_str(s, f"{p}/part-*").where("a != 0"))
)
query("file_vector", V, ["x"], "SELECT i, x FROM f", P_SQL)(lambda s, d: _through(s, lambda p: files.write_vector(rhs(s), p, N * N), lambda p: files.read_vector(s, f"{p}/part-*")))
query("file_indexed_vector", V, ["x"], "SELECT * FROM x", X_SQL)(lambda s, d: _through(s, lambda p: files.write_indexed_vector(prices(s, d), p), lambda p: files.read_indexed_vector(s, p)))
query("file_self_describing", M, ["a"], "SELECT * FROM p", P_SQL)(lambda s, d: _through(s, lambda p: files.write_self_describing(poisson(s), p, N * N, N * N), lambda p: files.read_matrix(s, f"{p}/part-*")))


def _full_bands(s: SparkSession) -> DataFrame:
    """Bands of the model problem with their zeros: a stored band has no gaps."""
    have = formats.to_bands(poisson(s))
    offs = s.createDataFrame([(o,) for o in (0, -1, 1, -N, N)], "off long")
    every = offs.crossJoin(s.range(N * N).select(F.col("id").alias("pos"))).where(f"pos < {N * N} - abs(off)")
    return every.join(have, ["off", "pos"], "left").select("off", "pos", F.coalesce("blk", F.array(F.lit(0.0))).alias("blk"))


# Iterative methods: the right-hand side is A y for the known y_i = i mod 17 - 8, so the solution that each must reach is
# stated by SQL; it is shown to 4 digits (the systems are solved to 1e-9 and better).

KNOWN = "SELECT CAST(range AS BIGINT) AS i, round((range % 17 - 8)::DOUBLE, 4) AS x FROM range({0})"


def known(s: SparkSession, n: int) -> DataFrame:
    return s.range(n).select(F.col("id").alias("i"), (F.col("id") % 17 - 8).cast("double").alias("x"))


def solves(name: str, n: int, run: Callable[[SparkSession, DataFrame, DataFrame, int], solve.Solution], m: Callable[[SparkSession], DataFrame]) -> None:
    def query_(s: SparkSession, d: str) -> DataFrame:
        a = written(m(s), "system")
        got = run(s, a, written(products.spmv(a, known(s, n)), "known"), n)
        if not got.converged:
            raise RuntimeError(f"{name} ended with {got.code}")
        return rounded(got.x, 4)

    QUERIES[name], ORACLE_SQL[name] = query_, KNOWN.format(n)


def _krylov(method: int | str, pre: str, q: amg.AmgParams = amg.AmgParams(coarse_dof=100), tol: float = 1e-10, **more):
    return lambda s, a, b, n: solve.solve(a, b, n, SolverParams(method, pre, krylov.Control(tol=tol, maxit=2000), q), **more)


def grid(n: int) -> Callable[[SparkSession], DataFrame]:
    return lambda s: problems.poisson(s, n, 2)


for _code, (_name, _, _) in krylov.METHODS.items():
    solves("solve_" + _name.replace(" ", "_"), 3600, _krylov(_code, "amg" if "gmres" in _name or _name == "gcr" else "diag"), grid(60))
for _pre in ("none", "amg", "fmg"):
    solves(f"solve_cg_{_pre}", 3600, _krylov(1, _pre), grid(60))
for _pre in ("ilu", "schwarz"):
    solves(f"solve_cg_{_pre}", 400, _krylov(1, _pre), grid(20))
solves("solve_amg_classical", 400, lambda s, a, b, n: solve.solve_amg(a, b, n, amg.AmgParams(coarse_dof=30, tol=1e-11)), grid(20))
for _kind, _interpolation, _coarsening in (("classical", "standard", "rs"), ("classical", "extended", "aggressive"), ("classical", "energy", "mis"), ("sa", "direct", "rs"), ("ua", "direct", "rs")):
    _q = amg.AmgParams(kind=_kind, interpolation=_interpolation, coarsening=_coarsening, coarse_dof=50, cycle="v" if _kind != "ua" else "kcycle")
    solves(f"solve_gcr_amg_{_kind}_{_interpolation}_{_coarsening}", 3600, _krylov("gcr", "amg", _q), grid(60))
# The same methods on tables: nothing of the finest levels is collected.
solves("solve_cg_on_tables", 36, _krylov("cg", "diag", local_rows=0), grid(6))
solves("solve_gmres_on_tables", 36, _krylov("gmres", "diag", local_rows=0), grid(6))
solves("solve_cg_amg_on_tables", 400, _krylov("cg", "amg", amg.AmgParams(smoother="l1", interpolation="standard", coarse_dof=20, local_rows=200), local_rows=0, tol=1e-7), grid(20))
solves("solve_operator", 36, lambda s, a, b, n: solve.solve_operator(lambda v: products.spmv(a, v), b, n, "cg", krylov.Control(tol=1e-10)), grid(6))
solves("solve_blocks", 400, lambda s, a, b, n: solve.solve_blocks(formats.to_blocks(a, 4), b, n // 4, 4, SolverParams("bicgstab", "diag", krylov.Control(tol=1e-10))), grid(20))
solves("solve_bands", 400, lambda s, a, b, n: solve.solve_bands(formats.to_bands(a), b, n, 1, SolverParams("vgmres", "diag", krylov.Control(tol=1e-10))), grid(20))
solves("solve_grid_of_blocks", 400, lambda s, a, b, n: solve.solve_grid_of_blocks(formats.to_grid_of_blocks(a, 100), [100] * 4, b, SolverParams("vfgmres", "diag", krylov.Control(tol=1e-10)), "sgs"), grid(20))
solves("solve_direct", 400, lambda s, a, b, n: solve.Solution(solve.solve_direct(a, b, n), 0, []), grid(20))


def geometric(s: SparkSession, d: str) -> DataFrame:
    """Multigrid on 63 x 63 points for the image of a known grid function."""
    want = gmg.grid(s, 64, 2, "(x * y) % 7 - 3.0")
    return rounded(gmg.solve(written(gmg.apply_stencil(want, 2), "known"), 64, 2, 1e-11).x, 4)


QUERIES["solve_geometric"] = geometric
ORACLE_SQL["solve_geometric"] = "SELECT x::INT AS x, y::INT AS y, round((x * y % 7 - 3)::DOUBLE, 4) AS u FROM (SELECT range % 63 + 1 AS x, range // 63 + 1 AS y FROM range(3969))"
query("largest_eigenvalue", ["one"], ["value"], "SELECT 1::BIGINT AS one, 22.0::DOUBLE AS value")(  # of ones + 2 I on 20 rows
    lambda s, d: s.range(1, 2).select(F.col("id").alias("one"), F.lit(graph.largest_eigenvalue(s.range(400).select(F.floor(F.col("id") / 20).alias("i"), (F.col("id") % 20).alias("j")).withColumn("a", F.when(F.col("i") == F.col("j"), 3.0).otherwise(1.0)), 1e-9)).alias("value"))
)


def cg_steps(s: SparkSession, m: DataFrame, b: DataFrame, n: int, steps: int) -> DataFrame:
    """Fixed number of distributed CG steps: the vectors of the method on a table."""
    from .plans.space import FrameSpace, multiply

    space = FrameSpace(s.range(n).select(F.col("id").alias("i")))
    got = krylov.cg(krylov.Problem(space, multiply(m), space.vector(b)), krylov.Control(tol=1e-30, abstol=0.0, maxit=steps))
    return space.frame(got.x)


CG_SQL = f"""WITH {P_SQL},
 q0 AS (SELECT p.i, sum(p.a * f.x) AS q FROM p JOIN f ON p.j = f.i GROUP BY 1),
 s0 AS (SELECT sum(f.x * f.x) AS rr, sum(f.x * q) AS pq FROM f JOIN q0 ON f.i = q0.i),
 r1 AS (SELECT f.i, f.x - rr / pq * q AS r, rr / pq * f.x AS x, f.x AS d FROM f JOIN q0 ON f.i = q0.i, s0),
 d1 AS (SELECT i, r + (SELECT sum(r * r) FROM r1) / (SELECT rr FROM s0) * d AS d, r, x FROM r1),
 q1 AS (SELECT p.i, sum(p.a * d1.d) AS q FROM p JOIN d1 ON p.j = d1.i GROUP BY 1),
 s1 AS (SELECT sum(d1.r * d1.r) AS rr, sum(d1.d * q) AS pq FROM d1 JOIN q1 ON d1.i = q1.i)
 SELECT i, round(x + rr / pq * d, 6) + 0.0 AS x FROM d1, s1"""
QUERIES["cg_two_steps"] = lambda s, d: rounded(cg_steps(s, poisson(s), rhs(s), N * N, 2))
ORACLE_SQL["cg_two_steps"] = CG_SQL
POWER_SQL = f"""WITH {P_SQL},
 v1 AS (SELECT p.i, sum(p.a * f.x) AS x FROM p JOIN f ON p.j = f.i GROUP BY 1),
 v2 AS (SELECT p.i, sum(p.a * v1.x) AS x FROM p JOIN v1 ON p.j = v1.i GROUP BY 1)
 SELECT i, round(x / (SELECT sqrt(sum(x * x)) FROM v2), 6) + 0.0 AS x FROM v2"""
QUERIES["power_iteration"] = lambda s, d: rounded(graph.power_iteration(poisson(s), rhs(s), 2)[0])
ORACLE_SQL["power_iteration"] = POWER_SQL
