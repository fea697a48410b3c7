"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

1. Rows fall into P logical partitions by a hash of their content, so the same input gives the same shards however
   Spark splits it.
2. The matrix of how many rows go from each partition to each shard is drawn exactly: row sums are the partition sizes,
   column sums are the shard sizes (at most one apart), and every fill is as likely as under a uniform shuffle.
3. Each partition orders its rows by a seeded hash (local permutation) and deals them out by its row of the matrix.
4. In each shard, rows are ordered by a second seeded hash and numbered from 0. The order is kept in ranges of that hash,
   so no task ever holds a shard.

Only the P x shards matrix reaches the driver; P grows with the row count (``rows_per_part``) up to ``most_parts``, beyond
which partitions grow instead (their sorts spill).

Defined results: a null text counts as empty (size 1, crc 0); empty tables give no rows; repeated rows are separate rows
(they get separate slots); extra columns are kept by ``shard_rows`` unless they are named like its outputs, then replaced.
"""

from __future__ import annotations

import math
import random
from decimal import Context, Decimal
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written


_DIGITS = Context(prec=34)
_HALF_LOG_TAU = _DIGITS.divide(_DIGITS.ln(_DIGITS.multiply(2, Decimal("3.14159265358979323846264338327950288"))), 2)


@lru_cache(1 << 16)
def log_factorial(n: int) -> Decimal:
    """ln n! to about 30 digits: exact below 400, else by Stirling's series, whose sixth term is below 1e-31 there."""
    if n < 400:
        return _DIGITS.ln(Decimal(math.factorial(n)))
    x, ln = Decimal(n), _DIGITS.ln(Decimal(n))
    out = _DIGITS.add(_DIGITS.subtract(_DIGITS.multiply(_DIGITS.add(x, Decimal("0.5")), ln), x), _HALF_LOG_TAU)
    for power, number in ((1, 12), (3, -360), (5, 1260), (7, -1680), (9, 1188)):  # Bernoulli numbers over 2k (2k - 1)
        out = _DIGITS.add(out, _DIGITS.divide(1, _DIGITS.multiply(number, _DIGITS.power(x, power))))
    return out


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw of how many of ``draws`` picks out of good + bad are good: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    # The probability of the mode from 34-digit logarithms: differences of double ones lose 0.6 % at 10^12 rows.
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))

    def choose(n: int, k: int) -> Decimal:
        return _DIGITS.subtract(log_factorial(n), _DIGITS.add(log_factorial(k), log_factorial(n - k)))

    p_mode = float(_DIGITS.exp(_DIGITS.subtract(_DIGITS.add(choose(good, mode), choose(bad, draws - mode)), choose(total, draws))))
    u = rng.random() - p_mode
    if u < 0:
        return mode
    up, down, p_up, p_down = mode, mode, p_mode, p_mode
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u < 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u < 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(part_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Random matrix with these row and column sums: row after row, each a multivariate hypergeometric draw."""
    if sum(part_sizes) != sum(shard_sizes):
        raise ValueError("partition and shard sizes differ in total")
    rng, left, matrix = random.Random(seed), list(shard_sizes), []
    for size in part_sizes:
        rest, total, row = size, sum(left), []
        for s, room in enumerate(left):
            x = hypergeometric(rng, room, total - room, rest)
            row.append(x)
            rest, total = rest - x, total - room
            left[s] -= x
        matrix.append(row)
    return matrix


def shard_rows(
    spark: SparkSession,
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = 16,
    seed: int = 2026,
    rows_per_part: int = 20_000,
    most_parts: int = 8192,
    carry: list[str] | None = None,
) -> DataFrame:
    """``df`` (or its columns in ``carry``) with size, text_crc32, shard (int) and slot (long, gapless from 0 in each shard)."""
    base = df.drop("size", "text_crc32", "shard", "slot", "_part", "_h1", "_h2")
    body = F.coalesce(F.col(text), F.lit(""))
    kept = base.columns if carry is None else carry
    rows = base.select(
        *kept,
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("_h1"),
        F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text)).alias("_h2"),
        *([] if key in kept else [F.col(key)]),
    )
    total = df.count()
    parts = max(1, min(most_parts, math.ceil(total / rows_per_part)))
    rows = rows.withColumn("_part", F.pmod(F.shiftright(F.col("_h1"), 20), F.lit(parts)).cast("int"))
    sizes = dict(rows.groupBy("_part").count().collect())  # P numbers, P = total / rows_per_part
    shard_sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([sizes.get(p, 0) for p in range(parts)], shard_sizes, seed)
    cumulated = [(p, [sum(row[: s + 1]) for s in range(shards)]) for p, row in enumerate(matrix)]
    plan = spark.createDataFrame(cumulated, "_part int, _cum array<long>")

    ties = ["_h1", "size", "text_crc32", key]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*ties)))
    dealt = ranked.join(plan, "_part").withColumn(
        "shard", F.size(F.filter("_cum", lambda c: c < F.col("_rank"))).cast("int")
    )
    # Ranges of the second hash, about rows_per_part rows each: the second permutation needs no whole shard in a task.
    cells = max(1, math.ceil(total / shards / rows_per_part))
    width = -(-(1 << 62) // cells)
    dealt = dealt.withColumn("_cell", F.expr(f"int(shiftrightunsigned(_h2, 2) div {width}L)"))
    dealt = written(spark, dealt.drop("_part", "_cum", "_rank", "_h1"), "dealt")
    counts = dealt.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("shard", "_cell").orderBy("_h2", "size", "text_crc32", key)
    out = dealt.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, ["shard", "_cell"])
    return out.select(*kept, "size", "text_crc32", "shard", (F.col("_off") + F.col("_in")).alias("slot"))
