"""Assembly of matrices and vectors from streams of entries.

Entries that arrive late or repeatedly add up, so a stream of element contributions gives the assembled matrix without
watermarks: the state is one running sum per stored position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_matrix(entries: DataFrame) -> DataFrame:
    """Streaming (i, j, a) contributions as running sums (output mode update or complete)."""
    return entries.groupBy("i", "j").agg(F.sum("a").alias("a"))


def windowed_products(entries: DataFrame, x: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """y = A x per time window of streaming entries with a time column: a stream-static join and a windowed sum."""
    rows = entries.withWatermark(time, delay).join(x.select(F.col("i").alias("j"), "x"), "j")
    return rows.groupBy(F.window(time, width).alias("w"), "i").agg(F.sum(F.col("a") * F.col("x")).alias("x")).select(F.col("w.start").alias("start"), "i", "x")


def into_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's contributions, summed, appended as Parquet: reading it back and summing gives the matrix. A batch that is
    replayed after a failure overwrites its own folder, so nothing counts twice."""

    def save(batch: DataFrame, number: int) -> None:
        batch.groupBy("i", "j").agg(F.sum("a").alias("a")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
