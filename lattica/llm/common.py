"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import new_path

#: The white space that separates words everywhere in this subpackage: 0x20 and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Cuts lineage: writes ``df`` once as Parquet in the shared folder and reads it back."""
    path = new_path(spark, tag)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Removes what ``written`` made, once nothing reads it any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else sorted({f.rsplit("/part-", 1)[0] for f in df_or_path.inputFiles()})
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (a lambda variable), however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def byte_view(texts) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary Arrow array as (bytes, offsets); nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    kind = pa.large_binary()
    if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    arr = pc.fill_null(arr.cast(kind), b"")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def release() -> None:
    """Gives freed memory of a worker back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def by_bytes(batches, column: str, limit: int = 8 << 20):
    """Arrow record batches cut so that one holds about ``limit`` bytes of ``column``, or a single row.

    Freed memory goes back to the system after each batch: workers live on between stages.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offs = byte_view(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offs, offs[start] + limit, "right")) - 1
            end = max(start + 1, min(end, batch.num_rows))
            yield batch.slice(start, end - start)
            start = end
        del batch
        release()
