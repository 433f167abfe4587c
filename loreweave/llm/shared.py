"""Shared-folder tables and Arrow plumbing used by every operator of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir

SLICE_BYTES = 1 << 20


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lw-{tag}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Each name, with as many underscores behind it as it takes to differ from every column, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bound_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by bytes as well as rows, so very long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def trim() -> None:
    """Hand freed memory back to the system: workers are reused, and would keep a stage's most for all later ones."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def large_text(column: pa.Array) -> pa.Array:
    """A contiguous large_string array; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy row ranges of a batch with about ``most`` bytes of text each (one row at least)."""
    import numpy as np

    if not batch.num_rows:
        return
    arr = large_text(batch.column(batch.schema.get_field_index(text)))
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    at = 0
    while at < len(arr):
        to = int(np.searchsorted(off, off[at] + most, side="right")) - 1
        to = min(max(to, at + 1), len(arr))
        yield batch.slice(at, to - at)
        at = to
