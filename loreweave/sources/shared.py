"""The folder that all executors share, for tables and checkpoints that cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. A temporary one where none is set and the master
    is local (tests); anywhere else that is an error, as executors don't share a machine's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
            own = tempfile.mkdtemp(prefix="loreweave-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            sc.setCheckpointDir("file://" + own)
        base = sc.getCheckpointDir()
    return re.sub("^file:/(?!/)", "file:///", base).rstrip("/")


def new_table(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder; its name begins with lw-."""
    return f"{shared_dir(spark)}/lw-{tag}-{uuid.uuid4().hex}"


def expire(spark: SparkSession, seconds: float) -> int:
    """Removes intermediate tables (lw-*) of the shared folder that were last changed so long ago; how many there were."""
    jvm, n = spark.sparkContext._jvm, 0
    folder = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        if status.getPath().getName().startswith("lw-") and status.getModificationTime() < (time.time() - seconds) * 1000:
            n += bool(fs.delete(status.getPath(), True))
    return n


def read_blocks(uri: str, rows: int) -> Iterator[pa.Table]:
    """In a task: a table of the shared folder, so many rows at a time."""
    fs, path = pafs.FileSystem.from_uri(uri)
    for batch in pads.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=rows, batch_readahead=1, fragment_readahead=1):
        if batch.num_rows:
            yield pa.Table.from_batches([batch])


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once into a table in the shared folder, without its lineage. A checkpoint would compute it twice."""
    spark = df.sparkSession
    path = new_table(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame) -> DataFrame:
    """``df`` for several readings: kept in the shared folder if its plan shuffles, as it is if it only scans."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return cut(df) if any(x in plan for x in ("Aggregate", "Join", "Window", "Exchange")) else df


#: Bytes of files for each piece of a table: so many up to BYPASS pieces, which a shuffle writes without sorting, then so many at most.
PIECE, PIECE_MOST, BYPASS = 4 << 20, 16 << 20, 200


def spread(df: DataFrame, *keys: str, beside: DataFrame | None = None) -> DataFrame:
    """``df`` by its keys in as many pieces as the files that it (and ``beside``) is made from need, so that a task's
    memory doesn't grow with the input: pieces of a number that is given aren't merged, and aggregates and joins by these keys
    need no other exchange. As it is where a table has no known size.
    """
    size = 0
    for x in (df, beside):
        leaves = [] if x is None else _sizes(x)
        if any(n is None for n in leaves):
            return df
        size += sum(leaves)
    return df.repartition(pieces(size, df.sparkSession.sparkContext.defaultParallelism), *keys)


def pieces(size: int, least: int) -> int:
    return max(least, min(-(-size // PIECE), BYPASS), -(-size // PIECE_MOST))


def _sizes(df: DataFrame) -> list[int | None]:
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return [n if n < 1 << 62 else None for n in sizes]  # rows that only the driver's plan knows have a size of 2^63 - 1
