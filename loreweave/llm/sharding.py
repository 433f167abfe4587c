"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each partition go to each shard is drawn from the multivariate hypergeometric
distribution, by halving: a range of partitions splits its shard counts between its halves with a
generator seeded by the range, so a task derives its own row of the matrix alone. The partition deals
its rows by a seeded local permutation, rows are exchanged once, and each shard permutes what it got.

Defined results
* Every row lands in one shard, nulls, empty texts, repeated rows and all. Shard sizes differ by 1 at most.
* The same input files, seed and number of shards give the same shards, after lost executors, too: how scans are split
  is settled for the session (spark.sql.leafNodeDefaultParallelism, where it isn't set).
* Empty tables: no rows. Columns named shard_id or shard_pos are replaced; all other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches, fresh, write_shared

#: Rows of a shard, or more where there would be more than MOST_SHARDS.
SHARD_ROWS, MOST_SHARDS = 8192, 1 << 16
#: numpy draws from totals below this.
LARGE = 10**9
#: Operators whose partitions and row order are the same each time.
_PLAIN = ("Scan parquet", "ColumnarToRow", "Project", "Filter", "WholeStageCodegen", "InputAdapter")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A draw by numpy, or beyond its range by inversion over the values within twelve deviations of the mode.

    The weights there are products of exact ratios from the mode, whose own weight is 1, so no factorial is rounded; they err
    by less than 1e-9 of themselves, and what lies farther out is less likely than 1e-30.
    """
    total = good + bad
    if total < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    far = int(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))) + 64
    up, down = np.arange(mode, min(high, mode + far), dtype=float), np.arange(mode, max(low, mode - far), -1, dtype=float)
    rise = np.cumprod((good - up) / (up + 1) * ((n - up) / (bad - n + up + 1)))
    fall = np.cumprod(down / (good - down + 1) * ((bad - n + down) / (n - down + 1)))
    weights = np.cumsum(np.concatenate([fall[::-1], [1.0], rise]))
    return mode - len(fall) + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def matrix_row(counts: np.ndarray, sizes: np.ndarray, p: int, seed: int) -> np.ndarray:
    """How many rows partition ``p`` sends to each shard."""
    before = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, have = 0, len(counts), sizes.astype(np.int64).copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left, rest = int(before[mid] - before[lo]), int(before[hi] - before[lo])
        if rest < LARGE:
            take = rng.multivariate_hypergeometric(have, left) if rest else np.zeros_like(have)
        else:
            take = np.zeros_like(have)
            for j, h in enumerate(have):
                rest -= int(h)
                take[j] = hypergeometric(rng, int(h), rest, left) if left else 0
                left -= int(take[j])
        have, lo, hi = (take, lo, mid) if p < mid else (have - take, mid, hi)
    return have


def shard_sizes(n: int, shards: int) -> np.ndarray:
    return n // shards + (np.arange(shards) < n % shards).astype(np.int64)


def _fixed(docs: DataFrame) -> DataFrame:
    """``docs`` if it is a plain file scan, whose partitions are the same each time; else a copy in the shared folder."""
    todo = [docs._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if not node.nodeName().startswith(_PLAIN):  # what isn't known to repeat itself is written once
            return write_shared(docs, "fixed")
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return docs


def shuffle_into_shards(docs: DataFrame, shards: int | None = None, shard_rows: int = SHARD_ROWS, seed: int = 11) -> DataFrame:
    """All rows and columns, with shard_id and shard_pos (from 0 in each shard), uniformly shuffled."""
    spark = docs.sparkSession
    bound_batches(spark)
    if spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) is None:
        # else a scan may be split otherwise when executors have come or gone since its rows were counted
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(spark.sparkContext.defaultParallelism))
    docs = _fixed(docs.drop("shard_id", "shard_pos"))
    key, row_ = fresh(docs.columns, "__lw_key", "__lw_row")
    per = {r[0]: r[1] for r in docs.groupBy(F.spark_partition_id()).count().toLocalIterator()}
    n = sum(per.values())
    counts = np.array([per.get(i, 0) for i in range(max(per, default=-1) + 1)], np.int64)
    s = shards or max(1, min(MOST_SHARDS, -(-n // shard_rows)))
    sizes = shard_sizes(n, s)

    def deal(batches):
        p = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, len(counts), p, 1])
        row = matrix_row(counts, sizes, p, seed) if p < len(counts) else np.zeros(s, np.int64)
        to = rng.permutation(np.repeat(np.arange(s, dtype=np.int32), row))
        at = 0
        for batch in batches:
            k = batch.num_rows
            if at + k > len(to):
                raise RuntimeError(f"partition {p} has more than the {len(to)} rows counted")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to[at : at + k]), pa.array(rng.integers(0, 2**62, k)), pa.array((np.int64(p) << 36) + np.arange(at, at + k))], [*batch.schema.names, "shard_id", key, row_])
            at += k
        if at != len(to):
            raise RuntimeError(f"partition {p} has {at} rows where {len(to)} were counted")

    schema = T.StructType([*docs.schema.fields, T.StructField("shard_id", T.IntegerType()), T.StructField(key, T.LongType()), T.StructField(row_, T.LongType())])
    dealt = docs.mapInArrow(deal, schema)
    own = dealt.repartitionById(s, F.col("shard_id")).sortWithinPartitions(key, row_)
    return own.withColumn("shard_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).drop(key, row_)
