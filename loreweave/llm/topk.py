"""Exact top-k search by a three-phase uniform threshold.

A score is a sum over blocks of dimensions: each block is a list of partial scores. Rows stay where they
are stored; a task reads the queries, block by block, from the shared folder. Phase 1 gathers the head of
every local list and scores those entries; the k-th best score of a query over all tasks is a safe
cut-off. Phase 2 sends it to every task, which collects the entries whose partial score is at least
cut-off / lists in some list (any other sums to less than the cut-off) and whose bound, the lists not yet
read counted at their norms, reaches it; it stops reading lists when few are left. Phase 3 scores those exactly.

The queries are the rows whose vec_id is divisible by ``every``. A task holds ``chunk_rows`` rows and one block
of queries, whatever the table's size; only k rows for each query and task are shuffled.

Defined results
* Null ids and null vectors, vectors with null or non-finite elements, and vectors of another
  dimension than most rows have (of equally frequent ones, the greatest) are neither queries nor hits.
* Rows that repeat a vec_id count once, by the least vector. A row isn't its own hit.
* Ties of score go to the least vec_id. Fewer than k other rows: all of them. Empty tables: no rows.
* Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import new_path, write_shared

EVERY = 50
CHUNK_ROWS = 8192
QUERY_ROWS = 4096
STEP = 256
SLACK = 1e-9
#: With a smaller share of entries left than this, they are scored singly, and lists are read no further.
FEW = 1 / 64


def _matrix(t: pa.Table, name: str, dim: int) -> np.ndarray:
    col = t.column(name).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row; summed in the same order wherever it is called."""
    return np.ascontiguousarray(q * x).sum(axis=1)


def gather(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, blocks: list[slice]) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: (query index, score) of the best k among the heads of each query's lists."""
    rows, scores = [], []
    for i in range(0, len(q), STEP):
        part = q[i : i + STEP]
        heads = []
        for b in blocks:
            p = part[:, b] @ x[:, b].T
            p[qid[i : i + STEP, None] == xid[None, :]] = -np.inf
            m = min(k, p.shape[1])
            heads.append(np.argpartition(-p, m - 1, axis=1)[:, :m])
        head = np.sort(np.concatenate(heads, 1), axis=1)
        row = np.repeat(np.arange(len(part)), head.shape[1])
        col = head.ravel()
        fresh = np.ones(len(col), bool)
        fresh[1:] = (col[1:] != col[:-1]) | (row[1:] != row[:-1])
        fresh &= qid[i + row] != xid[col]
        row, col = row[fresh], col[fresh]
        s = _exact(part[row], x[col])
        order = np.lexsort((-s, row))
        row, s = row[order], s[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        rows.append(row[rank < k] + i)
        scores.append(s[rank < k])
    return np.concatenate(rows), np.concatenate(scores)


def _rest(x: np.ndarray, blocks: list[slice]) -> list[np.ndarray]:
    """Norms of the rows in the blocks after each block."""
    square = [(x[:, b] ** 2).sum(1) for b in blocks]
    return [np.sqrt(sum(square[j + 1 :], np.zeros(len(x)))) for j in range(len(blocks))]


def resolve(q: np.ndarray, qid: np.ndarray, cut: np.ndarray, x: np.ndarray, xid: np.ndarray, blocks: list[slice]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3: (query index, row, score) of all that reach the query's cut-off, and how many entries were scored exactly."""
    rows, cols, scores, resolved = [], [], [], 0
    q_rest, x_rest = _rest(q, blocks), _rest(x, blocks)
    for i in range(0, len(q), STEP):
        part, c = q[i : i + STEP], cut[i : i + STEP, None]
        t = c / len(blocks) - SLACK
        total = np.zeros((len(part), len(x)))
        some = np.zeros((len(part), len(x)), bool)
        for j, b in enumerate(blocks):
            p = part[:, b] @ x[:, b].T
            some |= p >= t
            total += p
            live = total + q_rest[j][i : i + STEP, None] * x_rest[j][None, :] >= c - SLACK
            if np.count_nonzero(live) <= FEW * live.size:
                break
        if j == len(blocks) - 1:  # all lists are read
            live &= some
        row, col = np.nonzero(live & (qid[i : i + STEP, None] != xid[None, :]))
        resolved += len(row)
        s = _exact(part[row], x[col])
        on = s >= cut[i + row]
        rows.append(row[on] + i)
        cols.append(col[on])
        scores.append(s[on])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores), resolved


def _chunks(batches: Iterator[pa.RecordBatch], dim: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a task's rows, so many at a time."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            take = min(rows - n, batch.num_rows)
            held.append(batch.slice(0, take))
            n, batch = n + take, batch.slice(take)
            if n == rows:
                t = pa.Table.from_batches(held)
                yield t.column("vec_id").to_numpy(), _matrix(t, "embedding", dim)
                held, n = [], 0
    if n:
        t = pa.Table.from_batches(held)
        yield t.column("vec_id").to_numpy(), _matrix(t, "embedding", dim)


def _asked(uri: str) -> Iterator[pa.Table]:
    """The queries that were written to the shared folder, a block at a time."""
    fs, path = pafs.FileSystem.from_uri(uri)
    for batch in pads.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=QUERY_ROWS, batch_readahead=1, fragment_readahead=1):
        if batch.num_rows:
            yield pa.Table.from_batches([batch])


def top_k(vectors: DataFrame, k: int = 10, lists: int = 4, every: int = EVERY, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of greatest dot product with each query."""
    spark = vectors.sparkSession
    valid = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    clean = vectors.select("vec_id", "embedding").where(valid)
    most = clean.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None or not most[0]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = most[0]
    rows = clean.where(F.size("embedding") == dim)
    twice = write_shared(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if twice.limit(1).count():  # only rows that repeat an id are shuffled
        one = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        rows = write_shared(rows.join(twice, "vec_id", "left_anti").unionByName(one), "vectors")
    blocks = [slice(int(b[0]), int(b[-1]) + 1) for b in np.array_split(np.arange(dim), min(lists, dim)) if len(b)]
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked, told = new_path(spark, "queries"), new_path(spark, "cutoffs")
    queries.write.parquet(asked)

    def phase_1(batches):
        for xid, x in _chunks(batches, dim, chunk_rows):
            for t in _asked(asked):
                qid = t.column("vec_id").to_numpy()
                r, s = gather(_matrix(t, "embedding", dim), qid, x, xid, k, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(s)], ["query_id", "score"])

    heads = rows.mapInArrow(phase_1, "query_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"))
    cuts = heads.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cut"))
    spark.read.schema(rows.schema).parquet(asked).join(cuts, "vec_id", "left").withColumn("cut", F.coalesce("cut", F.lit(float("-inf")))).write.parquet(told)

    def phase_2(batches):
        for xid, x in _chunks(batches, dim, chunk_rows):
            for t in _asked(told):
                qid = t.column("vec_id").to_numpy()
                r, c, s, _ = resolve(_matrix(t, "embedding", dim), qid, t.column("cut").to_numpy(), x, xid, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(xid[c]), pa.array(s)], ["query_id", "vec_id", "score"])

    found = rows.mapInArrow(phase_2, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))
