"""Approximate vector search: an inverted file over cells, of which a query reads the nearest few.

The index is a table partitioned by cell, so a search lists and reads only its cells' files. Centroids
are trained on a bounded sample (``sample``); every vector is assigned. ``search_all`` takes every row
as a query and doubles the cells that it reads until recall, audited against exact search, suffices.
Exact search remains ``retrieval.semantic_top`` and ``retrieval.semantic_top_all``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalar import cosine_similarity
from .retrieval import BLOCK_ROWS, HITS, TOP, _block, ranked, semantic_top_all, whole_vectors

SAMPLE, CELLS, ROUNDS, PROBES = 50_000, 64, 12, 16
#: An index has the square root of its rows for cells, within CELLS and MOST_CELLS.
MOST_CELLS = 4096
#: What search_all wants of the exact hits, and on how many sampled queries it is audited.
RECALL, AUDITED = 0.9, 512


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)


def train(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Unit centroids by spherical k-means over the vectors with the least hashes."""
    rows = vectors.where("embedding is not null").select("embedding", F.xxhash64("node_num", F.lit(seed)).alias("h")).orderBy("h").limit(sample).select("embedding").toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0), np.float32)
    x = _unit(np.array(rows["embedding"].to_pylist(), np.float32))
    c = x[: min(cells, len(x))].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        for i in np.unique(own):
            c[i] = x[own == i].mean(0)
        c = _unit(c)
    return c


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Vectors with the cell of their nearest centroid."""
    at = vectors.columns.index("embedding")

    def run(batches):
        for b in batches:
            x = np.array(b.column(at).to_pylist(), np.float32).reshape(b.num_rows, -1)
            cell = np.argmax(x @ centroids.T, axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], [*b.schema.names, "cell"])

    return vectors.where("embedding is not null").mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())]))


def build(vectors: DataFrame, path: str, cells: int | None = None) -> np.ndarray:
    """Writes the index; returns its centroids, which are few."""
    if cells is None:
        cells = min(MOST_CELLS, max(CELLS, math.isqrt(vectors.count())))
    c = train(vectors, cells)
    if len(c):
        assign(vectors, c).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    return c


def search(spark: SparkSession, path: str, centroids: np.ndarray, queries: list[tuple[int, list[float]]], k: int = TOP, probes: int = PROBES) -> DataFrame:
    """(query_id, node_num, trust, score, rank): the k best of each query among its nearest cells."""
    q = np.array([v for _, v in queries], np.float32)
    near = np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :probes]
    asked = spark.createDataFrame([(qid, [float(a) for a in v], [int(c) for c in row]) for (qid, v), row in zip(queries, near)], "query_id bigint, query array<float>, cells array<int>")
    table = spark.read.parquet(path).where(F.col("cell").isin(*np.unique(near).tolist()))
    pairs = table.join(F.broadcast(asked), F.array_contains("cells", F.col("cell")))  # the caller holds the queries, so they are few
    scored = pairs.select("query_id", "node_num", "trust", F.round(cosine_similarity(F.col("embedding"), F.col("query")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_num")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def audited_probes(vectors: DataFrame, table: DataFrame, centroids: np.ndarray, k: int = TOP, probes: int = PROBES, wanted: float = RECALL, sample: int = AUDITED) -> tuple[int, float]:
    """The least probes (doubled from ``probes``) with ``wanted`` recall on sampled queries, two standard errors below the mean; and that mean.

    Within the cells that it reads a search is exact: it finds an exact hit if its cell is read.
    """
    picked = whole_vectors(vectors).orderBy(F.xxhash64("vec_id", F.lit(7))).limit(sample).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    local = picked.toArrow()
    if not local.num_rows:
        return len(centroids), 1.0
    near = np.argsort(-(np.array(local["query"].to_pylist(), np.float32) @ centroids.T), axis=1, kind="stable")
    place = dict(zip(local["query_id"].to_pylist(), np.argsort(near, axis=1)))
    asked = vectors.sparkSession.createDataFrame(local)
    hits = semantic_top_all(vectors, asked, k).join(table.select("node_num", "cell"), "node_num").select("query_id", "cell").toArrow()
    at: dict[int, list[int]] = {}
    for q, c in zip(hits["query_id"].to_pylist(), hits["cell"].to_pylist()):
        at.setdefault(q, []).append(int(place[q][c]))
    while True:
        each = np.array([np.mean(np.array(c) < probes) for c in at.values()])
        if probes >= len(centroids) or each.mean() - 2 * each.std() / np.sqrt(len(each)) >= wanted:
            return min(probes, len(centroids)), float(each.mean())
        probes *= 2


def search_all(spark: SparkSession, path: str, centroids: np.ndarray, vectors: DataFrame, k: int = TOP, probes: int | None = None, every: int = 1) -> DataFrame:
    """(query_id, node_num, trust, score, rank) of every row of ``vectors`` whose vec_id is divisible by ``every``, which the index at ``path`` holds; without ``probes``, as many as the audit asks for."""
    if not len(centroids):
        return ranked(spark.createDataFrame([], HITS), k, "cosine")
    table = whole_vectors(spark.read.parquet(path))
    if probes is None:
        probes, _ = audited_probes(vectors, table, centroids, k)
    total, most = table.groupBy("cell").count().agg(F.sum("count"), F.max("count")).first()
    n_q, n_o = (max(1, -(-(x or 0) // BLOCK_ROWS)) for x in (total, most))

    def cells(batches):
        for b in batches:
            q = np.array(b.column(1).to_pylist(), np.float32).reshape(b.num_rows, -1)
            near = np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :probes] if b.num_rows else np.zeros((0, 1), int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["query_id", "query", "cells"])

    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = table.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).mapInArrow(cells, "query_id bigint, query array<float>, cells array<int>")
    left = asked.select(F.explode("cells").alias("cell"), "query_id", "query").select("cell", block("query_id", n_q).alias("qb"), spread(n_o).alias("ob"), "query_id", "query").groupBy("cell", "qb", "ob")
    right = table.select("cell", spread(n_q).alias("qb"), block("node_num", n_o).alias("ob"), "node_num", "trust", "embedding").groupBy("cell", "qb", "ob")
    return ranked(left.cogroup(right).applyInArrow(_block(k, "cosine"), HITS), k, "cosine")
