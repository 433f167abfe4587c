"""Retrieval over the four backends, and the union of what they find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import cosine_similarity, dot_product, l2_distance

PRIORITY = {"exact": 0, "lexical": 1, "graph": 2, "semantic": 3}
BROADCAST_LIMIT = 256
TOP = 10
#: Rows of a block of vectors, and how many queries of a block are scored at a time.
BLOCK_ROWS, STEP = 4096, 256
HITS = "query_id bigint, node_num bigint, trust int, score double"


def exact(atoms: DataFrame, ids: list[str] | None = None, nodes: list[int] | None = None) -> DataFrame:
    """Atoms by id or node; without either, the first 256 by id."""
    if ids:
        return atoms.where(F.col("atom_id").isin(*ids))
    if nodes:
        return atoms.where(F.col("node_num").isin(*nodes))
    return atoms.orderBy("atom_id").limit(BROADCAST_LIMIT)


def lexical_term(postings: DataFrame, term: str) -> DataFrame:
    return postings.where(F.col("term") == term).select("node_num").distinct()


def lexical_any(postings: DataFrame, terms: list[str]) -> DataFrame:
    return postings.where(F.col("term").isin(*terms)).select("node_num").distinct()


def lexical_all(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Nodes that hold every term: one grouped count over the filtered postings, not a chain of joins."""
    n = len(set(terms))
    return postings.where(F.col("term").isin(*terms)).groupBy("node_num").agg(F.count_distinct("term").alias("n")).where(F.col("n") == n).select("node_num")


def semantic_top(vectors: DataFrame, queries: DataFrame, k: int = TOP, by: str = "cosine") -> DataFrame:
    """(query_id, node_num, trust, score, rank): the k best of each query (query_id, query); queries are few and broadcast if small."""
    s = {"cosine": cosine_similarity, "dot": dot_product, "l2": l2_distance}[by](F.col("embedding"), F.col("query"))
    # the score is rounded before ranking, so that equal means equal on any machine
    scored = vectors.crossJoin(queries).select("query_id", "node_num", "trust", F.round(s, 6).alias("score"))
    order = [F.asc("score") if by == "l2" else F.desc("score"), F.asc("node_num")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def _matrices(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and rows of the vectors of each length."""
    by: dict[int, tuple[list[int], list]] = {}
    for i, v in enumerate(vectors.to_numpy(zero_copy_only=False)):
        at = by.setdefault(len(v), ([], []))
        at[0].append(i)
        at[1].append(v)
    return {d: (np.array(i), np.array(v, np.float64).reshape(len(i), d)) for d, (i, v) in by.items()}


def best_of_block(left: pa.Table, right: pa.Table, k: int, by: str) -> pa.Table:
    """HITS: the k best rows (node_num, trust, embedding) of ``right`` for each query (query_id, query) of ``left``, scored as by semantic_top."""
    qid, node, trust = left.column("query_id").to_numpy(), right.column("node_num").to_numpy(), right.column("trust").combine_chunks()
    out: list[list[np.ndarray]] = [[], [], []]
    x = _matrices(right.column("embedding"))
    for d, (own, q) in _matrices(left.column("query")).items():
        for i in range(0, len(own), STEP):
            part = q[i : i + STEP]
            s = np.zeros((len(part), right.num_rows))
            if d in x and d:
                at, y = x[d]
                dot = part @ y.T
                if by == "l2":
                    dot = np.stack([np.sqrt(((y - p) ** 2).sum(1)) for p in part])
                elif by == "cosine":
                    a, b = np.linalg.norm(part, axis=1)[:, None], np.linalg.norm(y, axis=1)[None, :]
                    dot = np.where((a < 1e-8) | (b < 1e-8), 0.0, dot / np.maximum(a * b, 1e-300))
                s[:, at] = dot
            s = np.round(s, 6)
            key = s if by == "l2" else -s
            m = min(k, key.shape[1])
            row, col = np.nonzero(key <= np.partition(key, m - 1, axis=1)[:, m - 1 : m])
            order = np.lexsort((node[col], key[row, col], row))
            row, col = row[order], col[order]
            on = np.arange(len(row)) - np.searchsorted(row, row) < k
            for o, v in zip(out, (own[i + row[on]], col[on], s[row[on], col[on]])):
                o.append(v)
    r, c, s = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
    r, c = r.astype(np.int64), c.astype(np.int64)
    return pa.table({"query_id": pa.array(qid[r], pa.int64()), "node_num": pa.array(node[c], pa.int64()), "trust": trust.take(pa.array(c)).cast(pa.int32()), "score": pa.array(s, pa.float64())})


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """Without null vectors and vectors with null elements."""
    return vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda e: e.isNull()))


def ranked(found: DataFrame, k: int, by: str) -> DataFrame:
    """The k best of each query, with their rank."""
    order = [F.asc("score") if by == "l2" else F.desc("score"), F.asc("node_num")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def semantic_top_all(vectors: DataFrame, queries: DataFrame | None = None, k: int = TOP, by: str = "cosine", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """semantic_top for many queries: by default every row (by vec_id) is one.

    The rows stay where they are; each task reads the queries, a block at a time, from the shared folder and hands on
    k rows a query and block of its own. Null vectors and vectors with null elements are neither queries nor hits.
    """
    from ..sources.shared import new_table, read_blocks

    if queries is None:
        queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    path = new_table(vectors.sparkSession, "queries")
    whole_vectors(queries.withColumnRenamed("query", "embedding")).withColumnRenamed("embedding", "query").select("query_id", "query").write.parquet(path)
    score = _block(k, by)

    def run(batches):
        for own in in_blocks(batches, block_rows):
            for asked in read_blocks(path, block_rows):
                yield from score(asked, own).to_batches()

    return ranked(whole_vectors(vectors).select("node_num", "trust", "embedding").mapInArrow(run, HITS), k, by)


def in_blocks(batches, rows: int):
    """A task's batches as tables of so many rows."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            take = min(rows - n, batch.num_rows)
            held.append(batch.slice(0, take))
            n, batch = n + take, batch.slice(take)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _block(k: int, by: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "node_num": pa.array([], pa.int64()), "trust": pa.array([], pa.int32()), "score": pa.array([], pa.float64())})
        return best_of_block(left, right, k, by)

    return run


def semantic_candidates(vectors: DataFrame, queries: DataFrame, k: int = TOP, trust_min: int = 0) -> DataFrame:
    """Trust is capped by the similarity, on the scale of 10000."""
    return capped(semantic_top(vectors, queries, k), trust_min)


def capped(top: DataFrame, trust_min: int = 0) -> DataFrame:
    return top.withColumn("trust", F.least(F.floor(F.col("score") * 10000).cast("int"), F.col("trust"))).where(F.col("trust") >= trust_min)


def union_dedup(backends: dict[str, DataFrame], explicit_vectors: bool = False) -> DataFrame:
    """(node_num, backend): each node once, by the first backend that has it; vectors come first where they were asked for."""
    rank = dict(PRIORITY, **({"semantic": -1} if explicit_vectors else {}))
    out = None
    for name, df in backends.items():
        one = df.select("node_num", F.lit(rank[name]).alias("priority"), F.lit(name).alias("backend"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("node_num").agg(F.min_by("backend", "priority").alias("backend"))


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One row for each (atom, branch): gaps and evidence joined, least trust, most bytes and conflicts, any flag."""
    return candidates.groupBy("node_num", "branch").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("gaps")))).alias("gaps"),
        F.min("trust").alias("trust"), F.max("io_bytes").alias("io_bytes"), F.max("conflicts").alias("conflicts"),
        F.bool_or("needs_check").alias("needs_check"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
    )


def candidate_view(candidates: DataFrame) -> DataFrame:
    """The public view: gain is the number of gaps, cost at least 1."""
    return candidates.withColumn("gain", F.size("gaps")).withColumn("cost", F.greatest("io_bytes", F.lit(1)))


def lexicon(postings: DataFrame) -> DataFrame:
    """(term, n_nodes)."""
    return postings.groupBy("term").agg(F.count_distinct("node_num").alias("n_nodes"))


def index_text(docs: DataFrame, node: Column, text: str = "text") -> DataFrame:
    """Postings of new texts: lower-cased tokens between blanks, each once a node."""
    return docs.select(node.alias("node_num"), F.explode(F.split(F.lower(text), r"\s+")).alias("term")).where("term <> ''").select("term", "node_num").distinct()
