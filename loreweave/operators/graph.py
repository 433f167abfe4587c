"""Graph operators over edge tables (src, dst, edge_type, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut, once, spread

FANOUT = 128


def latest_edges(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Base and deltas as one table: the delta's version of an edge wins, a tombstone removes it.

    One grouped aggregate over the union (the delta ranks above the base), not a join. It keeps numbers only, so it hashes
    and doesn't sort, within pieces of bounded size.
    """
    both = base.select("src", "dst", "edge_type", "confidence", F.lit(False).alias("deleted"), F.lit(0).alias("layer")).unionByName(delta.select("src", "dst", "edge_type", "confidence", "deleted", F.lit(1).alias("layer")))
    at = lambda layer, c: F.when(F.col("layer") == layer, c)
    rank = F.coalesce(2 * F.col("confidence").cast("bigint"), F.lit(-(1 << 62))) + F.col("deleted").cast("int")  # of versions that repeat, the most confident counts
    top = spread(both, "src", "dst", "edge_type").groupBy("src", "dst", "edge_type").agg(
        F.max("layer").alias("layer"), F.max(at(0, F.col("confidence"))).alias("base"), F.max(at(1, F.col("confidence"))).alias("delta"), F.max_by("deleted", at(1, rank)).alias("deleted"))
    return top.where(F.when(F.col("layer") == 0, True).otherwise(~F.col("deleted"))).select("src", "dst", "edge_type", F.when(F.col("layer") == 0, F.col("base")).otherwise(F.col("delta")).alias("confidence"))


def first_inserted(edges: DataFrame) -> DataFrame:
    """Builder's dedup: of edges that repeat, the greatest confidence, then the first by ``seq``."""
    top = edges.groupBy("edge_type", "src", "dst").agg(F.max_by(F.struct("confidence", "seq"), F.struct("confidence", -F.col("seq"))).alias("v"))
    return top.select("edge_type", "src", "dst", "v.confidence")


def neighbors(edges: DataFrame, node: int, types: list[str] | None = None) -> DataFrame:
    """Both directions: (direction, edge_type, node, confidence)."""
    e = _typed(edges, types)
    out = e.where(F.col("src") == node).select(F.lit("out").alias("direction"), "edge_type", F.col("dst").alias("node"), "confidence")
    return out.unionByName(in_neighbors(edges, node, types).select(F.lit("in").alias("direction"), "edge_type", F.col("src").alias("node"), "confidence"))


def in_neighbors(edges: DataFrame, node: int, types: list[str] | None = None) -> DataFrame:
    return _typed(edges, types).where(F.col("dst") == node).select("src", "edge_type", "confidence")


def has_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst, edge_type) that exist; both sides meet in pieces of bounded size."""
    return spread(pairs, "src", "dst", beside=edges).join(spread(edges, "src", "dst", beside=pairs), ["src", "dst", "edge_type"], "left_semi")


def match_pattern(edges: DataFrame, src: int | None = None, edge_type: str | None = None, dst: int | None = None, limit: int | None = 50) -> DataFrame:
    """src -> TYPE -> dst, None for any; the first ``limit`` in order of (src, edge_type, dst)."""
    for name, want in (("src", src), ("edge_type", edge_type), ("dst", dst)):
        if want is not None:
            edges = edges.where(F.col(name) == want)
    return edges if limit is None else edges.orderBy("src", "edge_type", "dst").limit(limit)


def _typed(edges: DataFrame, types: list[str] | None) -> DataFrame:
    return edges.where(F.col("edge_type").isin(*types)) if types else edges


def walk(edges: DataFrame, seeds: DataFrame, depth: int, types: list[str] | None = None, fanout: int | None = FANOUT, expand: Column | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(node, depth): breadth-first from seeds (node), each node once at its least depth.

    At most ``fanout`` edges, by dst, leave a node for each type. ``expand`` (a predicate over ``nodes``,
    keyed by node): nodes that fail it are reached but not expanded.
    """
    e = _typed(edges, types).select("src", "dst", "edge_type")
    e = once(e) if depth > 1 else e
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        from_ = frontier.select(F.col("node").alias("src"))
        if expand is not None:
            from_ = from_.join(nodes.where(expand).select(F.col("node").alias("src")), "src", "left_semi")
        step = e.join(from_, "src", "left_semi")
        if fanout is not None:
            step = step.withColumn("n", F.row_number().over(Window.partitionBy("src", "edge_type").orderBy("dst"))).where(F.col("n") <= fanout)
        frontier = step.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(level))
        # a level is read by the next one and by all later anti-joins: computed once, it also ends the lineage
        frontier = cut(frontier)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def walk_edges(edges: DataFrame, seeds: DataFrame, depth: int = 2, types: list[str] | None = None, fanout: int | None = FANOUT) -> DataFrame:
    """Edges that a walk follows: those that leave a node reached before the last level."""
    inner = walk(edges, seeds, depth - 1, types, fanout) if depth > 1 else seeds.select("node").distinct()
    e = _typed(edges, types).join(inner.select(F.col("node").alias("src")), "src", "left_semi")
    if fanout is None:
        return e.select("src", "dst", "edge_type")
    return e.withColumn("n", F.row_number().over(Window.partitionBy("src", "edge_type").orderBy("dst"))).where(F.col("n") <= fanout).select("src", "dst", "edge_type")


def subgraph_nodes(edges: DataFrame, center: int, depth: int, types: list[str] | None = None) -> DataFrame:
    """The center and all nodes of the edges walked, each once."""
    seed = edges.sparkSession.createDataFrame([(center,)], "node bigint")
    e = walk_edges(edges, seed, depth, types)
    return e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).unionByName(seed).distinct()


def path_exists(edges: DataFrame, pairs: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """(src, dst, reachable) for many pairs at once, within ``depth`` steps. A node reaches itself, unless depth is 0.

    The frontier keeps its pair, and pairs that have arrived leave it.
    """
    p = pairs.select("src", "dst").distinct()
    if depth <= 0:
        return p.withColumn("reachable", F.lit(False))
    e = _typed(edges, types).select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct()
    e = once(e) if depth > 1 else e
    frontier = p.withColumn("at", F.col("src"))
    done = p.where("src = dst")
    seen = frontier
    for level in range(1, depth + 1):
        frontier = frontier.where("at <> dst").join(e, "at").select("src", "dst", F.col("next").alias("at")).distinct().join(seen, ["src", "dst", "at"], "left_anti")
        frontier = cut(frontier)
        done = done.unionByName(frontier.where("at = dst").select("src", "dst"))
        seen = seen.unionByName(frontier)
    return p.join(done.distinct().withColumn("reachable", F.lit(True)), ["src", "dst"], "left").select("src", "dst", F.coalesce("reachable", F.lit(False)).alias("reachable"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``links`` (a, b) is connected with.

    Alternating large and small stars; rounds are checkpointed, so lineage stays short. Before them each task joins what
    it finds in each of its batches, so that chains which lie together take no rounds.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if all(kind == "bigint" for _, kind in links.dtypes):
        links = links.mapInArrow(_stars, "a bigint, b bigint")
    now = cut(links.distinct())
    before = None
    w = Window.partitionBy("a")
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if state == before or not state[0]:
            roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = state
        each = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = each.withColumn("m", F.least("a", F.min("b").over(w))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.where("a <> b").distinct().withColumn("m", F.min("b").over(w))
        small = least.select("a", F.col("m").alias("b")).unionByName(least.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = cut(small.distinct())


def _stars(batches):
    """Each node of a batch's links with the least node that the batch connects it with."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, at = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_inverse=True)
        a, b = at[: batch.num_rows], at[batch.num_rows :]
        root = np.arange(len(nodes))
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
        child = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], names=["a", "b"])


def needs_compaction(n_base: int, n_delta: int, layers: int) -> bool:
    return layers > 8 or (n_base > 0 and n_delta / n_base > 0.20)
