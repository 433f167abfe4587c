"""SimHash near-duplicates by navigable small-world graphs.

Texts are told by 256-bit SimHashes of their word pairs. Distinct hashes are spread over shards by hash; each shard
builds a small-world graph over all bits, and every hash is sent to every shard as a query. Passes over the shard,
each sorted by some other bits, compare a block of queries with all nodes that agree in those bits; a query that meets
a node within reach enters the graph there: a beam search finds its first partners and expands from them along links as
long as nodes are within the radius. Each shard audits its recall, query by query, against exact search: over hashes of
other shards, which its graph doesn't hold, and over its own. Passes and beam double until that recall suffices; passes
that would read as many nodes as the shard has give way to the exact search. Edges are verified by the exact distance
and unioned.

Defined results
* Null or empty texts, and texts without a word: near duplicates of nothing; always kept.
* Texts of one word are compared by that word.
* A null doc_id is never grouped, its row always kept. Rows that repeat a doc_id are copies of one
  document: it is grouped by all of its texts, and one row stays (the least text).
* Groups are transitive; a group's id is its least doc_id, whose row stays. Ties of distance play no part.
* Empty tables: empty results. Extra columns: ignored by ``groups``, passed through by ``drop_copies``.
* Very long texts: hashed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import components
from .shared import bound_batches, fresh, slices, trim, write_shared
from .textops import shingles, simhash, words

#: Bits of 256 in which near copies may differ.
RADIUS = 54
#: A shard of so many hashes takes some 0.3 GB of a worker.
SHARDS, SHARD_ROWS = 6, 1_000_000
RECALL = 0.95
#: Entry tables while a graph is built; each takes 6 bytes a node.
TABLES = 24
#: Passes of a search before its audit; none is kept. Nodes that a pass shows a query, on average, are one to two.
PASSES = 48
#: A query enters the graph at nodes so much farther than the radius, too.
REACH = 10
#: Queries that share their passes, and pairs that are held of them at a time.
BLOCK, PAIRS = 1 << 19, 1 << 20
#: Queries of an audit: so many at most of other shards and as many of the own, until so many have partners.
AUDIT, AUDIT_STEP, PARTNERED = 4096, 256, 100
_MAX = np.uint64(2**64 - 1)
_SELF = 511  # beyond any distance
_W = ["s0", "s1", "s2", "s3"]
#: Up to so many dropped ids (8 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_IDS = 4_000_000


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, s0, s1, s2, s3) of every row that has an id and a word."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                f, n = shingles(words(part.column(1)), part.num_rows)
                on = np.flatnonzero(n > 0)
                s = simhash(f, n)[on].view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(on))] + [pa.array(np.ascontiguousarray(s[:, j])) for j in range(4)], ["doc_id", *_W])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.uint16)
    for j in range(1, a.shape[-1]):
        d += np.bitwise_count(a[..., j] ^ b[..., j])
    return d


class SmallWorld:
    """A navigable small-world graph over 256-bit hashes, searched many queries at a time.

    A beam is a row of machine words: distance << 33 | node << 1 | expanded, sorted.
    """

    def __init__(self, nodes: np.ndarray, degree: int = 8, tables: int = TABLES, beam: int = 16, seed: int = 1):
        self.x = np.ascontiguousarray(nodes)
        self.n = n = len(nodes)
        self.degree, self.cap, self.width, self.recall, self.outright = degree, 2 * degree, beam, 1.0, False
        self.passes, self.seed, self.pass_bits = PASSES, seed, int(np.clip(math.ceil(math.log2(max(n, 2) / 2)), 3, 24))
        self.rng = np.random.default_rng(seed)
        self.bits = int(np.clip(math.log2(max(n, 2) / 12), 3, 14))
        self.most = max(12, 2 * n >> self.bits)
        self.masks: list[np.ndarray] = []
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self._add_tables(tables)
        self.links = np.full((n, self.cap), -1, np.int32)
        self.used = np.zeros(n, np.int32)
        self._build(beam)
        self.masks.clear()
        self.tables.clear()

    def _add_tables(self, n: int) -> None:
        for _ in range(n):
            m = self.rng.choice(256, self.bits, replace=False)
            k = self._key(self.x, m).astype(np.uint16)
            order = np.argsort(k, kind="stable")
            self.masks.append(m)
            self.tables.append((k[order], order.astype(np.int32)))

    @staticmethod
    def _key(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.uint32)
        for at in range(0, len(x), 1 << 14):
            part = np.ascontiguousarray(x[at : at + (1 << 14)].T)
            k = np.zeros(part.shape[1], np.uint64)
            for i, b in enumerate(bits):
                k |= ((part[b >> 6] >> np.uint64(b & 63)) & np.uint64(1)) << np.uint64(i)
            out[at : at + (1 << 14)] = k
        return out

    def _entries(self, q: np.ndarray) -> np.ndarray:
        """Nodes that share a hash bucket with each query, twice as many of each table as a bucket has on average, as -1-padded rows."""
        cols = []
        for m, (keys, order) in zip(self.masks, self.tables):
            k = self._key(q, m).astype(np.uint16)
            at, end = np.searchsorted(keys, k), np.searchsorted(keys, k, side="right")
            size = min(self.most, int((end - at).max(initial=0)))
            i = at[:, None] + np.arange(size)
            cols.append(np.where(i < end[:, None], order[np.minimum(i, self.n - 1)], -1))
        return np.concatenate(cols, 1)

    def _score(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        d = _distance(self.x[nodes], q[:, None, :]).astype(np.uint64)
        return np.where(nodes >= 0, (d << np.uint64(33)) | (nodes.astype(np.uint64) << np.uint64(1)), _MAX)

    def _build(self, beam: int) -> None:
        at = min(self.n, 64)
        self._link_within(0, at)
        while at < self.n:
            to = min(self.n, at + min(max(at, 64), 2048))
            q = self.x[at:to]
            own = np.arange(at, to)
            near = []
            for i in range(0, to - at, 256):
                near.append(self._beam(q[i : i + 256], beam, below=at)[:, : self.degree])
            near = np.concatenate(near)
            # nodes of one batch don't find each other in the graph: compare them outright
            for i in range(0, to - at, 256):
                d = _distance(q[None, :, :], q[i : i + 256, None, :]).astype(np.uint64)
                d[np.arange(len(d)), i + np.arange(len(d))] = _SELF
                k = (d << np.uint64(33)) | (own.astype(np.uint64) << np.uint64(1))[None, :]
                m = min(self.degree, k.shape[1])
                k = np.partition(k, m - 1, axis=1)[:, :m]
                k[(k >> np.uint64(33)) >= _SELF] = _MAX
                both = np.sort(np.concatenate([near[i : i + 256], k], 1), axis=1)[:, : self.degree]
                self._link(own[i : i + 256], both)
            at = to

    def _link_within(self, lo: int, hi: int) -> None:
        if hi - lo < 2:
            return
        q = self.x[lo:hi]
        d = _distance(q[None, :, :], q[:, None, :]).astype(np.uint64)
        np.fill_diagonal(d, _SELF)
        k = np.sort((d << np.uint64(33)) | (np.arange(lo, hi).astype(np.uint64) << np.uint64(1))[None, :], axis=1)[:, : min(self.degree, hi - lo - 1)]
        self._link(np.arange(lo, hi), k)

    def _link(self, own: np.ndarray, keys: np.ndarray) -> None:
        """Links both ways. A full node gives up the link in a place drawn by hash: early, long links mostly stay."""
        src = np.repeat(own, keys.shape[1])
        flat = keys.ravel()
        ok = flat != _MAX
        src, dst = src[ok], ((flat[ok] & np.uint64(0x1FFFFFFFF)) >> np.uint64(1)).astype(np.int64)
        a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        start = np.flatnonzero(new)
        within = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
        slot = self.used[a] + within
        over = slot >= self.cap
        slot[over] = self.degree // 2 + (slot[over] * 7919 + b[over]) % (self.cap - self.degree // 2)
        self.links[a, slot] = b
        np.add.at(self.used, a, 1)

    def _footholds(self, q: np.ndarray, reach: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, key) of the ``width`` nearest nodes within ``reach`` that the passes show each query, in order.

        A pass compares a query with all nodes that agree with it in the pass's bits, however many.
        """
        rows, keys = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        new: list[tuple[np.ndarray, np.ndarray]] = []

        def settled():
            r, k = (np.concatenate(x) for x in zip((rows, keys), *new))
            new.clear()
            order = np.lexsort((k, r))
            r, k = r[order], k[order]
            once = np.ones(len(r), bool)
            once[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
            r, k = r[once], k[once]
            near = np.arange(len(r)) - np.searchsorted(r, r) < width
            return r[near], k[near]

        for nth in range(self.passes):
            bits = np.random.default_rng((self.seed, nth)).choice(256, self.pass_bits, replace=False)
            k = self._key(self.x, bits).astype(np.uint64)
            order = (np.sort((k << np.uint64(32)) | np.arange(self.n, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            start = np.concatenate([[0], np.cumsum(np.bincount(k.astype(np.int64), minlength=1 << self.pass_bits))])
            x = self.x[order]
            k = self._key(q, bits)
            at = start[k]
            many = start[k + np.uint32(1)] - at
            asks = np.flatnonzero(many)
            at, many = at[asks], many[asks]
            sums = np.cumsum(many)
            i = 0
            while i < len(asks):
                to = max(i + 1, int(np.searchsorted(sums, sums[i] - many[i] + PAIRS, side="right")))
                n = many[i:to]
                r = np.repeat(asks[i:to], n)
                p = np.arange(len(r)) + np.repeat(at[i:to] - (sums[i:to] - n - (sums[i] - many[i])), n)
                d = _distance(x[p], q[r])
                hit = np.flatnonzero(d <= reach)
                new.append((r[hit], (d[hit].astype(np.uint64) << np.uint64(33)) | (order[p[hit]].astype(np.uint64) << np.uint64(1))))
                if sum(len(r) for r, _ in new) > 2 * PAIRS:
                    rows, keys = settled()
                i = to
        return settled()

    def _beam(self, q: np.ndarray, width: int, below: int | None = None, start: np.ndarray | None = None) -> np.ndarray:
        """The ``width`` best nodes that a beam search finds for each query, from the keys of ``start`` or the entry tables, as sorted keys."""
        if start is None:
            start = self._entries(q)
            if below is not None:
                start = np.where(start < below, start, -1)
            few = np.broadcast_to(np.arange(min(32, self.n if below is None else below)), (len(q), min(32, self.n if below is None else below)))
            start = self._score(q, np.concatenate([start, few], 1))
        keys = self._settle(start, width)
        out = np.full((len(q), width), _MAX)
        live = np.arange(len(q))
        steps = 4
        while True:
            fresh = ((keys & np.uint64(1)) == 0) & (keys != _MAX)
            some = fresh.any(1)
            if not some.all():
                out[live[~some]] = keys[~some]
                live, keys, fresh = live[some], keys[some], fresh[some]
            if not len(live):
                return out
            pick = fresh & (np.cumsum(fresh, axis=1) <= steps)
            row, col = np.nonzero(pick)
            slot = (np.cumsum(pick, axis=1) - 1)[row, col]
            nodes = np.full((len(live), steps), -1, np.int64)
            nodes[row, slot] = ((keys[row, col] & np.uint64(0x1FFFFFFFF)) >> np.uint64(1)).astype(np.int64)
            keys[row, col] |= np.uint64(1)
            near = np.where(nodes[:, :, None] >= 0, self.links[nodes], -1).reshape(len(live), -1)
            if below is not None:
                near = np.where(near < below, near, -1)
            keys = self._settle(np.concatenate([keys, self._score(q[live], near)], 1), width)

    @staticmethod
    def _settle(keys: np.ndarray, width: int) -> np.ndarray:
        """Sorted, each node once (as expanded, if it was), the best ``width``."""
        keys = np.sort(keys, axis=1)
        same = (keys[:, :-1] >> np.uint64(1)) == (keys[:, 1:] >> np.uint64(1))
        keys[:, :-1][same & (keys[:, :-1] != _MAX)] = _MAX
        keys = np.sort(keys, axis=1)
        if keys.shape[1] < width:
            keys = np.concatenate([keys, np.full((len(keys), width - keys.shape[1]), _MAX)], 1)
        return keys[:, :width].copy()

    def within(self, q: np.ndarray, radius: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs at most ``radius`` apart; the beam is the audited one by default."""
        parts = list(self.parts_within(q, radius, width))
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def parts_within(self, q: np.ndarray, radius: int, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of ``within``, some queries at a time.

        What a beam of ``width`` finds expands along the links of nodes within the radius, as far as they
        go: a query with thousands of partners costs what its partners do, not a beam of thousands.
        """
        if width is None and self.outright:
            for i in range(0, len(q), 4096):
                r, p = self.exact(q[i : i + 4096], radius)
                yield r + i, p
            return
        width = width or self.width
        step = max(16, 8192 // width)
        for lo in range(0, len(q), BLOCK):
            block = q[lo : lo + BLOCK]
            row, key = self._footholds(block, radius + REACH, width)
            asks, first = np.unique(row, return_index=True)
            place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            first = np.append(first, len(row))
            for i in range(0, len(asks), step):
                on = asks[i : i + step]
                own = slice(first[i], first[i + len(on)])
                start = np.full((len(on), width), _MAX)
                start[np.searchsorted(on, row[own]), place[own]] = key[own]
                k = self._beam(block[on], width, start=start)
                hit = (k >> np.uint64(33)) <= radius
                full = hit.all(1)
                for some, most in ((np.flatnonzero(~full & hit.any(1)), 512), (np.flatnonzero(full), 16)):
                    for j in range(0, len(some), most):
                        part = some[j : j + most]
                        r, c = np.nonzero(hit[part])
                        found = ((k[part[r], c] & np.uint64(0x1FFFFFFFF)) >> np.uint64(1)).astype(np.int64)
                        r, p = self._expand(block[on[part]], r, found, radius)
                        yield lo + on[part[r]], p

    def _expand(self, q: np.ndarray, rows: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) pairs within the radius that links reach from those given, through such nodes only."""
        new = np.unique(rows * self.n + nodes)
        tested, found = new, [new]
        while len(new):
            near = self.links[new % self.n].astype(np.int64)
            key = np.unique(((new // self.n)[:, None] * self.n + near)[near >= 0])
            at = np.minimum(np.searchsorted(tested, key), len(tested) - 1)
            key = key[tested[at] != key]
            if not len(key):
                break
            tested = np.union1d(tested, key)
            new = key[_distance(self.x[key % self.n], q[key // self.n]) <= radius]
            found.append(new)
        pairs = np.concatenate(found)
        return pairs // self.n, pairs % self.n

    def exact(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        rows, nodes = [], []
        step = max(1, (1 << 20) // max(1, self.n))
        for i in range(0, len(q), step):
            r, p = np.nonzero(_distance(self.x[None, :, :], q[i : i + step, None, :]) <= radius)
            rows.append(r + i)
            nodes.append(p)
        return (np.concatenate(rows), np.concatenate(nodes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def audit(self, asked: np.ndarray, radius: int, wanted: float = RECALL, seed: int = 3) -> None:
        """Doubles the passes and the beam until the mean recall of queries, against exact search, is ``wanted``.

        ``asked``: hashes of other shards, in an order that tells nothing of them. They and own nodes, without
        themselves, are tried in turn until PARTNERED of them have partners, or AUDIT of each have been.
        """
        own = np.random.default_rng(seed).permutation(self.n)[:AUDIT]
        q, skip, true = [], [], []
        for i in range(0, max(len(own), min(len(asked), AUDIT)), AUDIT_STEP):
            mine = own[i : i + AUDIT_STEP]
            part = np.concatenate([asked[:AUDIT][i : i + AUDIT_STEP], self.x[mine]])
            self_ = np.concatenate([np.full(len(part) - len(mine), -1), mine])
            r, p = self.exact(part, radius)
            r, p = r[p != self_[r]], p[p != self_[r]]
            some = np.unique(r)
            at = np.searchsorted(some, r)
            base = sum(map(len, q))
            q.append(part[some])
            skip.append(self_[some])
            true.append((base + at) * self.n + p)
            if base + len(some) >= PARTNERED:
                break
        q, skip, true = np.concatenate(q), np.concatenate(skip), np.concatenate(true)
        if not len(true):
            return  # nothing near anything in all that was tried
        each = np.bincount(true // self.n, minlength=len(q))
        while True:
            r, p = self.within(q, radius, self.width)
            found = np.unique((r * self.n + p)[p != skip[r]])
            self.recall = float(np.mean(np.bincount(found // self.n, minlength=len(q)) / each))
            if self.recall >= wanted:
                return
            if self.passes * max(1, self.n >> self.pass_bits) >= self.n:
                self.outright, self.recall = True, 1.0
                return
            self.passes *= 2
            self.width *= 2


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n nodes."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def search(nodes: DataFrame, radius: int = RADIUS, beam: int = 16, shards: int | None = None) -> DataFrame:
    """Verified edges (a, b) of distinct hashes ``nodes`` (doc_id, s0..s3) that connect all that the search found, and
    a row for each shard with its number in ``a``, the audited beam and recall, and no ``b``.

    Within a shard a component is a star, and a query from elsewhere gets one edge to each component
    that it is near to: fewer rows than all pairs, with the same components.
    """
    n = nodes.count()
    s = shards or max(SHARDS, math.ceil(n / SHARD_ROWS))
    turn = F.xxhash64("doc_id", F.lit(1))  # an order that tells nothing of the hashes
    own = nodes.select(F.pmod(F.xxhash64("doc_id"), F.lit(s)).cast("int").alias("shard"), F.lit(0).alias("is_query"), turn.alias("turn"), "doc_id", *_W)
    asked = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(s - 1))).alias("shard"), F.lit(1).alias("is_query"), turn.alias("turn"), "doc_id", *_W).where(F.pmod(F.xxhash64("doc_id"), F.lit(s)) != F.col("shard"))
    edge = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.float64())], ["a", "b", "beam", "recall"])

    def run(batches):
        ids, rows, held, number, graph = [], [], [], -1, None

        def build():
            """The graph, audited with the queries that have come so far, and the shard's own edges."""
            nonlocal graph, ids
            ids = np.concatenate(ids)
            graph = SmallWorld(np.concatenate(rows), beam=beam, seed=1 + number)
            rows.clear()
            graph.audit(np.concatenate([x for _, x in held]) if held else np.zeros((0, 4), np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.int64()), pa.array([graph.width], pa.int64()), pa.array([graph.recall])], ["a", "b", "beam", "recall"])
            every = np.arange(len(ids))
            graph.root = every
            a, b = [every], [every]
            for r, p in graph.parts_within(graph.x, radius):
                a.append(r)
                b.append(p)
                if sum(map(len, a)) > len(ids) + 2 * PAIRS:
                    graph.root = _roots(len(ids), np.concatenate(a), np.concatenate(b))
                    a, b = [every], [graph.root]
            graph.root = _roots(len(ids), np.concatenate(a), np.concatenate(b))
            on = np.flatnonzero(graph.root != every)
            yield edge(ids[on], ids[graph.root[on]])

        def ask():
            """The edges of the queries that are held."""
            who, x = (np.concatenate(c) for c in zip(*held))
            held.clear()
            for r, p in graph.parts_within(x, radius):
                key = np.unique(r * len(ids) + graph.root[p])
                yield edge(who[key // len(ids)], ids[graph.root[key % len(ids)]])

        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(0)[0].as_py()
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            doc = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.stack([batch.column(4 + j).to_numpy(zero_copy_only=False) for j in range(4)], 1).astype(np.int64).view(np.uint64)
            mine = kind == 0
            if mine.any():
                ids.append(doc[mine])
                rows.append(x[mine])
            if mine.all():
                continue
            if not len(ids):  # a shard without nodes
                break
            held.append((doc[~mine], x[~mine]))
            waiting = sum(len(d) for d, _ in held)
            if graph is None and waiting >= AUDIT:
                yield from build()
            if waiting >= BLOCK:
                yield from ask()
        if graph is None and len(ids):
            yield from build()
        if held:
            yield from ask()
        graph = None
        trim()

    both = own.unionByName(asked).repartitionById(s, F.col("shard")).sortWithinPartitions("is_query", "turn", "doc_id")
    bound_batches(nodes.sparkSession)
    return both.mapInArrow(run, "a bigint, b bigint, beam bigint, recall double")


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep, s0..s3) of every document, rep being the least doc_id with the hash; the distinct hashes."""
    sig = write_shared(signatures(docs), "signatures")
    same = write_shared(sig.withColumn("rep", F.min("doc_id").over(Window.partitionBy(*_W))).select("doc_id", "rep", *_W), "same")
    return same, same.where("doc_id = rep").dropDuplicates(_W).select("doc_id", *_W)


def audited_recall(docs: DataFrame, radius: int = RADIUS, beam: int = 16, shards: int | None = None) -> DataFrame:
    """(shard, beam, recall) of a search of ``docs``."""
    return search(_prepared(docs)[1], radius, beam, shards).where("b is null").select(F.col("a").cast("int").alias("shard"), "beam", "recall")


def groups(docs: DataFrame, radius: int = RADIUS, beam: int = 16, shards: int | None = None) -> DataFrame:
    """(doc_id, group_id) of every document that has a near copy; group_id is the least doc_id of its group."""
    same, nodes = _prepared(docs)
    near = search(nodes, radius, beam, shards).where("b is not null").select("a", "b")
    copies = same.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return components(near.unionByName(copies)).select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))


def drop_copies(docs: DataFrame, radius: int = RADIUS, beam: int = 16) -> DataFrame:
    """One document of each group of near copies, and all that are in none; all columns as they were."""
    found = write_shared(groups(docs, radius, beam), "groups")
    gone, twice, nth = fresh(docs.columns, "__lw_drop", "__lw_again", "__lw_n")
    drop = found.where("doc_id <> group_id").select(F.col("doc_id").alias(gone))
    n = drop.count()
    kept = docs.join(F.broadcast(drop) if n <= BROADCAST_IDS else drop.hint("shuffle_hash"), docs["doc_id"] == F.col(gone), "left_anti")
    again = write_shared(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(twice)), "again")
    m = again.count()
    if not m:
        return kept
    again = F.broadcast(again) if m <= BROADCAST_IDS else again
    once = kept.join(again, kept["doc_id"] == F.col(twice), "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))).where(F.col(nth) == 1).drop(nth)
    return kept.join(again, kept["doc_id"] == F.col(twice), "left_anti").unionByName(once)
