"""Several knowledge bases as one table with a shard id: discovery, trust in mappings, negotiation, sync."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROTOCOL = 1
ACCEPTABLE = "acceptable"


@dataclass(frozen=True)
class TrustPolicy:
    min_confidence: float = 0.5
    min_source_trust: int = 1000
    allowed: tuple[int, ...] = ()
    blocked: tuple[int, ...] = ()
    require_evidence: bool = False
    min_evidence_weight: float = 0.0
    max_age: int = 0

    @classmethod
    def strict(cls) -> TrustPolicy:
        return cls(0.8, 5000, require_evidence=True, min_evidence_weight=0.5, max_age=3600)

    @classmethod
    def relaxed(cls) -> TrustPolicy:
        return cls(0.3, 100)


def trust_check(policy: TrustPolicy, now: int) -> Column:
    """The first check that a mapping fails, or "acceptable". Null valid_until never expires."""
    fails = [
        (F.col("confidence") < policy.min_confidence, "confidence_too_low"),
        ((F.col("confidence") <= 0) | (F.col("confidence") > 1), "confidence_invalid"),
        (F.col("valid_until").isNotNull() & (F.lit(now) >= F.col("valid_until")), "expired"),
    ]
    if policy.max_age > 0:
        fails.append((F.lit(now) - F.col("created_at") > policy.max_age, "too_old"))
    if policy.blocked:
        fails.append((F.col("remote_base").isin(*policy.blocked), "base_blocked"))
    if policy.allowed:
        fails.append((~F.col("remote_base").isin(*policy.allowed), "base_not_allowed"))
    fails.append((F.col("source_trust") < policy.min_source_trust, "source_trust_too_low"))
    if policy.require_evidence:
        fails.append((F.col("evidence_weight") <= 0, "missing_evidence"))
    fails.append((F.col("evidence_weight") < policy.min_evidence_weight, "evidence_weight_too_low"))
    out = F.lit(ACCEPTABLE)
    for bad, name in reversed(fails):
        out = F.when(bad, name).otherwise(out)
    return out


def valid_mapping(now: int) -> Column:
    return (F.col("confidence") > 0) & (F.col("confidence") <= 1) & (F.col("valid_until").isNull() | (F.lit(now) < F.col("valid_until")))


def find_mappings(mappings: DataFrame, ids: DataFrame, now: int | None = None, policy: TrustPolicy | None = None) -> DataFrame:
    """Mappings of local ids (local_id): all, those valid at ``now``, or those that a policy accepts."""
    found = mappings.join(ids, "local_id", "left_semi")
    if policy is not None:
        return found.where(trust_check(policy, now) == ACCEPTABLE)
    return found if now is None else found.where(valid_mapping(now))


def first_mapping(mappings: DataFrame) -> DataFrame:
    """One mapping for each (local_id, remote_base): the least remote id."""
    rest = [c for c in mappings.columns if c not in ("local_id", "remote_base")]
    return mappings.groupBy("local_id", "remote_base").agg(F.min_by(F.struct(*rest), "remote_id").alias("v")).select("local_id", "remote_base", "v.*")


@dataclass(frozen=True)
class DiscoverRequest:
    terms: tuple[str, ...]
    min_trust: int = 1000
    domain_mask: int = 0
    created_from: int | None = None
    created_to: int | None = None
    max_hops: int = 3
    local_shard: int = 0
    visited: tuple[int, ...] = field(default_factory=tuple)
    types: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()


def routes(peers: list[tuple[int, int, int]], req: DiscoverRequest) -> list[tuple[int, int, int]]:
    """(shard, hops, trust) of every base that requests are forwarded to, over peers (base, peer, trust), which are configured by hand.

    A request goes on for ``max_hops`` steps, to no base twice, to no visited one and to no peer below a trust of 100; of
    several ways with the fewest steps, the one whose least trusted peer is trusted most.
    """
    out, level = {req.local_shard: (0, 10_000)}, {req.local_shard: 10_000}
    for hops in range(1, req.max_hops + 1):
        new: dict[int, int] = {}
        for base, peer, trust in peers:
            if base in level and peer not in out and peer not in req.visited and trust >= 100:
                new[peer] = max(new.get(peer, 0), min(level[base], trust))
        out |= {k: (hops, v) for k, v in new.items()}
        level = new
    return [(k, *v) for k, v in sorted(out.items())]


def discover(shards: DataFrame, postings: DataFrame, req: DiscoverRequest, peers: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(shard_id, node_num, relevance, hops, path_trust): atoms with any of the terms, relevance the share of them.

    The local shard is at hop 0. Without ``peers``, every other shard is a peer of it at hop 1, with its trust as a bound; with
    them, requests are forwarded along ``routes``. Peers below a trust of 100, and those visited, aren't asked.
    Order: relevance, then path trust, both falling.
    """
    n = len(set(req.terms))
    hits = postings.where(F.col("term").isin(*req.terms)).groupBy("node_num").agg((F.count_distinct("term") / n).alias("relevance"))
    local = F.col("shard_id") == req.local_shard
    if peers is None:
        s = shards.where(local | (F.col("shard_trust") >= 100)).withColumns({"hops": F.when(local, 0).otherwise(1), "bound": F.when(~local, F.col("shard_trust"))})
        if req.visited:
            s = s.where(~F.col("shard_id").isin(*req.visited))
        if req.max_hops < 1:
            s = s.where(local)
    else:
        way = F.create_map(*[x for shard, hops, trust in routes(peers, req) for x in (F.lit(shard), F.struct(F.lit(hops).alias("hops"), F.lit(trust).alias("trust")))])
        s = shards.withColumn("way", F.try_element_at(way, F.col("shard_id").cast("int"))).where("way is not null").withColumns({"hops": F.col("way.hops"), "bound": F.col("way.trust")})
    if req.domain_mask:
        s = s.where(F.col("domain_mask").bitwiseAND(F.lit(req.domain_mask).cast("bigint")) != 0)
    if req.created_from is not None:
        s = s.where((F.col("created_at") >= req.created_from) & (F.col("created_at") < req.created_to))
    if req.types:
        s = s.where(F.col("atom_type").isin(*req.types))
    if req.ids:
        s = s.where(F.col("atom_id").isin(*req.ids))
    found = s.join(hits, "node_num").select("shard_id", "node_num", "relevance", "hops", F.least("trust", F.coalesce("bound", F.col("trust"))).alias("path_trust"))
    return found.where(F.col("path_trust") >= req.min_trust).distinct()


def evidence_weight(evidence: Column) -> Column:
    """The sum of the weights of a mapping's evidence, an array of structs; 0 without any."""
    return F.coalesce(F.aggregate(evidence, F.lit(0.0), lambda a, e: a + e["weight"].cast("double")), F.lit(0.0))


def ranked(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("relevance"), F.desc("path_trust"), "node_num")


def fetch(atoms: DataFrame, ids: DataFrame, key: str = "node_num") -> DataFrame:
    return atoms.join(ids, key, "left_semi")


def fetch_trusted(atoms: DataFrame, mappings: DataFrame, policy: TrustPolicy, now: int, key: str = "remote_id") -> DataFrame:
    """Remote atoms that some acceptable mapping leads to."""
    ok = mappings.where(trust_check(policy, now) == ACCEPTABLE).select(key).distinct()
    return atoms.join(ok, key, "left_semi")


def negotiate(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(compatibility, accepted) of two schemas (field, type): the mean over all fields, accepted from 0.5."""
    both = local.select("field", F.col("type").alias("l")).join(remote.select("field", F.col("type").alias("r")), "field", "full")
    c = both.agg(F.coalesce(F.avg((F.col("l").isNotNull() & (F.col("l") == F.col("r"))).cast("double")), F.lit(0.0)).alias("compatibility"))
    return c.withColumn("accepted", F.col("compatibility") >= 0.5)


def best_per_shard(found: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("shard_id").orderBy(F.desc("relevance"), F.desc("path_trust"), "node_num")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
