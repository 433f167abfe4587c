"""Retrieval planning: utility of gaps, and actions within a budget."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("DEFINITION", "FACT", "CAUSAL_CHAIN", "EVIDENCE", "COUNTEREXAMPLE", "CONSTRAINTS", "COMPARISON_AXIS", "PROCEDURE")
QUALITY = {"EVIDENCE": 1.0, "COUNTEREXAMPLE": 0.95, "FACT": 0.9, "CONSTRAINTS": 0.85, "DEFINITION": 0.8, "CAUSAL_CHAIN": 0.75, "COMPARISON_AXIS": 0.7, "PROCEDURE": 0.65}
BASE_COST = {"FACT": 1.0, "DEFINITION": 1.0, "EVIDENCE": 1.2, "CONSTRAINTS": 1.2, "COUNTEREXAMPLE": 1.5, "COMPARISON_AXIS": 1.5, "CAUSAL_CHAIN": 2.0, "PROCEDURE": 2.0}
#: Which backends serve a gap.
BACKENDS = {"DEFINITION": ("exact", "lexical"), "FACT": ("lexical",), "CAUSAL_CHAIN": ("graph",), "EVIDENCE": ("exact",), "COUNTEREXAMPLE": ("graph",), "CONSTRAINTS": ("exact",), "COMPARISON_AXIS": ("lexical",), "PROCEDURE": ("lexical", "exact")}


@dataclass(frozen=True)
class Action:
    gap_id: int
    kind: str
    utility: float
    cost: float
    shard_id: int | None = None


@dataclass(frozen=True)
class Shard:
    shard_id: int
    trust: int
    domain_mask: int
    kinds: frozenset[str] = frozenset()

    def serves(self, kind: str, trust_min: int, domain_mask: int) -> bool:
        return self.trust >= trust_min and (domain_mask == 0 or bool(self.domain_mask & domain_mask)) and (not self.kinds or kind in self.kinds)


def score(kind: str, priority: int, n_targets: int, trust_min: int) -> tuple[float, float]:
    """(utility, cost) of a gap."""
    cost = BASE_COST[kind] + trust_min / 10000
    return max(priority, 1) / 255 * QUALITY[kind] * (1 + min(0.05 * n_targets, 1)) / cost, cost


def utility(kind: Column, priority: Column, n_targets: Column, trust_min: int) -> Column:
    """The same over a table of gaps."""
    at = lambda d: F.element_at(F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(float(v)))]), kind)
    return F.greatest(priority, F.lit(1)) / 255.0 * at(QUALITY) * (1 + F.least(0.05 * n_targets, F.lit(1.0))) / (at(BASE_COST) + trust_min / 10000)


def _within(actions: list[Action], max_actions: int | None, max_io: int | None) -> list[Action]:
    """In order; an action beyond the budget is passed over, later ones may fit."""
    out, used = [], 0
    for a in actions:
        if max_actions is not None and len(out) >= max_actions:
            break
        c = math.ceil(a.cost)
        if max_io is None or used + c <= max_io:
            out.append(a)
            used += c
    return out


def plan(gaps: list[dict], n_targets: int, trust_min: int, max_actions: int | None = None, max_io: int | None = None) -> list[Action]:
    """Actions for the open gaps (id, kind, priority, covered), most useful first."""
    actions = [Action(g["id"], g["kind"], *score(g["kind"], g["priority"], n_targets, trust_min)) for g in gaps if not g.get("covered")]
    return _within(sorted(actions, key=lambda a: (-a.utility, a.gap_id)), max_actions, max_io)


def plan_federated(gaps: list[dict], n_targets: int, trust_min: int, domain_mask: int, shards: list[Shard], max_actions: int | None = None, max_io: int | None = None) -> list[Action]:
    """The same for each shard that serves a gap; a trusted shard, and one that has the whole domain, gains."""
    out = []
    for a in plan(gaps, n_targets, trust_min):
        for s in shards:
            if s.serves(a.kind, trust_min, domain_mask):
                whole = 1.05 if domain_mask and s.domain_mask & domain_mask == domain_mask else 1.0
                out.append(Action(a.gap_id, a.kind, a.utility * (0.5 + min(max(s.trust / 10000, 0), 1)) * whole, a.cost, s.shard_id))
    return _within(sorted(out, key=lambda a: (-a.utility, a.gap_id, a.shard_id)), max_actions, max_io)


def federated_utility(gaps: DataFrame, shards: list[Shard], kind: str, trust_min: int, domain_mask: int) -> DataFrame:
    """(gap_id, shard_id, utility) of gaps (gap_id, utility) of one kind, for every shard that serves it. Shards are few: an array, no join."""
    able = [s for s in shards if s.serves(kind, trust_min, domain_mask)]
    factor = [(0.5 + min(max(s.trust / 10000, 0), 1)) * (1.05 if domain_mask and s.domain_mask & domain_mask == domain_mask else 1.0) for s in able]
    each = F.explode(F.array(*[F.struct(F.lit(s.shard_id).alias("shard_id"), F.lit(f).alias("factor")) for s, f in zip(able, factor)])).alias("s")
    return gaps.select("gap_id", "utility", each).select("gap_id", "s.shard_id", (F.col("utility") * F.col("s.factor")).alias("utility"))
