"""Minimal proof selection: greedy weighted set cover over a query's candidates.

A query has few candidates (its contract bounds them), so one query is a plain function; many queries
run side by side, grouped by query.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.cost import Weights


@dataclass
class Candidate:
    atom_id: str
    covers: frozenset[int]
    trust: int = 5000
    io_bytes: int = 64
    edges: int = 0
    hard: int = 0
    soft: int = 0
    keys: frozenset[int] = frozenset()

    def cost(self, w: Weights, inverse_trust: bool = True) -> float:
        if not inverse_trust:
            return w.node + w.edge * self.edges + w.io * self.io_bytes + w.trust * (100 - self.trust / 100)
        return self.io_bytes * w.io + w.trust * (10000 / self.trust if self.trust > 0 else 10.0) + w.hard_conflict * self.hard + w.soft_conflict * self.soft + 1.0


@dataclass
class Cover:
    selected: list[int] = field(default_factory=list)
    covered: set[int] = field(default_factory=set)
    cost: float = 0.0


def solve(gaps: dict[int, int], candidates: list[Candidate], w: Weights = Weights(), max_cost: float | None = None, inverse_trust: bool = True) -> Cover:
    """Greedy cover of ``gaps`` (id -> priority): best gain for cost first, ties to the least atom id. A candidate beyond the budget is passed over."""
    out = Cover()
    costs = [c.cost(w, inverse_trust) for c in candidates]

    def key(i: int) -> tuple[float, str, int] | None:
        gain = sum(gaps.get(g, 0) for g in candidates[i].covers - out.covered)
        if gain <= 0 or (max_cost is not None and out.cost + costs[i] > max_cost):
            return None  # for good: gains only fall, and the cost only grows
        return -(gain / costs[i] if costs[i] > 0 else float("inf")), candidates[i].atom_id, i

    heap = [k for i in range(len(candidates)) if (k := key(i)) is not None]
    heapq.heapify(heap)
    while heap and not gaps.keys() <= out.covered:
        i = heapq.heappop(heap)[2]
        now = key(i)
        if now is None:
            continue
        if heap and now > heap[0]:
            heapq.heappush(heap, now)
            continue
        out.selected.append(i)
        out.covered |= candidates[i].covers & gaps.keys()
        out.cost += costs[i]
    return out


def prune(candidates: list[Candidate], selected: list[int]) -> list[int]:
    """Without those that cover nothing that the rest doesn't, the last chosen first."""
    kept = list(selected)
    for i in reversed(selected):
        rest = set().union(*(candidates[j].covers for j in kept if j != i)) if len(kept) > 1 else set()
        if candidates[i].covers <= rest:
            kept.remove(i)
    return kept


def connect(candidates: list[Candidate], selected: list[int], rounds: int = 10) -> list[int]:
    """Adds candidates that share a key with two unconnected parts of the selection, the least atom id first, until none does."""
    chosen = list(selected)
    for _ in range(rounds):
        parent = {i: i for i in chosen}

        def find(x: int) -> int:
            while parent[x] != x:
                x = parent[x]
            return x

        by_key: dict[int, list[int]] = defaultdict(list)
        for i in chosen:
            for k in candidates[i].keys:
                by_key[k].append(i)
        for members in by_key.values():
            for m in members[1:]:
                parent[find(m)] = find(members[0])
        if len({find(i) for i in chosen}) < 2:
            break
        bridges = [(candidates[i].atom_id, i) for i in range(len(candidates)) if i not in parent and len({find(j) for k in candidates[i].keys for j in by_key.get(k, [])}) > 1]
        if not bridges:
            break
        chosen.append(min(bridges)[1])
    return chosen


def solve_many(candidates: DataFrame, w: Weights = Weights()) -> DataFrame:
    """(query_id, step, atom_id) for candidates (query_id, atom_id, gap, priority, trust, io_bytes), one row a gap covered."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        gaps = dict(zip(pdf["gap"].tolist(), pdf["priority"].tolist()))
        covers: dict[str, set[int]] = defaultdict(set)
        about: dict[str, tuple[int, int]] = {}
        for atom, gap, trust, size in zip(*(pdf[c].tolist() for c in ("atom_id", "gap", "trust", "io_bytes"))):
            covers[atom].add(gap)
            about.setdefault(atom, (trust, size))
        each = [Candidate(a, frozenset(covers[a]), *about[a]) for a in sorted(covers)]
        found = solve(gaps, each, w)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "step": range(len(found.selected)), "atom_id": [each[i].atom_id for i in found.selected]})

    return candidates.groupBy("query_id").applyInPandas(one, "query_id bigint, step int, atom_id string")
