"""Fixed-point answering: gaps, retrieval, constraints, contexts, invariants, cover, claims, conflicts, inference - until nothing changes.

Every phase is a plan over DataFrames; the driver sees only a query's candidates and claims, which its contract
bounds (``max_atoms``, ``max_edges``). What a round infers opens the next one: nodes that inferred claims reach become
seeds of graph gaps, and gaps that they fit are met. Two rounds in a row that change nothing end the search; a round
that starts from what the last one started from would repeat it, so it isn't run.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cost import Weights
from ..functions.predicates import claim_matches
from ..model.projection import Model
from ..operators import constraints as K
from ..operators import graph, inference, setcover
from ..operators import invariants as I
from ..operators import retrieval as R
from ..sources.shared import cut
from . import gaps as G
from .contract import Contract, Goal
from .planner import BACKENDS, plan

RELATION = "RELATION"  # a gap that a claim of this form meets
PROOF_EDGES = {"SUPPORTS": "supports", "CONTRADICTS": "contradicts", "DERIVED_FROM": "derived_from", "CAUSES": "causes"}


CLAIM_STEPS = 3  # how far claims are followed for inference


@dataclass
class AnswerPack:
    """What was found: rows of atoms, edges and claims, with gaps, conflicts, branches, rejects and a trace."""

    status: str
    intent: str
    nodes: list[dict[str, Any]] = field(default_factory=list)
    edges: list[dict[str, Any]] = field(default_factory=list)
    claims: list[dict[str, Any]] = field(default_factory=list)
    inferred: list[dict[str, Any]] = field(default_factory=list)
    gaps: list[dict[str, Any]] = field(default_factory=list)
    conflicts: list[dict[str, Any]] = field(default_factory=list)
    branches: list[dict[str, Any]] = field(default_factory=list)
    rejected: list[dict[str, Any]] = field(default_factory=list)
    limitations: list[str] = field(default_factory=list)
    trace: list[dict[str, Any]] = field(default_factory=list)
    cost: float = 0.0
    ctx: int = 0

    @property
    def coverage(self) -> float:
        return sum(g["covered"] for g in self.gaps) / len(self.gaps) if self.gaps else 0.0


class Retriever(Protocol):
    """A backend of one's own: candidates (node_num) for a gap, or None if it serves no such gap."""

    def retrieve(self, gap: dict[str, Any], goal: Goal) -> DataFrame | None: ...


class Solver:
    def __init__(self, atoms: DataFrame, postings: DataFrame, edges: DataFrame, claims: DataFrame, vectors: DataFrame | None = None, weights: Weights = Weights(), retrievers: dict[str, Retriever] | None = None):
        self.retrievers = retrievers or {}
        self.atoms, self.postings, self.edges, self.claims, self.vectors, self.weights = atoms, postings, edges, claims, vectors, weights
        self.spark = atoms.sparkSession

    def route(self, gap: dict[str, Any], goal: Goal, terms: list[str]) -> DataFrame:
        """Candidates of a gap: every backend that serves its kind; (node_num, backend)."""
        found = {}
        for backend in BACKENDS.get(gap["kind"], ()):
            if backend == "exact":
                ids = [v for k, v in goal.entities if k == "atom"]
                nodes = [s for s in gap["seeds"] if s is not None]
                if ids or nodes or not terms:
                    found["exact"] = R.exact(self.atoms, ids, nodes).select("node_num")
                else:
                    found["exact"] = R.lexical_all(self.postings, terms)
            elif backend == "lexical" and terms:
                found["lexical"] = R.lexical_all(self.postings, terms)
            elif backend == "graph" and gap["seeds"] and gap["edge_types"]:
                seeds = self.spark.createDataFrame([(s,) for s in gap["seeds"] if s is not None], "node bigint")
                found["graph"] = graph.walk(self.edges, seeds, gap["depth"], gap["edge_types"]).where("depth > 0").select(F.col("node").alias("node_num"))
        if goal.vectors and self.vectors is not None:
            q = self.spark.createDataFrame(list(enumerate(goal.vectors)), "query_id int, query array<float>")
            found["semantic"] = R.semantic_candidates(self.vectors, q, trust_min=goal.trust_min).select("node_num")
        if gap["kind"] == RELATION:
            found["exact"] = self.claims.where(claim_matches(gap["subj"], gap["pred"], gap["obj"])).select(F.col("subj").alias("node_num"))
        for name, r in self.retrievers.items():
            if (own := r.retrieve(gap, goal)) is not None:
                found[name] = own.select("node_num")
        return R.union_dedup(found, bool(goal.vectors)) if found else self.spark.createDataFrame([], "node_num bigint, backend string")

    def solve(self, contract: Contract, terms: list[str]) -> AnswerPack:
        return self.solve_with_ctx(contract, terms, contract.context.active or 0)

    def solve_with_ctx(self, contract: Contract, terms: list[str], ctx: int) -> AnswerPack:
        """The answer in a context: candidates of its branch, of none and of those that the contract allows."""
        goal, b = contract.to_goal(), contract.budgets
        began = time.monotonic()
        late = lambda: (time.monotonic() - began) * 1000 > b.max_time_ms
        entities = goal.nodes()
        open_ = G.generate(goal.intent, entities)
        for r in contract.relations:
            open_.append({"id": len(open_), "kind": RELATION, "priority": 170, "subj": r.get("subject"), "pred": r.get("predicate"), "obj": r.get("object"), "tag": None, "edge_types": [], "depth": 1, "seeds": [], "covered": False})
        pack = AnswerPack("complete", goal.intent, gaps=open_, ctx=ctx)
        known: dict[str, setcover.Candidate] = {}
        rows: dict[str, dict[str, Any]] = {}
        last_cost, still, before = None, 0, None
        for iteration in range(b.max_iterations):
            start = (tuple(sorted(known)), tuple(tuple(g["seeds"]) for g in open_), tuple(g["covered"] for g in open_))
            if start == before or late():
                pack.limitations += ["deadline"] * late()
                break
            before = start
            cand = self._candidates(open_, goal, terms, iteration, pack)
            if cand is None:
                break
            kept = self._admitted(cand, contract, goal, ctx, pack)
            top = kept.select("atom_id", "node_num", "atom_type", "trust", "io_bytes", "gaps", "backend", K.should_score(goal.constraints).alias("soft")).orderBy(F.desc("soft"), F.desc("trust"), "atom_id").limit(b.max_atoms)
            got = [r.asDict() for r in top.collect()]
            if len(got) == b.max_atoms:
                pack.limitations.append("max_atoms")
            for r in got:
                old = known.get(r["atom_id"])
                rows[r["atom_id"]] = r
                known[r["atom_id"]] = setcover.Candidate(r["atom_id"], frozenset(r["gaps"]) | (old.covers if old else frozenset()), r["trust"], r["io_bytes"])
            cands = [known[k] for k in sorted(known)]
            cover = setcover.solve({g["id"]: g["priority"] for g in open_}, cands, self.weights)
            chosen = setcover.prune(cands, setcover.connect(cands, cover.selected)) if contract.policies.minimal_proof else list(range(len(cands)))
            io = 0
            pack.nodes = []
            for i in chosen:
                io += cands[i].io_bytes
                if io > b.max_io_bytes:
                    pack.limitations.append("max_io_bytes")
                    break
                pack.nodes.append(rows[cands[i].atom_id])
            for g in open_:
                g["covered"] = g["covered"] or g["id"] in cover.covered
            self._update_context(pack, contract, entities, late)
            self._infer(pack, open_, entities)
            pack.cost = cover.cost
            still = still + 1 if last_cost is not None and abs(last_cost - cover.cost) < 0.001 else 0
            last_cost = cover.cost
            if all(g["covered"] for g in open_) or still >= 2:
                break
        self._finish(pack, contract, entities)
        return pack

    def _candidates(self, open_: list[dict[str, Any]], goal: Goal, terms: list[str], iteration: int, pack: AnswerPack) -> DataFrame | None:
        """Atoms that any open gap leads to, with their gaps; of them the newest, where the contract asks for those."""
        routed = None
        for a in plan([g for g in open_ if g["kind"] != RELATION], len(goal.entities), goal.trust_min) + [g for g in open_ if g["kind"] == RELATION and not g["covered"]]:
            gap = a if isinstance(a, dict) else open_[a.gap_id]
            one = self.route(gap, goal, terms).withColumn("gap", F.lit(gap["id"]))
            routed = one if routed is None else routed.unionByName(one)
            pack.trace.append({"iteration": iteration, "gap": gap["id"], "kind": gap["kind"], "utility": None if isinstance(a, dict) else round(a.utility, 6)})
        if routed is None:
            return None
        merged = routed.groupBy("node_num").agg(F.array_sort(F.collect_set("gap")).alias("gaps"), F.min("backend").alias("backend"))
        return cut(K.latest(self.atoms.join(merged, "node_num"), goal))  # read for what is rejected and for what is kept

    def _admitted(self, cand: DataFrame, contract: Contract, goal: Goal, ctx: int, pack: AnswerPack) -> DataFrame:
        """Candidates that pass the hard constraints, quantifiers, context scope, provenance policies and invariants."""
        hard = [c for c in goal.constraints if c.strength != "should"]
        scope = F.lit(True)
        if "branch" in cand.columns:
            scope = K.context_allowed(F.col("branch"), [*contract.context.allowed, ctx], contract.context.include_conflicting_branches)
        if contract.policies.include_rejected and not pack.rejected:
            why = F.coalesce(K.first_failure(hard), F.when(~scope, "context"))
            pack.rejected = [r.asDict() for r in cand.withColumn("rejected_by", why).where("rejected_by is not null").select("atom_id", "rejected_by").orderBy("atom_id").limit(contract.output.max_items).collect()]
        kept = K.admitted(cand, hard).where(scope)
        if contract.quantifiers:
            kept = K.evaluate_all(kept, goal.constraints)
            for q in contract.quantifiers:
                kept = kept.where(K.quantified(F.col("results"), q.constraint_ids, q.kind, q.n))
        if contract.policies.require_provenance:
            kept = kept.join(self.edges.where("edge_type = 'DERIVED_FROM'").select(F.col("src").alias("node_num")), "node_num", "left_semi")
        if contract.policies.require_direct_evidence:
            kept = kept.join(self.claims.select(F.col("subj").alias("node_num")), "node_num", "left_semi")
        qc = I.Constraints(goal.time_range[0], goal.time_range[1], goal.trust_min, goal.domain_mask)
        if "program" in kept.columns:  # atoms that bring an invariant of their own
            passed = I.evaluate(kept, I.BASIC, qc, vm=True).where(F.col("result") == I.PASS).select("atom_id")
            return kept.join(passed, "atom_id", "left_semi")
        return kept.where(I.check_columns(I.BASIC, qc)["result"] == I.PASS)

    def _facts(self, nodes: list[int], steps: int) -> DataFrame:
        """Claims of nodes, and of what these claims lead to, so many steps far."""
        seeds = self.spark.createDataFrame([(n,) for n in nodes], "node bigint")
        seen = seeds
        for _ in range(steps - 1):
            seen = cut(seen.unionByName(self.claims.join(seen.select(F.col("node").alias("subj")), "subj", "left_semi").select(F.col("obj").alias("node"))).distinct())
        return self.claims.join(seen.select(F.col("node").alias("subj")), "subj", "left_semi").select("subj", "pred", "obj", "trust")

    def _update_context(self, pack: AnswerPack, contract: Contract, entities: list[int], late: Callable[[], bool]) -> None:
        """Asserts the claims of the chosen nodes: of a slot's objects the least stays, each other opens a branch with its reason.

        Beyond ``max_context_branches``, and past the deadline, claims are rejected instead.
        """
        nodes = sorted({n["node_num"] for n in pack.nodes} | set(entities))
        if not nodes:
            return
        own = self.claims.where(F.col("subj").isin(*nodes)).select("subj", "pred", "obj", "trust").orderBy("subj", "pred", "obj").limit(contract.budgets.max_edges)
        slots: dict[tuple[int, int], int] = {}
        pack.claims, pack.branches = [], []
        for r in own.collect():
            base = slots.setdefault((r["subj"], r["pred"]), r["obj"])
            if base == r["obj"]:
                pack.claims.append(r.asDict())
            elif len(pack.branches) < contract.budgets.max_context_branches and not late():
                pack.branches.append(r.asDict() | {"parent_ctx": pack.ctx, "reason": f"{r['subj']} has {base} for {r['pred']}"})
            else:
                pack.limitations += ["max_context_branches"] * ("max_context_branches" not in pack.limitations)

    def _infer(self, pack: AnswerPack, open_: list[dict[str, Any]], entities: list[int]) -> None:
        """Rules 1, 3 and 4 over the claims that the answer's nodes lead to; gaps that they fit are met, and what they reach seeds graph gaps."""
        nodes = sorted({n["node_num"] for n in pack.nodes} | set(entities))
        direct = pack.claims + pack.branches
        if not direct:  # nothing to infer from
            return
        facts = cut(self._facts(sorted({*nodes, *(c["obj"] for c in direct)}), CLAIM_STEPS - 1))
        every = inference.transitive(facts).withColumn("rule", F.lit(1)).unionByName(inference.contradiction(facts).withColumn("rule", F.lit(3))).unionByName(inference.second_order(facts).withColumn("rule", F.lit(4)))
        pack.inferred = [r.asDict() for r in every.where(F.col("subj").isin(*nodes)).orderBy("subj", "pred", "obj", "rule").collect()]
        reached = sorted({c["obj"] for c in pack.inferred})
        for g in open_:
            if g.get("pred") is not None or g["kind"] == RELATION:
                g["covered"] = g["covered"] or any(all(g.get(k) in (None, c[k]) for k in ("subj", "pred", "obj")) for c in pack.inferred)
            elif g["edge_types"] and not g["covered"]:
                g["seeds"] = sorted({*(s for s in g["seeds"] if s is not None), *reached})

    def _finish(self, pack: AnswerPack, contract: Contract, entities: list[int]) -> None:
        nodes = [n["node_num"] for n in pack.nodes] + entities
        n = contract.output.max_items
        if nodes:
            e = self.edges.where(F.col("edge_type").isin(*PROOF_EDGES) & F.col("src").isin(*nodes) & F.col("dst").isin(*nodes))
            pack.edges = [r.asDict() | {"relation": PROOF_EDGES[r["edge_type"]]} for r in e.orderBy("src", "dst", "edge_type").limit(min(n, contract.budgets.max_edges)).collect()]
            own = self.claims.where(F.col("subj").isin(*nodes))
            if contract.policies.include_conflicts:
                pack.conflicts = [r.asDict() for r in inference.conflict_sets(own).orderBy("subj", "pred").limit(n).collect()]
        done = [g["covered"] for g in pack.gaps]
        if not pack.nodes:
            pack.status = "policy_blocked" if pack.rejected else "no_match"
        elif pack.conflicts:
            pack.status = "conflicted"
        elif any(x in pack.limitations for x in ("deadline", "max_io_bytes")):
            pack.status = "budget_exhausted"
        elif not all(done):
            pack.status = "insufficient_evidence"


def answer_lookup(m: Model, terms: list[str]) -> DataFrame:
    """A lookup by terms, end to end: the atoms of its answer."""
    from .contract import Constraint, Target

    c = Contract("lookup", [Target(label=" ".join(terms), domain_mask=1)], constraints=[Constraint("trust", "trust", "gte", 5000)])
    pack = Solver(m.atoms(), m.occurrences(), m.current_edges(), m.claims(), m.embeddings()).solve(c, terms)
    return m.spark.createDataFrame([(n["atom_id"], n["node_num"], n["trust"], n["gaps"]) for n in pack.nodes], "atom_id string, node_num bigint, trust int, gaps array<int>")


def answer_node(m: Model, node: int, **more: Any) -> AnswerPack:
    """The answer about one node."""
    from .contract import Budgets, Target

    c = Contract("lookup", [Target(node_id=node)], budgets=Budgets(**({"max_time_ms": 300_000} | more)))
    return Solver(m.atoms(), m.occurrences(), m.current_edges(), m.claims()).solve(c, [])


__all__ = ["AnswerPack", "Retriever", "Solver", "answer_lookup", "answer_node"]
