"""Query contracts: what is asked, under which constraints and budgets; checked and lowered to a goal."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from ..operators.constraints import Constraint

INTENTS = ("lookup", "define", "explain", "compare", "derive", "verify", "plan")
SELECTORS = ("id", "entity_id", "atom_id", "node_id", "term_id", "symbol_id", "stable_key")
MAX_TARGETS, MAX_CONSTRAINTS = 256, 1024


class ContractError(ValueError):
    """A contract that can't be run; the first argument names the fault."""


@dataclass
class Target:
    label: str | None = None
    id: str | None = None
    entity_id: str | None = None
    atom_id: str | None = None
    node_id: int | None = None
    term_id: int | None = None
    symbol_id: int | None = None
    stable_key: str | None = None
    entity_type: str | None = None
    aliases: list[str] = field(default_factory=list)
    domain_mask: int | None = None


@dataclass
class Quantifier:
    kind: str  # all, any, at_least, exactly
    constraint_ids: list[str]
    n: int = 0


@dataclass
class TemporalScope:
    """Of several, latest wins over valid_at and observed_at, before, after and range."""

    latest: int | None = None
    valid_at: int | None = None
    observed_at: int | None = None
    before: int | None = None
    after: int | None = None
    range: tuple[int | None, int | None] | None = None

    def time_range(self) -> tuple[int | None, int | None]:
        if self.latest is not None:
            return None, None
        for t in (self.valid_at, self.observed_at):
            if t is not None:
                return t, t + 1
        if self.before is not None:
            return None, self.before
        if self.after is not None:
            return self.after, None
        return tuple(self.range) if self.range else (None, None)

    def constraints(self) -> list[Constraint]:
        out = []
        if self.before is not None:
            out.append(Constraint("__temporal_before", "time", "before", self.before))
        if self.after is not None:
            out.append(Constraint("__temporal_after", "time", "after", self.after))
        if self.range is not None:
            out.append(Constraint("__temporal_range", "time", "during", tuple(self.range)))
        return out


@dataclass
class ContextScope:
    active: int | None = None
    policy_id: int | None = None
    allowed: list[int] = field(default_factory=list)
    include_conflicting_branches: bool = False


@dataclass
class Policies:
    require_provenance: bool = False
    require_direct_evidence: bool = False
    include_rejected: bool = True
    include_conflicts: bool = False
    require_disambiguation_notes: bool = True
    minimal_proof: bool = True
    expose_unknowns: bool = True


@dataclass
class Output:
    format: str = "text"
    include_graph: bool = False
    include_trace: bool = False
    include_provenance: bool = False
    max_items: int = 100
    max_bytes: int = 65536


@dataclass
class Budgets:
    max_iterations: int = 100
    max_atoms: int = 4096
    max_edges: int = 8192
    max_io_bytes: int = 64 << 20
    max_time_ms: int = 30_000
    max_context_branches: int = 128
    max_federated_calls: int = 0


@dataclass
class Contract:
    intent: str = "lookup"
    targets: list[Target] = field(default_factory=list)
    semantic_vectors: list[list[float]] = field(default_factory=list)
    relations: list[dict[str, Any]] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)
    quantifiers: list[Quantifier] = field(default_factory=list)
    temporal: TemporalScope = field(default_factory=TemporalScope)
    context: ContextScope = field(default_factory=ContextScope)
    policies: Policies = field(default_factory=Policies)
    output: Output = field(default_factory=Output)
    budgets: Budgets = field(default_factory=Budgets)

    def by_strength(self, strength: str) -> list[Constraint]:
        return [c for c in self.constraints if c.strength == strength]

    def domain_mask(self) -> int:
        out = 0
        for t in self.targets:
            out |= t.domain_mask or 0
        return out

    def trust_min(self) -> int:
        """The trust that every must-constraint on it asks for at least."""
        return max([int(c.value) for c in self.by_strength("must") if c.target == "trust" and c.operator == "gte"], default=0)

    def validate(self) -> None:
        if self.intent not in INTENTS:
            raise ContractError("unknown intent")
        if not (self.targets or self.semantic_vectors or self.relations or self.constraints):
            raise ContractError("empty contract")
        if any(not v for v in self.semantic_vectors):
            raise ContractError("empty semantic vector")
        ids = [c.id for c in self.constraints]
        if len(set(ids)) < len(ids):
            raise ContractError("duplicate constraint id")
        if any(not 0 <= c.weight <= 1 for c in self.by_strength("should")):
            raise ContractError("should weight out of range")
        if any(set(r) - {"subject", "predicate", "object"} or not set(r) for r in self.relations):
            raise ContractError("a relation has subject, predicate and object")
        if any(q.kind not in ("all", "any", "at_least", "exactly") for q in self.quantifiers):
            raise ContractError("unknown quantifier")
        if self.context.policy_id is not None:
            raise ContractError("context policies aren't supported")
        if any(i not in ids for q in self.quantifiers for i in q.constraint_ids):
            raise ContractError("unknown constraint in a quantifier")
        if len(self.targets) > MAX_TARGETS or len(self.constraints) > MAX_CONSTRAINTS:
            raise ContractError("too many targets or constraints")
        for t in self.targets:
            if sum(getattr(t, s) is not None for s in SELECTORS) > 1:
                raise ContractError("a target has several exact selectors")
            if t.stable_key is not None and not t.stable_key.strip():
                raise ContractError("empty stable key")
        b, o = self.budgets, self.output
        for name, ok in (("max_atoms", 0 < b.max_atoms <= 65_536), ("max_iterations", 0 < b.max_iterations <= 1_000), ("max_edges", b.max_edges <= 262_144), ("max_io_bytes", b.max_io_bytes <= 1 << 30), ("max_time_ms", b.max_time_ms <= 300_000), ("max_federated_calls", b.max_federated_calls <= 128), ("max_context_branches", b.max_context_branches <= 65_536), ("max_items", 0 < o.max_items <= 4096), ("max_bytes", 2_048 <= o.max_bytes <= 8 << 20)):
            if not ok:
                raise ContractError(f"budget {name}")

    def to_goal(self) -> Goal:
        self.validate()
        refs = []
        for t in self.targets:
            if t.id is not None and ":" in t.id:
                refs.append(parse_ref(t.id))
            for kind, value in (("atom", t.atom_id), ("node", t.node_id), ("term", t.term_id), ("sym", t.symbol_id)):
                if value is not None:
                    refs.append((kind, value))
        return Goal(self.intent, refs, self.temporal.time_range(), self.domain_mask(), self.semantic_vectors, self.constraints + self.temporal.constraints(), self.context, self.policies.include_conflicts, self.temporal.latest, self.trust_min())


@dataclass
class Goal:
    """A contract lowered for the solver."""

    intent: str
    entities: list[tuple[str, Any]]
    time_range: tuple[int | None, int | None]
    domain_mask: int
    vectors: list[list[float]]
    constraints: list[Constraint]
    context: ContextScope
    include_conflicts: bool
    latest: int | None = None
    trust_min: int = 0

    def nodes(self) -> list[int]:
        return [v for k, v in self.entities if k == "node"]


def parse_ref(text: str) -> tuple[str, Any]:
    """term:N, sym:N, node:N or atom:<64 hexadecimal digits>."""
    kind, _, value = text.partition(":")
    if kind in ("term", "sym", "node") and re.fullmatch(r"\d+", value):
        return kind, int(value)
    if kind == "atom" and re.fullmatch(r"[0-9a-fA-F]{64}", value):
        return kind, value.lower()
    raise ContractError(f"bad reference {text!r}")


def to_json(c: Contract) -> str:
    return json.dumps(asdict(c), sort_keys=True, ensure_ascii=False)


def _make(cls: type, data: dict[str, Any]) -> Any:
    known = {f.name for f in fields(cls)}
    if set(data) - known:
        raise ContractError(f"unknown fields {sorted(set(data) - known)}")
    try:
        return cls(**data)
    except TypeError as e:
        raise ContractError(str(e)) from e


def from_dict(data: dict[str, Any]) -> Contract:
    """A contract from JSON or YAML; unknown fields are refused."""
    d = dict(data)
    for name, cls in (("targets", Target), ("constraints", Constraint), ("quantifiers", Quantifier)):
        if name in d:
            d[name] = [_make(cls, x) for x in d[name]]
    for name, cls in (("temporal", TemporalScope), ("context", ContextScope), ("policies", Policies), ("output", Output), ("budgets", Budgets)):
        if name in d:
            d[name] = _make(cls, d[name])
    return _make(Contract, d)


def read_contract(path: str) -> Contract:
    text = open(path, encoding="utf-8").read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            return from_dict(json.loads(text))
        return from_dict(yaml.safe_load(text))
    return from_dict(json.loads(text))
