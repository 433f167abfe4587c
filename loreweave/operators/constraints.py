"""Constraints over atoms: evaluation, and the split into admitted and rejected."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P

#: Constraint target -> column of atoms, and whether it holds numbers. Targets that atoms have no value for are absent.
SUBJECT = {"atom_id": ("atom_id", False), "atom_type": ("atom_type", False), "trust": ("trust", True), "domain": ("domain_mask", True), "source": ("source_id", True), "time": ("valid_from", True), "io_bytes": ("io_bytes", True)}


@dataclass(frozen=True)
class Constraint:
    id: str
    target: str
    operator: str
    value: Any = None
    strength: str = "must"  # must, must_not, should
    weight: float = 1.0


def evaluate(c: Constraint, subject: dict[str, tuple[str, bool]] | None = None) -> Column:
    """The constraint's status; unknown where the subject has no value for its target."""
    subject = subject or SUBJECT
    if c.target not in subject:
        return F.lit(P.UNKNOWN)
    name, numeric = subject[c.target]
    return P.status(F.col(name), P.compare(F.col(name), c.operator, c.value, numeric=numeric), c.strength)


def evaluate_all(atoms: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """Atoms with one column of structs: id, strength and status of each constraint."""
    each = [F.struct(F.lit(c.id).alias("id"), F.lit(c.strength).alias("strength"), evaluate(c).alias("status")) for c in constraints]
    return atoms.withColumn("results", F.array(*each) if each else F.array().cast("array<struct<id:string,strength:string,status:string>>"))


def first_failure(constraints: list[Constraint]) -> Column:
    """Id of the first hard constraint that isn't satisfied (unknown rejects, should never does); null if none."""
    out = F.lit(None).cast("string")
    for c in reversed([c for c in constraints if c.strength != "should"]):
        out = F.when(evaluate(c) != P.SATISFIED, F.lit(c.id)).otherwise(out)
    return out


def admitted(atoms: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """One plain filter for each hard constraint: they reach the scan."""
    for c in constraints:
        if c.strength != "should":
            atoms = atoms.where(evaluate(c) == P.SATISFIED)
    return atoms


def rejected(atoms: DataFrame, constraints: list[Constraint]) -> DataFrame:
    return atoms.withColumn("rejected_by", first_failure(constraints)).where("rejected_by is not null")


def should_score(constraints: list[Constraint]) -> Column:
    """Sum of the weights of the soft constraints satisfied."""
    return sum((F.when(evaluate(c) == P.SATISFIED, F.lit(float(c.weight))).otherwise(0.0) for c in constraints if c.strength == "should"), F.lit(0.0))


def quantified(results: Column, ids: list[str], kind: str, n: int = 0) -> Column:
    """all, any, at_least n or exactly n of the named constraints are satisfied."""
    hits = F.size(F.filter(results, lambda r: r["id"].isin(*ids) & (r["status"] == P.SATISFIED)))
    return {"all": hits == len(ids), "any": hits >= 1, "at_least": hits >= n, "exactly": hits == n}[kind]


def context_allowed(branch: Column, allowed: list[int], include_conflicting: bool = False) -> Column:
    """Candidates of no branch, or of one that the contract allows."""
    return F.lit(True) if include_conflicting else branch.isNull() | branch.isin(*allowed) if allowed else branch.isNull()


def latest(atoms: DataFrame, scope: Any) -> DataFrame:
    """The newest atoms that a temporal scope asks for, ties to the least id; all where it doesn't."""
    return atoms if scope.latest is None else atoms.orderBy(F.desc("created_at"), "atom_id").limit(scope.latest)
