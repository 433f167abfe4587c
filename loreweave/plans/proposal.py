"""What a language model may hand in: proposals, never facts. Nothing joins them to claims before they are accepted."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum
from typing import Generic, TypeVar

from .contract import Contract, ContractError

T = TypeVar("T")


class Validation(Enum):
    PROPOSED = "proposed"
    ACCEPTED = "accepted"
    REJECTED = "rejected"
    REVIEW = "needs_human_review"


@dataclass(frozen=True)
class Proposal(Generic[T]):
    value: T
    proposed_by: str
    model: str
    at: int
    confidence: float
    status: Validation = Validation.PROPOSED

    def __post_init__(self) -> None:
        object.__setattr__(self, "confidence", min(max(self.confidence, 0.0), 1.0))

    def with_status(self, status: Validation) -> Proposal[T]:
        return replace(self, status=status)

    @property
    def validated(self) -> bool:
        return self.status is Validation.ACCEPTED


def judge(p: Proposal[Contract], least: float = 0.5) -> Proposal[Contract]:
    """A proposed contract: rejected if it can't be run, for review if its proposer is unsure of it."""
    try:
        p.value.validate()
    except ContractError:
        return p.with_status(Validation.REJECTED)
    return p.with_status(Validation.ACCEPTED if p.confidence >= least else Validation.REVIEW)
