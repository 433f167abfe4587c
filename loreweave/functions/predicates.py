"""Predicates as columns: the eleven comparisons, strengths, masks, intervals and claim patterns."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SATISFIED, VIOLATED, UNKNOWN, BLOCKED = "satisfied", "violated", "unknown", "blocked"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def values_equal(actual: Column, expected: Any) -> Column:
    """Text without regard to ASCII case, all else as it is."""
    return ascii_lower(actual) == ascii_lower(F.lit(expected)) if isinstance(expected, str) else actual == F.lit(expected)


def contains_value(actual: Column, expected: Any, is_list: bool = False) -> Column:
    """Text in text; each of a list in a list; one value in a list."""
    if not is_list:
        return F.lower(actual).contains(str(expected).lower())
    wanted = expected if isinstance(expected, (list, tuple)) else [expected]
    return reduce(lambda a, b: a & b, (F.exists(actual, lambda x, w=w: values_equal(x, w)) for w in wanted), F.lit(True))


def compare(actual: Column, operator: str, expected: Any = None, is_list: bool = False, numeric: bool = True) -> Column:
    """One of the eleven comparisons. ``after`` includes the bound, ``before`` doesn't; ``during`` and ``within`` are half-open.

    ``numeric``: whether the column holds numbers; gte and lte are false on anything else.
    """
    match operator:
        case "exists":
            return actual.isNotNull()
        case "eq":
            return values_equal(actual, expected)
        case "ne":
            return ~values_equal(actual, expected)
        case "contains":
            return contains_value(actual, expected, is_list)
        case "matches":
            # the documented meaning: a regular expression
            return actual.rlike(str(expected)) if not is_list else F.exists(actual, lambda x: x.rlike(str(expected)))
        case "gte" | "lte":
            if not numeric or isinstance(expected, (str, bool)):
                return F.lit(False)
            return actual >= F.lit(expected) if operator == "gte" else actual <= F.lit(expected)
        case "before":
            return actual < F.lit(expected)
        case "after":
            return actual >= F.lit(expected)
        case "during" | "within":
            lo, hi = expected
            return (actual >= F.lit(lo) if lo is not None else F.lit(True)) & (actual < F.lit(hi) if hi is not None else F.lit(True))
    raise ValueError(f"unknown operator {operator}")


def status(actual: Column, matched: Column, strength: str) -> Column:
    """satisfied, violated, or unknown where there is no value; must_not is satisfied by no match."""
    good = ~matched if strength == "must_not" else matched
    return F.when(actual.isNull(), UNKNOWN).when(good, SATISFIED).otherwise(VIOLATED)


def hard_ok(statuses: Column) -> Column:
    """No status is violated or blocked; unknown passes."""
    return F.forall(statuses, lambda s: ~s.isin(VIOLATED, BLOCKED))


def matches_domain(mask: Column, wanted: int, zero_is_any: bool = True) -> Column:
    """The masks overlap; a wanted mask of 0 lets all pass, unless told otherwise."""
    if wanted == 0:
        return F.lit(zero_is_any)
    return mask.bitwiseAND(F.lit(wanted).cast("bigint")) != 0


def overlaps(a_from: Column, a_to: Column, b_from: Any, b_to: Any) -> Column:
    """Half-open intervals; null is open."""
    lo = F.lit(True) if b_to is None else a_from.isNull() | (a_from < F.lit(b_to))
    hi = F.lit(True) if b_from is None else a_to.isNull() | (F.lit(b_from) < a_to)
    return lo & hi


def valid_at(valid_from: Column, valid_to: Column, t: Any) -> Column:
    """Atoms: the closed interval; null is open."""
    return (valid_from.isNull() | (valid_from <= F.lit(t))) & (valid_to.isNull() | (F.lit(t) <= valid_to))


def edge_valid_at(from_bucket: Column, to_bucket: Column, bucket: int) -> Column:
    """Edges: half-open; 0 is open."""
    return (F.lit(bucket) >= from_bucket) & ((to_bucket == 0) | (F.lit(bucket) < to_bucket))


def trust_at_least(trust: Column, least: int) -> Column:
    return trust >= F.lit(least)


def type_in(atom_type: Column, types: list[str]) -> Column:
    """An empty list lets all pass."""
    return atom_type.isin(*types) if types else F.lit(True)


def pattern_term(value: Column, term: Any) -> Column:
    """None: any; a number: that one; ("range", lo, hi): inclusive; a set: one of it."""
    if term is None:
        return F.lit(True)
    if isinstance(term, (set, frozenset, list)):
        return value.isin(*sorted(term))
    if isinstance(term, tuple):
        return value.between(term[1], term[2])
    return value == F.lit(term)


def claim_matches(subj: Any = None, pred: Any = None, obj: Any = None, tag: int | None = None, mask: int = 0) -> Column:
    """A claim pattern over the columns subj, pred, obj (obj_tag, qualifiers where asked for)."""
    out = pattern_term(F.col("subj"), subj) & pattern_term(F.col("pred"), pred) & pattern_term(F.col("obj"), obj)
    if tag is not None:
        out = out & (F.col("obj_tag") == tag)
    if mask:
        out = out & (F.col("qualifiers").bitwiseAND(F.lit(mask)) == mask)
    return out
