"""Claim inference by self-joins, conflicts, and gaps met by claims."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..sources.shared import spread

TRANSITIVE = (2, 3, 5, 7)
SUPPORTS, CONTRADICTS = 5, 8
MARK, MARK_CONTRADICTION, MARK_SECOND = 0x80000000, 0xC0000000, 0xE0000000
LEAST_TRUST, DERIVED_TRUST = 100, 5000


def damped(a: Column, b: Column, factor: float) -> Column:
    """Least trust times a factor, rounded down, 100 at least."""
    return F.greatest(F.floor(F.least(a, b) * factor + 1e-9).cast("int"), F.lit(LEAST_TRUST))


def _best(df: DataFrame) -> DataFrame:
    """Of the ways to derive a claim: greatest trust, then the least node in between. One grouped aggregate."""
    return df.groupBy("subj", "pred", "obj").agg(F.max_by(F.struct("trust", "via"), F.struct("trust", -F.col("via"))).alias("v")).select("subj", "pred", "obj", "v.trust", "v.via")


def transitive(claims: DataFrame, factor: float = 0.8, predicates: tuple[int, ...] = TRANSITIVE) -> DataFrame:
    """Rule 1: a p b, b p c gives a p c."""
    c = claims.where(F.col("pred").isin(*predicates))
    a = c.select("subj", "pred", F.col("obj").alias("via"), F.col("trust").alias("t1"))
    b = c.select(F.col("subj").alias("via"), "pred", "obj", F.col("trust").alias("t2"))
    return _best(a.join(b, ["via", "pred"]).where("subj <> obj").select("subj", "pred", "obj", damped(F.col("t1"), F.col("t2"), factor).alias("trust"), "via"))


def shared_evidence(evidence: DataFrame, trust: DataFrame, factor: float = 0.8) -> DataFrame:
    """Rule 2: nodes a < b with evidence in common give a supports b. ``trust``: (node_num, trust)."""
    e = spread(evidence.join(trust, "node_num"), "evidence")  # a task's pairs are of a piece of bounded size
    a = e.select(F.col("node_num").alias("subj"), "evidence", F.col("trust").alias("t1"))
    b = e.select(F.col("node_num").alias("obj"), "evidence", F.col("trust").alias("t2"))
    pairs = spread(a.join(b, "evidence").where("subj < obj"), "subj", "obj")
    return pairs.groupBy("subj", "obj").agg(F.max(damped(F.col("t1"), F.col("t2"), factor)).alias("trust"), F.count("*").alias("n_shared")).select("subj", F.lit(SUPPORTS).alias("pred"), "obj", "trust", "n_shared")


def contradiction(claims: DataFrame, factor: float = 0.6) -> DataFrame:
    """Rule 3: a contradicts b, b supports c gives a contradicts c."""
    a = claims.where(F.col("pred") == CONTRADICTS).select("subj", F.col("obj").alias("via"), F.col("trust").alias("t1"))
    b = claims.where(F.col("pred") == SUPPORTS).select(F.col("subj").alias("via"), "obj", F.col("trust").alias("t2"))
    return _best(a.join(b, "via").where("subj <> obj").select("subj", F.lit(CONTRADICTS).alias("pred"), "obj", damped(F.col("t1"), F.col("t2"), factor).alias("trust"), "via"))


def second_order(claims: DataFrame, factor: float = 0.64, predicates: tuple[int, ...] = TRANSITIVE) -> DataFrame:
    """Rule 4: rule 1 once more, where at least one of the two claims is itself derived (at a trust of 5000)."""
    direct = claims.where(F.col("pred").isin(*predicates)).select("subj", "pred", "obj", "trust", F.lit(0).alias("derived"))
    first = transitive(claims, predicates=predicates).select("subj", "pred", "obj", F.lit(DERIVED_TRUST).alias("trust"), F.lit(1).alias("derived"))
    every = direct.unionByName(first)
    a = every.select("subj", "pred", F.col("obj").alias("via"), F.col("trust").alias("t1"), F.col("derived").alias("d1"))
    b = every.select(F.col("subj").alias("via"), "pred", "obj", F.col("trust").alias("t2"), F.col("derived").alias("d2"))
    new = a.join(b, ["via", "pred"]).where("subj <> obj and d1 + d2 > 0").select("subj", "pred", "obj", damped(F.col("t1"), F.col("t2"), factor).alias("trust"), "via")
    return _best(new.join(first.select("subj", "pred", "obj"), ["subj", "pred", "obj"], "left_anti"))


def probe_conflicts(new: DataFrame, active: DataFrame) -> DataFrame:
    """New claims whose slot (subj, pred) is taken, but by no claim with the same object."""
    slots = active.select("subj", "pred").distinct()
    return new.join(slots, ["subj", "pred"], "left_semi").join(active.select("subj", "pred", "obj").distinct(), ["subj", "pred", "obj"], "left_anti")


def conflict_sets(active: DataFrame) -> DataFrame:
    """(subj, pred, n_objects, objects) of the slots with several objects."""
    return active.groupBy("subj", "pred").agg(F.array_sort(F.collect_set("obj")).alias("objects")).where(F.size("objects") > 1).select("subj", "pred", F.size("objects").alias("n_objects"), "objects")


def meets_gaps(claims: DataFrame, gaps: list[dict[str, Any]]) -> DataFrame:
    """(gap_id, subj, pred, obj): claims that fit an open gap's pattern. Gaps are few: one filter each, over one scan."""
    hit = F.array(*[F.when(P.claim_matches(g.get("subj"), g.get("pred"), g.get("obj")), F.lit(g["id"])) for g in gaps])
    return claims.select("subj", "pred", "obj", F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("gap_id"))


def resolve_deferred(pending: DataFrame, created: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending edges (src, target, edge_type) whose target now exists (target, node_num), and those still pending."""
    done = pending.join(created, "target").select("src", F.col("node_num").alias("dst"), "edge_type")
    return done, pending.join(created, "target", "left_anti")


def retained(pending: DataFrame, cycle: int, most: int) -> DataFrame:
    """Pending edges no more than ``most`` cycles old."""
    return pending.where(F.lit(cycle) - F.col("created_cycle") <= most)
