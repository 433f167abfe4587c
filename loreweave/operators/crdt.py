"""Replicated states as grouped aggregates over the log (key, actor, phys, logical, ...).

Every merge is associative, commutative and idempotent: a state is a table, merging is union and
aggregation, and log order doesn't matter. The clock is (phys, logical); actors break its ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clock(*more: str) -> Column:
    return F.struct("phys", "logical", *more)


def gcounter_state(log: DataFrame, count: Column | None = None) -> DataFrame:
    """(key, actor, count): each actor's greatest count; without counts, its operations are counted."""
    return log.groupBy("key", "actor").agg((F.count("*") if count is None else F.max(count)).alias("count"))


def gcounter_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("key", "actor").agg(F.max("count").alias("count"))


def gcounter_value(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.sum("count").alias("value"))


def pncounter_state(log: DataFrame, plus: Column, minus: Column) -> DataFrame:
    """(key, actor, p, n)."""
    return log.groupBy("key", "actor").agg(F.count(F.when(plus, 1)).alias("p"), F.count(F.when(minus, 1)).alias("n"))


def pncounter_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("key", "actor").agg(F.max("p").alias("p"), F.max("n").alias("n"))


def pncounter_value(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg((F.sum("p") - F.sum("n")).alias("value"))


def lww(log: DataFrame, *values: str) -> DataFrame:
    """The values written last: (key, phys, logical, actor, values)."""
    return log.groupBy("key").agg(F.max_by(F.struct("phys", "logical", "actor", *values), clock("actor")).alias("v")).select("key", "v.*")


def orset(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """(key, element): elements with an add that no later removal has seen.

    A removal takes away the element's adds with a lesser clock: the last add against the last
    removal decides, so one grouped aggregate replaces the anti-join of dots.
    """
    both = adds.select("key", "element", clock("actor").alias("at"), F.lit(1).alias("is_add")).unionByName(removes.select("key", "element", clock("actor").alias("at"), F.lit(0).alias("is_add")))
    last = both.groupBy("key", "element").agg(F.max(F.when(F.col("is_add") == 1, F.col("at"))).alias("a"), F.max(F.when(F.col("is_add") == 0, F.col("at"))).alias("r"))
    return last.where("a is not null and (r is null or r < a)").select("key", "element")


def orset_dots(adds: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The same from explicit dots (key, element, actor, counter): those not in the tombstones."""
    return adds.join(tombstones, ["key", "element", "actor", "counter"], "left_anti").select("key", "element").distinct()


def ormap(log: DataFrame, field: str, value: str, removed: Column) -> DataFrame:
    """(key, field, value): last write of each map key, removals being writes too, so replicas converge."""
    last = log.withColumn("gone", removed).groupBy("key", field).agg(F.max_by(F.struct(value, "gone"), clock("actor")).alias("v"))
    return last.where("not v.gone").select("key", field, F.col(f"v.{value}").alias(value))


def mvreg(log: DataFrame, value: str, context: Column | None = None) -> DataFrame:
    """(key, actor, value): values that no other write dominates.

    A write dominates what its actor wrote before; and, with ``context`` (phys of the newest write it
    has seen), all writes up to there.
    """
    own = log if context is None else log.withColumn("seen", context)
    more = [] if context is None else ["seen"]
    last = own.groupBy("key", "actor").agg(F.max_by(F.struct("phys", "logical", value, *more), clock()).alias("v")).select("key", "actor", "v.*")
    if context is None:
        return last.select("key", "actor", value)
    horizon = last.groupBy("key").agg(F.max("seen").alias("h"))
    return last.join(horizon, "key").where("phys > h or h is null").select("key", "actor", value)


def flagset(log: DataFrame, bits: Column) -> DataFrame:
    """(key, flags): the mask written last."""
    return log.withColumn("flags", bits).groupBy("key").agg(F.max_by("flags", clock("actor")).alias("flags"))


def merge_stores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Outer union of two stores of last-writer fields (key, field, kind, phys, logical, actor, value).

    Of states of different kinds the one written last stays, whole.
    """
    both = a.unionByName(b)
    cols = [c for c in both.columns if c not in ("key", "field")]
    return both.groupBy("key", "field").agg(F.max_by(F.struct(*cols), clock("actor")).alias("v")).select("key", "field", "v.*")


#: Kinds of replicated states: what tells their parts apart.
COUNTERS, BY_ACTOR, BY_ELEMENT, WHOLE = ("gcounter", "pncounter"), ("mvreg",), ("orset", "ormap"), ("lww", "flagset")


def kind_state(log: DataFrame) -> DataFrame:
    """A log (key, field, kind, actor, element, phys, logical, number, removed) as states of its kinds: counters count their operations."""
    count = F.col("kind").isin(*COUNTERS)
    counted = log.where(count).groupBy("key", "field", "kind", "actor").agg(F.max("element").alias("element"), F.max("phys").alias("phys"), F.max("logical").alias("logical"), F.count("*").alias("number"), F.lit(False).alias("removed"))
    return _by_kind(log.where(~count)).unionByName(counted)


def _by_kind(states: DataFrame) -> DataFrame:
    slot = F.when(F.col("kind").isin(*COUNTERS, *BY_ACTOR), F.col("actor")).when(F.col("kind").isin(*BY_ELEMENT), F.col("element"))
    cols = ["actor", "element", "phys", "logical", "number", "removed"]
    newest = F.max_by(F.struct(*cols), clock(*["actor"]))
    g = states.withColumn("slot", slot).groupBy("key", "field", "kind", "slot").agg(newest.alias("v"), F.max("number").alias("most"))
    return g.select("key", "field", "kind", "v.actor", "v.element", "v.phys", "v.logical", F.when(F.col("kind").isin(*COUNTERS), F.col("most")).otherwise(F.col("v.number")).alias("number"), "v.removed")


def merge_by_kind(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two stores merged, each field by its kind, in one grouped aggregate: counters by the greatest count of an actor,
    registers with several values by their actors, sets and maps by their elements, others by the last write.
    """
    return _by_kind(a.unionByName(b))


def kind_view(states: DataFrame) -> DataFrame:
    """(key, field, kind, slot, number): counters summed, removed elements left out; slot is the actor or element of the others."""
    count = F.col("kind").isin(*COUNTERS)
    slot = F.when(F.col("kind").isin(*BY_ACTOR), F.col("actor")).when(F.col("kind").isin(*BY_ELEMENT), F.col("element"))
    return states.where("not removed").groupBy("key", "field", "kind", F.when(~count, slot).alias("slot")).agg(F.sum("number").alias("number"))


def compact(log: DataFrame, snapshot: DataFrame | None, *values: str) -> DataFrame:
    """Log and snapshot replayed into a new snapshot."""
    new = lww(log, *values)
    return new if snapshot is None else lww(new.unionByName(snapshot), *values)


def should_compact(n_files: int, snapshot_bytes: int, log_bytes: int) -> bool:
    return snapshot_bytes == 0 or n_files > 8 or log_bytes > 0.25 * snapshot_bytes


def validate_log(log: DataFrame) -> DataFrame:
    """(n_valid, n_bad, first_bad): by the stored crc32 of each payload; first_bad is the offset where trust ends."""
    bad = ~F.crc32("payload").eqNullSafe(F.col("stored_crc"))
    return log.agg(F.count(F.when(~bad, 1)).alias("n_valid"), F.count(F.when(bad, 1)).alias("n_bad"), F.min(F.when(bad, F.col("offset"))).alias("first_bad"))


def recover_tail(log: DataFrame) -> DataFrame:
    """The longest valid prefix."""
    bad = log.where(~F.crc32("payload").eqNullSafe(F.col("stored_crc"))).agg(F.min("offset").alias("first_bad"))
    return log.crossJoin(bad).where("first_bad is null or offset < first_bad").drop("first_bad")


def valid_records(log: DataFrame) -> DataFrame:
    return log.where(F.crc32("payload").eqNullSafe(F.col("stored_crc")))
