"""Storage lifecycle over append-only tables: current views, compaction, audits, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def current(atoms: DataFrame, superseded: DataFrame, tombstones: DataFrame, key: str = "doc_id") -> DataFrame:
    """Atoms that nothing supersedes and no tombstone removes. One anti-join against both."""
    gone = superseded.select(F.col("old_id").alias(key)).unionByName(tombstones.select(key))
    return atoms.join(gone, key, "left_anti")


def compact_latest(records: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the records of one key the last by ``order``; one grouped aggregate."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(key, "v.*")


def collect_garbage(records: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Records whose key lives and that aren't deleted."""
    return records.where("not deleted").join(live.select(key), key, "left_semi")


def append_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append so that repeating the append changes nothing."""
    return rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def history_top(history: DataFrame, n: int = 20) -> DataFrame:
    return history.orderBy(F.desc("at"), F.desc("id")).limit(n)


def canonical_form(*columns: str) -> Column:
    """Deterministic JSON of sorted columns; lists should be sorted before."""
    return F.to_json(F.struct(*sorted(columns)))


def content_id(*columns: str) -> Column:
    return F.sha2(canonical_form(*columns), 256)


def integrity(records: DataFrame) -> DataFrame:
    """(record_id, errors) of stored records (record_id, body, stored_id, stored_crc, length): what doesn't hold."""
    errors = F.array_compact(F.array(
        F.when(F.col("body").isNull(), F.lit("missing body")),
        F.when(F.octet_length("body") != F.col("length"), F.lit("length")),
        F.when(F.crc32("body") != F.col("stored_crc"), F.lit("crc")),
        F.when(F.sha2("body", 256) != F.col("stored_id"), F.lit("identity")),
    ))
    return records.select("record_id", errors.alias("errors"))


def audit_relations(journal: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, finding): in the journal but not projected, or projected without a journal entry."""
    j = journal.select(*keys).distinct().withColumn("in_journal", F.lit(True))
    a = active.select(*keys).distinct().withColumn("in_context", F.lit(True))
    both = j.join(a, keys, "full")
    return both.where("in_journal is null or in_context is null").select(*keys, F.when(F.col("in_context").isNull(), "missing").otherwise("orphan").alias("finding"))


def repair_relations(findings: DataFrame, keys: list[str]) -> DataFrame:
    """What to append: a missing relation is asserted, an orphan gets a tombstone."""
    return findings.select(*keys, F.when(F.col("finding") == "missing", "assert").otherwise("tombstone").alias("action"))


def transition(relations: DataFrame, changes: DataFrame) -> DataFrame:
    """Many-to-one change: current rows (subject, predicate, object, valid_from, valid_to) of changed slots are closed, new ones opened.

    ``changes``: (subject, predicate, new_object, at). A change to the object already held does nothing.
    """
    c = changes.select("subject", "predicate", "new_object", "at")
    joined = relations.join(c, ["subject", "predicate"], "left")
    moves = F.col("new_object").isNotNull() & F.col("valid_to").isNull() & (F.col("object") != F.col("new_object"))
    kept = joined.select("subject", "predicate", "object", "valid_from", F.when(moves, F.col("at")).otherwise(F.col("valid_to")).alias("valid_to"))
    opened = joined.where(moves).select("subject", "predicate", F.col("new_object").alias("object"), F.col("at").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"))
    return kept.unionByName(opened)


def merge_ends(merges: DataFrame) -> DataFrame:
    """(source_id, target_id) with every target followed to its end, in as many rounds as the chains' length has bits; a cycle ends where the rounds do."""
    now = cut(merges.select("source_id", "target_id"))
    for _ in range(32):
        on = now.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("next"))
        step = cut(now.join(on, "target_id", "left").select("source_id", F.coalesce("next", "target_id").alias("target_id"), (F.col("next") != F.col("target_id")).alias("moved")))
        now = step.select("source_id", "target_id")
        if step.where("moved").isEmpty():
            break
    return now


def merge_entities(refs: DataFrame, merges: DataFrame, column: str = "entity_id") -> DataFrame:
    """References to merged entities (source_id -> target_id, through as many merges as there are) rewritten, with where they came from."""
    m = merge_ends(merges).select(F.col("source_id").alias(column), "target_id")
    return refs.join(m, column, "left").withColumn("merged_from", F.when(F.col("target_id").isNotNull(), F.col(column))).withColumn(column, F.coalesce("target_id", F.col(column))).drop("target_id")
