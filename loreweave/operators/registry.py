"""Sources, predicates, entities and their lineage, as append-only tables with a latest-wins view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, once


def latest(table: DataFrame, key: str, order: str = "at") -> DataFrame:
    """The last version of each row of an append-only table; one grouped aggregate."""
    rest = [c for c in table.columns if c != key]
    return table.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, "v.*")


def find_by(table: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns have the wanted values (one, or any of a list): evidence by kind or source, metadata by kind."""
    for name, value in wanted.items():
        table = table.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return table


def metadata_fields(atoms: DataFrame, key: str, *fields: str) -> DataFrame:
    """(key, kind, value): metadata columns as one row each; nulls have none."""
    return atoms.select(key, *[F.col(f).cast("bigint").alias(f) for f in fields]).unpivot(key, list(fields), "kind", "value").where("value is not null")


def add_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities with aliases (entity_id, alias) added, each once, sorted."""
    new = aliases.groupBy("entity_id").agg(F.collect_set("alias").alias("__new"))
    return entities.join(new, "entity_id", "left").withColumn("aliases", F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("__new", F.array().cast("array<string>"))))).drop("__new")


def split_entities(entities: DataFrame, splits: DataFrame) -> DataFrame:
    """New entities (entity_id, canonical_name, entity_type, aliases, split_from) for splits (source_id, entity_id, canonical_name, entity_type) of known ones."""
    known = entities.select(F.col("entity_id").alias("source_id"))
    s = splits.join(known, "source_id", "left_semi")
    return s.select("entity_id", "canonical_name", "entity_type", F.array().cast("array<string>").alias("aliases"), F.col("source_id").alias("split_from"))


def resolve(table: DataFrame, name: str, *columns: str) -> DataFrame:
    """Rows that any of the columns names, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | (F.lower(c) == name.lower())
    return table.where(hit)


def provenance(edges: DataFrame, start: DataFrame, depth: int = 4) -> DataFrame:
    """(node, origin, depth): what each node (node) derives from, step by step along DERIVED_FROM edges; least depth of each pair.

    A pair is followed once, so cycles end; each level is written once.
    """
    e = edges.where("edge_type = 'DERIVED_FROM'").select(F.col("src").alias("at"), F.col("dst").alias("next"))
    e = once(e) if depth > 1 else e
    level = start.select("node", F.col("node").alias("at"))
    out = None
    for d in range(1, depth + 1):
        one = level.join(e, "at").select("node", F.col("next").alias("origin")).distinct()
        if out is not None:
            one = one.join(out, ["node", "origin"], "left_anti")
        one = cut(one.withColumn("depth", F.lit(d)))
        out = one if out is None else out.unionByName(one)
        if one.isEmpty():
            break
        level = one.select("node", F.col("origin").alias("at"))
    return out


def provenance_chain(edges: DataFrame, start: DataFrame, claims: DataFrame, atoms: DataFrame, depth: int = 4) -> DataFrame:
    """(node, origin, depth, trust, evidence) of what nodes (node, trust) derive from, themselves at depth 0.

    Trust is that of the best path of least steps: the least of its edges' confidences and of the trust of the atoms on
    it; evidence are the origin's claims.
    """
    e = edges.where("edge_type = 'DERIVED_FROM'").join(atoms.groupBy(F.col("node_num").alias("dst")).agg(F.max("trust").alias("own")), "dst", "left")
    e = once(e.select(F.col("src").alias("at"), F.col("dst").alias("next"), F.least("confidence", F.coalesce("own", F.col("confidence"))).alias("step")))
    level = start.select("node", F.col("node").alias("origin"), F.lit(0).alias("depth"), "trust")
    out = level
    for d in range(1, depth + 1):
        step = level.withColumnRenamed("origin", "at").join(e, "at").groupBy("node", F.col("next").alias("origin")).agg(F.max(F.least("trust", "step")).alias("trust"))
        level = cut(step.join(out, ["node", "origin"], "left_anti").select("node", "origin", F.lit(d).alias("depth"), "trust"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    told = claims.groupBy(F.col("subj").alias("origin")).agg(F.array_sort(F.collect_set(F.struct("pred", "obj"))).alias("evidence"))
    return out.join(told, "origin", "left").select("node", "origin", "depth", "trust", F.coalesce("evidence", F.array().cast("array<struct<pred:bigint,obj:bigint>>")).alias("evidence"))


def conflict_status(sets: DataFrame, policy: str = "branch") -> Column:
    """Status of a conflict set (n_objects) by policy: branch keeps all, reject blocks, prefer_trusted resolves a pair."""
    match policy:
        case "branch":
            return F.lit("branched")
        case "reject":
            return F.lit("blocked")
        case "prefer_trusted":
            return F.when(sets["n_objects"] == 2, "resolved").otherwise("open")
    raise ValueError(f"unknown policy {policy}")
