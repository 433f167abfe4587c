"""One knowledge base as a folder of append-only Parquet tables, with a method for each tool of the public API.

Writes append rows, each operation in one atomic commit with its history; reads are latest-wins views. Bulk
input comes as DataFrames (``ingest_frame``), interactive input as dicts. Ids are content hashes, so
repeating a write changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, is_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, inference, lifecycle, registry
from .operators import retrieval as R
from .plans.compiler import compile_contract, normalize_query
from .plans.contract import Contract, ContractError, from_dict
from .plans.solver import AnswerPack, Solver
from .sources import exchange
from .sources.shared import cut
from .store import Store

TABLES = {
    "atoms": "atom_id string, node_num bigint, atom_type string, trust int, domain_mask bigint, source_id bigint, created_at bigint, valid_from bigint, valid_to bigint, io_bytes bigint, payload string",
    "claims": "atom_id string, subj bigint, pred bigint, obj bigint, trust int, ctx bigint",
    "postings": "term string, node_num bigint",
    "edges": "src bigint, dst bigint, edge_type string, confidence int, deleted boolean, at bigint",
    "vectors": "node_num bigint, embedding array<float>, trust int",
    "supersedes": "new_id string, old_id string",
    "tombstones": "atom_id string, reason string",
    "sources": "source_id bigint, kind string, label string, at bigint",
    "atom_sources": "atom_id string, source_id bigint",
    "predicates": "predicate_id bigint, stable_key string, canonical_name string, description string, cardinality string, direction string, at bigint",
    "entities": "entity_id bigint, canonical_name string, entity_type string, aliases array<string>, merged_into bigint, split_from bigint, at bigint",
    "relations": "relation_id bigint, subject bigint, predicate bigint, object bigint, ctx bigint, active boolean, supersedes bigint, at bigint",
    "contexts": "ctx_id bigint, parent_ctx bigint, reason string, at bigint",
    "history": "id string, action string, at bigint",
    "claim_tombstones": "subj bigint, pred bigint, obj bigint, reason string, at bigint",
}
MANAGED = 0x80000000


def _number(*parts: Any) -> int:
    """A stable positive number of 60 bits."""
    return int(hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:15], 16)


def _sorted(df: DataFrame, *columns: str) -> DataFrame:
    """By ranges of the columns that its lookups name: a read of few keys skips the files and row groups of others."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


class Bases:
    """Bases by name, one of them active."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known, self.current = spark, {}, None

    def connect_base(self, name: str, path: str) -> Engine:
        self.known[name] = Engine(self.spark, path)
        self.current = self.current or name
        return self.known[name]

    def list_bases(self) -> list[str]:
        return sorted(self.known)

    def active_base(self) -> str | None:
        return self.current

    def switch_base(self, base_ref: str) -> Engine:
        self.current = base_ref if base_ref in self.known else self._unknown(base_ref)
        return self.known[base_ref]

    def query_base(self, base_ref: str, query: str | dict | Contract) -> AnswerPack:
        return (self.known.get(base_ref) or self._unknown(base_ref)).query(query)

    @staticmethod
    def _unknown(name: str):
        raise KeyError(f"unknown base {name}")


class Engine:
    def __init__(self, spark: SparkSession, path: str, fail: Callable[[str], None] = lambda stage: None):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, self.path, TABLES, fail)

    # tables

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def commit(self, rows: dict[str, list[tuple] | DataFrame], *log: tuple[Any, str]) -> int:
        """Rows of several tables and their history, all at once; the time that they are written under."""
        at = time.time_ns()
        history = [(str(ident), action, at) for ident, action in log]
        self.store.commit({**rows, "history": history} if history else rows)
        return at

    def atoms(self) -> DataFrame:
        """Live atoms: neither superseded nor deleted, each once."""
        gone = self.table("supersedes").select(F.col("old_id").alias("atom_id")).unionByName(self.table("tombstones").select("atom_id"))
        return self.table("atoms").dropDuplicates(["atom_id"]).join(gone, "atom_id", "left_anti")

    def claims(self) -> DataFrame:
        live = self.table("claims").distinct().join(self.atoms().select("atom_id"), "atom_id", "left_semi")
        return live.join(self.table("claim_tombstones").select("subj", "pred", "obj").distinct(), ["subj", "pred", "obj"], "left_anti")

    def edges(self) -> DataFrame:
        v = self.table("edges").groupBy("src", "dst", "edge_type").agg(F.max_by(F.struct("confidence", "deleted"), "at").alias("v"))
        return v.where(~F.col("v.deleted")).select("src", "dst", "edge_type", "v.confidence")

    def relations(self) -> DataFrame:
        return registry.latest(self.table("relations"), "relation_id").where("active")

    # writing

    def ingest_frame(self, atoms: DataFrame, log: list[tuple[Any, str]] | None = None, **more: list[tuple]) -> None:
        """Bulk: atoms (payload, atom_type, claims, optional columns of TABLES), new ones appended with claims and postings, ``log`` and rows of ``more`` tables in one commit."""
        have = atoms.columns
        given = lambda c, kind, other: (F.col(c) if c in have else F.lit(other)).cast(kind).alias(c)
        claims = F.col("claims") if "claims" in have else F.array().cast("array<struct<subj:bigint,pred:bigint,obj:bigint>>")
        made = F.sha2(F.to_json(F.struct("atom_type", F.array_sort(claims).alias("claims"), "payload")), 256)
        a = atoms.withColumn("atom_id", made).withColumn("claims", claims).dropDuplicates(["atom_id"]).join(self.table("atoms").select("atom_id"), "atom_id", "left_anti")
        at = int(time.time())
        full = a.select("atom_id", F.conv(F.substring("atom_id", 1, 15), 16, 10).cast("bigint").alias("node_num"), "atom_type", given("trust", "int", 5000), given("domain_mask", "bigint", 0), given("source_id", "bigint", None), given("created_at", "bigint", at), given("valid_from", "bigint", at), given("valid_to", "bigint", None), F.greatest(F.octet_length(F.coalesce("payload", F.lit(""))), F.lit(64)).cast("bigint").alias("io_bytes"), "payload", "claims", given("ctx", "bigint", 0))
        full = cut(full)  # what is new is told once, before anything is appended
        claims = full.select("atom_id", F.explode("claims").alias("c"), "trust", "ctx").select("atom_id", "c.subj", F.col("c.pred").cast("bigint").alias("pred"), "c.obj", "trust", "ctx")
        self.commit({"claims": claims, "postings": R.index_text(full, F.col("node_num"), "payload"), "atoms": full.drop("claims", "ctx"), **more}, *(log or []))

    def ingest(self, payload: str, atom_type: str, claims: list[tuple[int, int, int]], **more: Any) -> str:
        return self.batch_ingest([{"payload": payload, "atom_type": atom_type, "claims": claims, **more}])[0]

    @staticmethod
    def _ids(df: DataFrame) -> list[str]:
        made = F.sha2(F.to_json(F.struct("atom_type", F.array_sort("claims").alias("claims"), "payload")), 256)
        return [r[0] for r in df.orderBy("n").select(made).collect()]

    def batch_ingest(self, atoms: list[dict[str, Any]], replaces: str | None = None) -> list[str]:
        """Ids in order. An atom needs a claim. ``replaces``: the atom that the first one supersedes."""
        if any(not a["claims"] for a in atoms):
            raise ValueError("an atom without claims")
        names = ("trust", "domain_mask", "source_id", "created_at", "valid_from", "valid_to", "ctx")
        rows = [(i, a["payload"], a["atom_type"].upper(), [tuple(c) for c in a["claims"]], *[a.get(n) for n in names]) for i, a in enumerate(atoms)]
        df = self.spark.createDataFrame(rows, "n int, payload string, atom_type string, claims array<struct<subj:bigint,pred:bigint,obj:bigint>>, " + ", ".join(f"{n} bigint" for n in names))
        ids = self._ids(df)
        log, more = [(i, "ingest") for i in ids], {}
        if replaces is not None and ids[0] != replaces:
            log.append((replaces, "supersede"))
            more["supersedes"] = [(ids[0], replaces)]
        now = int(time.time())
        filled = {"trust": F.coalesce("trust", F.lit(5000)), "domain_mask": F.coalesce("domain_mask", F.lit(0)), "created_at": F.coalesce("created_at", F.lit(now)), "valid_from": F.coalesce("valid_from", F.lit(now)), "ctx": F.coalesce("ctx", F.lit(0))}
        self.ingest_frame(df.drop("n").withColumns(filled), log, **more)
        return ids

    def ingest_file(self, path: str, fmt: str = "json", atom_type: str | None = None, skip_validation: bool = False) -> tuple[int, DataFrame]:
        """Atoms of the exchange schema from a file or folder: how many were good, and the rejects with their problems. ``atom_type``: of atoms without one."""
        atoms = exchange.read_atoms(self.spark, path, fmt)
        if atom_type is not None:
            atoms = atoms.withColumn("atom_type", F.coalesce("atom_type", F.lit(atom_type.upper())))
        good, bad = exchange.checked(atoms, skip_validation)
        good = cut(good)
        self.ingest_frame(exchange.to_base(good))
        return good.count(), bad

    def export_atoms(self, needle: str | None = None) -> DataFrame:
        """Live atoms in the exchange schema, filtered as an export is."""
        return exchange.export_filter(exchange.from_base(self.atoms(), self.claims()), needle)

    def export_atom(self, atom_id: str) -> DataFrame:
        """One stored atom in the exchange schema; no row if it isn't there."""
        mine = F.col("atom_id") == atom_id
        return exchange.from_base(self.atoms().where(mine), self.claims().where(mine))

    def _known_atom(self, atom_id: str) -> None:
        if self.atoms().where(F.col("atom_id") == atom_id).isEmpty():
            raise KeyError(f"no atom {atom_id}")

    def update_atom(self, atom_id: str, payload: str, atom_type: str, claims: list[tuple[int, int, int]], **more: Any) -> str:
        self._known_atom(atom_id)
        return self.batch_ingest([{"payload": payload, "atom_type": atom_type, "claims": claims, **more}], replaces=atom_id)[0]

    supersede_claim = correct_claim = update_atom

    def delete_atom(self, atom_id: str, reason: str = "") -> None:
        self._known_atom(atom_id)
        self.commit({"tombstones": [(atom_id, reason)]}, (atom_id, "delete"))

    def add_edge(self, src: int, dst: int, edge_type: str, confidence: int = 10000, deleted: bool = False) -> None:
        self.commit({"edges": [(src, dst, edge_type, confidence, deleted, time.time_ns())]})

    def delete_edge(self, src: int, dst: int, edge_type: str) -> None:
        self.add_edge(src, dst, edge_type, 0, True)

    def add_vectors(self, vectors: DataFrame) -> None:
        self.commit({"vectors": vectors})

    # asking

    def compile_query_contract(self, query_text: str) -> Contract:
        return compile_contract(query_text)

    def validate_query_contract(self, contract: dict | Contract) -> str | None:
        """What is wrong with it, or None."""
        try:
            (contract if isinstance(contract, Contract) else from_dict(contract)).validate()
        except ContractError as e:
            return str(e)
        return None

    def query(self, query: str | dict | Contract, ctx: int | None = None) -> AnswerPack:
        """The answer, in the context given, the contract's, or the root."""
        c = compile_contract(query) if isinstance(query, str) else query if isinstance(query, Contract) else from_dict(query)
        terms = normalize_query(" ".join(t.label or "" for t in c.targets if t.entity_type is None)).split()
        solver = Solver(self._in_branches(), self.table("postings"), self.edges(), self.claims(), self.table("vectors"))
        return solver.solve_with_ctx(c, sorted(set(terms)), c.context.active or 0 if ctx is None else ctx)

    def _in_branches(self) -> DataFrame:
        """Live atoms with the context of their claims, where that isn't the root."""
        branch = self.table("claims").groupBy("atom_id").agg(F.max(F.nullif("ctx", F.lit(0))).alias("branch"))
        return self.atoms().join(branch, "atom_id", "left")

    def explain_answer_graph(self, query: str | dict | Contract, max_bytes: int = 65536) -> str:
        """The answer as JSON, with a line for why each atom is in it; beyond ``max_bytes`` a partial summary."""
        pack = self.query(query)
        kinds = {g["id"]: g["kind"] for g in pack.gaps}
        lines = [f"{n['atom_id']} meets {', '.join(kinds[g] for g in n['gaps'])}, found by {n['backend']}" for n in pack.nodes]
        lines += [f"{kinds[g['id']]} is open" for g in pack.gaps if not g["covered"]] + [f"{r['atom_id']} is left out: {r['rejected_by']}" for r in pack.rejected]
        text = json.dumps(asdict(pack) | {"explanation": lines}, sort_keys=True, default=lambda x: asdict(x) if is_dataclass(x) else str(x))
        if len(text.encode()) > max_bytes:
            text = json.dumps({"status": "partial", "intent": pack.intent, "n_nodes": len(pack.nodes), "n_edges": len(pack.edges), "coverage": pack.coverage})
        return text

    def get_provenance_path(self, atom_id: str, depth: int = 4) -> DataFrame:
        """(node, origin, depth, trust, evidence): what the atom's node derives from, with the trust of the path and the origin's claims.

        At depth 0 the atom itself, with its own trust and claims; overall trust is the least of all rows.
        """
        own = self.atoms().where(F.col("atom_id") == atom_id).select(F.col("node_num").alias("node"), "trust").distinct()
        return registry.provenance_chain(self.edges(), own, self.claims(), self.atoms(), depth)

    def search_lex(self, term: str, trust_min: int = 0, domain_mask: int = 0, types: list[str] | None = None) -> DataFrame:
        from .functions import predicates as P

        hit = self.atoms().join(R.lexical_term(self.table("postings"), term.lower()), "node_num", "left_semi").where(P.trust_at_least(F.col("trust"), trust_min) & P.matches_domain(F.col("domain_mask"), domain_mask))
        return hit.where(P.type_in(F.col("atom_type"), types)) if types else hit

    def search_graph(self, src: int | None = None, edge_type: str | None = None, dst: int | None = None, limit: int = 50) -> DataFrame:
        return graph.match_pattern(self.edges(), src, edge_type, dst, limit)

    def search_semantic(self, vector: list[float], k: int = 10) -> DataFrame:
        return R.semantic_top(self.table("vectors"), self.spark.createDataFrame([(0, vector)], "query_id int, query array<float>"), k)

    def graph_neighbors(self, node_num: int, types: list[str] | None = None) -> DataFrame:
        return graph.neighbors(self.edges(), node_num, types).orderBy("edge_type", "node")

    def graph_walk(self, seeds: list[int], types: list[str] | None = None, depth: int = 2) -> DataFrame:
        return graph.walk_edges(self.edges(), self.spark.createDataFrame([(n,) for n in seeds], "node bigint"), depth, types)

    def extract_subgraph(self, center_node: int, depth: int = 2) -> DataFrame:
        return graph.subgraph_nodes(self.edges(), center_node, depth).orderBy("node")

    # registries

    def register_source(self, kind: str, label: str) -> int:
        ident = _number("source", kind, label)
        self.commit({"sources": [(ident, kind, label, time.time_ns())]})
        return ident

    def list_sources(self) -> DataFrame:
        return registry.latest(self.table("sources"), "source_id")

    def attach_atom_source(self, atom_id: str, source_id: int) -> None:
        self.commit({"atom_sources": [(atom_id, source_id)]})

    def atom_sources(self) -> DataFrame:
        return self.table("atom_sources").distinct()

    def register_predicate(self, stable_key: str, canonical_name: str, description: str, cardinality: str = "many", direction: str = "directed") -> int:
        """The id that the stable key already has, or a managed one that no other has. ``cardinality``: one or many objects of a subject."""
        if cardinality not in ("one", "many") or direction not in ("directed", "symmetric"):
            raise ValueError("cardinality is one or many, direction directed or symmetric")
        taken = {r["predicate_id"]: r["stable_key"] for r in self.list_predicates().select("predicate_id", "stable_key").collect()}
        ident = next((i for i, k in taken.items() if k == stable_key), None)
        if ident is None:
            ident = MANAGED + _number("predicate", stable_key) % MANAGED
            while ident in taken:
                ident = MANAGED + (ident + 1) % MANAGED
        self.commit({"predicates": [(ident, stable_key, canonical_name, description, cardinality, direction, time.time_ns())]})
        return ident

    def list_predicates(self) -> DataFrame:
        return registry.latest(self.table("predicates"), "predicate_id")

    def get_predicate(self, predicate_id: int) -> DataFrame:
        return self.list_predicates().where(F.col("predicate_id") == predicate_id)

    def resolve_predicate(self, name_or_key: str) -> DataFrame:
        return registry.resolve(self.list_predicates(), name_or_key, "stable_key", "canonical_name")

    def _entity(self, ident: int, **changes: Any) -> int:
        row = self.list_entities(merged=True).where(F.col("entity_id") == ident).first()
        if row is None:
            raise KeyError(f"unknown entity {ident}")
        r = row.asDict() | changes
        self.commit({"entities": [(ident, r["canonical_name"], r["entity_type"], sorted(set(r["aliases"])), r["merged_into"], r["split_from"], time.time_ns())]}, (ident, "entity"))
        return ident

    def create_entity(self, canonical_name: str, entity_type: str, aliases: list[str] | None = None, split_from: int | None = None) -> int:
        ident = _number("entity", canonical_name, entity_type, split_from)
        self.commit({"entities": [(ident, canonical_name, entity_type, sorted(set(aliases or [])), None, split_from, time.time_ns())]}, (ident, "create_entity"))
        return ident

    def list_entities(self, merged: bool = False) -> DataFrame:
        e = registry.latest(self.table("entities"), "entity_id")
        return e if merged else e.where("merged_into is null")

    def alias_entity(self, entity_id: int, alias: str) -> int:
        row = self.list_entities(merged=True).where(F.col("entity_id") == entity_id).first()
        return self._entity(entity_id, aliases=[*(row["aliases"] if row else []), alias])

    def merge_entities(self, target_entity: int, source_entity: int) -> int:
        """References to the source lead to the target's end: a target that is itself merged stands for what it was merged into."""
        merged = {r["entity_id"]: r["merged_into"] for r in self.list_entities(merged=True).select("entity_id", "merged_into").collect()}
        end = target_entity
        while merged.get(end) is not None:
            end = merged[end]
        if end not in merged:
            raise KeyError(f"unknown entity {target_entity}")
        if end == source_entity:
            raise ValueError("an entity can't be merged into itself")
        self._entity(source_entity, merged_into=end)
        return end

    def split_entity(self, source_entity: int, canonical_name: str, entity_type: str) -> int:
        if self.list_entities(merged=True).where(F.col("entity_id") == source_entity).isEmpty():
            raise KeyError(f"unknown entity {source_entity}")
        return self.create_entity(canonical_name, entity_type, split_from=source_entity)

    def add_claim(self, entity_id: int, predicate: int, object_: int) -> str:
        return self.ingest(f"{entity_id} {predicate} {object_}", "FACT", [(entity_id, predicate, object_)])

    # relations

    def assert_relation(self, subject: int, predicate: int, object_: int, ctx: int = 0, supersedes: int | None = None) -> int:
        ident = _number("relation", subject, predicate, object_, ctx)
        self.commit({"relations": [(ident, subject, predicate, object_, ctx, True, supersedes, time.time_ns())]}, (ident, "assert"))
        return ident

    def _current_relation(self, relation_id: int) -> Any:
        row = self.relations().where(F.col("relation_id") == relation_id).first()
        if row is None:
            raise KeyError(f"no current relation {relation_id}")
        return row

    def _replace(self, old: Any, subject: int, predicate: int, object_: int, action: str) -> int:
        """Closes a relation and asserts another in its place, in one commit."""
        ident, at = _number("relation", subject, predicate, object_, old["ctx"]), time.time_ns()
        closed = (old["relation_id"], old["subject"], old["predicate"], old["object"], old["ctx"], False, old["supersedes"], at)
        self.commit({"relations": [closed, (ident, subject, predicate, object_, old["ctx"], True, old["relation_id"], at + 1)]}, (old["relation_id"], action), (ident, "assert"))
        return ident

    def correct_relation(self, relation_id: int, subject: int, predicate: int, object_: int) -> int:
        return self._replace(self._current_relation(relation_id), subject, predicate, object_, "correct")

    def transition_relation(self, old_relation_id: int, new_object: int) -> int:
        """The subject's new object; of a predicate that is registered for several objects there is no such change."""
        old = self._current_relation(old_relation_id)
        kind = self.get_predicate(old["predicate"]).first()
        if kind is not None and kind["cardinality"] == "many" and self.relations().where((F.col("subject") == old["subject"]) & (F.col("predicate") == old["predicate"])).count() > 1:
            raise ValueError(f"predicate {old['predicate']} has several objects of {old['subject']}")
        return self._replace(old, old["subject"], old["predicate"], new_object, "transition")

    def audit_relation_contexts(self) -> DataFrame:
        """Relations without a claim, and claims of the journal's predicates without a relation."""
        keys = ["subj", "pred", "obj"]
        journal = self.relations().select(F.col("subject").alias("subj"), F.col("predicate").alias("pred"), F.col("object").alias("obj"))
        own = self.table("relations").select(F.col("predicate").alias("pred")).distinct()
        return lifecycle.audit_relations(journal, self.claims().join(own, "pred", "left_semi"), keys)

    def repair_relation_contexts(self, dry_run: bool = True, reason: str = "orphan") -> DataFrame:
        """What has to be appended: missing claims, and tombstones of orphans; appended in one commit, unless it is a dry run."""
        fix = lifecycle.repair_relations(self.audit_relation_contexts(), ["subj", "pred", "obj"])
        if dry_run:
            return fix
        fix, at = cut(fix), time.time_ns()
        add, gone = fix.where("action = 'assert'"), fix.where("action = 'tombstone'")
        dead = gone.select("subj", F.col("pred").cast("bigint").alias("pred"), "obj", F.lit(reason).alias("reason"), F.lit(at).alias("at"))
        self.ingest_frame(add.select(F.concat_ws(" ", "subj", "pred", "obj").alias("payload"), F.lit("FACT").alias("atom_type"), F.array(F.struct("subj", "pred", "obj")).alias("claims")), [("relations", "repair")], claim_tombstones=dead)
        return fix

    # contexts

    def create_context(self, parent_ctx: int | None = None, reason: str = "") -> int:
        ident = _number("context", parent_ctx, reason, self.table("contexts").count())
        self.commit({"contexts": [(ident, parent_ctx, reason, time.time_ns())]}, (ident, "context"))
        return ident

    def branch_context(self, parent_ctx: int, reason: str = "", claims: list[tuple[int, int, int]] | None = None) -> int:
        """A child context with the reason for it; ``claims`` are asserted in it, and seen by answers in it only."""
        if parent_ctx and self.list_contexts().where(F.col("ctx_id") == parent_ctx).isEmpty():
            raise KeyError(f"unknown context {parent_ctx}")
        ctx = self.create_context(parent_ctx, reason)
        if claims:
            self.batch_ingest([{"payload": f"{s} {p} {o} in {ctx}", "atom_type": "HYPOTHESIS", "claims": [(s, p, o)], "ctx": ctx} for s, p, o in claims])
        return ctx

    def branch_conflicts(self, pack: AnswerPack) -> list[int]:
        """A context for each branch that an answer opened, with the claim that made it."""
        return [self.branch_context(b["parent_ctx"], b["reason"], [(b["subj"], b["pred"], b["obj"])]) for b in pack.branches]

    def list_contexts(self) -> DataFrame:
        return registry.latest(self.table("contexts"), "ctx_id")

    def list_conflicts(self) -> DataFrame:
        return inference.conflict_sets(self.claims())

    # upkeep

    def history(self, limit: int = 20) -> DataFrame:
        return lifecycle.history_top(self.table("history"), limit)

    def get_stats(self) -> DataFrame:
        n = lambda df, name: df.agg(F.count("*").alias(name))
        parts = {"atoms": self.table("atoms").dropDuplicates(["atom_id"]), "current_atoms": self.atoms(), "current_claims": self.claims(), "active_relations": self.relations(), "edges": self.edges()}
        out = None
        for name, df in parts.items():
            out = n(df, name) if out is None else out.crossJoin(n(df, name))
        return out

    def verify_integrity(self) -> DataFrame:
        """(atom_id, error): ids that their content doesn't make, and claims without an atom."""
        c = self.table("claims").groupBy("atom_id").agg(F.array_sort(F.collect_set(F.struct("subj", "pred", "obj"))).alias("claims"))
        a = self.table("atoms").dropDuplicates(["atom_id"]).join(c, "atom_id", "left")
        made = F.sha2(F.to_json(F.struct("atom_type", F.coalesce("claims", F.array().cast("array<struct<subj:bigint,pred:bigint,obj:bigint>>")).alias("claims"), "payload")), 256)
        bad = a.where(F.col("atom_id") != made).select("atom_id", F.lit("identity").alias("error"))
        lost = self.table("claims").select("atom_id").distinct().join(self.table("atoms"), "atom_id", "left_anti")
        return bad.unionByName(lost.select("atom_id", F.lit("orphan claim").alias("error")))

    def rebuild_indexes(self) -> int:
        """Postings of the live atoms take the place of those stored; how many there are."""
        new = cut(_sorted(R.index_text(self.atoms(), F.col("node_num"), "payload"), "term"))
        self.store.commit({"postings": new, "history": [("postings", "rebuild", time.time_ns())]}, ["postings"])
        return new.count()

    def repair(self) -> tuple[int, int]:
        """Faults before and after: parts of lost writers are removed, claims without an atom dropped, postings rebuilt."""
        self.store.recover()
        before = self.verify_integrity().count()
        claims = cut(self.table("claims").join(self.table("atoms").select("atom_id").distinct(), "atom_id", "left_semi"))
        self.store.commit({"claims": claims, "history": [("claims", "repair", time.time_ns())]}, ["claims"])
        self.rebuild_indexes()
        return before, self.verify_integrity().count()

    def _live(self) -> dict[str, DataFrame]:
        """All tables, without what is superseded, deleted or repeated."""
        newest = {"relations": "relation_id", "entities": "entity_id", "predicates": "predicate_id", "sources": "source_id", "contexts": "ctx_id"}
        out = {name: registry.latest(self.table(name), key) for name, key in newest.items()}
        out |= {name: self.table(name).distinct() for name in ("supersedes", "tombstones", "atom_sources", "history", "claim_tombstones", "vectors")}
        edges = _sorted(self.edges().withColumns({"deleted": F.lit(False), "at": F.lit(0).cast("bigint")}), "edge_type", "src")
        postings = _sorted(R.index_text(self.atoms(), F.col("node_num"), "payload"), "term")
        return out | {"atoms": _sorted(self.atoms(), "node_num"), "claims": _sorted(self.claims(), "subj"), "postings": postings, "edges": edges}

    def compact(self) -> int:
        """All tables rewritten in place, in one commit; what they replace is removed. How many parts were."""
        with self.store.lease():
            self.store.commit(self._live(), list(TABLES))
            return self.store.recover(old=True)

    def snapshot(self, path: str) -> None:
        """The live tables, compacted, as a base in another folder."""
        Store(self.spark, path, TABLES).commit(self._live(), list(TABLES))
