"""Every query of the engine by name, with its SQL over the same source tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import cost as C
from .functions import predicates as P
from .functions import scalar as S
from .model.projection import BILLION, DAY, EPOCH, Model, sql
from .operators import constraints as K
from .operators import crdt, extraction, federation, graph, inference, lifecycle, setcover
from .operators import invariants as I
from .operators import registry
from .operators import retrieval as R
from .sources.shared import spread

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_O: dict[str, str] = {}
NOW = EPOCH + 400 * DAY
TERMS = ["the", "of"]


def query(sql_text: str | None = None, *tables: str, recursive: bool = False):
    """Registers a function of a Model under its name, with its SQL."""

    def deco(f: Callable[[Model], DataFrame]):
        _Q[f.__name__] = lambda spark, sf_dir, f=f: f(Model(spark, sf_dir))
        if sql_text is not None:
            _O[f.__name__] = sql(sql_text, *tables, recursive=recursive)
        return f

    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_O)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Q["lookup_flagship"](spark, sf_dir)


# --- model and sources


@query("select * from atoms", "atoms")
def atoms_project(m):
    return m.atoms()


@query("select * from claims", "claims")
def claims_project(m):
    return m.claims()


@query("select term, count(*) as n_nodes from postings group by term", "postings")
def lexicon(m):
    return R.lexicon(m.postings())


@query("select * from contexts", "contexts")
def list_contexts(m):
    return m.contexts()


@query("""select atom_id, atom_type, trust from atoms where contains(lower(atom_id), 'ab') or contains(lower(atom_type), 'fact') or contains(trust::varchar, '300')""", "atoms")
def export_filter(m):
    from .sources.exchange import matches_export_filter

    hit = matches_export_filter("ab", "atom_id") | matches_export_filter("FACT", "atom_type") | matches_export_filter("300", "trust")
    return m.atoms().where(hit).select("atom_id", "atom_type", "trust")


@query("select doc_id::varchar as id, subj, pred, obj from (select doc_id, 7000000000 + doc_id as subj, 7 as pred, n_chars as obj from documents)")
def csv_roundtrip(m):
    from .sources import exchange

    docs = m.table("documents").select(F.col("doc_id").cast("string").alias("id"), (F.lit(7 * BILLION) + F.col("doc_id")).alias("subj"), F.lit(7).alias("pred"), F.col("n_chars").alias("obj"))
    return exchange.csv_roundtrip(docs).select("id", "subj", "pred", "obj")


# --- predicates and constraints

CONSTRAINTS = [
    K.Constraint("trust", "trust", "gte", 5000),
    K.Constraint("domain", "domain", "eq", 8, "must_not"),
    K.Constraint("type", "atom_type", "eq", "fact", "should", 0.5),
    K.Constraint("source", "source", "lte", 12),
    K.Constraint("time", "time", "within", (EPOCH, EPOCH + 20 * DAY)),
    K.Constraint("label", "text", "contains", "x", "should", 0.25),
]
_STATUS = {
    "trust": "case when trust is null then 'unknown' when trust >= 5000 then 'satisfied' else 'violated' end",
    "domain": "case when domain_mask is null then 'unknown' when domain_mask <> 8 then 'satisfied' else 'violated' end",
    "type": "case when atom_type is null then 'unknown' when lower(atom_type) = 'fact' then 'satisfied' else 'violated' end",
    "source": "case when source_id is null then 'unknown' when source_id <= 12 then 'satisfied' else 'violated' end",
    "time": f"case when valid_from is null then 'unknown' when valid_from >= {EPOCH} and valid_from < {EPOCH + 20 * DAY} then 'satisfied' else 'violated' end",
    "label": "'unknown'",
}


@query("select atom_id, " + ", ".join(f"{v} as st_{k}" for k, v in _STATUS.items()) + " from atoms", "atoms")
def constraint_eval(m):
    return m.atoms().select("atom_id", *[K.evaluate(c).alias(f"st_{c.id}") for c in CONSTRAINTS])


_HARD = ("trust", "domain", "source", "time")


@query("select atom_id, trust, (case when lower(atom_type) = 'fact' then 0.5 else 0.0 end)::double as soft_score from atoms where " + " and ".join(f"({_STATUS[k]}) = 'satisfied'" for k in _HARD), "atoms")
def constraint_admit(m):
    return K.admitted(m.atoms(), CONSTRAINTS).select("atom_id", "trust", K.should_score(CONSTRAINTS).alias("soft_score"))


@query("select * from (select atom_id, case " + " ".join(f"when ({_STATUS[k]}) <> 'satisfied' then '{k}'" for k in _HARD) + " end as rejected_by from atoms) where rejected_by is not null", "atoms")
def constraint_reject(m):
    return K.rejected(m.atoms(), CONSTRAINTS).select("atom_id", "rejected_by")


@query("select atom_id, (select count(*) from (values (" + "), (".join(f"({v})" for v in _STATUS.values()) + ")) as t(s) where s = 'satisfied')::int as n_satisfied, not (" + " or ".join(f"({v}) = 'violated'" for v in _STATUS.values()) + ") as hard_ok from atoms", "atoms")
def constraint_quantified(m):
    r = K.evaluate_all(m.atoms(), CONSTRAINTS)
    return r.select("atom_id", F.size(F.filter("results", lambda x: x["status"] == P.SATISFIED)).alias("n_satisfied"), P.hard_ok(F.transform("results", lambda x: x["status"])).alias("hard_ok"))


_CMP = {"exists": ("valid_to", None), "eq": ("atom_type", "Fact"), "ne": ("atom_type", "FACT"), "contains": ("atom_type", "pothes"), "matches": ("atom_type", "^(FACT|OBS)"), "gte": ("trust", 5000), "lte": ("trust", 5000), "before": ("valid_from", EPOCH + 5 * DAY), "after": ("valid_from", EPOCH + 5 * DAY), "during": ("valid_from", (EPOCH + DAY, EPOCH + 9 * DAY)), "within": ("source_id", (3, 9))}


@query(f"""select atom_id, valid_to is not null as op_exists, lower(atom_type) = 'fact' as op_eq, lower(atom_type) <> 'fact' as op_ne, contains(lower(atom_type), 'pothes') as op_contains,
    regexp_matches(atom_type, '^(FACT|OBS)') as op_matches, trust >= 5000 as op_gte, trust <= 5000 as op_lte, valid_from < {EPOCH + 5 * DAY} as op_before, valid_from >= {EPOCH + 5 * DAY} as op_after,
    valid_from >= {EPOCH + DAY} and valid_from < {EPOCH + 9 * DAY} as op_during, source_id >= 3 and source_id < 9 as op_within from atoms""", "atoms")
def comparison_operators(m):
    return m.atoms().select("atom_id", *[P.compare(F.col(c), op, v).alias(f"op_{op}") for op, (c, v) in _CMP.items()])


@query("select * from claims where pred in (5, 8) and obj between 5000000000 and 5000000100", "claims")
def pattern_match_claims(m):
    return m.claims().where(P.claim_matches(pred={5, 8}, obj=("range", 5 * BILLION, 5 * BILLION + 100)))


@query("select * from claims where subj = 6000000001", "claims")
def find_by_subject(m):
    return m.claims().where(P.claim_matches(subj=6 * BILLION + 1))


@query("select * from claims where pred = 8", "claims")
def find_by_predicate(m):
    return m.claims().where(P.claim_matches(pred=8))


@query(f"select atom_id from atoms where (valid_from < {EPOCH + 12 * DAY}) and (valid_to is null or {EPOCH + 8 * DAY} < valid_to)", "atoms")
def interval_overlap(m):
    return m.atoms().where(P.overlaps(F.col("valid_from"), F.col("valid_to"), EPOCH + 8 * DAY, EPOCH + 12 * DAY)).select("atom_id")


@query(f"select atom_id from atoms where valid_from <= {EPOCH + 15 * DAY} and (valid_to is null or {EPOCH + 15 * DAY} <= valid_to)", "atoms")
def valid_at(m):
    return m.atoms().where(P.valid_at(F.col("valid_from"), F.col("valid_to"), EPOCH + 15 * DAY)).select("atom_id")


@query("select atom_id, created_at from atoms order by created_at desc, atom_id limit 100", "atoms")
def latest_n(m):
    from .plans.contract import TemporalScope

    return K.latest(m.atoms(), TemporalScope(latest=100)).select("atom_id", "created_at")


@query("select atom_id from atoms where domain_mask & 6 <> 0 and trust >= 5000 and atom_type in ('FACT', 'OBSERVATION')", "atoms")
def domain_trust_type(m):
    return m.atoms().where(P.matches_domain(F.col("domain_mask"), 6) & P.trust_at_least(F.col("trust"), 5000) & P.type_in(F.col("atom_type"), ["FACT", "OBSERVATION"])).select("atom_id")


@query("select dst, edge_type, count(*) as n from edges where confidence >= 9500 group by dst, edge_type", "edges")
def edges_current(m):
    return m.current_edges().where("confidence >= 9500").groupBy("dst", "edge_type").agg(F.count("*").alias("n"))


@query("select atom_id, list_filter(range(0, 64), lambda b: (domain_mask >> b) & 1 = 1)::varchar as tags from atoms", "atoms")
def domain_mask_tags(m):
    return m.atoms().select("atom_id", F.concat(F.lit("["), F.array_join(S.domain_tags(F.col("domain_mask")).cast("array<string>"), ", "), F.lit("]")).alias("tags"))


@query("select subj, pred, xor(subj, pred::bigint << 32) as pattern_hash, count(*) as n from claims group by all", "claims")
def claim_pattern_hash(m):
    return m.claims().groupBy("subj", "pred").agg(F.count("*").alias("n")).withColumn("pattern_hash", S.claim_pattern_hash(F.col("subj"), F.col("pred")))


@query("select l_orderkey, l_linenumber, case when l_orderkey % 2 = 0 then 2 * l_orderkey else 2 * l_orderkey - 1 end as zz, case when l_orderkey % 2 = 0 then l_orderkey else -l_orderkey end as back from lineitem")
def zigzag_codec(m):
    x = F.when(F.col("l_orderkey") % 2 == 0, F.col("l_orderkey")).otherwise(-F.col("l_orderkey"))
    return m.table("lineitem").select("l_orderkey", "l_linenumber", S.zigzag(x).alias("zz"), S.unzigzag(S.zigzag(x)).alias("back"))


# --- retrieval


@query(f"select node_num from postings where term = '{TERMS[0]}'", "postings")
def search_lex_term(m):
    return R.lexical_term(m.postings(), TERMS[0])


@query(f"select node_num from postings where term in ('{TERMS[0]}', '{TERMS[1]}') group by node_num having count(distinct term) = 2", "postings")
def search_lex_and(m):
    return R.lexical_all(m.occurrences(), TERMS)


@query(f"select distinct node_num from postings where term in ('{TERMS[0]}', 'der')", "postings")
def search_lex_or(m):
    return R.lexical_any(m.occurrences(), [TERMS[0], "der"])


@query("select atom_id, node_num, trust from atoms where atom_id in (sha256('document:3'), sha256('document:17'), sha256('document:99'))", "atoms")
def search_exact(m):
    import hashlib

    return R.exact(m.atoms(), [hashlib.sha256(f"document:{i}".encode()).hexdigest() for i in (3, 17, 99)]).select("atom_id", "node_num", "trust")


@query("select atom_id from atoms order by atom_id limit 256", "atoms")
def exact_broadcast_256(m):
    return R.exact(m.atoms()).select("atom_id")


EVERY = 50  # searches ask with each row whose id is divisible by this


def _query_vectors(m):
    return m.table("embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _topk(score: str, order: str) -> str:
    return f"""select query_id, node_num, trust, score, rank from (
        select *, row_number() over (partition by query_id order by score {order}, node_num)::int as rank from (
            select q.vec_id as query_id, 8000000000 + v.vec_id as node_num, v.label * 1000 as trust, round({score}, 6) as score
            from (select * from embeddings where vec_id % {EVERY} = 0) q, embeddings v)) where rank <= 10"""


_VQ = "v.embedding::double[], q.embedding::double[]"


@query(_topk(f"list_cosine_similarity({_VQ})", "desc"))
def search_semantic_topk(m):
    return R.semantic_top_all(m.embeddings(), _query_vectors(m))


@query(_topk(f"list_distance({_VQ})", "asc"))
def l2_topk(m):
    return R.semantic_top_all(m.embeddings(), _query_vectors(m), by="l2")


@query(_topk(f"list_dot_product({_VQ})", "desc"))
def dot_topk(m):
    return R.semantic_top_all(m.embeddings(), _query_vectors(m), by="dot")


@query(f"select query_id, node_num, least(floor(score * 10000)::int, trust) as trust from ({_topk(f'list_cosine_similarity({_VQ})', 'desc')}) where least(floor(score * 10000)::int, trust) >= 1000")
def semantic_capped_trust(m):
    return R.capped(R.semantic_top_all(m.embeddings(), _query_vectors(m)), trust_min=1000).select("query_id", "node_num", "trust")


@query("""select node_num, arg_min(backend, priority) as backend from (
    select node_num, 0 as priority, 'exact' as backend from (select node_num from atoms order by atom_id limit 256)
    union all select node_num, 1, 'lexical' from postings where term = 'the'
    union all select dst, 2, 'graph' from edges where src = 5000000001
    union all select 8000000000 + vec_id, 3, 'semantic' from embeddings where label = 3) group by node_num""", "atoms", "postings", "edges")
def route_union_dedup(m):
    e = m.current_edges().where(F.col("src") == 5 * BILLION + 1).select(F.col("dst").alias("node_num"))
    return R.union_dedup({"exact": R.exact(m.atoms()), "lexical": R.lexical_term(m.occurrences(), "the"), "graph": e, "semantic": m.embeddings().where("trust = 3000")})


def _candidates(m):
    """A candidate of each line: its part found through its order, in the order's branch."""
    return m.table("lineitem").select(
        (F.lit(5 * BILLION) + F.col("l_partkey")).alias("node_num"), F.when(F.col("l_orderkey") % 4 == 0, F.col("l_orderkey") % 3).alias("branch"),
        F.array((F.col("l_orderkey") % 7).cast("int")).alias("gaps"), (F.col("l_suppkey") * 10).cast("int").alias("trust"), F.col("l_quantity").cast("bigint").alias("io_bytes"),
        (F.col("l_linenumber") % 3).cast("int").alias("conflicts"), (F.col("l_returnflag") == "R").alias("needs_check"), F.array(F.col("l_suppkey")).alias("evidence"))


@query("""select 5000000000 + l_partkey as node_num, case when l_orderkey % 4 = 0 then l_orderkey % 3 end as branch, list_sort(list(distinct (l_orderkey % 7)::int))::varchar as gaps, min((l_suppkey * 10)::int) as trust,
    max(l_quantity::bigint) as io_bytes, max((l_linenumber % 3)::int) as conflicts, bool_or(l_returnflag = 'R') as needs_check, list_sort(list(distinct l_suppkey))::varchar as evidence, count(distinct l_orderkey % 7)::int as gain from lineitem group by 1, 2""")
def candidate_merge(m):
    v = R.candidate_view(R.merge_candidates(_candidates(m))).drop("cost")
    text = lambda c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]")).alias(c)
    return v.select("node_num", "branch", text("gaps"), "trust", "io_bytes", "conflicts", "needs_check", text("evidence"), "gain")


@query("""select a.atom_id, a.node_num, a.trust from atoms a where a.node_num in (select node_num from postings where term in ('the', 'of') group by node_num having count(distinct term) = 2)
    and a.domain_mask & 1 <> 0 and a.trust >= 5000 order by a.trust desc, a.atom_id limit 10""", "atoms", "postings")
def lookup_flagship(m):
    hits = R.lexical_all(m.occurrences(), TERMS)
    a = m.atoms().where(P.matches_domain(F.col("domain_mask"), 1) & P.trust_at_least(F.col("trust"), 5000))
    return a.join(hits, "node_num", "left_semi").dropDuplicates(["atom_id"]).orderBy(F.desc("trust"), "atom_id").limit(10).select("atom_id", "node_num", "trust")


# --- graph


@query("select 'out' as direction, edge_type, dst as node, confidence from edges where src = 5000000001 union all select 'in', edge_type, src, confidence from edges where dst = 5000000001", "edges")
def graph_neighbors(m):
    return graph.neighbors(m.current_edges(), 5 * BILLION + 1)


@query("select src, edge_type, confidence from edges where dst = 4000000001 and edge_type = 'OUTPUT_OF'", "edges")
def graph_in_neighbors(m):
    return graph.in_neighbors(m.current_edges(), 4 * BILLION + 1, ["OUTPUT_OF"])


@query("select src, dst, edge_type, confidence from edges where edge_type = 'OUTPUT_OF' and dst = 4000000003 order by src, edge_type, dst limit 50", "edges")
def graph_pattern(m):
    return graph.match_pattern(m.current_edges(), edge_type="OUTPUT_OF", dst=4 * BILLION + 3).select("src", "dst", "edge_type", "confidence")


@query("select s.src, s.dst, s.edge_type from (select 5000000000 + l_partkey as src, 4000000000 + l_suppkey as dst, 'OUTPUT_OF' as edge_type from lineitem group by all) s where exists (select 1 from edges e where e.src = s.src and e.dst = s.dst and e.edge_type = s.edge_type)", "edges")
def graph_has_edge(m):
    pairs = m.table("lineitem").select((F.lit(5 * BILLION) + F.col("l_partkey")).alias("src"), (F.lit(4 * BILLION) + F.col("l_suppkey")).alias("dst"), F.lit("OUTPUT_OF").alias("edge_type"))
    return graph.has_edges(m.current_edges(), spread(pairs, "src", "dst").distinct())


def _seeds(m, *nodes):
    return m.spark.createDataFrame([(n,) for n in nodes], "node bigint")


@query("""with recursive w(node, depth) as (select unnest([6000000001, 6000000002, 6000000003]), 0 union select e.dst, w.depth + 1 from w join edges e on e.src = w.node where w.depth < 3)
    select node, min(depth)::int as depth from w group by node""", "edges", recursive=True)
def graph_walk_d3(m):
    return graph.walk(m.current_edges(), _seeds(m, *(6 * BILLION + i for i in (1, 2, 3))), 3, fanout=None)


@query("""with f as (select src, dst, edge_type from (select *, row_number() over (partition by src, edge_type order by dst) as n from edges) where n <= 2),
    l1 as (select distinct dst as node from f where src in (6000000001, 6000000002)),
    l2 as (select distinct dst as node from f where src in (select node from l1))
    select node, min(depth)::int as depth from (select unnest([6000000001, 6000000002]) as node, 0 as depth union all select node, 1 from l1 union all select node, 2 from l2) group by node""", "edges")
def graph_walk_fanout(m):
    return graph.walk(m.current_edges(), _seeds(m, 6 * BILLION + 1, 6 * BILLION + 2), 2, fanout=2)


_PAIRS = "(select 6000000000 + o_orderkey as src, 1000000000 + (o_orderkey % 5) as dst from orders )"


@query(f"""with r as (select p.src, p.dst, exists (select 1 from edges a join edges b on b.src = a.dst join edges c on c.src = b.dst where a.src = p.src and c.dst = p.dst and a.edge_type = 'DERIVED_FROM' and b.edge_type = 'DERIVED_FROM' and c.edge_type = 'DERIVED_FROM') as reachable from {_PAIRS} p)
    select src, dst, reachable from r""", "edges")
def graph_path_exists(m):
    pairs = m.table("orders").select((F.lit(6 * BILLION) + F.col("o_orderkey")).alias("src"), (F.lit(BILLION) + F.col("o_orderkey") % 5).alias("dst"))
    return graph.path_exists(m.current_edges(), pairs, 3, ["DERIVED_FROM"])


@query("""with e1 as (select src, dst from edges where src = 6000000005), e2 as (select src, dst from edges where src in (select dst from e1)),
    e as (select * from e1 union all select * from e2)
    select distinct node from (select src as node from e union all select dst from e union all select 6000000005)""", "edges")
def extract_subgraph(m):
    return graph.subgraph_nodes(m.current_edges(), 6 * BILLION + 5, 2)


@query("""with e1 as (select src, dst, edge_type from edges where src in (5000000001, 5000000002)), e2 as (select src, dst, edge_type from edges where src in (select dst from e1))
    select src, dst, edge_type from e1 union select src, dst, edge_type from e2""", "edges")
def graph_walk_edges(m):
    return graph.walk_edges(m.current_edges(), _seeds(m, 5 * BILLION + 1, 5 * BILLION + 2), 2)


# chains of some five hundred orders: each order with the next one of its fifty customers
@query("select o_orderkey as node, min(o_orderkey) over (partition by o_custkey // 50) as root from orders qualify count(*) over (partition by o_custkey // 50) > 1")
def connectivity_components(m):
    w = Window.partitionBy(F.floor(F.col("o_custkey") / 50)).orderBy("o_orderkey")
    return graph.components(m.table("orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).where("b is not null"))


@query("select edge_type, src, dst, max(confidence)::int as confidence from (select 'OUTPUT_OF' as edge_type, l_partkey as src, l_suppkey as dst, (l_discount * 10000)::int as confidence from lineitem) group by all")
def graph_builder_dedup(m):
    e = m.table("lineitem").select(F.lit("OUTPUT_OF").alias("edge_type"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.round(F.col("l_discount") * 10000).cast("int").alias("confidence"), F.col("l_orderkey").alias("seq"))
    return graph.first_inserted(e)


# --- conflicts, inference


@query("select * from (select subj, pred, count(distinct obj)::int as n_objects, list_sort(list(distinct obj))::varchar as objects from active group by subj, pred) where n_objects > 1", "active")
def conflict_sets(m):
    return inference.conflict_sets(m.active_claims()).withColumn("objects", F.concat(F.lit("["), F.array_join(F.col("objects").cast("array<string>"), ", "), F.lit("]")))


@query("""with n as (select * from active where event_id % 10 = 0), o as (select * from active where event_id % 10 <> 0)
    select event_id, subj, pred, obj from n where exists (select 1 from o where o.subj = n.subj and o.pred = n.pred) and not exists (select 1 from o where o.subj = n.subj and o.pred = n.pred and o.obj = n.obj)""", "active")
def conflict_probe(m):
    a = m.active_claims()
    return inference.probe_conflicts(a.where("event_id % 10 = 0"), a.where("event_id % 10 <> 0")).select("event_id", "subj", "pred", "obj")


def _damp(a: str, b: str, f: float) -> str:
    return f"greatest(floor(least({a}, {b}) * {f} + 1e-9)::int, 100)"


_PICK = "subj, pred, obj, trust, via from (select *, row_number() over (partition by subj, pred, obj order by trust desc, via) as n from ({})) where n = 1"
_RULE1 = f"select a.subj, a.pred, b.obj, {_damp('a.trust', 'b.trust', 0.8)} as trust, a.obj as via from claims a join claims b on a.obj = b.subj and a.pred = b.pred where a.pred in (2, 3, 5, 7) and a.subj <> b.obj"


@query("select " + _PICK.format(_RULE1), "claims")
def infer_transitive(m):
    return inference.transitive(m.claims())


@query(f"""with t as (select distinct subj as node_num, trust from claims where subj >= 6000000000 and pred = 7)
    select a.node_num as subj, 5 as pred, b.node_num as obj, max({_damp('s.trust', 't.trust', 0.8)}) as trust, count(*) as n_shared
    from evidence a join evidence b on a.evidence = b.evidence and a.node_num < b.node_num join t s on s.node_num = a.node_num join t on t.node_num = b.node_num group by 1, 3""", "claims", "evidence")
def infer_shared_evidence(m):
    trust = m.claims().where("subj >= 6000000000 and pred = 7").select(F.col("subj").alias("node_num"), "trust").distinct()
    return inference.shared_evidence(m.evidence(), trust)


@query("select " + _PICK.format(f"select a.subj, 8 as pred, b.obj, {_damp('a.trust', 'b.trust', 0.6)} as trust, a.obj as via from claims a join claims b on a.obj = b.subj where a.pred = 8 and b.pred = 5 and a.subj <> b.obj"), "claims")
def infer_contradiction(m):
    return inference.contradiction(m.claims())


@query(f"""with d1 as (select distinct subj, pred, obj from ({_RULE1})),
    e as (select subj, pred, obj, trust, 0 as d from claims where pred in (2, 3, 5, 7) union all select subj, pred, obj, 5000, 1 from d1),
    x as (select a.subj, a.pred, b.obj, {_damp('a.trust', 'b.trust', 0.64)} as trust, a.obj as via from e a join e b on a.obj = b.subj and a.pred = b.pred where a.subj <> b.obj and a.d + b.d > 0),
    y as (select * from x where not exists (select 1 from d1 where d1.subj = x.subj and d1.pred = x.pred and d1.obj = x.obj))
    select """ + _PICK.format("select * from y"), "claims")
def infer_second_order(m):
    return inference.second_order(m.claims())


GAPS = [{"id": 1, "pred": 8}, {"id": 2, "subj": 2 * BILLION + 3}, {"id": 3, "pred": 7, "obj": ("range", BILLION, BILLION + 2)}]


@query("select 1 as gap_id, subj, pred, obj from claims where pred = 8 union all select 2, subj, pred, obj from claims where subj = 2000000003 union all select 3, subj, pred, obj from claims where pred = 7 and obj between 1000000000 and 1000000002", "claims")
def gap_matches(m):
    return inference.meets_gaps(m.claims(), GAPS)


@query("select 6000000000 + l_orderkey as src, 5000000000 + p_partkey as dst, 'DERIVED_FROM' as edge_type from (select distinct l_orderkey, l_partkey from lineitem) join (select * from part where p_size <= 10) on l_partkey = p_partkey")
def deferred_resolve(m):
    pending = m.table("lineitem").select((F.lit(6 * BILLION) + F.col("l_orderkey")).alias("src"), F.col("l_partkey").alias("target"), F.lit("DERIVED_FROM").alias("edge_type")).distinct()
    created = m.table("part").where("p_size <= 10").select(F.col("p_partkey").alias("target"), (F.lit(5 * BILLION) + F.col("p_partkey")).alias("node_num"))
    return inference.resolve_deferred(pending, created)[0]


@query("select l_orderkey, l_partkey from (select distinct l_orderkey, l_partkey from lineitem) where l_partkey not in (select p_partkey from part where p_size <= 10) and 100 - l_partkey % 100 <= 40")
def deferred_retained(m):
    pending = m.table("lineitem").select("l_orderkey", "l_partkey", F.col("l_partkey").alias("target"), (F.col("l_partkey") % 100).alias("created_cycle")).distinct()
    created = m.table("part").where("p_size <= 10").select(F.col("p_partkey").alias("target"), F.col("p_partkey").alias("node_num"))
    return inference.retained(inference.resolve_deferred(pending.withColumns({"src": F.col("l_orderkey"), "edge_type": F.lit("X")}), created)[1], 100, 40).select("l_orderkey", "l_partkey")


# --- lifecycle


@query("select doc_id, lang from documents where doc_id not in (select old_id from supersedes) and doc_id not in (select doc_id from tombstones)", "supersedes", "tombstones")
def current_atoms(m):
    return lifecycle.current(m.table("documents").select("doc_id", "lang"), m.supersedes(), m.tombstones())


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def compact_latest(m):
    e = m.table("events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("k"), "ts", "event_id", "user_id", "event_type", "value")
    return lifecycle.compact_latest(e, "k", "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("select doc_id, n_chars from documents where doc_id not in (select old_id from supersedes) and doc_id % 11 <> 0", "supersedes")
def compact_supersedes(m):
    d = m.table("documents").select("doc_id", "n_chars", (F.col("doc_id") % 11 == 0).alias("deleted"))
    live = lifecycle.current(d, m.supersedes(), m.tombstones().where("false"))
    return lifecycle.collect_garbage(d, live, "doc_id").select("doc_id", "n_chars")


@query("select conv_id as id, turn as at, role from conversations order by turn desc, conv_id desc, role desc limit 20")
def history_topn(m):
    h = m.table("conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("at"), "role")
    return lifecycle.history_top(h)


@query("""select count(*)::bigint as atoms, (select count(*) from documents where doc_id not in (select old_id from supersedes) and doc_id not in (select doc_id from tombstones))::bigint as current_atoms,
    (select count(*) from claims)::bigint as claims, (select count(*) from edges)::bigint as edges from atoms""", "atoms", "claims", "edges", "supersedes", "tombstones")
def stats(m):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    cur = lifecycle.current(m.table("documents").select("doc_id"), m.supersedes(), m.tombstones())
    return n(m.atoms(), "atoms").crossJoin(n(cur, "current_atoms")).crossJoin(n(m.claims(), "claims")).crossJoin(n(m.current_edges(), "edges"))


@query("""with j as (select distinct subj, pred, obj from active where event_id % 3 <> 0), a as (select distinct subj, pred, obj from active where event_id % 3 <> 1)
    select coalesce(j.subj, a.subj) as subj, coalesce(j.pred, a.pred) as pred, coalesce(j.obj, a.obj) as obj, case when a.subj is null then 'missing' else 'orphan' end as finding,
    case when a.subj is null then 'assert' else 'tombstone' end as action from j full join a on j.subj = a.subj and j.pred = a.pred and j.obj = a.obj where j.subj is null or a.subj is null""", "active")
def relation_audit(m):
    a = m.active_claims()
    found = lifecycle.audit_relations(a.where("event_id % 3 <> 0"), a.where("event_id % 3 <> 1"), ["subj", "pred", "obj"])
    return found.join(lifecycle.repair_relations(found, ["subj", "pred", "obj"]), ["subj", "pred", "obj"])


@query("""select doc_id as record_id, case when doc_id % 13 = 0 then 'length' when doc_id % 17 = 0 then 'identity' else '' end as errors from documents where text is not null""")
def integrity_check(m):
    d = m.table("documents").where("text is not null")
    body = F.col("text").cast("binary")
    r = d.select(F.col("doc_id").alias("record_id"), body.alias("body"), F.when((F.col("doc_id") % 17 == 0) & (F.col("doc_id") % 13 != 0), F.lit("0")).otherwise(F.sha2(body, 256)).alias("stored_id"), F.crc32(body).alias("stored_crc"), (F.octet_length("text") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)).alias("length"))
    return lifecycle.integrity(r).select("record_id", F.array_join("errors", ",").alias("errors"))


@query("""with r as (select 3000000000 + c_custkey as subject, 7 as predicate, 2000000000 + c_nationkey as object, 0::bigint as valid_from from customer),
    c as (select 3000000000 + c_custkey as subject, 2000000000 + c_nationkey % 7 as new_object from customer where c_custkey % 4 = 0),
    j as (select r.*, c.new_object, coalesce(c.new_object <> r.object, false) as moves from r left join c using (subject))
    select subject, predicate, object, valid_from, case when moves then 99 end::bigint as valid_to from j union all select subject, predicate, new_object, 99::bigint, null from j where moves""")
def transition_relation(m):
    c = m.table("customer")
    r = c.select((F.lit(3 * BILLION) + F.col("c_custkey")).alias("subject"), F.lit(7).alias("predicate"), (F.lit(2 * BILLION) + F.col("c_nationkey")).alias("object"), F.lit(0).cast("bigint").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"))
    change = c.where("c_custkey % 4 = 0").select((F.lit(3 * BILLION) + F.col("c_custkey")).alias("subject"), F.lit(7).alias("predicate"), (F.lit(2 * BILLION) + F.col("c_nationkey") % 7).alias("new_object"), F.lit(99).cast("bigint").alias("at"))
    return lifecycle.transition(r, change)


@query("select o_orderkey, case when o_custkey % 10 in (3, 4, 5) then o_custkey - o_custkey % 10 + 2 else o_custkey end as o_custkey, case when o_custkey % 10 in (3, 4, 5) then o_custkey end as merged_from from orders")
def merge_entities(m):
    """Chains of three merges: 5 into 4, 4 into 3, 3 into 2."""
    merges = m.table("customer").where("c_custkey % 10 in (3, 4, 5)").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") - 1).alias("target_id"))
    return lifecycle.merge_entities(m.table("orders").select("o_orderkey", "o_custkey"), merges, "o_custkey")


# --- replicated states

_CLOCK = "(phys, logical, actor)"


def _last(cols: str, by: str = "key", where: str = "true") -> str:
    return f"select {by}, {cols} from (select *, row_number() over (partition by {by} order by phys desc, logical desc, actor desc) as n from crdt_log where {where}) where n = 1"


_SIDES = "greatest(count(*) filter (logical % 3 <> 0 and {0}), count(*) filter (logical % 3 <> 1 and {0}))"


@query(f"select key, sum(c)::bigint as value from (select key, actor, {_SIDES.format('true')} as c from crdt_log group by all) group by key", "crdt_log")
def crdt_gcounter(m):
    """Two replicas, each without a third of the log: neither holds the other."""
    log = m.crdt_log()
    return crdt.gcounter_value(crdt.gcounter_merge(*(crdt.gcounter_state(log.where(f"logical % 3 <> {i}")) for i in (0, 1))))


@query(f"select k as key, (sum(p) - sum(n))::bigint as value from (select k, actor, {_SIDES.format("key = 'purchase'")} as p, {_SIDES.format("key = 'error'")} as n from crdt_log group by all) group by k", "crdt_log")
def crdt_pncounter(m):
    log = m.crdt_log().select("phys", "logical", F.col("key").alias("kind"), F.col("k").alias("key"), "actor")
    return crdt.pncounter_value(crdt.pncounter_merge(*(crdt.pncounter_state(log.where(f"logical % 3 <> {i}"), F.col("kind") == "purchase", F.col("kind") == "error") for i in (0, 1))))


@query("select distinct actor as key, k as element from crdt_log where key = 'signup' and not (logical % 3 = 0 or logical % 7 = 1)", "crdt_log")
def crdt_orset_dots(m):
    """Each signup adds its element by a dot of its own; the removals of two replicas tell the dots that they have seen."""
    dots = m.crdt_log().where("key = 'signup'").select(F.col("actor").alias("key"), F.col("k").alias("element"), "actor", F.col("logical").alias("counter"))
    return crdt.orset_dots(dots, dots.where("counter % 3 = 0").unionByName(dots.where("counter % 7 = 1")))


@query("""with n as (select *, case when logical % 4 = 0 then phys - 3600000000 end as seen, row_number() over (partition by key, actor order by phys desc, logical desc) as n from crdt_log),
    l as (select * from n where n = 1), h as (select key, max(seen) as h from l group by key)
    select l.key, l.actor, l.value from l join h using (key) where l.phys > h.h or h.h is null""", "crdt_log")
def crdt_mvreg_contexts(m):
    """Every fourth write has seen all that were an hour old."""
    return crdt.mvreg(m.crdt_log(), "value", F.when(F.col("logical") % 4 == 0, F.col("phys") - 3_600_000_000))


_KINDS = "case key when 'click' then 'gcounter' when 'error' then 'flagset' when 'purchase' then 'lww' when 'signup' then 'mvreg' else 'orset' end"


@query(f"""with s as (select actor as key, key as field, {_KINDS} as kind, phys, logical, actor, k from crdt_log),
    c as (select key, field, kind, count(*) as number from s where kind = 'gcounter' group by all),
    o as (select *, case kind when 'orset' then k when 'mvreg' then logical % 2 end as slot from s where kind <> 'gcounter'),
    l as (select key, field, kind, slot, max_by(k, (phys, logical)) as number, max_by(logical, (phys, logical)) as last from o group by all)
    select key, field, kind, null::bigint as slot, number from c union all select key, field, kind, slot, number from l where not (kind = 'orset' and last % 4 = 3)""", "crdt_log")
def crdt_merge_kinds(m):
    """Stores of two replicas, whose fields are of five kinds, merged by kind; a third of the log both have."""
    kind = F.expr(_KINDS)
    log = m.crdt_log().select(F.col("actor").alias("key"), F.col("key").alias("field"), kind.alias("kind"), "phys", "logical", F.when(kind == "gcounter", F.col("actor")).when(kind == "mvreg", F.col("logical") % 2).alias("actor"), F.when(kind == "orset", F.col("k")).alias("element"), F.col("k").alias("number"), ((kind == "orset") & (F.col("logical") % 4 == 3)).alias("removed"))
    whole = crdt.kind_state(log)
    part = lambda i: crdt.kind_state(log.where(f"kind <> 'gcounter' and logical % 3 <> {i}")).unionByName(whole.where("kind = 'gcounter'"))
    return crdt.kind_view(crdt.merge_by_kind(part(0), part(1))).select("key", "field", "kind", "slot", "number")


@query(_last("phys, logical, actor, value"), "crdt_log")
def crdt_lww(m):
    log = m.crdt_log()
    return crdt.compact(log.where("logical % 2 = 0"), crdt.lww(log.where("logical % 2 = 1"), "value"), "value")


@query("""with a as (select actor as key, k as element, max((phys, logical)) as at from crdt_log where key = 'signup' group by all), r as (select actor as key, k as element, max((phys, logical)) as at from crdt_log where key = 'error' group by all)
    select a.key, a.element from a left join r using (key, element) where r.at is null or r.at < a.at""", "crdt_log")
def crdt_orset(m):
    log = m.crdt_log().select("phys", "logical", F.col("key").alias("kind"), F.col("actor").alias("key"), "actor", F.col("k").alias("element"))
    return crdt.orset(log.where("kind = 'signup'"), log.where("kind = 'error'"))


@query("select key, k, value from (select *, row_number() over (partition by key, k order by phys desc, logical desc, actor desc) as n from crdt_log) where n = 1 and logical % 5 <> 0", "crdt_log")
def crdt_ormap(m):
    return crdt.ormap(m.crdt_log(), "k", "value", F.col("logical") % 5 == 0)


@query("select key, actor, value from (select *, row_number() over (partition by key, actor order by phys desc, logical desc) as n from crdt_log) where n = 1", "crdt_log")
def crdt_mvreg(m):
    return crdt.mvreg(m.crdt_log(), "value")


@query("select actor as key, 1 << (case key when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end) as flags from (select *, row_number() over (partition by actor order by phys desc, logical desc) as n from crdt_log) where n = 1", "crdt_log")
def crdt_flagset(m):
    bits = F.when(F.col("kind") == "click", 1).when(F.col("kind") == "error", 2).when(F.col("kind") == "purchase", 4).when(F.col("kind") == "signup", 8).otherwise(16)
    log = m.crdt_log().select("phys", "logical", F.col("key").alias("kind"), F.col("actor").alias("key"), F.lit(0).alias("actor"))
    return crdt.flagset(log, bits)


@query("select actor as key, key as field, max_by(value, (phys, logical)) as value from crdt_log group by all", "crdt_log")
def crdt_store_merge(m):
    log = m.crdt_log().select(F.col("actor").alias("key"), F.col("key").alias("field"), F.lit("lww").alias("kind"), "phys", "logical", "actor", "value")
    return crdt.merge_stores(log.where("logical % 3 = 0"), log.where("logical % 3 <> 0")).select("key", "field", "value")


@query("select (count(*) - count(*) filter (event_id % 997 = 996))::bigint as n_valid, count(*) filter (event_id % 997 = 996)::bigint as n_bad, min(event_id) filter (event_id % 997 = 996) as first_bad from events")
def wal_validate(m):
    p = F.col("props").cast("binary")
    log = m.table("events").select(F.col("event_id").alias("offset"), p.alias("payload"), (F.crc32(p) + F.when(F.col("event_id") % 997 == 996, 1).otherwise(0)).alias("stored_crc"))
    return crdt.validate_log(log)


@query("select event_id as \"offset\" from events where event_id < (select min(event_id) from events where event_id % 997 = 996)")
def wal_recover_tail(m):
    p = F.col("props").cast("binary")
    log = m.table("events").select(F.col("event_id").alias("offset"), p.alias("payload"), (F.crc32(p) + F.when(F.col("event_id") % 997 == 996, 1).otherwise(0)).alias("stored_crc"))
    return crdt.recover_tail(log).select("offset")


@query("select key, sum(c)::bigint as value from (select key, actor, count(*) as c from crdt_log group by all) group by key", "crdt_log")
def crdt_stream_gcounter(m):
    from .streaming.log import stream_counter

    return stream_counter(m.spark, f"{m.dir}/events.parquet")


# --- cost and planning

_COST = {
    "cost_node": "1.0::double", "cost_io": "io_bytes * 0.001::double", "cost_trust": "10.0::double * (1.0::double / least(greatest(trust / 10000.0::double, 0.01), 1.0) - 1.0)",
    "cost_age": f"0.5::double * (({NOW} - valid_from) / (365.25::double * 86400))", "cost_domain": "case when domain_mask = 0 then 2.0 else 0.0 end::double",
}
_TOTAL = " + ".join(f"({v})" for v in _COST.values())


@query("select atom_id, " + ", ".join(f"round({v}, 6)::double as {k}" for k, v in _COST.items()) + " from atoms", "atoms")
def cost_breakdown(m):
    return m.atoms().select("atom_id", *[F.round(c, 6).alias(k) for k, c in C.breakdown(NOW).items()])


@query(f"select source_id, count(*) as n_nodes, round(sum({_TOTAL}), 4)::double as cost, round(sum({_TOTAL}) / count(*), 4)::double as cost_per_node from atoms group by source_id", "atoms")
def graph_cost(m):
    return C.graph_cost(m.atoms(), "source_id", NOW).select("source_id", "n_nodes", F.round("cost", 4).alias("cost"), F.round("cost_per_node", 4).alias("cost_per_node"))


_GRAPHS = "(select source_id, round(avg(io_bytes), 3) as c, count(*) as v from atoms group by source_id)"


@query(f"with g as (select * from {_GRAPHS}) select source_id, c, v from g where not exists (select 1 from g h where h.c <= g.c and h.v >= g.v and (h.c < g.c or h.v > g.v))", "atoms")
def pareto_frontier(m):
    g = m.atoms().groupBy("source_id").agg(F.round(F.avg("io_bytes"), 3).alias("c"), F.count("*").alias("v"))
    return C.pareto(g, "c", "v")


@query(f"select source_id, c from {_GRAPHS} order by c, source_id limit 1", "atoms")
def lowest_cost(m):
    g = m.atoms().groupBy("source_id").agg(F.round(F.avg("io_bytes"), 3).alias("c"))
    return C.lowest(g, "c", "source_id")


@query("select l_orderkey, round(sum(g) / sum(c), 6) as ratio from (select l_orderkey, l_quantity as g, 1.0 + 0.001 * l_quantity::bigint + 10 * (100 - l_suppkey / 100) as c from lineitem) group by l_orderkey having sum(c) > 0")
def benefit_ratio(m):
    cost = C.candidate_cost(F.lit(0), F.col("l_quantity").cast("bigint"), F.col("l_suppkey"))
    g = m.table("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("g"), F.sum(cost).alias("c"))
    return g.where("c > 0").select("l_orderkey", F.round(C.benefit_ratio(F.col("g"), F.col("c")), 6).alias("ratio"))


@query("""select doc_id as gap_id, kind, round(greatest(priority, 1) / 255.0::double * q * (1 + least(0.05 * n_targets, 1)) / (c + 5000 / 10000.0), 6)::double as utility from (
    select doc_id, (doc_id % 256)::int as priority, (doc_id % 12)::int as n_targets, k.kind, k.q, k.c from documents join (values (0, 'DEFINITION', 0.8::double, 1.0::double), (1, 'FACT', 0.9, 1.0), (2, 'CAUSAL_CHAIN', 0.75, 2.0), (3, 'EVIDENCE', 1.0, 1.2),
    (4, 'COUNTEREXAMPLE', 0.95, 1.5), (5, 'CONSTRAINTS', 0.85, 1.2), (6, 'COMPARISON_AXIS', 0.7, 1.5), (7, 'PROCEDURE', 0.65, 2.0)) as k(i, kind, q, c) on doc_id % 8 = k.i)""")
def planner_rank(m):
    from .plans.planner import KINDS, utility

    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 8 + 1).cast("int"))
    d = m.table("documents").select(F.col("doc_id").alias("gap_id"), kind.alias("kind"), (F.col("doc_id") % 256).cast("int").alias("priority"), (F.col("doc_id") % 12).cast("int").alias("n"))
    return d.select("gap_id", "kind", F.round(utility(F.col("kind"), F.col("priority"), F.col("n"), 5000), 6).alias("utility"))


_UTILITY = "round(greatest(doc_id % 256, 1) / 255.0::double * k.q * (1 + least(0.05 * 4, 1)) / (k.c + 0.5), 9)"


@query(f"""with u as (select doc_id // 8 as goal, doc_id as gap_id, k.kind, {_UTILITY} as utility from documents join (values (0, 'DEFINITION', 0.8::double, 1.0::double), (1, 'FACT', 0.9, 1.0), (2, 'CAUSAL_CHAIN', 0.75, 2.0), (3, 'EVIDENCE', 1.0, 1.2),
    (4, 'COUNTEREXAMPLE', 0.95, 1.5), (5, 'CONSTRAINTS', 0.85, 1.2), (6, 'COMPARISON_AXIS', 0.7, 1.5), (7, 'PROCEDURE', 0.65, 2.0)) as k(i, kind, q, c) on doc_id % 8 = k.i where doc_id % 5 <> 0)
    select goal, gap_id, kind, round(utility, 6)::double as utility from u qualify row_number() over (partition by goal order by utility desc, gap_id) <= 3""")
def planner_budget(m):
    """The plan of each goal of up to eight gaps, those met left out, within three actions."""
    import pandas as pd

    from .plans.planner import KINDS, plan

    def one(key, pdf):
        gaps = [{"id": i, "kind": KINDS[i % 8], "priority": i % 256, "covered": i % 5 == 0} for i in pdf["doc_id"].tolist()]
        found = plan(gaps, 4, 5000, max_actions=3)
        return pd.DataFrame({"goal": key[0], "gap_id": [a.gap_id for a in found], "kind": [a.kind for a in found], "utility": [round(a.utility, 6) for a in found]})

    d = m.table("documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("goal"))
    return d.groupBy("goal").applyInPandas(one, "goal bigint, gap_id bigint, kind string, utility double")


# --- invariants

QC = I.Constraints(time_from=EPOCH + 5 * DAY, time_to=EPOCH + 25 * DAY, trust_min=4000, domain_mask=7, sources=tuple(range(15)))
_TIME = f"valid_from < {EPOCH + 25 * DAY} and (valid_to is null or {EPOCH + 5 * DAY} < valid_to)"
_CHECKS = [(_TIME, "TIME_INVALID"), ("trust >= 4000", "TRUST_TOO_LOW"), ("domain_mask & 7 <> 0", "DOMAIN_MISMATCH"), ("source_id between 0 and 14", "SOURCE_DENIED")]


def _invariant(checks: list) -> str:
    bad = " ".join(f"when not ({c}) then '{why}'" for c, why in checks)
    return f"select atom_id, case when reason = '' then 'PASS' else 'FAIL_HARD' end as result, reason from (select atom_id, case {bad} else '' end as reason from atoms)"


@query(_invariant(_CHECKS[:3]), "atoms")
def invariant_basic(m):
    return I.evaluate(m.atoms(), I.BASIC, QC)


@query(_invariant(_CHECKS), "atoms")
def invariant_full(m):
    return I.evaluate(m.atoms(), I.FULL, QC)


@query(f"select atom_id, case when valid_from between {EPOCH + 3 * DAY} and {EPOCH + 9 * DAY} then 'PASS' else 'FAIL_HARD' end as result, '' as reason from atoms", "atoms")
def invariant_time_range(m):
    return I.evaluate(m.atoms(), I.time_range_program(EPOCH + 3 * DAY, EPOCH + 9 * DAY), QC)


@query("select atom_id, case when trust >= 5000 then 'PASS' else 'FAIL_HARD' end as result, '' as reason from atoms", "atoms")
def invariant_trust_threshold(m):
    return I.evaluate(m.atoms(), I.trust_program(5000), QC)


@query(_invariant(_CHECKS), "atoms")
def invariant_vm_generic(m):
    return I.evaluate(m.atoms(), I.FULL, QC, vm=True)


@query("""with c as (select subj, pred, max((n >= 3)::int) as hard from (select subj, pred, count(distinct obj) as n from active group by all) where n > 1 group by all)
    select event_id, case when c.hard is null then 'PASS' when c.hard = 1 then 'FAIL_HARD' else 'NEED_BRANCH' end as result from active left join c using (subj, pred)""", "active")
def invariant_conflict_probe(m):
    sets = inference.conflict_sets(m.active_claims()).select("subj", "pred", F.when(F.col("n_objects") >= 3, "hard").otherwise("soft").alias("severity"))
    return I.probe(m.active_claims(), sets).select("event_id", "result")


@query("""with a as (select o_orderkey as atom_id, 7000 + o_custkey % 4 * 1000 as trust, o_orderkey % 4 as domain, min(l_partkey) as part, count(*) % 2 as tag from orders join lineitem on o_orderkey = l_orderkey group by all)
    select atom_id, case when part not between 10 and 1500 or tag <> 1 then 'NEED_BRANCH' when trust < 8000 then 'FAIL_HARD' when domain & 1 = 0 then 'FAIL_SOFT' when part in (11, 12, 13) then 'FAIL_HARD' when part in (14, 15, 16) then 'NEED_BRANCH' else 'PASS' end as result,
    case when part not between 10 and 1500 or tag <> 1 then 'CONFLICT_FOUND' when trust < 8000 or domain & 1 = 0 then '' when part between 11 and 16 then 'CONFLICT_FOUND' else '' end as reason from a""")
def invariant_claims(m):
    """A program with a subroutine, over atoms with claims, in a context, against known conflicts: all that the checks above don't run."""
    b = I.Builder().emit("LD_CLAIM", 1, 3 << 16 | 1).emit("IN_RANGE", 1, imm=1500 << 32 | 10).jump("JZ", "branch", 1).emit("LD_CLAIM", 2, 2 << 16 | 1).emit("IS_TAG", 2, imm=1).jump("JZ", "branch", 2)
    b.jump("CALL", "trusted").jump("JZ", "bad", 4).emit("LD_ATOM_META", 5, 4).emit("HAS_BIT", 5, imm=0).emit("LD_CTX", 6, 1).emit("LD_IMM", 7, imm=5).emit("EQ", 6, 7).emit("AND", 5, 6).emit("NOT", 5).emit("LD_IMM", 7, imm=I.U64).emit("EQ", 5, 7).jump("JNZ", "soft", 5)
    b.emit("LD_CLAIM", 1, 3 << 16 | 1).emit("CTX_PROBE", 1).jump("JMP", "good").label("trusted").emit("LD_ATOM_META", 3, 3).emit("LD_QC", 4, 2).emit("LE", 4, 3).emit("RET", 1)
    program = b.label("good").emit("RET", 0).label("soft").emit("RET", 2).label("bad").emit("RET", 1).label("branch").emit("RAISE_CONFLICT", 0, imm=1).build()
    lines = m.table("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("part"), (F.count("*") % 2).alias("tag"))
    claim = F.struct(F.col("o_orderkey").alias("subj"), F.lit(5).cast("bigint").alias("pred"), F.col("tag").alias("tag"), F.col("part").alias("value"), F.lit(0).cast("bigint").alias("qualifiers"))
    a = m.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("atom_id"), F.lit(0).alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"), (7000 + F.col("o_custkey") % 4 * 1000).alias("trust"), (F.col("o_orderkey") % 4).alias("domain_mask"), F.lit(0).alias("source_id"), F.array(claim).alias("claims"))
    return I.evaluate(a, program, I.Constraints(trust_min=8000), vm=True, conflicts={11: "hard", 12: "hard", 13: "hard", 14: "soft", 15: "soft", 16: "soft"}, ctx=(0, 5, 0)).select(F.col("atom_id").cast("bigint").alias("atom_id"), "result", "reason")


# --- text extraction

_SEG = r"""s0 as (select conv_id * 1000 + turn as id, regexp_split_to_array(text, '[.\n]') as parts from conversations),
    s1 as (select id, unnest(range(1, len(parts) + 1)) as i, parts from s0),
    s2 as (select id, i, parts[i] as raw, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: strlen(x) + 1)), 0) as before from s1),
    s3 as (select id, i, before + strlen(raw) - strlen(regexp_replace(raw, '^\s+', '')) as byte_start, regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '') as segment from s2),
    segs as (select id, (row_number() over (partition by id order by i) - 1)::int as seg_no, byte_start::bigint as byte_start, (byte_start + strlen(segment))::bigint as byte_end, segment from s3 where segment <> '')"""


def _segments(m):
    c = m.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return extraction.segments(c, "id")


@query(f"with {_SEG} select * from segs")
def extract_segments(m):
    return _segments(m)


@query(rf"""with {_SEG}, t as (select id, seg_no, regexp_replace(raw, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') as mention from (select id, seg_no, unnest(regexp_split_to_array(segment, '\s+')) as raw from segs))
    select id, seg_no, mention, count(*) as n, 0.55::double as confidence from t where regexp_matches(mention, '^\p{{Lu}}') and strlen(mention) >= 2 group by id, seg_no, mention""")
def extract_entities(m):
    return extraction.entities(_segments(m), "id")


@query(rf"""with {_SEG}, w as (select id, seg_no, regexp_split_to_array(segment, '\s+') as w from segs)
    select id, seg_no, w[1] as subject, array_to_string(w[2:least(len(w) - 1, 5)], ' ') as predicate, w[-1] as object, 0.45::double as confidence from w where len(w) >= 3 and w[1] <> w[-1]""")
def extract_claims(m):
    return extraction.claims(_segments(m), "id")


@query(r"select conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[;,.:]', ' ', 'g'), '\s+', ' ', 'g')) as normalized from conversations")
def normalize_queries(m):
    return m.table("conversations").select("conv_id", "turn", S.normalize_query(F.col("text")).alias("normalized"))


@query("select conv_id, turn, round(least(sqrt(((contains(t, 'what is'))::int + (contains(t, 'the'))::int + (contains(t, 'find'))::int) / 3.0), 1.0), 6)::double as score from (select conv_id, turn, lower(text) as t from conversations)")
def pattern_scores(m):
    return m.table("conversations").select("conv_id", "turn", F.round(S.match_patterns(F.lower("text"), ["what is", "the", "find"]), 6).alias("score"))


# --- selection and answers


@query()
def setcover_greedy(m):
    li = m.table("lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").cast("string").alias("atom_id"), (F.col("l_partkey") % 50).cast("int").alias("gap"), (F.col("l_partkey") % 50 + 1).cast("int").alias("priority"), F.lit(5000).alias("trust"), F.lit(64).alias("io_bytes")).distinct()
    return setcover.solve_many(li)


# both gaps of a lookup are met by any of its atoms, so the cheapest one is the proof
@query("""select atom_id, node_num, trust, '0,1' as gaps from atoms where node_num in (select node_num from postings where term in ('the', 'of') group by node_num having count(distinct term) = 2)
    and domain_mask & 1 <> 0 and trust >= 5000 order by io_bytes * 0.001 + 10 * (10000 / trust) + 1, atom_id limit 1""", "atoms", "postings")
def answer_lookup(m):
    from .plans.solver import answer_lookup as run

    return run(m, TERMS).withColumn("gaps", F.array_join(F.col("gaps").cast("array<string>"), ","))


_FACTS = """facts as (select * from claims where subj = 6000000001 or subj in (select obj from claims where subj = 6000000001)
    or subj in (select obj from claims where subj in (select obj from claims where subj = 6000000001)))"""
_F1 = _RULE1.replace("claims", "facts")


@query(f"""with {_FACTS}, d1 as (select distinct subj, pred, obj from ({_F1})),
    e as (select subj, pred, obj, trust, 0 as d from facts where pred in (2, 3, 5, 7) union all select subj, pred, obj, 5000, 1 from d1),
    x as (select a.subj, a.pred, b.obj, {_damp('a.trust', 'b.trust', 0.64)} as trust, a.obj as via from e a join e b on a.obj = b.subj and a.pred = b.pred where a.subj <> b.obj and a.d + b.d > 0),
    y as (select * from x where not exists (select 1 from d1 where d1.subj = x.subj and d1.pred = x.pred and d1.obj = x.obj)),
    z as (select 1 as rule, {_PICK.format(_F1)} union all select 4, {_PICK.format('select * from y')} union all
    select 3, {_PICK.format(f"select a.subj, 8 as pred, b.obj, {_damp('a.trust', 'b.trust', 0.6)} as trust, a.obj as via from facts a join facts b on a.obj = b.subj where a.pred = 8 and b.pred = 5 and a.subj <> b.obj")})
    select rule, subj, pred, obj, trust, via from z where subj = 6000000001""", "claims")
def solve_inferred(m):
    """What the answer about an order infers, by rules 1, 3 and 4."""
    from .plans.solver import answer_node

    found = answer_node(m, 6 * BILLION + 1).inferred
    return m.spark.createDataFrame([(c["rule"], c["subj"], c["pred"], c["obj"], c["trust"], c["via"]) for c in found], "rule int, subj bigint, pred int, obj bigint, trust int, via bigint")


@query("""select subj, pred, obj, subj || ' has ' || least_obj || ' for ' || pred as reason from (select *, min(obj) over (partition by subj, pred) as least_obj from claims where subj = 6000000001)
    where obj <> least_obj order by subj, pred, obj limit 3""", "claims")
def solve_branch(m):
    """The branches that conflicting claims about an order open, three at most."""
    from .plans.solver import answer_node

    found = answer_node(m, 6 * BILLION + 1, max_context_branches=3).branches
    return m.spark.createDataFrame([(c["subj"], c["pred"], c["obj"], c["reason"]) for c in found], "subj bigint, pred int, obj bigint, reason string")


# --- federation

_FAIL = [("confidence < 0.5", "confidence_too_low"), ("confidence <= 0 or confidence > 1", "confidence_invalid"), (f"valid_until is not null and {EPOCH + 20 * DAY} >= valid_until", "expired"), ("source_trust < 1000", "source_trust_too_low"), ("evidence_weight < 0", "evidence_weight_too_low")]
_STRICT = [("confidence < 0.8", "confidence_too_low"), ("confidence <= 0 or confidence > 1", "confidence_invalid"), (f"valid_until is not null and {EPOCH + 20 * DAY} >= valid_until", "expired"), (f"{EPOCH + 20 * DAY} - created_at > 3600", "too_old"), ("source_trust < 5000", "source_trust_too_low"), ("evidence_weight <= 0", "missing_evidence"), ("evidence_weight < 0.5", "evidence_weight_too_low")]


def _trust(checks: list) -> str:
    return "case " + " ".join(f"when {c} then '{n}'" for c, n in checks) + " else 'acceptable' end"


@query(f"select local_id, {_trust(_FAIL)} as by_default, {_trust(_STRICT)} as by_strict from mappings", "mappings")
def mapping_trust(m):
    t = EPOCH + 20 * DAY
    return m.mappings().select("local_id", federation.trust_check(federation.TrustPolicy(), t).alias("by_default"), federation.trust_check(federation.TrustPolicy.strict(), t).alias("by_strict"))


@query(f"select local_id, remote_base, remote_id from mappings where confidence > 0 and confidence <= 1 and (valid_until is null or {EPOCH + 20 * DAY} < valid_until)", "mappings")
def find_mappings_valid(m):
    ids = m.table("documents").select(F.col("doc_id").alias("local_id"))
    return federation.find_mappings(m.mappings(), ids, EPOCH + 20 * DAY).select("local_id", "remote_base", "remote_id")


@query("""select distinct s.shard_id, s.node_num, h.relevance, case when s.shard_id = 0 then 0 else 1 end as hops, case when s.shard_id = 0 then s.trust else least(s.trust, s.shard_trust) end as path_trust
    from shards s join (select node_num, count(distinct term) / 2 as relevance from postings where term in ('the', 'of') group by node_num) h using (node_num)
    where (s.shard_id = 0 or s.shard_trust >= 100) and case when s.shard_id = 0 then s.trust else least(s.trust, s.shard_trust) end >= 1000""", "shards", "postings")
def federated_discover(m):
    return federation.discover(m.shards(), m.occurrences(), federation.DiscoverRequest(tuple(TERMS)))


@query("""select distinct s.shard_id, s.node_num, h.relevance, w.hops, least(s.trust, w.bound) as path_trust
    from shards s join (select node_num, count(distinct term) / 2 as relevance from postings where term in ('the', 'of') group by node_num) h using (node_num)
    join (values (0, 0, 10000), (1, 1, 6000), (2, 2, 3000)) as w(shard_id, hops, bound) on w.shard_id = s.shard_id where least(s.trust, w.bound) >= 1000 and s.domain_mask & 3 <> 0 and s.created_at >= 1704326400 and s.created_at < 1705708800""", "shards", "postings")
def federated_hops(m):
    """Forwarded from base to base, over two hops of a chain of three, within a domain and a time."""
    req = federation.DiscoverRequest(tuple(TERMS), domain_mask=3, created_from=EPOCH + 3 * DAY, created_to=EPOCH + 19 * DAY, max_hops=2)
    return federation.discover(m.shards(), m.occurrences(), req, [(0, 1, 6000), (1, 2, 3000), (2, 3, 9000), (1, 0, 9000), (0, 3, 50)])


@query("select l_orderkey, round(sum(l_discount), 6)::double as weight from lineitem group by l_orderkey")
def evidence_weights(m):
    """The lines of an order as evidence for a mapping."""
    e = m.table("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_discount").alias("weight"))).alias("evidence"))
    return e.select("l_orderkey", F.round(federation.evidence_weight(F.col("evidence")), 6).alias("weight"))


@query("""with d as (select src, dst, confidence from edges where edge_type = 'DERIVED_FROM'), a as (select c_custkey + 3000000000 as node, 1000 + c_custkey % 9 * 1000 as trust from customer),
    p1 as (select 6000000000 + o_orderkey as node, d.dst as origin, 1 as depth, least(9000, d.confidence, coalesce(a.trust, d.confidence)) as trust from orders join d on d.src = 6000000000 + o_orderkey left join a on a.node = d.dst),
    p2 as (select p1.node, d.dst as origin, 2 as depth, max(least(p1.trust, d.confidence)) as trust from p1 join d on d.src = p1.origin group by all),
    p3 as (select p2.node, d.dst as origin, 3 as depth, max(least(p2.trust, d.confidence)) as trust from p2 join d on d.src = p2.origin group by all)
    select node, node as origin, 0 as depth, 9000 as trust from (select 6000000000 + o_orderkey as node from orders) union all select * from p1 union all select * from p2 union all select * from p3""", "edges")
def provenance_trust(m):
    """Chains of orders, with the trust of each path; customers are atoms with a trust of their own."""
    start = m.table("orders").select((F.lit(6 * BILLION) + F.col("o_orderkey")).alias("node"), F.lit(9000).alias("trust"))
    atoms = m.table("customer").select((F.lit(3 * BILLION) + F.col("c_custkey")).alias("node_num"), (1000 + F.col("c_custkey") % 9 * 1000).cast("int").alias("trust"))
    return registry.provenance_chain(m.current_edges(), start, m.claims(), atoms, 3).select("node", "origin", "depth", F.col("trust").cast("int").alias("trust"))


@query(f"select atom_id, trust from atoms where node_num - 7000000000 in (select remote_id from mappings where {_trust(_FAIL)} = 'acceptable')", "atoms", "mappings")
def fetch_trusted(m):
    a = m.atoms().withColumn("remote_id", F.col("node_num") - 7 * BILLION)
    return federation.fetch_trusted(a, m.mappings(), federation.TrustPolicy(), EPOCH + 20 * DAY).select("atom_id", "trust")


@query("select local_id, remote_base, remote_id from mappings where confidence > 0 and confidence <= 1", "mappings")
def mapping_first(m):
    from .operators.federation import first_mapping

    ok = m.mappings().where("confidence > 0 and confidence <= 1")
    return first_mapping(ok.unionByName(ok.withColumn("remote_id", F.col("remote_id") + 1))).select("local_id", "remote_base", "remote_id")


@query("select round(avg(case when p_type = t then 1.0 else 0.0 end), 6)::double as compatibility, avg(case when p_type = t then 1.0 else 0.0 end) >= 0.5 as accepted from (select p_type, case when p_size > 25 then 'other' else p_type end as t from part)")
def negotiate_schemas(m):
    p = m.table("part").select(F.col("p_partkey").alias("field"), F.col("p_type").alias("type"), "p_size")
    r = federation.negotiate(p, p.withColumn("type", F.when(F.col("p_size") > 25, "other").otherwise(F.col("type"))))
    return r.select(F.round("compatibility", 6).alias("compatibility"), "accepted")


@query("""select doc_id as gap_id, s.shard_id, round(greatest(doc_id % 256, 1) / 255.0::double * 0.9 * 1.05 / 1.1 * (0.5 + s.trust / 10000.0) * (case when s.mask & 3 = 3 then 1.05 else 1.0 end), 6)::double as utility
    from documents, (values (0, 9000, 15), (1, 6000, 1), (2, 3000, 2), (3, 500, 12)) as s(shard_id, trust, mask) where s.trust >= 1000 and s.mask & 3 <> 0""")
def planner_federated(m):
    from .plans.planner import Shard, federated_utility, utility

    gaps = m.table("documents").select(F.col("doc_id").alias("gap_id"), utility(F.lit("FACT"), (F.col("doc_id") % 256).cast("int"), F.lit(1), 1000).alias("utility"))
    shards = [Shard(0, 9000, 15), Shard(1, 6000, 1), Shard(2, 3000, 2), Shard(3, 500, 12)]
    return federated_utility(gaps, shards, "FACT", 1000, 3).withColumn("utility", F.round("utility", 6))


# --- registries, evidence, provenance


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem where l_returnflag = 'R' and l_suppkey in (1, 2, 3) group by all")
def find_evidence(m):
    e = m.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("source"))
    return registry.find_by(e, kind="R", source=[1, 2, 3]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("select atom_id, 'trust' as kind, trust::bigint as value from atoms union all select atom_id, 'valid_to', valid_to from atoms where valid_to is not null", "atoms")
def find_metadata(m):
    return registry.find_by(registry.metadata_fields(m.atoms(), "atom_id", "trust", "domain_mask", "valid_to"), kind=["trust", "valid_to"])


@query("select source as label, max(doc_id) as at, arg_max(lang, doc_id) as kind from documents group by source")
def list_sources(m):
    """Every document registers its source once more, as of its language; the last one counts."""
    return registry.latest(m.table("documents").select(F.col("source").alias("label"), F.col("lang").alias("kind"), F.col("doc_id").alias("at")), "label")


_ENTITIES = """(select 3000000000 + c_custkey as entity_id, c_name as canonical_name, 'customer' as entity_type, c_mktsegment as alias from customer
    union all select 5000000000 + p_partkey, p_name, 'part', p_brand from part union all select 4000000000 + s_suppkey, s_name, 'supplier', null from supplier)"""


def _entities(m):
    one = lambda t, kind, base: m.table(t[0]).select((F.lit(base * BILLION) + F.col(t[1])).alias("entity_id"), F.col(t[2]).alias("canonical_name"), F.lit(kind).alias("entity_type"), (F.col(t[3]) if t[3] else F.lit(None).cast("string")).alias("alias"))
    e = one(("customer", "c_custkey", "c_name", "c_mktsegment"), "customer", 3).unionByName(one(("part", "p_partkey", "p_name", "p_brand"), "part", 5)).unionByName(one(("supplier", "s_suppkey", "s_name", None), "supplier", 4))
    return e.drop("alias").withColumn("aliases", F.array().cast("array<string>")), e.where("alias is not null").select("entity_id", "alias")


@query(f"select entity_id, canonical_name, entity_type, coalesce(alias, '') as aliases from {_ENTITIES}")
def alias_entities(m):
    e, aliases = _entities(m)
    return registry.add_aliases(e, aliases.unionByName(aliases)).withColumn("aliases", F.array_join("aliases", ","))


@query(f"select 6000000000 + entity_id as entity_id, canonical_name || ' (2)' as canonical_name, entity_type, entity_id as split_from from {_ENTITIES} where entity_type = 'part'")
def split_entities(m):
    e = _entities(m)[0]
    s = e.where("entity_type = 'part'").select(F.col("entity_id").alias("source_id"), (F.lit(6 * BILLION) + F.col("entity_id")).alias("entity_id"), F.concat("canonical_name", F.lit(" (2)")).alias("canonical_name"), "entity_type")
    return registry.split_entities(e, s).drop("aliases")


@query(f"select entity_id, canonical_name from {_ENTITIES} where lower(canonical_name) = 'customer#000000007' or lower(alias) = 'customer#000000007' or entity_type = 'CUSTOMER#000000007'")
def resolve_entity(m):
    return registry.resolve(_entities(m)[0], "CUSTOMER#000000007", "canonical_name", "entity_type").select("entity_id", "canonical_name")


@query("select p_partkey % 100 as predicate_id, max(p_partkey) as at, arg_max(p_brand, p_partkey) as stable_key, arg_max(p_name, p_partkey) as canonical_name from part group by 1")
def list_predicates(m):
    return registry.latest(m.table("part").select((F.col("p_partkey") % 100).alias("predicate_id"), F.col("p_brand").alias("stable_key"), F.col("p_name").alias("canonical_name"), F.col("p_partkey").alias("at")), "predicate_id")


@query("""with d as (select src, dst from edges where edge_type = 'DERIVED_FROM'),
    p1 as (select src as node, dst as origin, 1 as depth from d where src >= 6000000000), p2 as (select p1.node, d.dst as origin, 2 as depth from p1 join d on d.src = p1.origin), p3 as (select p2.node, d.dst as origin, 3 as depth from p2 join d on d.src = p2.origin)
    select node, origin, min(depth)::int as depth from (select * from p1 union all select * from p2 union all select * from p3) group by all""", "edges")
def provenance_path(m):
    start = m.table("orders").select((F.lit(6 * BILLION) + F.col("o_orderkey")).alias("node"))
    return registry.provenance(m.current_edges(), start)


@query("select distinct l_orderkey as subject, l_partkey as object from lineitem l where not exists (select 1 from lineitem r where r.l_returnflag = 'R' and r.l_orderkey = l.l_orderkey and r.l_partkey = l.l_partkey)")
def assert_relations(m):
    r = m.table("lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_partkey").alias("object"), "l_returnflag")
    return lifecycle.append_new(r.where("l_returnflag = 'R'"), r.drop("l_returnflag"), ["subject", "object"])


@query("select doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') as atom_id from documents")
def content_ids(m):
    return m.table("documents").select("doc_id", lifecycle.content_id("source", "doc_id", "lang").alias("atom_id"))


@query(r"select distinct 11000000000 + conv_id as node_num, term from (select conv_id, unnest(regexp_split_to_array(lower(text), '\s+')) as term from conversations) where term <> ''")
def rebuild_index(m):
    return R.index_text(m.table("conversations"), F.lit(11 * BILLION) + F.col("conv_id"))


@query("select subj, pred, n_objects, case when n_objects = 2 then 'resolved' else 'open' end as status from (select subj, pred, count(distinct obj)::int as n_objects from active group by subj, pred) where n_objects > 1", "active")
def conflict_policy(m):
    s = inference.conflict_sets(m.active_claims())
    return s.select("subj", "pred", "n_objects", registry.conflict_status(s, "prefer_trusted").alias("status"))


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem where l_orderkey % 4 <> 0 or l_orderkey % 3 in (0, 1) group by all")
def context_scope(m):
    c = m.table("lineitem").withColumn("branch", F.when(F.col("l_orderkey") % 4 == 0, F.col("l_orderkey") % 3))
    return c.where(K.context_allowed(F.col("branch"), [0, 1])).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


_THREE = "((" + ")::int + (".join(f"({_STATUS[k]}) = 'satisfied'" for k in ("trust", "type", "source")) + ")::int)"


@query(f"select atom_id, {_THREE} = 3 as q_all, {_THREE} >= 1 as q_any, {_THREE} >= 2 as q_two, {_THREE} = 1 as q_one from atoms", "atoms")
def quantified_conditions(m):
    r, ids = K.evaluate_all(m.atoms(), CONSTRAINTS), ["trust", "type", "source"]
    q = lambda kind, n=0: K.quantified(F.col("results"), ids, kind, n)
    return r.select("atom_id", q("all").alias("q_all"), q("any").alias("q_any"), q("at_least", 2).alias("q_two"), q("exactly", 1).alias("q_one"))


@query("""with u as (select vec_id, embedding::double[] as e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n from embeddings)
    select vec_id, round(list_sum(list_transform(e, lambda x: x / n)), 5)::double as total, round(list_max(list_transform(e, lambda x: x / n)), 5)::double as greatest from u""")
def normalize_vectors(m):
    u = S.normalize(F.col("embedding"))
    return m.table("embeddings").select("vec_id", u.alias("u")).select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.array_max("u").cast("double"), 5).alias("greatest"))


@query("select l_orderkey, round(case when count(distinct l_partkey % 50) filter (l_partkey % 50 >= 5) = 0 then 0 else 100.0 * count(distinct l_partkey % 50) filter (l_partkey % 50 >= 5) / sum(l_quantity) end, 6)::double as ratio from lineitem group by l_orderkey")
def marginal_ratio(m):
    g = m.table("lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_partkey") % 50).cast("int")).alias("gaps"), F.sum("l_quantity").alias("cost"))
    return g.select("l_orderkey", F.round(C.marginal_ratio(F.col("gaps"), F.array(*map(F.lit, range(5))), F.col("cost")), 6).alias("ratio"))


@query("select source_id, round(count(distinct domain_mask) / sum(io_bytes), 9)::double as efficiency from atoms group by source_id", "atoms")
def cost_efficiency(m):
    g = m.atoms().groupBy("source_id").agg(F.count_distinct("domain_mask").alias("covered"), F.sum("io_bytes").alias("cost"))
    return g.select("source_id", F.round(C.efficiency(F.col("covered"), F.col("cost")), 9).alias("efficiency"))


@query()
def search_semantic_ann(m):
    """The queries of search_semantic_topk over an index in the shared folder."""
    from .operators import ann
    from .sources.shared import new_table

    path = new_table(m.spark, "ann")
    centroids = ann.build(m.embeddings(), path)
    return ann.search_all(m.spark, path, centroids, m.embeddings(), every=EVERY)
