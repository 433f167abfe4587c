from loreweave.engine import Bases


def test_a_base_from_ingest_to_snapshot(spark, tmp_path):
    bases = Bases(spark)
    e = bases.connect_base("one", f"file://{tmp_path}/one")
    assert bases.active_base() == "one" and bases.list_bases() == ["one"] and bases.switch_base("one") is e
    a, b = e.batch_ingest([
        {"payload": "Water boils at hundred degrees", "atom_type": "fact", "claims": [(1, 7, 2)], "trust": 9000},
        {"payload": "Water freezes at zero", "atom_type": "fact", "claims": [(1, 8, 3)]},
    ])
    assert e.ingest("Water freezes at zero", "FACT", [(1, 8, 3)]) == b  # twice changes nothing
    assert e.get_stats().first().asDict() == {"atoms": 2, "current_atoms": 2, "current_claims": 2, "active_relations": 0, "edges": 0}
    assert {r["atom_id"] for r in e.search_lex("water").collect()} == {a, b}
    assert [r["atom_id"] for r in e.search_lex("Water", trust_min=6000).collect()] == [a]
    new = e.update_atom(b, "Water freezes at zero degrees", "FACT", [(1, 8, 4)])
    assert {r["atom_id"] for r in e.atoms().collect()} == {a, new}
    assert e.verify_integrity().count() == 0
    pack = e.query({"targets": [{"label": "water degrees"}]})
    assert pack.status in ("complete", "insufficient_evidence") and {n["atom_id"] for n in pack.nodes} <= {a, new} and pack.nodes
    assert bases.query_base("one", {"targets": [{"label": "nothing here"}]}).status == "no_match"
    assert '"status": "partial"' in e.explain_answer_graph({"targets": [{"label": "water degrees"}]}, max_bytes=10)
    e.delete_atom(new, "wrong")
    assert [r["atom_id"] for r in e.atoms().collect()] == [a]
    assert [r["action"] for r in e.history(1).collect()] == ["delete"]
    e.snapshot(f"{tmp_path}/two")
    two = bases.connect_base("two", f"file://{tmp_path}/two")
    assert two.get_stats().first()["atoms"] == 1 and two.search_lex("boils").count() == 1
    assert e.validate_query_contract({"targets": []}) == "empty contract" and e.validate_query_contract(e.compile_query_contract("compare a and b")) is None


def test_graph_registries_relations_and_contexts(spark, tmp_path):
    e = Bases(spark).connect_base("b", f"file://{tmp_path}/b")
    for s, d, t in ((1, 2, "SUPPORTS"), (2, 3, "DERIVED_FROM"), (3, 4, "DERIVED_FROM"), (1, 9, "CAUSES")):
        e.add_edge(s, d, t)
    e.delete_edge(1, 9, "CAUSES")
    assert [(r["direction"], r["node"]) for r in e.graph_neighbors(2).collect()] == [("out", 3), ("in", 1)]
    assert {(r["src"], r["dst"]) for r in e.graph_walk([1]).collect()} == {(1, 2), (2, 3)}
    assert [r["node"] for r in e.extract_subgraph(1).collect()] == [1, 2, 3]
    assert e.search_graph(edge_type="DERIVED_FROM").count() == 2
    s = e.register_source("book", "Physics")
    assert e.register_source("book", "Physics") == s and e.list_sources().count() == 1
    e.attach_atom_source("x", s)
    e.attach_atom_source("x", s)
    assert e.atom_sources().count() == 1
    p = e.register_predicate("has.part", "has part", "whole to part")
    assert p >= 0x80000000 and e.resolve_predicate("HAS PART").first()["predicate_id"] == p == e.get_predicate(p).first()["predicate_id"]
    one, two = e.create_entity("Ada", "person"), e.create_entity("A. L.", "person")
    e.alias_entity(one, "Lovelace")
    e.alias_entity(one, "Lovelace")
    e.merge_entities(one, two)
    three = e.split_entity(one, "Ada the ship", "ship")
    got = {r["entity_id"]: r for r in e.list_entities().collect()}
    assert set(got) == {one, three} and got[one]["aliases"] == ["Lovelace"] and got[three]["split_from"] == one
    r = e.assert_relation(one, p, 5)
    assert e.assert_relation(one, p, 5) == r and e.relations().count() == 1
    t = e.transition_relation(r, 6)
    c = e.correct_relation(t, one, p, 7)
    assert [(x["relation_id"], x["object"], x["supersedes"]) for x in e.relations().collect()] == [(c, 7, t)]
    assert [x["finding"] for x in e.audit_relation_contexts().collect()] == ["missing"]
    assert [x["action"] for x in e.repair_relation_contexts().collect()] == ["assert"]
    e.repair_relation_contexts(dry_run=False)
    assert e.audit_relation_contexts().count() == 0
    e.add_claim(one, p, 8)
    assert [(x["subj"], x["n_objects"]) for x in e.list_conflicts().collect()] == [(one, 2)]
    root = e.create_context()
    child = e.branch_context(root)
    assert {x["ctx_id"]: x["parent_ctx"] for x in e.list_contexts().collect()} == {root: None, child: root}
    v = spark.createDataFrame([(1, [1.0, 0.0], 9), (2, [0.0, 1.0], 9)], "node_num bigint, embedding array<float>, trust int")
    e.add_vectors(v)
    assert [x["node_num"] for x in e.search_semantic([0.9, 0.1], 1).collect()] == [1]
