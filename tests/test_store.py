"""Commits, recovery, leases, and the operations of a base over them."""

import pytest

from loreweave.engine import Engine
from loreweave.store import LeaseError, Store

A = {"payload": "Water boils at hundred degrees", "atom_type": "fact", "claims": [(1, 7, 2)], "trust": 9000}
B = {"payload": "Water freezes at zero", "atom_type": "fact", "claims": [(1, 8, 3)]}


class Lost(Exception):
    pass


@pytest.mark.parametrize("stage", ["leased", "staged", "committed"])
def test_a_writer_that_is_lost(spark, tmp_path, stage):
    """Before its commit nothing of an ingest is seen, after it everything."""
    def fail(at):
        if at == stage and armed:
            raise Lost

    armed = False
    e = Engine(spark, f"file://{tmp_path}/base", fail)
    e.batch_ingest([A])
    armed = True
    with pytest.raises(Lost):
        e.batch_ingest([B])
    e = Engine(spark, f"file://{tmp_path}/base")
    n = 2 if stage == "committed" else 1
    assert e.get_stats().first()["atoms"] == e.claims().count() == e.history().count() == n
    assert e.verify_integrity().count() == 0
    assert e.store.recover() == (4 if stage == "staged" else 0) and e.store.recover() == 0
    e.batch_ingest([B])
    assert e.get_stats().first()["atoms"] == 2


def test_one_writer_at_a_time(spark, tmp_path, monkeypatch):
    tables = {"t": "x int"}
    one, two = Store(spark, f"file://{tmp_path}/b", tables), Store(spark, f"file://{tmp_path}/b", tables)
    with one.lease():
        with pytest.raises(LeaseError):
            two.commit({"t": [(1,)]})
        one.commit({"t": [(2,)]})
    two.commit({"t": [(3,)]})
    assert sorted(r[0] for r in one.read("t").collect()) == [2, 3]
    (tmp_path / "b" / "_lease").touch()  # of a writer that is gone
    monkeypatch.setattr("loreweave.store.LEASE_SECONDS", -1)
    two.commit({"t": [(4,)]}, ["t"])
    assert [r[0] for r in one.read("t").collect()] == [4]


def test_compaction_keeps_every_table(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/base")
    a, b = e.batch_ingest([A, B])
    new = e.update_atom(b, "Water freezes at zero degrees", "FACT", [(1, 8, 4)])
    e.attach_atom_source(a, e.register_source("book", "Physics"))
    e.delete_atom(a, "wrong")
    want = {t: e.table(t).distinct().count() for t in ("history", "atom_sources", "tombstones", "supersedes", "sources")}
    assert e.compact() > 5
    assert {t: e.table(t).count() for t in want} == want
    assert [r["atom_id"] for r in e.atoms().collect()] == [new] == [r["atom_id"] for r in e.table("atoms").collect()]
    assert e.search_lex("degrees").count() == 1 and e.verify_integrity().count() == 0
    e.ingest(A["payload"], "FACT", A["claims"])
    assert e.atoms().count() == 1  # what was deleted stays so


def test_repair_and_unknown_ids(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/base")
    a = e.ingest("one two", "FACT", [(1, 7, 2)])
    e.store.commit({"claims": [("nobody", 5, 5, 5, 1, 0)], "postings": [("lost", 9)]})
    assert e.verify_integrity().count() == 1 and e.repair() == (1, 0)
    assert {r["term"] for r in e.table("postings").collect()} == {"one", "two"}
    for wrong in (lambda: e.update_atom("x", "p", "FACT", [(1, 1, 1)]), lambda: e.delete_atom("x"), lambda: e.split_entity(5, "n", "t"), lambda: e.branch_context(77), lambda: e.merge_entities(1, 2)):
        with pytest.raises(KeyError):
            wrong()
    assert e.export_atom(a).first()["claims"][0]["object_value"] == 2 and e.export_atom("x").count() == 0


def test_export_and_import_again(spark, tmp_path):
    from loreweave.sources import exchange

    one, two = Engine(spark, f"file://{tmp_path}/one"), Engine(spark, f"file://{tmp_path}/two")
    ids = one.batch_ingest([A, B])
    for fmt in ("ndjson", "csv"):
        exchange.write_atoms(one.export_atoms(), f"{tmp_path}/out-{fmt}", fmt)
        assert two.ingest_file(f"{tmp_path}/out-{fmt}", fmt)[0] == 2
    assert {r["atom_id"] for r in two.atoms().collect()} == set(ids) and two.claims().count() == 2
    assert [r["id"] for r in one.export_atoms("1:8:3:3").collect()] == [ids[1]]


def test_contexts_branches_and_provenance(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/base")
    a, b = e.batch_ingest([{"payload": "apples are red", "atom_type": "fact", "claims": [(10, 7, 20)]}, {"payload": "apples are green", "atom_type": "fact", "claims": [(10, 7, 21)]}])
    root = e.create_context()
    pack = e.query({"targets": [{"node_id": 10}]}, ctx=root)
    assert [(x["subj"], x["pred"], x["obj"], x["parent_ctx"]) for x in pack.branches] == [(10, 7, 21, root)] and pack.claims == [{"subj": 10, "pred": 7, "obj": 20, "trust": 5000}]
    child = e.branch_conflicts(pack)[0]
    row = e.list_contexts().where(f"ctx_id = {child}").first()
    assert row["parent_ctx"] == root and row["reason"] == "10 has 20 for 7"
    words = {"targets": [{"label": "10 7"}]}
    assert not e.query(words).nodes and [r["rejected_by"] for r in e.query(words).rejected] == ["context"]
    assert [n["atom_type"] for n in e.query(words, ctx=child).nodes] == ["HYPOTHESIS"]
    assert [n["atom_type"] for n in e.query(words | {"context": {"allowed": [child]}}).nodes] == ["HYPOTHESIS"]
    nodes = {r["atom_id"]: r["node_num"] for r in e.atoms().collect()}
    e.add_edge(nodes[a], nodes[b], "DERIVED_FROM", 8000)
    e.add_edge(nodes[b], nodes[a], "DERIVED_FROM", 8000)  # a cycle ends
    e.add_edge(nodes[b], 99, "DERIVED_FROM", 6000)
    chain = {r["origin"]: (r["depth"], r["trust"]) for r in e.get_provenance_path(a).collect()}
    assert chain == {nodes[a]: (0, 5000), nodes[b]: (1, 5000), 99: (2, 5000)}


def test_predicates_and_relations(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/base")
    many, one = e.register_predicate("a.b", "a", "d"), e.register_predicate("c.d", "c", "d", cardinality="one")
    assert many != one and e.register_predicate("a.b", "again", "d") == many
    r = [e.assert_relation(1, many, o) for o in (5, 6)]
    with pytest.raises(ValueError):
        e.transition_relation(r[0], 7)
    e.transition_relation(e.assert_relation(1, one, 5), 7)
    e.repair_relation_contexts(dry_run=False)
    assert e.audit_relation_contexts().count() == 0
    e.ingest("an orphan", "FACT", [(4, one, 4)])
    assert [x["finding"] for x in e.audit_relation_contexts().collect()] == ["orphan"]
    e.repair_relation_contexts(dry_run=False)
    assert e.audit_relation_contexts().count() == 0 and e.claims().where("subj = 4").count() == 0
    x, y, z = (e.create_entity(n, "t") for n in "xyz")
    e.merge_entities(y, x)
    assert e.merge_entities(x, z) == y  # x itself has become y
