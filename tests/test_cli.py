"""The command line, and what a language model may hand in."""

import json
import threading

from loreweave import cli
from loreweave.plans import compiler, proposal
from loreweave.plans.contract import Contract, Target


def out(capsys):
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_commands(spark, tmp_path, capsys):
    base = f"file://{tmp_path}/base"
    atoms = [{"atom_type": "FACT", "payload": "V2F0ZXIgYm9pbHM=", "claims": [{"subject": 1, "predicate": 7, "object_tag": 3, "object_value": 2, "qualifiers": 0}]}, {"payload": "eA==", "claims": []}]
    (tmp_path / "in.json").write_text(json.dumps(atoms))
    (tmp_path / "text.txt").write_text("Cats chase mice. Dogs bark")

    def run(*args):
        assert cli.main([args[0], "-b", base, *args[1:]], spark) == 0
        return out(capsys)

    assert run("init") == {"base": base}
    assert run("ingest", f"{tmp_path}/in.json", "--dry-run")["good"] == 1
    got = run("ingest", f"{tmp_path}/in.json")
    assert got["ingested"] == 1 and got["rejected"][0]["problems"] == ["claims"]
    assert run("query", "boils", "--emit-contract")["intent"] == "lookup"
    found = run("query", "find water", "--min-trust", "1")
    assert "trace" not in found and found["status"] in ("complete", "no_match", "insufficient_evidence")
    assert run("ingest", f"{tmp_path}/text.txt", "--extract-claims", "--dry-run")[0]["subject"] == "Cats"
    assert run("ingest", f"{tmp_path}/text.txt", "--extract-claims") == {"proposed": 1}
    assert run("stats")[0]["atoms"] == 2 and run("verify-integrity") == []
    entity = run("create-entity", "Ada", "person", "--alias", "Lovelace")["entity_id"]
    run("add-entity-claim", str(entity), "7", "5")
    run("create-relation", str(entity), "7", "5")
    run("export", f"{tmp_path}/out", "--filter", f"{entity}:7")
    assert run("import", f"{tmp_path}/out")["imported"] == 1
    assert run("rebuild-index")["postings"] > 3 and run("repair") == {"before": 0, "after": 0} and run("compact")["removed"] > 0
    assert run("history", "-l", "50")[-1]["action"] == "init"
    run("snapshot", f"file://{tmp_path}/copy")
    assert cli.main(["--output", "text", "stats", "-b", f"file://{tmp_path}/copy"], spark) == 0 and "atoms: 3" in capsys.readouterr().out
    assert cli.main(["query", "-b", base, "--contract", f"{tmp_path}/none.json"], spark) == 1


def test_server_and_client(spark, tmp_path, capsys):
    from loreweave.engine import Engine

    e, ports, there = Engine(spark, f"file://{tmp_path}/base"), [], threading.Event()
    t = threading.Thread(target=cli.serve, args=(e, 0, 3, lambda port: (ports.append(port), there.set())), daemon=True)
    t.start()
    assert there.wait(20)
    assert cli.main(["client", "--port", str(ports[0]), "create_entity", '{"canonical_name": "Ada", "entity_type": "person"}']) == 0
    assert out(capsys)["result"] > 0
    assert [r["canonical_name"] for r in cli.send(ports[0], "list_entities", {})["result"]] == ["Ada"]
    assert "unknown tool" in cli.send(ports[0], "_entity", {})["error"]
    t.join(20)
    assert not t.is_alive()


def test_proposals():
    p = proposal.Proposal(Contract("lookup", [Target(label="x")]), "someone", "a model", 1, 7.0)
    assert p.confidence == 1.0 and not p.validated and proposal.judge(p).validated
    assert proposal.judge(proposal.Proposal(Contract("lookup"), "s", "m", 1, 1)).status is proposal.Validation.REJECTED
    assert proposal.judge(proposal.Proposal(p.value, "s", "m", 1, -3)).status is proposal.Validation.REVIEW


def test_goals_from_tokens():
    g = compiler.goal_from_tokens("Explain why 42 follows: the proof!")
    assert (g.intent, g.entities) == ("explain", [("term", 42), ("term", 1), ("term", 2)])
    assert compiler.goal_from_tokens("steps 1").intent == "plan" and compiler.goal_from_tokens("...").intent == "lookup"
