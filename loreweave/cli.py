"""The command line: ``python -m loreweave COMMAND``, one command for each operation on a base.

``serve`` answers a line of JSON ({"tool", "params"}) with one, for every public method of a base, on a loopback
socket; ``client`` sends such a line. Results are printed as JSON, one row a line, or as text.
"""

from __future__ import annotations

import argparse
import json
import socketserver
import sys
from dataclasses import asdict, is_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Bases, Engine
from .operators import extraction
from .plans.contract import Constraint, Contract, read_contract, to_json
from .sources import exchange


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loreweave", description="A knowledge base over Spark.")
    p.add_argument("--output", choices=("json", "text"), default="json")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        c.add_argument("-b", "--base", required=name != "client", help="the base's folder")
        return c

    command("init", "make an empty base")
    c = command("ingest", "add atoms from files, or claims from plain text")
    c.add_argument("files", nargs="+")
    c.add_argument("-a", "--atom-type", default="fact")
    c.add_argument("--format", choices=("json", "ndjson", "yaml", "csv"), default="json")
    c.add_argument("--extract-claims", action="store_true", help="read plain text and propose claims")
    c.add_argument("--dry-run", action="store_true")
    c = command("query", "ask in words or by a contract")
    c.add_argument("query", nargs="?")
    c.add_argument("--contract", help="a contract's JSON or YAML file")
    c.add_argument("--emit-contract", action="store_true", help="print the contract instead")
    c.add_argument("--include-trace", action="store_true")
    c.add_argument("--explain-rejections", action="store_true")
    c.add_argument("--ctx", type=int, default=0)
    c.add_argument("-l", "--limit", type=int)
    c.add_argument("--min-trust", type=int)
    c = command("export", "write live atoms to a folder")
    c.add_argument("path")
    c.add_argument("--format", choices=("json", "ndjson", "yaml", "csv"), default="ndjson")
    c.add_argument("--filter")
    c = command("import", "add exported atoms")
    c.add_argument("path")
    c.add_argument("--format", choices=("json", "ndjson", "yaml", "csv"), default="ndjson")
    c.add_argument("--skip-validation", action="store_true")
    command("compact", "rewrite the tables in place")
    command("stats", "count atoms, claims, relations and edges")
    command("verify-integrity", "check ids and orphans")
    command("rebuild-index", "make the postings anew")
    command("repair", "verify, rebuild, verify")
    c = command("history", "the last operations")
    c.add_argument("-l", "--limit", type=int, default=20)
    c = command("snapshot", "copy the live base to another folder")
    c.add_argument("path")
    c = command("create-entity", "add an entity")
    c.add_argument("name")
    c.add_argument("entity_type")
    c.add_argument("--alias", action="append", default=[])
    c = command("add-entity-claim", "add a claim about an entity")
    for name in ("entity", "predicate", "object"):
        c.add_argument(name, type=int)
    c = command("create-relation", "assert a relation")
    for name in ("subject", "predicate", "object"):
        c.add_argument(name, type=int)
    c = command("serve", "answer tools on a loopback socket")
    c.add_argument("--port", type=int, default=0)
    c.add_argument("--requests", type=int, help="end after so many")
    c = command("client", "send a tool's call to a server")
    c.add_argument("--port", type=int, required=True)
    c.add_argument("tool")
    c.add_argument("params", nargs="?", default="{}", help="JSON")
    return p


def plain(value: Any) -> Any:
    """A result as JSON values."""
    if isinstance(value, DataFrame):
        return [r.asDict(recursive=True) for r in value.collect()]
    if isinstance(value, Contract):
        return json.loads(to_json(value))
    if is_dataclass(value):
        return asdict(value)
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value if value is None or isinstance(value, (str, int, float, bool, dict)) else str(value)


def call(engine: Engine, request: dict[str, Any]) -> dict[str, Any]:
    """A public method of a base by its name; the result, or what was wrong."""
    tool, params = request.get("tool", ""), request.get("params", {})
    method = getattr(engine, str(tool), None)
    if str(tool).startswith("_") or not callable(method):
        return {"error": f"unknown tool {tool}"}
    try:
        return {"result": plain(method(**params))}
    except Exception as e:  # told to the caller; the server goes on
        return {"error": f"{type(e).__name__}: {e}"}


def serve(engine: Engine, port: int, requests: int | None, ready=lambda port: print(json.dumps({"port": port}), flush=True)) -> None:
    left = [requests]

    class Handler(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            for line in self.rfile:
                try:
                    out = call(engine, json.loads(line))
                except ValueError:
                    out = {"error": "not JSON"}
                self.wfile.write((json.dumps(out, sort_keys=True, default=str) + "\n").encode())
                if left[0] is not None:
                    left[0] -= 1

    with socketserver.TCPServer(("127.0.0.1", port), Handler) as server:
        ready(server.server_address[1])
        while left[0] is None or left[0] > 0:
            server.handle_request()


def send(port: int, tool: str, params: dict[str, Any]) -> dict[str, Any]:
    import socket

    with socket.create_connection(("127.0.0.1", port)) as s:
        s.sendall((json.dumps({"tool": tool, "params": params}) + "\n").encode())
        return json.loads(s.makefile().readline())


def ask(e: Engine, a: argparse.Namespace) -> Any:
    contract = read_contract(a.contract) if a.contract else e.compile_query_contract(a.query or "")
    if a.min_trust is not None:
        contract.constraints.append(Constraint("__min_trust", "trust", "gte", a.min_trust))
    if a.limit is not None:
        contract.output.max_items = a.limit
    if a.emit_contract:
        return contract
    out = plain(e.query(contract, ctx=a.ctx or None))
    out["nodes"] = out["nodes"][: a.limit]
    for key, on in (("trace", a.include_trace), ("rejected", a.explain_rejections)):
        if not on:
            del out[key]
    return out


def extract(e: Engine, a: argparse.Namespace) -> Any:
    """Claims that plain text seems to make: candidates, written only as proposals of hypotheses where it isn't a dry run."""
    text = e.spark.read.text(a.files, wholetext=True).select(F.crc32("value").alias("id"), F.col("value").alias("text"))
    found = extraction.claims(extraction.segments(text, "id"), "id")
    if a.dry_run:
        return found
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")
    claim = F.struct(number("subject").alias("subj"), number("predicate").alias("pred"), number("object").alias("obj"))
    atoms = found.select(F.concat_ws(" ", "subject", "predicate", "object").alias("payload"), F.lit("HYPOTHESIS").alias("atom_type"), F.array(claim).alias("claims"), F.lit(4500).alias("trust"))
    e.ingest_frame(atoms)
    return {"proposed": atoms.count()}


def run(spark: SparkSession, a: argparse.Namespace) -> Any:
    e = Bases(spark).connect_base("base", a.base)
    match a.command:
        case "init":
            e.commit({}, ("base", "init"))
            return {"base": a.base}
        case "ingest" if a.extract_claims:
            return extract(e, a)
        case "ingest":
            if a.dry_run:
                good, bad = exchange.checked(exchange.read_atoms(spark, a.files, a.format))
                return {"good": good.count(), "rejected": plain(bad)}
            n, bad = e.ingest_file(a.files, a.format, a.atom_type)
            return {"ingested": n, "rejected": plain(bad)}
        case "query":
            return ask(e, a)
        case "export":
            exchange.write_atoms(e.export_atoms(a.filter), a.path, a.format)
            return {"path": a.path}
        case "import":
            n, bad = e.ingest_file(a.path, a.format, None, a.skip_validation)
            return {"imported": n, "rejected": plain(bad)}
        case "compact":
            return {"removed": e.compact()}
        case "stats":
            return e.get_stats()
        case "verify-integrity":
            return e.verify_integrity()
        case "rebuild-index":
            return {"postings": e.rebuild_indexes()}
        case "repair":
            return dict(zip(("before", "after"), e.repair()))
        case "history":
            return e.history(a.limit)
        case "snapshot":
            e.snapshot(a.path)
            return {"path": a.path}
        case "create-entity":
            return {"entity_id": e.create_entity(a.name, a.entity_type, a.alias)}
        case "add-entity-claim":
            return {"atom_id": e.add_claim(a.entity, a.predicate, a.object)}
        case "create-relation":
            return {"relation_id": e.assert_relation(a.subject, a.predicate, a.object)}
        case "serve":
            return serve(e, a.port, a.requests)
    raise ValueError(a.command)


def show(value: Any, output: str) -> None:
    value = plain(value)
    if output == "text":
        for row in value if isinstance(value, list) else [value]:
            print(", ".join(f"{k}: {v}" for k, v in row.items()) if isinstance(row, dict) else row)
    else:
        print(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "client":
            show(send(a.port, a.tool, json.loads(a.params)), a.output)
            return 0
        out = run(spark or SparkSession.builder.appName("loreweave").getOrCreate(), a)
        if out is not None:
            show(out, a.output)
    except (ValueError, KeyError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0
