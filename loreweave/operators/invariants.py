"""Invariants: programs of 26 operations that admit an atom, reject it or ask for a branch.

The standard programs are columns (whole-stage code); any other program runs as a Python function over
Arrow batches. Numbers are unsigned 64-bit; registers are eight.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, FAIL_HARD, FAIL_SOFT, NEED_BRANCH = "PASS", "FAIL_HARD", "FAIL_SOFT", "NEED_BRANCH"
RESULTS = {0: PASS, 1: FAIL_HARD, 2: FAIL_SOFT, 3: NEED_BRANCH}
OPCODES = {
    "LD_ATOM_META": 1, "LD_CLAIM": 2, "LD_QC": 3, "LD_CTX": 4, "LD_IMM": 5,
    "EQ": 10, "LT": 11, "LE": 12, "GT": 13, "GE": 14, "IN_RANGE": 15, "HAS_BIT": 16, "IS_TAG": 17,
    "CHK_TIME": 20, "CHK_TRUST": 21, "CHK_DOMAIN": 22, "CHK_SOURCE": 23, "CTX_PROBE": 24, "RAISE_CONFLICT": 25,
    "AND": 26, "NOT": 27, "JZ": 30, "JMP": 31, "RET": 32, "JNZ": 33, "CALL": 34,
}
U64 = (1 << 64) - 1
REGISTERS = 8
MAX_STEPS = 10_000


@dataclass(frozen=True)
class Op:
    """An operation: register or result a, register or field b, immediate."""

    code: str
    a: int = 0
    b: int = 0
    imm: int = 0


@dataclass(frozen=True)
class Constraints:
    """What a query demands; None is open."""

    time_from: int | None = None
    time_to: int | None = None
    trust_min: int = 0
    domain_mask: int = 0
    sources: tuple[int, ...] | None = None
    max_results: int = 0


@dataclass
class Atom:
    valid_from: int | None = None
    valid_to: int | None = None
    atom_type: int = 0
    trust: int = 0
    domain_mask: int = 0
    source_id: int = 0
    claims: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # subj, pred, tag, value, qualifiers


def validate(program: list[Op], max_steps: int = MAX_STEPS) -> str | None:
    """What is wrong with a program, or None."""
    n = len(program)
    if any(op.code not in OPCODES for op in program):
        return "invalid opcode"
    if not any(op.code == "RET" for op in program):
        return "no RET"
    if n * 3 > max_steps:
        return "too large for the step budget"
    todo, seen = [0], set()
    while todo:
        i = todo.pop()
        if i in seen:
            continue
        if i >= n:
            return "runs past the end"
        seen.add(i)
        op = program[i]
        if op.code in ("JZ", "JNZ", "JMP", "CALL"):
            if not 0 <= op.imm < n:
                return "jump out of bounds"
            todo.append(op.imm)
        if op.code not in ("RET", "JMP", "RAISE_CONFLICT"):
            todo.append(i + 1)
    return None


def run(program: list[Op], atom: Atom, qc: Constraints, conflicts: dict[int, str] | None = None, ctx: tuple[int, ...] = (0, 0, 0), max_steps: int = MAX_STEPS) -> tuple[str, str]:
    """(result, reason). ``conflicts``: severity ("hard", "soft") by pattern hash. Errors reject hard."""
    if not program:
        return PASS, ""
    if validate(program, max_steps):
        return FAIL_HARD, "CORRUPT_SECTION"
    r = [0] * REGISTERS
    pc, steps, back = 0, 0, []
    meta = (atom.valid_from or 0, U64 if atom.valid_to is None else atom.valid_to, atom.atom_type, atom.trust, atom.domain_mask & U64, atom.source_id)
    want = (qc.time_from or 0, U64 if qc.time_to is None else qc.time_to, qc.trust_min, qc.domain_mask & U64, 0, qc.max_results)
    pick = lambda xs, i: xs[i] if 0 <= i < len(xs) else 0
    while pc < len(program):
        steps += 1
        if steps > max_steps:
            return FAIL_HARD, "BUDGET_EXCEEDED"
        op, pc = program[pc], pc + 1
        a, b = op.a % REGISTERS, op.b % REGISTERS
        match op.code:
            case "LD_ATOM_META":
                r[a] = pick(meta, op.b)
            case "LD_CLAIM":
                index, what = op.b & 0xFFFF, op.b >> 16
                claim = pick(atom.claims, max(0, index - 1)) if atom.claims and index <= len(atom.claims) else None
                r[a] = pick(claim, what) & U64 if claim else 0
            case "LD_QC":
                r[a] = pick(want, op.b)
            case "LD_CTX":
                r[a] = pick(ctx, op.b)
            case "LD_IMM":
                r[a] = op.imm & U64
            case "EQ":
                r[a] = int(r[a] == r[b])
            case "LT":
                r[a] = int(r[a] < r[b])
            case "LE":
                r[a] = int(r[a] <= r[b])
            case "GT":
                r[a] = int(r[a] > r[b])
            case "GE":
                r[a] = int(r[a] >= r[b])
            case "IN_RANGE":
                r[a] = int(op.imm & 0xFFFFFFFF <= r[a] <= op.imm >> 32)
            case "HAS_BIT":
                r[a] = r[a] >> (op.imm & 63) & 1
            case "IS_TAG":
                r[a] = int(r[a] == op.imm)
            case "AND":
                r[a] &= r[b]
            case "NOT":
                r[a] = ~r[a] & U64
            case "CHK_TIME":
                if not (meta[0] < want[1] and want[0] < meta[1]):
                    return FAIL_HARD, "TIME_INVALID"
            case "CHK_TRUST":
                if atom.trust < qc.trust_min:
                    return FAIL_HARD, "TRUST_TOO_LOW"
            case "CHK_DOMAIN":
                if qc.domain_mask and not atom.domain_mask & qc.domain_mask:
                    return FAIL_HARD, "DOMAIN_MISMATCH"
            case "CHK_SOURCE":
                if qc.sources is not None and atom.source_id not in qc.sources:
                    return FAIL_HARD, "SOURCE_DENIED"
            case "CTX_PROBE":
                severity = (conflicts or {}).get(r[a])
                if severity:
                    return (FAIL_HARD if severity == "hard" else NEED_BRANCH), "CONFLICT_FOUND"
            case "RAISE_CONFLICT":
                return (FAIL_HARD if op.imm == 0 else NEED_BRANCH), "CONFLICT_FOUND"
            case "JZ":
                pc = op.imm if r[a] == 0 else pc
            case "JNZ":
                pc = op.imm if r[a] != 0 else pc
            case "JMP":
                pc = op.imm
            case "CALL":
                back.append(pc)
                pc = op.imm
            case "RET":
                if back:
                    pc = back.pop()
                    continue
                return RESULTS.get(op.a, PASS), ""
    return FAIL_HARD, "CORRUPT_SECTION"


class Builder:
    """Writes programs with labels."""

    def __init__(self) -> None:
        self.ops: list[Op] = []
        self.labels: dict[str, int] = {}
        self.jumps: list[tuple[int, str]] = []

    def label(self, name: str) -> Builder:
        self.labels[name] = len(self.ops)
        return self

    def emit(self, code: str, a: int = 0, b: int = 0, imm: int = 0) -> Builder:
        self.ops.append(Op(code, a, b, imm))
        return self

    def jump(self, code: str, label: str, a: int = 0) -> Builder:
        self.jumps.append((len(self.ops), label))
        return self.emit(code, a)

    def build(self) -> list[Op]:
        out = list(self.ops)
        for i, name in self.jumps:
            out[i] = Op(out[i].code, out[i].a, out[i].b, self.labels[name])
        return out


BASIC = [Op("CHK_TIME"), Op("CHK_TRUST"), Op("CHK_DOMAIN"), Op("RET", 0)]
FULL = [Op("CHK_TIME"), Op("CHK_TRUST"), Op("CHK_DOMAIN"), Op("CHK_SOURCE"), Op("RET", 0)]


def tag_program(tag: int) -> list[Op]:
    """FULL, and the first claim's object has the tag."""
    return Builder().emit("CHK_TIME").emit("CHK_TRUST").emit("CHK_DOMAIN").emit("CHK_SOURCE").emit("LD_CLAIM", 1, 2 << 16).emit("IS_TAG", 1, imm=tag).jump("JZ", "bad", 1).emit("RET", 0).label("bad").emit("RET", 1).build()


def probe_program() -> list[Op]:
    """The conflict probe of the first claim's slot hash, which the caller puts into the context's first field."""
    return [Op("LD_CTX", 1, 0), Op("CTX_PROBE", 1), Op("RET", 0)]


def time_range_program(lo: int, hi: int) -> list[Op]:
    """Validity begins in [lo, hi], both ends included."""
    b = Builder().emit("LD_ATOM_META", 1, 0).emit("LD_IMM", 2, imm=lo).emit("LT", 1, 2).jump("JNZ", "bad", 1)
    return b.emit("LD_ATOM_META", 1, 0).emit("LD_IMM", 2, imm=hi).emit("GT", 1, 2).jump("JNZ", "bad", 1).emit("RET", 0).label("bad").emit("RET", 1).build()


def trust_program(least: int) -> list[Op]:
    return Builder().emit("LD_ATOM_META", 1, 3).emit("LD_IMM", 2, imm=least).emit("GE", 1, 2).jump("JZ", "bad", 1).emit("RET", 0).label("bad").emit("RET", 1).build()


def _time_ok(qc: Constraints) -> Column:
    hi = F.lit(True) if qc.time_to is None else F.coalesce("valid_from", F.lit(0)) < qc.time_to
    lo = F.lit(True) if qc.time_from is None else F.col("valid_to").isNull() | (F.lit(qc.time_from) < F.col("valid_to"))
    return hi & lo


def check_columns(program: list[Op], qc: Constraints) -> Column | None:
    """(result, reason) as a struct column, for programs that only check and return; None for any other."""
    checks = {
        "CHK_TIME": (_time_ok(qc), "TIME_INVALID"),
        "CHK_TRUST": (F.col("trust") >= qc.trust_min, "TRUST_TOO_LOW"),
        "CHK_DOMAIN": (F.lit(True) if not qc.domain_mask else F.col("domain_mask").bitwiseAND(F.lit(qc.domain_mask).cast("bigint")) != 0, "DOMAIN_MISMATCH"),
        "CHK_SOURCE": (F.lit(True) if qc.sources is None else F.col("source_id").isin(*qc.sources), "SOURCE_DENIED"),
    }
    if validate(program) or program[-1].code != "RET" or any(op.code not in checks for op in program[:-1]):
        return None
    result = lambda x, y: F.struct(F.lit(x).alias("result"), F.lit(y).alias("reason"))
    out = result(RESULTS.get(program[-1].a, PASS), "")
    for op in reversed(program[:-1]):
        ok, why = checks[op.code]
        out = F.when(~ok, result(FAIL_HARD, why)).otherwise(out)
    return out


def evaluate(atoms: DataFrame, program: list[Op], qc: Constraints, vm: bool = False, conflicts: dict[int, str] | None = None, ctx: tuple[int, ...] = (0, 0, 0)) -> DataFrame:
    """(atom_id, result, reason) of each atom; ``vm`` forces the interpreter.

    The interpreter also reads an atom's ``claims`` (subj, pred, tag, value, qualifiers), where there is such a column, and
    its own ``program`` (code, a, b, imm) in place of the one given; ``conflicts`` has severities by pattern hash.
    """
    column = None if vm else check_columns(program, qc)
    if column is not None:
        return atoms.select("atom_id", column.alias("v")).select("atom_id", "v.result", "v.reason")
    names = ["atom_id", "valid_from", "valid_to", "trust", "domain_mask", "source_id"]
    more = [c for c in ("claims", "program") if c in atoms.columns]

    def interpret(batches: Any) -> Any:
        for batch in batches:
            column = {c: batch.column(i).to_pylist() for i, c in enumerate([*names, *more])}
            out = []
            for i in range(batch.num_rows):
                f, t, u, d, s = (column[c][i] for c in names[1:])
                claims = [tuple(c.values()) for c in column["claims"][i] or []] if "claims" in column else []
                own = [Op(**o) for o in column["program"][i]] if column.get("program") and column["program"][i] is not None else program
                out.append(run(own, Atom(f, t, 0, u or 0, d or 0, s or 0, claims), qc, conflicts, ctx))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["atom_id", "result", "reason"])

    return atoms.select(*names, *more).mapInArrow(interpret, "atom_id string, result string, reason string")


def probe(claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Claims with the result of the conflict probe; ``conflicts``: (subj, pred, severity)."""
    c = conflicts.groupBy("subj", "pred").agg(F.max((F.col("severity") == "hard").cast("int")).alias("hard"))
    return claims.join(c, ["subj", "pred"], "left").withColumn("result", F.when(F.col("hard").isNull(), PASS).when(F.col("hard") == 1, FAIL_HARD).otherwise(NEED_BRANCH)).drop("hard")
