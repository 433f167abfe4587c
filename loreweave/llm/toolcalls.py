"""Tool-call linking: calls meet their results by identifier, are ordered by what they depend on, checked against schemas and written as canonical JSON.

Defined results
* A call without a result has the result null; a result without a call is listed under "orphans".
* Null conversation ids or call ids: left out (nothing can link them). Calls or results that repeat an
  identifier: the first by (turn, arguments or content) counts.
* Order: a call comes after those it depends on; among those free to go, by (turn, call id). Unknown and
  null dependencies bind nothing. Calls on a cycle, and what depends on them, come last, in the same
  order, with "cyclic": true.
* Null arguments count as {}. Listed as errors, with their path: arguments that aren't a JSON object, unknown tools,
  and what the tool's JSON Schema (type, enum, const, properties, required, additionalProperties, items, bounds) refuses.
* Arguments that can't be JSON values are kept as their text, with the error: no JSON (NaN and Infinity too), a number
  beyond double range, more than MOST_DEPTH levels. Of an object's repeated names the last holds.
* Canonical JSON: sorted keys, no blanks, UTF-8 unescaped but for lone surrogates, integral numbers without a fraction.
* A conversation is one row of output, so one task holds it whole; calls and results are shuffled once, by conversation.
* Empty tables: no rows. Extra columns are ignored. Very long texts are kept whole.
"""

from __future__ import annotations

import heapq
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def _object(required: dict[str, str], optional: dict[str, str] | None = None) -> dict:
    return {"type": "object", "properties": {k: {"type": t} for k, t in {**required, **(optional or {})}.items()}, "required": [*required], "additionalProperties": False}


SCHEMAS = {
    "search": _object({"query": "string", "limit": "integer"}),
    "lookup": _object({"key": "string"}, {"strict": "boolean"}),
    "write": _object({"text": "string", "words": "integer"}),
}
MOST_DEPTH = 128
_NUMBER = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: _NUMBER(v) and v == int(v),
    "number": _NUMBER,
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
}
_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    def plain(v):
        if isinstance(v, float) and math.isfinite(v) and v == int(v):
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    text = _ENCODER.encode(plain(value))
    return text if text.isascii() else _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _float(text: str) -> float:
    v = float(text)
    if not math.isfinite(v):
        raise OverflowError(text)
    return v


def _no_constant(text: str):
    raise ValueError(text)


def _depth(value) -> int:
    depth, level = 0, [value]
    while level := [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]:
        depth += 1
    return depth


def faults(value, schema: dict, path: str = "") -> list[str]:
    """What a JSON Schema refuses, each with its path."""
    at = lambda k: f"{path}.{k}" if path else str(k)
    here = path or "arguments"
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    if types and not any(_TYPES[t](value) for t in types):
        return [f"{here} is not {' or '.join(types)}"]
    out = []
    if "enum" in schema and not any(value == x and type(value) is type(x) for x in schema["enum"]):
        out.append(f"{here} is not in the enum")
    if "const" in schema and (value != schema["const"] or type(value) is not type(schema["const"])):
        out.append(f"{here} is not the constant")
    if _NUMBER(value):
        out += [f"{here} is below {schema['minimum']}"] if value < schema.get("minimum", -math.inf) else []
        out += [f"{here} is above {schema['maximum']}"] if value > schema.get("maximum", math.inf) else []
    if isinstance(value, (str, list)):
        least, most = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if not schema.get(least, 0) <= len(value) <= schema.get(most, math.inf):
            out.append(f"{here} has a length of {len(value)}")
    if isinstance(value, dict):
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"missing {at(k)}" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += faults(v, known[k], at(k))
            elif others is False:
                out.append(f"undeclared {at(k)}")
            elif isinstance(others, dict):
                out += faults(v, others, at(k))
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, v in enumerate(value):
            out += faults(v, schema["items"], f"{here}[{i}]")
    return out


def check(name: str | None, arguments: str | None, schemas: dict) -> tuple[object, list[str]]:
    """The parsed arguments and what is wrong with them, sorted."""
    try:
        args = json.loads(arguments, parse_float=_float, parse_constant=_no_constant) if arguments is not None else {}
    except OverflowError:
        return arguments, ["number out of range"]
    except RecursionError:
        return arguments, ["nested too deeply"]
    except ValueError:
        return arguments, ["not JSON"]
    if _depth(args) > MOST_DEPTH:
        return arguments, ["nested too deeply"]
    if not isinstance(args, dict):
        return args, ["not an object"]
    if name not in schemas:
        return args, ["unknown tool"]
    return args, sorted(faults(args, schemas[name]))


def order(calls: list[tuple[int, str, list[str]]]) -> tuple[list[int], int]:
    """Indices of (turn, call id, depends on) in topological order, and how many of them aren't on or after a cycle."""
    index = {c[1]: i for i, c in enumerate(calls)}
    after: dict[int, list[int]] = {i: [] for i in range(len(calls))}
    waits = [0] * len(calls)
    for i, (_, _, needs) in enumerate(calls):
        for d in {index[x] for x in needs or [] if x in index}:
            after[d].append(i)
            waits[i] += 1
    ready = [(calls[i][0], calls[i][1], i) for i in range(len(calls)) if not waits[i]]
    heapq.heapify(ready)
    out = []
    while ready:
        i = heapq.heappop(ready)[2]
        out.append(i)
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, (calls[j][0], calls[j][1], j))
    done = len(out)
    out += [i for _, _, i in sorted((calls[i][0], calls[i][1], i) for i in range(len(calls)) if waits[i])]
    return out, done


def tool_events(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results told by conversations without any: an assistant turn calls a tool, the user turn that follows is its result.

    The first, third, ... call of a conversation depends on the one after it. Every fifth turn number
    leaves out a required argument.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null and role in ('assistant', 'user')")
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    a = turns.where("role = 'assistant'").withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("turn").over(w))
    ident = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    text = F.coalesce("text", F.lit(""))
    n_words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    kind = F.pmod("turn", F.lit(3))
    gap = F.pmod("turn", F.lit(5)) == 0
    arguments = F.when(kind == 0, F.to_json(F.struct(text.alias("query"), F.when(~gap, n_words).alias("limit")))).when(kind == 1, F.to_json(F.struct(F.when(~gap, text).alias("key"), F.lit(True).alias("strict")))).otherwise(F.to_json(F.struct(text.alias("text"), F.when(~gap, n_words).alias("words"))))
    name = F.when(kind == 0, "search").when(kind == 1, "lookup").otherwise("write")
    calls = a.select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), F.when((F.col("n") % 2 == 1) & F.col("next").isNotNull(), F.array(ident(F.col("next")))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = turns.where("role = 'user' and turn > 0").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """(conv_id, n_calls, n_linked, n_invalid, n_orphans, json) of each conversation."""
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    c = calls.select("conv_id", "call_id", F.col("turn").cast("bigint").alias("turn"), "name", "arguments", "depends_on").where(keyed)
    r = results.select("conv_id", "call_id", F.col("turn").cast("bigint").alias("turn"), "content").where(keyed)

    def table(t: pa.Table, value: str) -> dict[str, dict]:
        """The first row of each identifier."""
        out: dict[str, dict] = {}
        for x in sorted(t.to_pylist(), key=lambda x: (x["turn"] is None, x["turn"] or 0, x[value] is None, x[value] or "")):
            out.setdefault(x["call_id"], x)
        return out

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        # a hash join by identifier
        asked, told = table(left, "arguments"), table(right, "content")
        calls_ = [asked[k] for k in sorted(asked)]
        at, done = order([(x["turn"] or 0, x["call_id"], x["depends_on"]) for x in calls_])
        out, invalid, linked = [], 0, 0
        for n, i in enumerate(at):
            x = calls_[i]
            args, wrong = check(x["name"], x["arguments"], schemas)
            result = told.get(x["call_id"])
            invalid += bool(wrong)
            linked += result is not None
            item = {"id": x["call_id"], "name": x["name"], "arguments": args, "errors": wrong, "result": result["content"] if result is not None else None}
            out.append(item | ({"cyclic": True} if n >= done else {}))
        orphans = [{"id": k, "content": told[k]["content"]} for k in sorted(told) if k not in asked]
        conv = key[0].as_py()
        numbers = [pa.array([v], pa.int32()) for v in (len(calls_), linked, invalid, len(orphans))]
        text = canonical({"conversation": conv, "calls": out, "orphans": orphans})
        return pa.Table.from_arrays([pa.array([conv], pa.int64()), *numbers, pa.array([text], pa.large_string()).cast(pa.string())], ["conv_id", "n_calls", "n_linked", "n_invalid", "n_orphans", "json"])

    return c.groupBy("conv_id").cogroup(r.groupBy("conv_id")).applyInArrow(run, "conv_id bigint, n_calls int, n_linked int, n_invalid int, n_orphans int, json string")
