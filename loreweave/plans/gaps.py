"""Gaps: what has to be known to answer an intent, generated backwards from the goal's entities.

A gap is a dict: id, kind, priority, subj (a node or None), tag, edge_types, depth, seeds, covered.
Walks are seeded by the goal's entities for every intent.
"""

from __future__ import annotations

from typing import Any

CAUSAL = ("CAUSES", "ENABLES", "PREVENTS", "SUPPORTS")
SYM = 6

#: Intent -> (kind, priority, once or for each entity, edge types, depth, object tag).
WAVE: dict[str, list[tuple[str, int, str, tuple[str, ...], int, int | None]]] = {
    "lookup": [("FACT", 180, "each", (), 1, None), ("EVIDENCE", 150, "each", (), 1, None)],
    "define": [("DEFINITION", 200, "each", ("DEFINES",), 2, SYM), ("CONSTRAINTS", 160, "each", (), 1, None), ("COUNTEREXAMPLE", 80, "each", ("CONTRADICTS",), 1, None)],
    "explain": [("DEFINITION", 200, "each", (), 1, None), ("CAUSAL_CHAIN", 190, "each", CAUSAL, 5, None), ("CONSTRAINTS", 140, "each", (), 1, None)],
    "compare": [("DEFINITION", 200, "each", (), 1, None), ("COMPARISON_AXIS", 170, "axis", (), 1, None), ("FACT", 160, "each_axis", (), 1, None), ("CONSTRAINTS", 120, "once", (), 1, None)],
    "derive": [("PROCEDURE", 200, "once", ("IMPLIES",), 3, None), ("FACT", 170, "each", (), 1, None), ("CONSTRAINTS", 140, "once", (), 1, None)],
    "verify": [("EVIDENCE", 200, "each", (), 1, None), ("COUNTEREXAMPLE", 180, "each", ("CONTRADICTS",), 3, None), ("CONSTRAINTS", 150, "once", (), 1, None)],
    "plan": [("PROCEDURE", 200, "once", ("STEP_OF",), 10, None), ("CONSTRAINTS", 160, "once", (), 1, None), ("FACT", 150, "each", (), 1, None), ("COUNTEREXAMPLE", 130, "once", (), 1, None)],
}

#: A flatter alternative: fewer gaps, other priorities.
TEMPLATES: dict[str, list[tuple[str, int, str, tuple[str, ...], int, int | None]]] = {
    "lookup": [("FACT", 200, "each", (), 1, None)],
    "define": [("DEFINITION", 220, "each", ("DEFINES",), 1, SYM), ("CONSTRAINTS", 120, "each", (), 1, None)],
    "explain": [("CAUSAL_CHAIN", 220, "each", CAUSAL, 4, None), ("EVIDENCE", 160, "each", (), 1, None)],
    "compare": [("COMPARISON_AXIS", 210, "axis", (), 1, None), ("FACT", 180, "each", (), 1, None)],
    "derive": [("PROCEDURE", 210, "once", ("IMPLIES",), 4, None), ("EVIDENCE", 150, "each", (), 1, None)],
    "verify": [("EVIDENCE", 230, "each", (), 1, None), ("COUNTEREXAMPLE", 200, "each", ("CONTRADICTS",), 2, None)],
    "plan": [("PROCEDURE", 220, "once", ("STEP_OF",), 6, None), ("CONSTRAINTS", 170, "once", (), 1, None)],
}


def generate(intent: str, entities: list[int], axes: tuple[str, ...] = ("properties",), templates: dict | None = None) -> list[dict[str, Any]]:
    out: list[dict[str, Any]] = []
    for kind, priority, scope, types, depth, tag in (templates or WAVE)[intent]:
        subjects = {"once": [None], "axis": [None] * len(axes), "each": entities or [None], "each_axis": [e for e in entities or [None] for _ in axes]}[scope]
        for s in subjects:
            out.append({"id": len(out), "kind": kind, "priority": priority, "subj": s, "tag": tag, "edge_types": list(types), "depth": depth, "seeds": list(entities) if s is None else [s], "covered": False})
    return out
