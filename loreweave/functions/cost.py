"""Cost model: what an atom or an answer graph costs, and what it gains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut
from .scalar import age_penalty, trust_penalty


@dataclass(frozen=True)
class Weights:
    node: float = 1.0
    edge: float = 0.1
    io: float = 0.001
    trust: float = 10.0
    age: float = 0.5
    domain: float = 2.0
    hard_conflict: float = 1_000_000.0
    soft_conflict: float = 50.0


def breakdown(now: int, w: Weights = Weights()) -> dict[str, Column]:
    """Components of an atom's cost."""
    return {
        "cost_node": F.lit(w.node),
        "cost_io": F.col("io_bytes") * w.io,
        "cost_trust": trust_penalty(F.col("trust"), w.trust),
        "cost_age": age_penalty(F.col("valid_from"), now, w.age),
        "cost_domain": F.when(F.col("domain_mask") == 0, w.domain).otherwise(0.0),
    }


def atom_cost(now: int, w: Weights = Weights()) -> Column:
    return sum(breakdown(now, w).values(), F.lit(0.0))


def dominant(now: int, w: Weights = Weights()) -> Column:
    """Name of the greatest component; of equal ones, the first."""
    parts = breakdown(now, w)
    top = F.greatest(*parts.values())
    out = F.lit(None).cast("string")
    for name, c in reversed(parts.items()):
        out = F.when(c == top, F.lit(name)).otherwise(out)
    return out


def graph_cost(atoms: DataFrame, graph: str, now: int, w: Weights = Weights(), edges: DataFrame | None = None) -> DataFrame:
    """(graph, n_nodes, cost, cost_per_node): node costs and, for each edge of ``edges`` (graph, n_edges), the edge weight."""
    g = atoms.groupBy(graph).agg(F.count("*").alias("n_nodes"), F.sum(atom_cost(now, w)).alias("cost"))
    if edges is not None:
        g = g.join(edges, graph, "left").withColumn("cost", F.col("cost") + w.edge * F.coalesce("n_edges", F.lit(0))).drop("n_edges")
    return g.withColumn("cost_per_node", F.coalesce(F.col("cost") / F.nullif("n_nodes", F.lit(0)), F.lit(0.0)))


def pareto(df: DataFrame, cost: str, coverage: str, ranges: int = 128) -> DataFrame:
    """Rows that no other beats: as cheap and as covering, and better in one.

    By increasing cost, a row stays if it covers more than all cheaper ones. The best coverage of each cost comes
    first; a window then runs within ranges of costs, each of which knows the best of the cheaper ranges.
    """
    best = cut(df.groupBy(cost).agg(F.max(coverage).alias("__best")))
    bounds = best.agg(F.percentile_approx(cost, [i / ranges for i in range(1, ranges)])).first()[0] or []
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda x: x < F.col(cost))) if bounds else F.lit(0)
    best = best.withColumn("__range", at)
    tops = dict(best.groupBy("__range").agg(F.max("__best")).collect())
    below, most = [], None
    for r in sorted(tops):
        below += [F.lit(r), F.lit(most).cast(best.schema["__best"].dataType)]
        most = tops[r] if most is None else max(most, tops[r])
    before = F.max("__best").over(Window.partitionBy("__range").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    cheaper = F.create_map(*below)[F.col("__range")] if below else F.lit(None)
    front = best.withColumn("__before", F.greatest(before, cheaper)).where("__before is null or __best > __before").select(F.col(cost).alias("__c"), F.col("__best").alias("__b"))
    return df.join(front, (df[cost] == F.col("__c")) & (df[coverage] == F.col("__b")), "left_semi")


def lowest(df: DataFrame, cost: str, key: str) -> DataFrame:
    return df.orderBy(cost, key).limit(1)


def benefit(priorities: Column | None, covered: Column) -> Column:
    """Sum of priorities of the gaps covered, or 100 for each."""
    return F.size(covered) * 100.0 if priorities is None else F.aggregate(priorities, F.lit(0.0), lambda a, x: a + x)


def benefit_ratio(gain: Column, cost: Column) -> Column:
    return F.when(cost <= 0, F.lit(float("inf"))).otherwise(gain / cost)


def candidate_cost(edges: Column, io: Column, trust: Column, w: Weights = Weights()) -> Column:
    """The set cover's own: wN + wE edges + wIO bytes + wT (100 - trust / 100)."""
    return w.node + w.edge * edges + w.io * io + w.trust * (100 - trust / 100)


def marginal_ratio(gaps: Column, covered: Column, cost: Column) -> Column:
    """The ratio on gaps that aren't covered yet, 100 for each; 0 if there are none."""
    new = F.size(F.array_except(gaps, covered))
    return F.when(new == 0, F.lit(0.0)).otherwise(benefit_ratio(new * 100.0, cost))


def efficiency(covered: Column, cost: Column) -> Column:
    """Gaps covered for a unit of cost; 0 without cost."""
    return F.when(cost > 0, covered / cost).otherwise(0.0)
