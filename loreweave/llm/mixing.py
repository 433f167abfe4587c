"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length. Of each length a source first gives its share
of the budget but for a remainder, rounded down; what remains is met by a bounded-knapsack dynamic programme
over the lengths left. Where that falls short of the budget, more of the share is given back, in the end all
of it, and the programme runs again. Of each (source, length) the documents with the least seeded hashes are taken:
the hash of the last one is a cut-off, so the choice is a filter over one scan.

Defined results
* A token is a run of non-blank characters; null, empty and blank texts have none and are never chosen.
* A null source is a source of its own. Null ids hash alike; ties at a cut-off go by (doc_id, text), and
  of rows equal in these, any.
* Repeated rows are documents of their own, each with its tokens.
* A source's tokens are its budget exactly, or the most below it that its lengths can make. (Only where it
  takes a programme over more than MOST_REST tokens, in units of the lengths' common divisor, to make them
  is it the most that one of that size finds.)
* A source short of its share gives all; the others share what it lacks, so a small source shrinks none.
* Sources without a weight get none (weights given). Empty tables: empty results.
* Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import bound_batches, fresh, large_text, slices, write_shared

#: What the dynamic programme has to fit at first, beside the longest document, and at most.
REST, MOST_REST = 1 << 16, 1 << 24
#: The default budget, as a share of the tokens of all weighted sources.
KEEP = 0.8
#: So many (source, length) cut-offs are broadcast; more are joined by a shuffle.
BROADCAST_CUTS = 2_000_000
NULL_SOURCE = "\x00null"


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def count_tokens(texts: pa.Array) -> np.ndarray:
    """Runs of non-blank characters of each text; 0 for null."""
    arr = large_text(texts)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    head = ~_BLANK[raw]
    first = off[:-1][np.diff(off) > 0]
    begins = head[first].copy()
    head[1:] &= _BLANK[raw[:-1]]
    head[first] = begins
    at = np.flatnonzero(head)
    return np.searchsorted(at, off[1:]) - np.searchsorted(at, off[:-1])


@F.arrow_udf(T.IntegerType())
def _n_tokens(texts: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    out = [count_tokens(part.column(0)) for part in slices(batch, "text", 8 << 20)]
    return pa.array(np.concatenate([np.zeros(0, np.int64), *out]).astype(np.int32))


def n_tokens(text: Column) -> Column:
    """Runs of non-blank characters; 0 for null."""
    return _n_tokens(text)


def bounded_fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length make the largest sum up to ``budget``: a bitset dynamic programme over binary-split counts.

    Each sum remembers the first part that made it; parts before that one made the rest.
    """
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return take
    reach, mask = 1, (1 << (budget + 1)) - 1
    maker = np.full(budget + 1, -1, np.int32)
    parts: list[tuple[int, int]] = []
    for i, (w, c) in enumerate(zip(lengths.tolist(), counts.tolist())):
        c = min(c, budget // w) if w else 0
        k = 1
        while c > 0:
            k = min(k, c)
            new = (reach << (w * k)) & mask & ~reach
            if new:
                sums = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes((budget >> 3) + 1, "little"), np.uint8), bitorder="little"))
                maker[sums] = len(parts)
                reach |= new
            parts.append((i, k))
            c -= k
            k *= 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    while at:
        i, k = parts[maker[at]]
        take[i] += k
        at -= int(lengths[i]) * k
    return take


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length make ``budget`` tokens, or the most below it."""
    on = np.flatnonzero((counts > 0) & (lengths > 0))
    take = np.zeros(len(counts), np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0 or not len(on):
        return take
    unit = math.gcd(*lengths[on].tolist())
    w, c, budget, total = lengths[on] // unit, counts[on], budget // unit, total // unit
    order = np.random.default_rng(seed).permutation(len(on))
    rest, most = REST, -1
    while True:
        given = max(0, budget - rest)
        own = np.array([int(x) * given // total for x in c], np.int64)
        left = budget - int((w * own).sum())
        while left > 2 * rest:  # what rounding lost: one more of each length, in seeded order
            can = order[(own < c)[order]]
            fill = can[np.cumsum(w[can]) <= left - rest]
            if not len(fill):
                break
            own[fill] += 1
            left -= int(w[fill].sum())
        own[order] += bounded_fit(w[order], (c - own)[order], left)
        made = int((w * own).sum())
        if made > most:
            most, take[on] = made, own
        if made == budget or not given or rest >= MOST_REST:
            return take
        rest *= 8


def target_budgets(totals: dict[str, int], weights: dict[str, float] | None = None, budget: int | None = None, temperature: float = 0.7) -> dict[str, int]:
    """Tokens of each source. Default weights: token counts to the power of ``temperature``; default budget: KEEP of all tokens of weighted sources.

    A source that is short of its share gives all it has; what it lacks is shared among the others by weight.
    """
    totals = {k: v for k, v in totals.items() if v > 0}
    if weights is None:
        weights = {k: v**temperature for k, v in totals.items()}
    weights = {k: w for k, w in weights.items() if k in totals and w > 0}
    if not weights:
        return {}
    left = int(KEEP * sum(totals[k] for k in weights)) if budget is None else budget
    out: dict[str, int] = {}
    rest = dict(weights)
    while rest:
        whole = sum(rest.values())
        short = [k for k, w in rest.items() if totals[k] <= left * w / whole]
        if not short:
            return out | {k: int(left * w / whole) for k, w in rest.items()}
        for k in short:
            out[k] = totals[k]
            left -= totals[k]
            del rest[k]
    return out


def kept_shares(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """(source, tokens, kept, share) of every source that has tokens."""
    sums = lambda d, name: d.groupBy("source").agg(F.sum(n_tokens(F.col("text")).cast("bigint")).alias(name))
    a, b = sums(docs, "tokens"), sums(mixed, "kept").withColumnRenamed("source", "of")
    kept = F.coalesce("kept", F.lit(0))
    return a.join(b, a["source"].eqNullSafe(b["of"]), "left").where("tokens > 0").select("source", "tokens", kept.alias("kept"), (kept / F.col("tokens")).alias("share"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, temperature: float = 0.7, seed: int = 5) -> DataFrame:
    """The chosen rows, all columns as they were."""
    spark = docs.sparkSession
    bound_batches(spark)
    names = docs.columns
    src, tok, draw, cut, tied_, need, nth = fresh(names, "__lw_source", "__lw_tokens", "__lw_draw", "__lw_cut", "__lw_tied", "__lw_need", "__lw_n")
    source = F.coalesce(F.col("source").cast("string"), F.lit(NULL_SOURCE))
    tokens = n_tokens(F.col("text"))
    drawn = F.xxhash64("doc_id", F.lit(seed))
    light = write_shared(docs.select(source.alias("__lw_source"), tokens.alias("__lw_tokens"), drawn.alias("__lw_draw")).where("__lw_tokens > 0"), "lengths")
    hist = write_shared(light.groupBy("__lw_source", "__lw_tokens").count(), "histogram")
    totals = {r[0]: int(r[1]) for r in hist.groupBy("__lw_source").agg(F.sum(F.col("__lw_tokens") * F.col("count"))).toLocalIterator()}
    budgets = target_budgets(totals, weights, budget, temperature)
    plan = spark.createDataFrame([(k, v) for k, v in budgets.items()], "__lw_source string, budget bigint")

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__lw_tokens")
        pdf["take"] = fit_counts(pdf["__lw_tokens"].to_numpy(np.int64), pdf["count"].to_numpy(np.int64), int(pdf["budget"].iloc[0]), seed)
        return pdf[["__lw_source", "__lw_tokens", "count", "take"]]

    quota = write_shared(hist.join(plan, "__lw_source").groupBy("__lw_source").applyInPandas(quotas, "__lw_source string, __lw_tokens int, count bigint, take bigint").where("take > 0"), "quotas")
    w = Window.partitionBy("__lw_source", "__lw_tokens")
    ranked = light.join(quota.where("take < count"), ["__lw_source", "__lw_tokens"]).withColumn("n", F.row_number().over(w.orderBy("__lw_draw")))
    at_cut = ranked.withColumn("cut", F.max(F.when(F.col("n") == F.col("take"), F.col("__lw_draw"))).over(w)).where(F.col("__lw_draw") == F.col("cut"))
    some = at_cut.groupBy("__lw_source", "__lw_tokens", "cut").agg(F.count("*").alias("tied"), F.sum((F.col("n") <= F.col("take")).cast("bigint")).alias("need"))
    every = quota.where("take = count").select("__lw_source", "__lw_tokens", F.lit(2**63 - 1).alias("cut"), F.lit(1).cast("bigint").alias("tied"), F.lit(1).cast("bigint").alias("need"))
    cuts = write_shared(some.unionByName(every), "cuts").withColumnsRenamed({"__lw_source": src, "__lw_tokens": tok, "cut": cut, "tied": tied_, "need": need})
    n_cuts, n_tied = cuts.agg(F.count("*"), F.count(F.when(F.col(tied_) > F.col(need), 1))).first()
    cuts = F.broadcast(cuts) if n_cuts <= BROADCAST_CUTS else cuts
    marked = docs.withColumns({src: source, tok: tokens, draw: drawn}).join(cuts, [src, tok])
    at = F.col(draw) == F.col(cut)
    sure = marked.where((F.col(draw) < F.col(cut)) | (at & (F.col(tied_) == F.col(need)))).select(*names)
    if not n_tied:
        return sure
    order = Window.partitionBy(src, tok).orderBy(F.col("doc_id").asc_nulls_last(), "text")
    tied = marked.where(at & (F.col(tied_) > F.col(need))).withColumn(nth, F.row_number().over(order)).where(F.col(nth) <= F.col(need))
    return sure.unionByName(tied.select(*names))
