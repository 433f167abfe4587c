"""Non-negative positive-unlabelled toxicity classifier.

A numpy logistic model over hashed words and word stems, trained from confirmed toxic texts and
unlabelled ones with the non-negative PU risk: pi E_P[l+] + max(0, E_U[l-] - pi E_P[l-]). A feature's
value is how densely it occurs: ``DENSE`` times its share of the words, 1 at most, so that a long clean
text isn't rejected for a few words that chance brings.

Confirmed texts are a bounded sample of the labelled ones (``most_positive``); all unlabelled rows count. A first pass
counts in how many of them each word of the confirmed texts occurs; that share, less pi times the share among the
confirmed, is the one among clean texts. A feature is admitted if its shares among confirmed and unlabelled texts differ
by ``ADMIT`` deviations, those among confirmed and clean ones by a factor of ``FACTOR``, either way, and at least 3
confirmed texts (and one in 500) have it; of more than ``most_features`` the surest. A second pass writes the admitted features of every unlabelled row, equal rows as one with
their number; ``steps`` passes over that table give the gradients of the whole risk.

Defined results
* Null or empty text, or a text without any known feature: scored by the bias alone (kept below 0), never rejected.
* Null labels and labels of unknown documents: ignored. A document labelled more than once is
  confirmed toxic if any of its labels says so. A null doc_id is scored like any other.
* Repeated rows: each is scored, all alike. Copies of a confirmed text count as one, by what is learnt from it. Empty documents: empty result. No confirmed toxic
  document: nothing can be learnt, and nothing is rejected.
* The prior among the unlabelled is kept within 0.005 and 0.9; where no clean label tells a share, toxic text is
  taken for 0.05 of all.
* Extra columns: ignored by ``toxic_documents``; passed through untouched, whatever their names, by
  ``drop_toxic``.
* Very long texts: read whole, like all others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, slices, trim, write_shared
from .textops import words

STEMS = (4, 5, 6)
BITS = 32
#: A feature counts in full from one in so many words; a shorter text counts as having so many.
DENSE = 48
ADMIT, FACTOR = 5, 3
MOST_TASKS = 128
#: Up to so many confirmed ids (8 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_IDS = 4_000_000


@dataclass(frozen=True)
class ToxicModel:
    features: np.ndarray  # sorted uint32 hashes
    weights: np.ndarray
    bias: float
    prior: float


def _density(count: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.minimum(1, DENSE * count / np.maximum(n_words, DENSE))


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document index, feature, density), each pair once; features are words and their stems hashed to BITS bits."""
    w = words(texts, STEMS)
    n = len(w.first) - 1
    parts = [(w.doc, w.hashes)] + [(w.doc[at], h) for at, h in w.prefixes.values()]
    doc = np.concatenate([d for d, _ in parts]).astype(np.uint64)
    feature = np.concatenate([h for _, h in parts]) >> np.uint64(64 - BITS)
    key, count = np.unique((doc << np.uint64(BITS)) | feature, return_counts=True)
    doc = (key >> np.uint64(BITS)).astype(np.int64)
    return doc, (key & np.uint64((1 << BITS) - 1)).astype(np.int64), _density(count, np.diff(w.first)[doc]), n


_PAIR = np.dtype([("feature", np.uint32), ("density", np.float32)])


def _sample_features(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            d, f, v, n = _features(part.column(1))
            pairs = np.empty(len(f), _PAIR)
            pairs["feature"], pairs["density"] = f, v
            cut = np.searchsorted(d, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pairs[cut[i] : cut[i + 1]].tobytes() for i in range(n)], pa.binary())], ["confirmed", "features"])


def _known(texts: pa.Array, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document index, place in the sorted ``features``, density) of those that occur, each pair once."""
    w = words(texts, STEMS)
    maybe = np.zeros(1 << 20, bool)  # a first sieve by 20 bits, then the exact look-up
    maybe[features >> np.uint32(BITS - 20)] = True
    keys = []
    for doc, h in [(w.doc, w.hashes)] + [(w.doc[at], h) for at, h in w.prefixes.values()]:
        on = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
        f = (h[on] >> np.uint64(64 - BITS)).astype(np.uint32)
        at = np.minimum(np.searchsorted(features, f), len(features) - 1)
        hit = features[at] == f
        keys.append(doc[on[hit]] * len(features) + at[hit])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    doc = key // len(features)
    return doc, key % len(features), _density(count, np.diff(w.first)[doc]), len(w.first) - 1


#: (bias last) -> E_U[l-] and its gradient
Unlabelled = Callable[[np.ndarray], tuple[float, np.ndarray]]
_sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nnpu_train(x_p: np.ndarray, unlabelled: Unlabelled, prior: float, steps: int = 30, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk of the logistic loss, by Adam, with a rate that falls to 0, on gradients of the whole risk.

    Where the corrected negative part falls below 0, its gradient is reversed, as the estimator prescribes.
    """
    dim = x_p.shape[1]
    theta = np.zeros(dim + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(dim + 1), np.zeros(dim + 1)
    grad = lambda g: np.append(g @ x_p, g.sum()) / len(g)
    for t in range(1, steps + 1):
        s_p = x_p @ theta[:-1] + theta[-1]
        loss, g_neg = unlabelled(theta)
        negative = loss - prior * np.logaddexp(0, s_p).mean()
        g_neg = g_neg - prior * grad(_sig(s_p))
        g = -g_neg if negative < 0 else prior * grad(_sig(s_p) - 1) + g_neg
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


_ADMITTED = np.dtype([("at", np.uint32), ("density", np.float32)])


def _rows_of(features: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                d, f, v, n = _known(part.column(0), features)
                pairs = np.empty(len(f), _ADMITTED)
                pairs["at"], pairs["density"] = f, v
                cut = np.searchsorted(d, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([pa.array([pairs[cut[i] : cut[i + 1]].tobytes() for i in range(n)], pa.binary())], ["features"])
        trim()

    return run


def _gradient(theta: np.ndarray):
    """(place, sum) of a task's gradient, the bias at len(theta) - 1 and the loss after it."""

    def run(batches):
        total = np.zeros(len(theta) + 1)
        for batch in batches:
            blob = batch.column(0).cast(pa.large_binary())
            size = pc.binary_length(blob).to_numpy(zero_copy_only=False) // _ADMITTED.itemsize
            pairs = np.frombuffer(b"".join(blob.to_pylist()), _ADMITTED)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            s = np.bincount(row, pairs["density"] * theta[pairs["at"]], minlength=len(size)) + theta[-1]
            g = n * _sig(s)
            total[: len(theta) - 1] += np.bincount(pairs["at"], pairs["density"] * g[row], minlength=len(theta) - 1)
            total[-2] += g.sum()
            total[-1] += (n * np.logaddexp(0, s)).sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "value"])

    return run


def over_table(table: DataFrame, n_rows: int, dim: int) -> Unlabelled:
    """The mean over ``table`` (features, n). Of its gradient the driver gets a number for each feature and task, or, of more
    than MOST_TASKS tasks, for each feature."""
    many = table.rdd.getNumPartitions() > MOST_TASKS

    def of(theta: np.ndarray) -> tuple[float, np.ndarray]:
        sums = table.mapInArrow(_gradient(theta), "at bigint, value double")
        sums = (sums.groupBy("at").agg(F.sum("value").alias("value")) if many else sums).toArrow()
        total = np.zeros(dim + 2)
        np.add.at(total, sums["at"].to_numpy(), sums["value"].to_numpy())
        return total[-1] / n_rows, total[:-1] / n_rows

    return of


def fit(docs: DataFrame, labels: DataFrame, class_prior: float | None = None, most_positive: int = 4000, most_features: int = 2048, steps: int = 30, seed: int = 7) -> ToxicModel:
    """Train on ``most_positive`` confirmed toxic texts, drawn by a seeded hash, and on all others; all texts are read whole.

    ``class_prior``: the share of toxic text among all; by default the toxic share of the labelled
    documents, all labels counted. The unlabelled exclude the confirmed ones, so the prior is corrected for
    their share.
    """
    bound_batches(docs.sparkSession)
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_labelled, n_toxic = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    n_docs = docs.count()
    nothing = ToxicModel(np.zeros(0, np.uint32), np.zeros(0), -20.0, 0.0)
    if not n_toxic or not n_docs:
        return nothing
    share = class_prior if class_prior is not None else n_toxic / n_labelled if n_labelled > n_toxic else 0.05
    prior = float(np.clip((share * n_docs - n_toxic) / max(1, n_docs - n_toxic), 0.005, 0.9))
    rank = (F.xxhash64("doc_id", F.lit(seed)).cast("double") / F.lit(2.0**64)) + 0.5
    confirmed = known.where("toxic = 1").select("doc_id")
    # the sample is bounded by its parameter; an id on many rows counts by its least text
    some = docs.select("doc_id", "text").join(F.broadcast(confirmed.where(rank < most_positive / n_toxic)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    blobs = some.select("doc_id", "text").mapInArrow(_sample_features, "confirmed bigint, features binary").select("features").toArrow()["features"].to_pylist()
    positive = [np.frombuffer(x, _PAIR) for x in sorted(set(blobs))]  # copies of a text would count as evidence again
    if not positive:
        return nothing
    vocabulary, df_p = np.unique(np.concatenate([x["feature"] for x in positive]), return_counts=True)
    n_p = len(positive)
    often = df_p >= max(3, n_p // 500)
    vocabulary, df_p = vocabulary[often], df_p[often]
    confirmed = F.broadcast(confirmed) if n_toxic <= BROADCAST_IDS else confirmed.hint("shuffle_hash")
    unlabelled = docs.select("doc_id", "text").join(confirmed, "doc_id", "left_anti").select("text")
    if not len(vocabulary):
        return nothing

    def occurrences(batches):
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                _, f, _, n = _known(part.column(0), vocabulary)
                total[:-1] += np.bincount(f, minlength=len(vocabulary))
                total[-1] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])
        trim()

    # as many numbers as the bounded sample has features
    counted = unlabelled.mapInArrow(occurrences, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df_u = np.zeros(len(vocabulary) + 1, np.int64)
    df_u[counted["at"].to_numpy()] = counted["n"].to_numpy()
    n_u = int(df_u[-1])
    if not n_u:
        return nothing
    p1, pu = (df_p + 0.5) / (n_p + 1), (df_u[:-1] + 0.5) / (n_u + 1)
    p0 = np.maximum((pu - prior * p1) / (1 - prior), 0.5 / (n_u + 1))
    alike = (p1 - pu) / np.sqrt(pu * (1 - pu) * (1 / n_p + 1 / n_u))  # were both shares the same
    apart = (p1 - p0) / np.sqrt(p1 * (1 - p1) / n_p + p0 * (1 - p0) / n_u + 1e-12)
    on = np.flatnonzero((alike > ADMIT) & (p1 > FACTOR * p0) | (apart < -ADMIT) & (p0 > FACTOR * p1))
    on = np.sort(on[np.argsort(-np.abs(apart[on]), kind="stable")[:most_features]])
    if not len(on):
        return nothing
    chosen = vocabulary[on]
    table = write_shared(unlabelled.mapInArrow(_rows_of(chosen), "features binary").groupBy("features").agg(F.count("*").alias("n")), "unlabelled")
    x_p = np.zeros((n_p, len(chosen)))
    for i, f in enumerate(positive):
        c = np.minimum(np.searchsorted(chosen, f["feature"]), len(chosen) - 1)
        hit = chosen[c] == f["feature"]
        x_p[i, c[hit]] = f["density"][hit]
    w, bias = nnpu_train(x_p, over_table(table, n_u, len(chosen)), prior, steps)
    return ToxicModel(chosen, w, min(bias, -1e-3), prior)


def score(texts: pa.Array, model: ToxicModel) -> np.ndarray:
    """P(toxic) of each text."""
    total = np.full(len(texts), model.bias)
    if len(model.features):
        doc, at, density, _ = _known(texts, model.features)
        np.add.at(total, doc, model.weights[at] * density)
    return _sig(total)


def toxic_documents(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, toxicity) of every row that the model rejects."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = score(part.column(1), model)
                on = np.flatnonzero(s >= threshold)
                if len(on):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(on)), pa.array(np.round(s[on], 6))], ["doc_id", "toxicity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, toxicity double")


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """The rows that the model doesn't reject, all columns as they were."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keep = score(part.column(at), model) < threshold
                yield part if keep.all() else part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
