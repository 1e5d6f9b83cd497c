"""Toxicity by non-negative positive-unlabelled learning.

A few linear classifiers, in numpy, learn from confirmed toxic texts and unlabelled texts. With the class
prior p, the risk is p R+(positive) + max(0, R-(unlabelled) - p R-(positive)): the bracket estimates the risk
on clean text and may not fall below zero; where it does, a step goes against it.

Features of a text are the hashed words and word beginnings it holds, weighed by how much commoner they are
in toxic than in unlabelled texts. Scores use the text alone.

Null and empty texts have no features and get the score of the intercept. Rows repeat as they come; labels that are null,
repeated or without a document are ignored as such. Training samples are bounded by parameters; every
document is scored whole. Without any confirmed toxic text, all scores are the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm import blocks as B

#: Bits of a feature's hash: enough that no two features of a corpus are likely to share it.
FEATURE_BITS = 40
#: Bytes of a word that make up the other kinds of features.
BEGINNINGS = (4, 6)
#: Expected size of the training samples; they are the part of the fit that the driver holds.
POSITIVES, UNLABELLED = 3_000, 5_000
MEMBERS = 3
STEPS = 150
#: Standard deviations by which a feature must be commoner in toxic texts than in unlabelled ones.
SURPRISE = 6.0
#: Least number of different toxic texts that hold a feature.
LEAST_TEXTS = 5
#: Strength of the ridge against weights, shared out over the toxic texts.
RIDGE = 0.3
SEED = 11


def features(data: np.ndarray, offsets: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each document: ids, and the first of each document (one entry more).

    With ``among`` (sorted), only those features.
    """
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    letters = (lower >= 128) | ((lower >= 97) & (lower <= 122)) | ((lower >= 48) & (lower <= 57))
    starts, ends = B.runs(letters, offsets)
    of = np.searchsorted(offsets, starts, "right") - 1
    span_hash = B.SpanHash(lower)
    whole = span_hash(starts, ends)
    beginnings = [B.mixed(span_hash(starts, np.minimum(ends, starts + n)) + np.uint64(n)) for n in BEGINNINGS]
    keys = (np.concatenate([whole, *beginnings]) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    of = np.tile(of, 1 + len(BEGINNINGS)).astype(np.int64)
    if among is not None:
        known = np.zeros(len(keys), bool) if not len(among) else among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys
        keys, of = keys[known], of[known]
    pairs = np.unique(of << FEATURE_BITS | keys)
    return pairs & ((1 << FEATURE_BITS) - 1), np.searchsorted(pairs >> FEATURE_BITS, np.arange(len(offsets)))


class Rows:
    """Sparse 0/1 rows."""

    def __init__(self, ids: np.ndarray, first: np.ndarray) -> None:
        self.ids, self.first = ids, first
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def __len__(self) -> int:
        return len(self.first) - 1

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.ids], len(self))

    def back(self, values: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.ids, values[self.row], n)

    def take(self, rows: np.ndarray) -> Rows:
        lengths = np.diff(self.first)[rows]
        return Rows(self.ids[B.spread(self.first[rows], lengths)], np.concatenate([[0], np.cumsum(lengths)]))

    def only(self, chosen: np.ndarray, n: int) -> Rows:
        """The rows with the chosen of ``n`` columns, numbered anew."""
        at = np.full(n, -1)
        at[chosen] = np.arange(len(chosen))
        ids = at[self.ids]
        return Rows(ids[ids >= 0], B.sums_before(ids >= 0)[self.first])


@dataclass
class Model:
    """Features (sorted), their weights and the intercept, averaged over the members; bounded by the samples."""

    ids: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, first = features(data, offsets, self.ids)
        return _sigmoid(Rows(np.searchsorted(self.ids, ids), first).times(self.weights) + self.intercept)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _fit_one(positive: Rows, unlabelled: Rows, n: int, prior: float, steps: int) -> tuple[np.ndarray, float]:
    in_positive = np.bincount(positive.ids, minlength=n)
    share_p = in_positive / len(positive)
    share_u = np.bincount(unlabelled.ids, minlength=n) / max(1, len(unlabelled))
    # Half a text more on either side: what a share of so few texts can tell.
    few = 0.5 / min(len(positive), max(1, len(unlabelled)))
    lift = np.log((share_p + few) / (share_u + few))
    # Only features that toxic texts hold more often than chance explains; the rest is noise in such samples.
    expected = share_u * len(positive)
    lift[(in_positive < LEAST_TEXTS) | (in_positive - expected < SURPRISE * np.sqrt(expected + 1))] = 0
    out, chosen = np.zeros(n), np.flatnonzero(lift)
    positive, unlabelled, lift, n = positive.only(chosen, n), unlabelled.only(chosen, n), lift[chosen], len(chosen)
    weights, intercept = np.zeros(n), float(np.log(prior / (1 - prior)))
    moments = [np.zeros(n + 1), np.zeros(n + 1)]
    for step in range(1, steps + 1):
        z_p, z_u = positive.times(weights * lift) + intercept, unlabelled.times(weights * lift) + intercept
        s_p, s_u = _sigmoid(z_p), _sigmoid(z_u)
        # Logistic losses: softplus(-z) for label 1, softplus(z) for label 0.
        clean = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        if clean >= 0:
            g_p, g_u = prior * (s_p - 1 - s_p), s_u
        else:
            g_p, g_u = prior * s_p, -s_u
        g_p, g_u = g_p / len(positive), g_u / len(unlabelled)
        gradient = np.append((positive.back(g_p, n) + unlabelled.back(g_u, n)) * lift + RIDGE / len(positive) * weights, g_p.sum() + g_u.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights, intercept = weights - move[:-1], intercept - float(move[-1])
    out[chosen] = weights * lift
    return out, intercept


def fit(positive: Rows, unlabelled: Rows, prior: float, members: int = MEMBERS, steps: int = STEPS) -> Model:
    """Train the members on two thirds of both samples each and average them."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    ids, column = np.unique(np.concatenate([positive.ids, unlabelled.ids]), return_inverse=True)
    positive, unlabelled = Rows(column[: len(positive.ids)], positive.first), Rows(column[len(positive.ids) :], unlabelled.first)
    positive, unlabelled = _without_copies(positive), _without_copies(unlabelled)
    rng = np.random.default_rng(SEED)

    def part(rows: Rows) -> Rows:
        return rows.take(np.sort(rng.permutation(len(rows))[: max(1, 2 * len(rows) // 3)]))

    fitted = [_fit_one(part(positive), part(unlabelled), len(ids), prior, steps) for _ in range(members)]
    weights = np.mean([w for w, _ in fitted], axis=0)
    used = weights != 0
    return Model(ids[used], weights[used], float(np.mean([b for _, b in fitted])))


def _without_copies(rows: Rows) -> Rows:
    """One of the rows that share their ten least hashed features: copies would make their words look toxic."""
    seen, kept = set(), []
    hashed = B.mixed(rows.ids.astype(np.uint64))
    for i, (a, b) in enumerate(zip(rows.first[:-1].tolist(), rows.first[1:].tolist())):
        least = np.sort(np.partition(hashed[a:b], 9)[:10] if b - a > 10 else hashed[a:b]).tobytes()
        if least not in seen:
            seen.add(least)
            kept.append(i)
    return rows.take(np.array(kept, np.int64))


def _collected(docs: DataFrame, text: str) -> Rows:
    """Features of a bounded sample, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in B.blocks(batch.column(0)):
                ids, first = features(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int64()))], ["ids"])

    lists = docs.select(text).mapInArrow(run, "ids array<long>").toArrow().column("ids").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    return Rows(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on documents with ``label`` 1 and on documents whatever their label; the prior is the labels' mean."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("is_toxic"))
    n_known, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("is_toxic"), F.lit(0))).first()
    # A seeded hash of the id draws a sample of the wanted expected size.
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(key)), 11) / F.lit(float(1 << 53))
    toxic = known.where((F.col("is_toxic") == 1) & (draw < positives / max(1, n_toxic))).select(key)
    some = docs.where(draw < unlabelled / max(1, docs.count()))
    # About ``positives`` ids: the sample's bound is the bound of the broadcast.
    confirmed = docs.join(F.broadcast(toxic), key, "left_semi")
    return fit(_collected(confirmed, text), _collected(some, text), float(n_toxic) / max(1, n_known))


def scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``score`` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != text]
    if "score" in {c.lower() for c in others}:
        raise ValueError("A column has the name of the result: score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for first, data, offsets in B.blocks(batch.column(names.index(text))):
                kept = batch.slice(first, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*(kept.column(names.index(c)) for c in others), pa.array(shared.value.score(data, offsets), pa.float64())], [*others, "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(run, ", ".join([*fields, "score double"]))
