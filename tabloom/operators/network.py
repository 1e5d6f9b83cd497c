"""Feed-forward networks: minibatch gradients in the tasks, averaged over the cluster, stopped by held-out rows.

In each pass every task starts from the same weights and moments, goes once through its blocks in minibatches
(Adam, or gradient descent with momentum), and gives back its weights; the mean over tasks by rows is the next
start. Held-out rows, drawn per block by seed, are scored with the weights at the start of the same pass, so
early stopping costs no pass of its own. Rows that take up to ``LOCAL_BYTES`` are trained inside one task by the
same code: then each pass is a plain epoch.

Losses: squared error (of the standardised target), logistic loss for two classes, softmax loss for more, plus
``alpha / 2`` times the squared weights per row of a minibatch. Weights are broadcast; their number does not depend
on the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabloom.functions import matrix
from tabloom.operators.boosting import shares

LOCAL_BYTES = 64 << 20
ACTIVATIONS = ("relu", "tanh", "logistic", "identity")
SCHEDULES = ("constant", "adaptive", "invscaling")
SOLVERS = ("adam", "sgd")
#: The adaptive rate divides by five until here.
LEAST_RATE = 1e-6


@dataclass
class Rules:
    """``classes`` is 0 for a numeric target."""

    hidden: tuple[int, ...] = (128, 64, 32)
    activation: str = "relu"
    solver: str = "adam"
    alpha: float = 1e-4
    rate: float = 1e-3
    schedule: str = "adaptive"
    batch: int = 200
    epochs: int = 500
    early_stopping: bool = True
    validation: float = 0.1
    tolerance: float = 1e-4
    patience: int = 10
    classes: int = 0
    seed: int = 42

    @property
    def outputs(self) -> int:
        return self.classes if self.classes > 2 else 1

    def check(self) -> None:
        for value, known in ((self.activation, ACTIVATIONS), (self.schedule, SCHEDULES), (self.solver, SOLVERS)):
            if value not in known:
                raise ValueError(f"'{value}' is none of {known}.")


def sizes(features: int, rules: Rules) -> list[int]:
    return [features, *rules.hidden, rules.outputs]


def layers(theta: np.ndarray, widths: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the weights and biases in one flat array."""
    found, at = [], 0
    for a, b in zip(widths, widths[1:]):
        found.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return found


def first_weights(widths: Sequence[int], rules: Rules) -> np.ndarray:
    """Uniform weights, scaled by the width of both sides."""
    random = np.random.default_rng([rules.seed, 5])
    factor = 2.0 if rules.activation == "logistic" else 6.0
    return np.concatenate([random.uniform(-1, 1, a * b + b) * np.sqrt(factor / (a + b)) for a, b in zip(widths, widths[1:])])


def _active(z: np.ndarray, kind: str) -> np.ndarray:
    if kind == "relu":
        return np.maximum(z, 0)
    if kind == "tanh":
        return np.tanh(z)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) if kind == "logistic" else z


def _slope(a: np.ndarray, kind: str) -> np.ndarray | float:
    """Derivative of the activation, by its value."""
    return {"relu": lambda: (a > 0).astype(float), "tanh": lambda: 1 - a * a, "logistic": lambda: a * (1 - a), "identity": lambda: 1.0}[kind]()


def outputs(theta: np.ndarray, widths: Sequence[int], x: np.ndarray, rules: Rules) -> np.ndarray:
    """Margins (or values) of rows."""
    *hidden, (w, b) = layers(theta, widths)
    for v, c in hidden:
        x = _active(x @ v + c, rules.activation)
    return x @ w + b


def loss_and_gradient(theta: np.ndarray, widths: Sequence[int], x: np.ndarray, y: np.ndarray, rules: Rules) -> tuple[float, np.ndarray]:
    """Mean loss of a minibatch and its gradient."""
    n, net = len(x), layers(theta, widths)
    values = [x]
    for v, c in net[:-1]:
        values.append(_active(values[-1] @ v + c, rules.activation))
    margin = values[-1] @ net[-1][0] + net[-1][1]
    if rules.classes == 0:
        error = margin - y[:, None]
        loss = 0.5 * float((error**2).sum()) / n
    else:
        p = shares(margin, rules.classes)
        kind = y.astype(np.int64)
        loss = -float(np.log(np.maximum(p[np.arange(n), kind], 1e-300)).sum()) / n
        error = p.copy()
        error[np.arange(n), kind] -= 1.0
        if rules.classes == 2:
            error = error[:, 1:]
    gradient = np.empty_like(theta)
    parts = layers(gradient, widths)
    delta = error / n
    for i in range(len(net) - 1, -1, -1):
        parts[i][0][:] = values[i].T @ delta + rules.alpha / n * net[i][0]
        parts[i][1][:] = delta.sum(axis=0)
        loss += 0.5 * rules.alpha / n * float((net[i][0] ** 2).sum())
        if i:
            delta = (delta @ net[i][0].T) * _slope(values[i], rules.activation)
    return loss, gradient


@dataclass
class State:
    """Weights, moments and steps done."""

    theta: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0

    def step(self, gradient: np.ndarray, rate: float, rules: Rules) -> None:
        self.steps += 1
        if rules.solver == "sgd":
            # Momentum that looks ahead.
            self.first = 0.9 * self.first - rate * gradient
            self.theta = self.theta + 0.9 * self.first - rate * gradient
            return
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        scale = rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        self.theta = self.theta - scale * self.first / (np.sqrt(self.second) + 1e-8)


def _held_out(block: matrix.Block, rules: Rules) -> np.ndarray:
    if not rules.early_stopping:
        return np.zeros(len(block.y), bool)
    return np.random.default_rng([rules.seed, 3, block.part, block.seq]).random(len(block.y)) < rules.validation


def epoch(blocks: Iterator[matrix.Block], state: State, widths: Sequence[int], rules: Rules, number: int, rate: float, target: tuple[float, float]) -> np.ndarray:
    """Go once through the blocks, changing ``state``: rows, summed loss, and of the held-out rows, scored with the
    weights before, their number, hits (or squared error), sum and sum of squares of the target."""
    sums, before = np.zeros(6), state.theta.copy()
    for block in blocks:
        y = (block.y - target[0]) / target[1]
        out = _held_out(block, rules)
        if out.any():
            margin = outputs(before, widths, block.x[out], rules)
            if rules.classes:
                hit = shares(margin, rules.classes).argmax(axis=1) == y[out]
                sums[2:4] += len(hit), hit.sum()
            else:
                sums[2:] += out.sum(), ((margin[:, 0] - y[out]) ** 2).sum(), y[out].sum(), (y[out] ** 2).sum()
        order = np.random.default_rng([rules.seed, 4, number, block.part, block.seq]).permutation(np.flatnonzero(~out))
        for at in range(0, len(order), rules.batch):
            rows = order[at : at + rules.batch]
            loss, gradient = loss_and_gradient(state.theta, widths, block.x[rows], y[rows], rules)
            now = rate / (state.steps + 1) ** 0.5 if rules.schedule == "invscaling" and rules.solver == "sgd" else rate
            state.step(gradient, now, rules)
            sums[:2] += len(rows), loss * len(rows)
    return sums


def _score(sums: np.ndarray, rules: Rules) -> float:
    """Higher is better: accuracy or R2 of the held-out rows, else minus the training loss."""
    if not rules.early_stopping or sums[2] == 0:
        return -sums[1] / max(sums[0], 1)
    if rules.classes:
        return sums[3] / sums[2]
    spread = sums[5] - sums[4] ** 2 / sums[2]
    return 1 - sums[3] / spread if spread > 0 else 0.0


def descend(one_pass, theta: np.ndarray, rules: Rules) -> tuple[np.ndarray, list[float]]:
    """Passes until the score stands still; the weights with the best score and the scores.

    ``one_pass(state, number, rate)`` gives the next state and the sums of ``epoch``.
    """
    state = State(theta, np.zeros_like(theta), np.zeros_like(theta))
    rate, best, kept, still, scores = rules.rate, -np.inf, theta, 0, []
    for number in range(rules.epochs):
        before = state.theta
        state, sums = one_pass(state, number, rate)
        scores.append(float(_score(sums, rules)))
        still = 0 if scores[-1] > best + rules.tolerance else still + 1
        if scores[-1] > best:
            # Held-out rows are scored before the pass, the training loss is that of the pass.
            best, kept = scores[-1], before if rules.early_stopping else state.theta
        if still > rules.patience:
            if rules.solver == "sgd" and rules.schedule == "adaptive" and rate > LEAST_RATE:
                rate, still = rate / 5, 0
                continue
            break
        if not np.isfinite(state.theta).all():
            break
    return kept, scores


@dataclass
class Network:
    """Weights, and the mean and spread of a numeric target."""

    rules: Rules
    widths: list[int]
    theta: np.ndarray
    target: tuple[float, float]
    scores: list[float]
    importances: None = None

    def values(self, x: np.ndarray) -> np.ndarray:
        found = outputs(self.theta, self.widths, x, self.rules)
        return shares(found, self.rules.classes) if self.rules.classes else found * self.target[1] + self.target[0]

    def predict(self, df: DataFrame, features: str, output: str) -> DataFrame:
        """Add an array: the value, or the probability of each class. ``features`` is a column of arrays."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scored(arrays: pd.Series) -> pd.Series:
            if not len(arrays):
                return pd.Series([], dtype="object")
            return pd.Series(list(shared.value.values(np.stack(arrays.to_numpy()))))

        return df.withColumn(output, scored(features))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        record = {"rules": vars(self.rules), "widths": self.widths, "theta": self.theta.tolist(), "target": list(self.target), "scores": self.scores}
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/network")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        d = json.loads(spark.read.text(f"{path}/network").first()[0])
        rules = Rules(**{**d["rules"], "hidden": tuple(d["rules"]["hidden"])})
        return cls(rules, d["widths"], np.array(d["theta"]), tuple(d["target"]), d["scores"])


def fit(df: DataFrame, features: Sequence[Column], target: Column, rules: Rules, local_bytes: int = LOCAL_BYTES) -> Network:
    """Train on numeric features without nulls; class targets are numbers from 0."""
    rules.check()
    blocks = matrix.packed(df, features, target)
    widths, p = sizes(blocks.features, rules), blocks.features
    scale = (0.0, 1.0)
    if not rules.classes:

        def moments(found: Iterator[matrix.Block]) -> np.ndarray:
            total = np.zeros(2)
            for block in found:
                total += block.y.sum(), (block.y**2).sum()
            return total

        mean, square = matrix.summed(blocks, moments, 2) / max(blocks.rows, 1)
        scale = (float(mean), float(np.sqrt(max(square - mean**2, 0.0))) or 1.0)
    theta = first_weights(widths, rules)
    if blocks.rows * 8 * (p + 1) <= local_bytes:

        def all_epochs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sorted(matrix.read(batches, p, "<f8"), key=lambda b: (b.part, b.seq))

            def here(state: State, number: int, rate: float) -> tuple[State, np.ndarray]:
                order = np.random.default_rng([rules.seed, 6, number]).permutation(len(held))
                return state, epoch((held[i] for i in order), state, widths, rules, number, rate, scale)

            kept, scores = descend(here, theta, rules)
            yield pa.RecordBatch.from_arrays([pa.array([kept.tobytes()], pa.binary()), pa.array([scores], pa.list_(pa.float64()))], ["theta", "scores"])

        row = blocks.table.repartition(1).mapInArrow(all_epochs, "theta binary, scores array<double>").first()
        return Network(rules, widths, np.frombuffer(row["theta"], "<f8"), scale, list(row["scores"]))

    def spread(state: State, number: int, rate: float) -> tuple[State, np.ndarray]:
        shared = df.sparkSession.sparkContext.broadcast(state)

        def task(found: Iterator[matrix.Block]) -> np.ndarray | None:
            mine = shared.value
            mine = State(mine.theta.copy(), mine.first.copy(), mine.second.copy(), mine.steps)
            sums = epoch(found, mine, widths, rules, number, rate, scale)
            n = sums[0]
            return np.concatenate([n * mine.theta, n * mine.first, n * mine.second, [n * mine.steps], sums])

        size = len(theta)
        total = matrix.summed(blocks, task, 3 * size + 7)
        sums = total[-6:]
        mean = total[:-6] / max(sums[0], 1.0)
        return State(mean[:size], mean[size : 2 * size], mean[2 * size : 3 * size], float(mean[-1])), sums

    kept, scores = descend(spread, theta, rules)
    return Network(rules, widths, kept, scale, scores)
