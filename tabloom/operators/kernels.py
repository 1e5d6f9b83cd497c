"""Kernels by landmarks, and support vector regression on them.

A kernel machine needs the kernel of every two rows. ``KernelMap`` (Nystroem) gives rows as many features as there
are landmarks, whose inner products are the kernel: exact between landmarks, and for all rows where the landmarks
are all different rows of the table. Its cost grows with rows times landmarks. Landmarks are a seeded sample of
``n_components`` rows, a documented bound. Directions of negative curvature, which the sigmoid kernel can have, are
left out.

``fit`` minimises ``|w|²/2 + C sum(max(0, |y - w·phi(x) - b| - epsilon))``. Every pass adds up value, gradient and
second derivatives over the tasks, with the kinks of the loss rounded off over a width that shrinks to
``LAST_WIDTH`` of the target's spread; steps are Newton steps that are halved until the value falls. Rows that take
up to ``LOCAL_BYTES`` are solved inside one task by the same code.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabloom.functions import matrix

KERNELS = ("linear", "rbf", "poly", "sigmoid")
LOCAL_BYTES = 64 << 20
#: Width of the rounded kinks, as a share of the target's spread: first and last, each a tenth of the one before.
FIRST_WIDTH, LAST_WIDTH = 1.0, 1e-4
#: Newton steps per width at most, and the relative fall of the value at which they stop.
STEPS, TOLERANCE = 30, 1e-9
#: Eigenvalues below this share of the largest are noise.
LEAST_EIGENVALUE = 1e-10
#: Rows whose kernel values are held at a time.
SLICE_ROWS = 4_096


def kernel(kind: str, x: np.ndarray, z: np.ndarray, gamma: float, degree: int = 3, offset: float = 0.0) -> np.ndarray:
    """The kernel of each row of ``x`` with each of ``z``."""
    inner = x @ z.T
    if kind == "linear":
        return inner
    if kind == "rbf":
        apart = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1) - 2 * inner
        return np.exp(-gamma * np.maximum(apart, 0.0))
    scaled = gamma * inner + offset
    return scaled**degree if kind == "poly" else np.tanh(scaled)


@dataclass
class KernelMap:
    """Features of rows whose inner products are a kernel; the rows as they are for the linear one."""

    kernel: str
    gamma: float
    degree: int = 3
    offset: float = 0.0
    landmarks: list[list[float]] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)

    @classmethod
    def of(cls, kind: str, gamma: float, rows: np.ndarray, degree: int = 3, offset: float = 0.0) -> KernelMap:
        """The map by these landmarks."""
        if kind == "linear" or not len(rows):
            return cls("linear", gamma)
        rows = np.unique(rows, axis=0)
        values, vectors = np.linalg.eigh(kernel(kind, rows, rows, gamma, degree, offset))
        kept = values > LEAST_EIGENVALUE * max(values.max(), 1e-300)
        return cls(kind, gamma, degree, offset, rows.tolist(), (vectors[:, kept] / np.sqrt(values[kept])).tolist())

    def values(self, x: np.ndarray) -> np.ndarray:
        """The kernel of rows with the landmarks; the rows for the linear one."""
        if self.kernel == "linear":
            return x
        return kernel(self.kernel, x, np.array(self.landmarks), self.gamma, self.degree, self.offset)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x if self.kernel == "linear" else self.values(x) @ np.array(self.weights)

    def apply(self, df: DataFrame) -> DataFrame:
        """Replace the vector column ``features``."""
        if self.kernel == "linear":
            return df
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def mapped(x: pa.Array) -> pa.Array:
            # One array for the batch, and kernel values of a slice of it at a time.
            rows, found = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 0)), None
            for i in range(0, len(x), SLICE_ROWS):
                part = shared.value(rows[i : i + SLICE_ROWS])
                found = np.empty((len(x), part.shape[1])) if found is None else found
                found[i : i + SLICE_ROWS] = part
            width = 0 if found is None else found.shape[1]
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width, pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.array(np.zeros(0) if found is None else found.reshape(-1)))

        return df.withColumn("features", array_to_vector(mapped(vector_to_array("features"))))


def landmark_rows(df: DataFrame, features: Sequence[Column], count: int, seed: int) -> np.ndarray:
    """A seeded sample of ``count`` different rows, if there are as many among twice that number."""
    drawn = df.select(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)).alias("h"), F.array(*(f.cast("double") for f in features)).alias("x"))
    rows = [tuple(r["x"]) for r in drawn.orderBy("h").limit(2 * count).collect()]
    return np.array(list(dict.fromkeys(rows))[:count]).reshape(-1, len(features))


@dataclass
class Rules:
    """Support vector regression."""

    penalty: float = 1.0
    epsilon: float = 0.1


def objective(theta: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], weights: np.ndarray | None, rules: Rules, width: float) -> np.ndarray:
    """Flat sums over rows: loss, gradient and second derivatives, with kinks rounded off over ``width``.

    Blocks are kernel values (rows x landmarks); features are those times ``weights``, or the values themselves
    without. Only rows on a kink have second derivatives and need their features.
    """
    d = len(theta)
    total = np.zeros(1 + d + d * d)
    by_value = theta[:-1] if weights is None else weights @ theta[:-1]
    slopes = np.zeros(len(by_value))
    for values, y in blocks:
        error = values @ by_value + theta[-1] - y
        beyond = np.abs(error) - rules.epsilon
        curved, straight = (beyond > 0) & (beyond <= width), beyond > width
        total[0] += (beyond[curved] ** 2).sum() / (2 * width) + (beyond[straight] - width / 2).sum()
        slope = np.where(curved, beyond / width, straight.astype(float)) * np.sign(error)
        slopes += values.T @ slope
        total[d] += slope.sum()
        if curved.any():
            phi = values[curved] if weights is None else values[curved] @ weights
            one = np.column_stack([phi, np.ones(len(phi))])
            total[1 + d :] += (one.T @ one / width).ravel()
    total[1:d] = slopes if weights is None else weights.T @ slopes
    return total


def solve(sums: Callable[[np.ndarray, float], np.ndarray], d: int, start: float, spread: float, rules: Rules) -> np.ndarray:
    """Weights and intercept (last) from passes ``sums(theta, width)``."""
    theta = np.zeros(d)
    theta[-1] = start
    ridge = np.append(np.ones(d - 1), 1e-9)

    def at(theta: np.ndarray, width: float) -> tuple[float, np.ndarray, np.ndarray]:
        total = sums(theta, width) * rules.penalty
        value = total[0] + 0.5 * float((theta[:-1] ** 2).sum())
        return value, total[1 : 1 + d] + np.append(theta[:-1], 0.0), total[1 + d :].reshape(d, d) + np.diag(ridge)

    width = FIRST_WIDTH * spread
    while True:
        value, gradient, second = at(theta, width)
        for _ in range(STEPS):
            # A little damping where no row is on a kink.
            step = np.linalg.solve(second + 1e-10 * np.trace(second) / d * np.eye(d), -gradient)
            share = 1.0
            while True:
                found = at(theta + share * step, width)
                if found[0] <= value + 1e-4 * share * float(gradient @ step) or share < 1e-4:
                    break
                share /= 4
            fall = value - found[0]
            if fall <= 0:
                break
            theta = theta + share * step
            value, gradient, second = found
            if fall <= TOLERANCE * abs(value):
                break
        if width <= LAST_WIDTH * spread:
            return theta
        width /= 10


@dataclass
class Regressor:
    """A kernel map, weights and intercept."""

    kernel: KernelMap
    theta: np.ndarray

    @property
    def importances(self) -> np.ndarray | None:
        return np.abs(self.theta[:-1]) if self.kernel.kernel == "linear" else None

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.theta[:-1] + self.theta[-1]

    def predict(self, df: DataFrame, features: str, output: str) -> DataFrame:
        """Add an array of the one value. ``features`` is a column of arrays."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scored(arrays: pd.Series) -> pd.Series:
            if not len(arrays):
                return pd.Series([], dtype="object")
            return pd.Series(list(shared.value.values(np.stack(arrays.to_numpy()))[:, None]))

        return df.withColumn(output, scored(features))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        record = {"kernel": vars(self.kernel), "theta": self.theta.tolist()}
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/regressor")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Regressor:
        d = json.loads(spark.read.text(f"{path}/regressor").first()[0])
        return cls(KernelMap(**d["kernel"]), np.array(d["theta"]))


def fit(df: DataFrame, features: Sequence[Column], target: Column, rules: Rules, kernel_map: KernelMap, local_bytes: int = LOCAL_BYTES) -> Regressor:
    """Support vector regression on numeric features without nulls."""
    blocks = matrix.packed(df, features, target)
    d = (len(kernel_map.weights[0]) if kernel_map.kernel != "linear" else blocks.features) + 1

    def moments(found: Iterator[matrix.Block]) -> np.ndarray:
        total = np.zeros(2)
        for block in found:
            total += block.y.sum(), (block.y**2).sum()
        return total

    mean, square = matrix.summed(blocks, moments, 2) / max(blocks.rows, 1)
    spread = float(np.sqrt(max(square - mean**2, 0.0))) or 1.0
    p = blocks.features
    width = len(kernel_map.landmarks) or d
    weights = np.array(kernel_map.weights) if kernel_map.kernel != "linear" else None
    if blocks.rows * 8 * (p + width + 1) <= local_bytes:

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(kernel_map.values(b.x), b.y) for b in sorted(matrix.read(batches, p, "<f8"), key=lambda b: (b.part, b.seq))]
            theta = solve(lambda theta, width: objective(theta, iter(held), weights, rules, width), d, float(mean), spread, rules)
            yield pa.RecordBatch.from_arrays([pa.array([theta.tobytes()], pa.binary())], ["theta"])

        row = blocks.table.repartition(1).mapInArrow(here, "theta binary").first()
        return Regressor(kernel_map, np.frombuffer(row["theta"], "<f8"))
    shared = df.sparkSession.sparkContext.broadcast((kernel_map, weights))

    def sliced(found: Iterator[matrix.Block]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in found:
            for i in range(0, len(b.y), SLICE_ROWS):
                yield shared.value[0].values(b.x[i : i + SLICE_ROWS]), b.y[i : i + SLICE_ROWS]

    def sums(theta: np.ndarray, width: float) -> np.ndarray:
        return matrix.summed(blocks, lambda found: objective(theta, sliced(found), shared.value[1], rules, width), 1 + d + d * d)

    return Regressor(kernel_map, solve(sums, d, float(mean), spread, rules))
