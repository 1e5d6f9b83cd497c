"""Gradient-boosted trees with second-order splits.

Each round fits one tree (one per class beyond two) to the gradients g and curvatures h of the loss at the current
margins: squared error, logistic loss, or softmax loss. Features are cut at up to 256 values, and a level of a tree
is one pass: every task adds g and h of its rows per (node, feature, bin), the sums of a node meet in one task, and
the best split reaches the driver. With G and H the sums over a side, a split gains
``G_left²/(H_left + l2) + G_right²/(H_right + l2) - G²/(H + l2)``, and a leaf weighs ``-eta G/(H + l2)``.

Columns are drawn per tree, rows per round by draws seeded by block, so repeated tasks agree. Spark keeps the blocks
with the margins of the round, so a tree is added to them once; they are checkpointed every ``WRITE_ROUNDS`` rounds.
Rows that take up to ``LOCAL_BYTES`` are boosted inside one task by the same code, which saves a job per level.

The model is at most rounds x classes x 2^(depth + 1) nodes, whatever the rows, and is broadcast for scoring.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabloom.functions import matrix
from tabloom.operators.forest import Tree

BINS = 256
#: Rows of the sample that the cuts of features with more different values come from.
BIN_ROWS = 200_000
LOCAL_BYTES = 64 << 20
WRITE_ROUNDS = 25
#: Bytes of blocks in a task of a pass, where the cores don't ask for smaller ones.
TASK_BYTES = 64 << 20
#: Least gain of a split.
LEAST_GAIN = 1e-6


@dataclass
class Rules:
    """``classes`` is 0 for a numeric target."""

    rounds: int = 100
    max_depth: int = 6
    eta: float = 0.1
    subsample: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    classes: int = 0
    seed: int = 42

    @property
    def outputs(self) -> int:
        return self.classes if self.classes > 2 else 1


def gradients(margin: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the margins (rows x outputs)."""
    if not classes:
        return margin - y[:, None], np.ones_like(margin)
    if classes == 2:
        p = 1.0 / (1.0 + np.exp(-margin))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    p = shares(margin, classes)
    hit = np.zeros_like(p)
    hit[np.arange(len(y)), y.astype(np.int64)] = 1.0
    return p - hit, np.maximum(2 * p * (1 - p), 1e-16)


def shares(margin: np.ndarray, classes: int) -> np.ndarray:
    """Class probabilities of margins."""
    if classes == 2:
        second = 1.0 / (1.0 + np.exp(-margin))
        return np.concatenate([1 - second, second], axis=1)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Walk:
    """A tree on bins as the arrays of a step down; a leaf leads to itself."""

    def __init__(self, tree: Tree) -> None:
        inner = tree.feature >= 0
        self.feature = np.where(inner, tree.feature, 0).astype(np.intp)
        self.cut = np.where(inner, tree.threshold, BINS - 1).astype(np.uint8)
        self.left = np.where(inner, tree.left, np.arange(len(inner))).astype(np.intp)
        self.value = tree.value
        self.height, level = 0, np.flatnonzero(inner[:1])
        while len(level):
            level = np.concatenate([tree.left[level], tree.left[level] + 1])
            level = level[inner[level]]
            self.height += 1


@dataclass
class _Rows:
    """A block of binned rows (column after column) with their margins."""

    part: int
    seq: int
    bins: np.ndarray
    y: np.ndarray
    margin: np.ndarray
    round: int = -1
    g: np.ndarray = field(default_factory=lambda: np.zeros(0))
    h: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Per output the node that each row has come down to in the round's tree, and how many steps that took.
    at: list[np.ndarray] = field(default_factory=list)
    steps: list[int] = field(default_factory=list)

    def __reduce__(self) -> tuple:
        return _Rows, (self.part, self.seq, self.bins, self.y, self.margin)

    def begin(self, number: int, outputs: int) -> None:
        self.round = number
        self.at = [np.zeros(len(self.y), np.intp) for _ in range(outputs)]
        self.steps = [0] * outputs

    def derive(self, number: int, rules: Rules) -> None:
        """Gradients of a round; rows that it leaves out have none."""
        if self.round == number:
            return
        self.g, self.h = gradients(self.margin, self.y, rules.classes)
        if rules.subsample < 1:
            out = np.random.default_rng([rules.seed, 1, number, self.part, self.seq]).random(len(self.y)) >= rules.subsample
            self.g[out], self.h[out] = 0.0, 0.0
        self.begin(number, rules.outputs)

    def descend(self, k: int, walk: _Walk) -> np.ndarray:
        """Move rows on to the open nodes of a tree that has grown."""
        bins, row = self.bins.T.reshape(-1), np.arange(len(self.y))
        # Where a node's column begins.
        column = walk.feature * len(self.y)
        for _ in range(self.steps[k], walk.height):
            at = self.at[k]
            value = bins.take(column.take(at) + row)
            self.at[k] = walk.left.take(at) + (value > walk.cut.take(at))
        self.steps[k] = walk.height
        return self.at[k]

    def add(self, walks: list[_Walk]) -> None:
        for k, walk in enumerate(walks):
            self.margin[:, k] += walk.value[self.descend(k, walk)]


@dataclass
class _Growing:
    """A tree of a round on bins: ``threshold`` is the number of the cut."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])

    def tree(self) -> Tree:
        return Tree(np.array(self.feature, np.int32), np.array(self.threshold), np.array(self.left, np.int64), np.array(self.value))


def histograms(rows: _Rows, walks: list[_Walk], opened: list[list[int]], columns: np.ndarray, total: list[np.ndarray]) -> None:
    """Add a block's g and h to ``total``: per output (open node, drawn column, bin, g and h)."""
    for k, (walk, nodes) in enumerate(zip(walks, opened)):
        if not nodes:
            continue
        # Rows at closed nodes come last and are left out.
        place = np.full(len(walk.left), len(nodes) * BINS)
        place[nodes] = np.arange(len(nodes)) * BINS
        here, size = place.take(rows.descend(k, walk)), (len(nodes) + 1) * BINS
        sides = [np.ascontiguousarray(side[:, k]) for side in (rows.g, rows.h)]
        for c, f in enumerate(columns[k]):
            cell = here + rows.bins[:, f]
            for i, side in enumerate(sides):
                total[k][:, c, :, i] += np.bincount(cell, side, size)[:-BINS].reshape(-1, BINS)


def best_split(histogram: np.ndarray, rules: Rules) -> tuple[float, int, int, float, float, float, float]:
    """Of a node's (column, bin, g and h): gain, column, cut, and G and H of both sides; a gain of 0 is no split."""
    total = histogram.sum(axis=1, keepdims=True)
    left = np.cumsum(histogram, axis=1)[:, :-1]
    right = total - left

    def score(side: np.ndarray) -> np.ndarray:
        return side[..., 0] ** 2 / (side[..., 1] + rules.l2)

    gain = score(left) + score(right) - score(total)
    # Sums of curvatures of no rows may be off zero by rounding.
    least = max(rules.min_child_weight, 1e-12 * float(total[..., 1].max()))
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), gain, 0.0)
    c, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    best = float(gain[c, cut])
    if best / 2 - rules.gamma <= LEAST_GAIN:
        best = 0.0
    return best, int(c), int(cut), *map(float, left[c, cut]), *map(float, right[c, cut])


class _Here:
    """Passes over blocks in memory."""

    def __init__(self, rows: list[_Rows], rules: Rules) -> None:
        self.rows, self.rules = rows, rules

    def best(self, number: int, trees: list[Tree], opened: list[list[int]], columns: np.ndarray) -> dict:
        total, walks = [np.zeros((len(nodes), columns.shape[1], BINS, 2)) for nodes in opened], [_Walk(tree) for tree in trees]
        for rows in self.rows:
            rows.derive(number, self.rules)
            histograms(rows, walks, opened, columns, total)
        return {(k, node): best_split(total[k][i], self.rules) for k, nodes in enumerate(opened) for i, node in enumerate(nodes)}

    def add(self, number: int, trees: list[Tree]) -> None:
        walks = [_Walk(tree) for tree in trees]
        for rows in self.rows:
            rows.add(walks)


_BINNED = "part int, seq int, n int, x binary, y binary, margin binary"


class _Spread:
    """Passes over blocks that Spark keeps, in memory as far as they fit; each pass is one job."""

    def __init__(self, rows: RDD, rules: Rules) -> None:
        self.rows, self.rules = rows.persist(StorageLevel.MEMORY_AND_DISK), rules
        #: The blocks of the round before, until those of this one are made.
        self.before: RDD | None = None

    def best(self, number: int, trees: list[Tree], opened: list[list[int]], columns: np.ndarray) -> dict:
        rules, width, walks = self.rules, columns.shape[1], [_Walk(tree) for tree in trees]

        def count(blocks: Iterator[_Rows]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
            total = [np.zeros((len(nodes), width, BINS, 2)) for nodes in opened]
            for rows in blocks:
                rows.derive(number, rules)
                histograms(rows, walks, opened, columns, total)
            for k, nodes in enumerate(opened):
                for i, node in enumerate(nodes):
                    yield (k, node), total[k][i]

        tasks = min(sum(map(len, opened)), self.rows.context.defaultParallelism)
        counted = self.rows.mapPartitions(count).reduceByKey(np.add, tasks)
        found = dict(counted.mapValues(lambda total: best_split(total, rules)).collect())
        if self.before is not None:
            self.before.unpersist()
            self.before = None
        return found

    def add(self, number: int, trees: list[Tree]) -> None:
        outputs, walks = self.rules.outputs, [_Walk(tree) for tree in trees]

        def added(blocks: Iterator[_Rows]) -> Iterator[_Rows]:
            for rows in blocks:
                rows.begin(number, outputs)
                rows.add(walks)
                yield rows

        self.before, self.rows = self.rows, self.rows.mapPartitions(added).persist(StorageLevel.MEMORY_AND_DISK)
        if (number + 1) % WRITE_ROUNDS == 0:
            # Lost blocks are made again from here.
            self.rows.checkpoint()

    def close(self) -> None:
        for rows in (self.before, self.rows):
            if rows is not None:
                rows.unpersist()


def _batch(rows: _Rows) -> pa.RecordBatch:
    cells = [[rows.part], [rows.seq], [len(rows.y)], [rows.bins.tobytes("F")], [rows.y.tobytes()], [rows.margin.tobytes()]]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], ["part", "seq", "n", "x", "y", "margin"])


def _rows(cells: Sequence, features: int, outputs: int) -> _Rows:
    """A block from the cells of a row of ``_BINNED``."""
    part, seq, n, x, y, margin = cells
    bins = np.frombuffer(x, np.uint8).reshape(features, n).T
    return _Rows(part, seq, bins, np.frombuffer(y, "<f8"), np.frombuffer(margin, "<f8").reshape(n, outputs).copy())


def read(batches: Iterator[pa.RecordBatch], features: int, outputs: int) -> Iterator[_Rows]:
    for batch in batches:
        for cells in zip(*(column.to_pylist() for column in batch.columns)):
            yield _rows(cells, features, outputs)


def boost(passes: _Here | _Spread, features: int, rules: Rules) -> tuple[list[list[Tree]], np.ndarray, np.ndarray]:
    """The trees per round, on bins; the gain and the number of splits of each feature."""
    rounds, gains, splits = [], np.zeros(features), np.zeros(features)
    width = max(1, int(rules.columns * features))
    for number in range(rules.rounds):
        growing = [_Growing() for _ in range(rules.outputs)]
        columns = np.array([np.sort(np.random.default_rng([rules.seed, 2, number, k]).permutation(features)[:width]) for k in range(rules.outputs)])
        for _ in range(rules.max_depth):
            opened = [g.open for g in growing]
            if not any(opened):
                break
            found = passes.best(number, [g.tree() for g in growing], opened, columns)
            for k, g in enumerate(growing):
                nodes, g.open = g.open, []
                for node in nodes:
                    gain, c, cut, *sums = found[k, node]
                    if gain == 0:
                        if node == 0:
                            # No split at all: the tree is its root.
                            g.value[0] = -rules.eta * (sums[0] + sums[2]) / (sums[1] + sums[3] + rules.l2)
                        continue
                    f = int(columns[k][c])
                    gains[f] += gain
                    splits[f] += 1
                    g.feature[node], g.threshold[node], g.left[node] = f, float(cut), len(g.left)
                    for grad, curve in (sums[:2], sums[2:]):
                        g.open.append(len(g.left))
                        g.feature.append(-1)
                        g.threshold.append(0.0)
                        g.left.append(0)
                        g.value.append(-rules.eta * grad / (curve + rules.l2))
        trees = [g.tree() for g in growing]
        rounds.append(trees)
        if number + 1 < rules.rounds:
            passes.add(number, trees)
    return rounds, gains, splits


@dataclass
class Booster:
    """The first margins and the trees of all rounds, on values."""

    rules: Rules
    start: np.ndarray
    rounds: list[list[Tree]]
    importances: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        margin = np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                tree.add(x, margin[:, k : k + 1])
        return margin

    def predict(self, df: DataFrame, features: str, output: str) -> DataFrame:
        """Add an array: the value, or the probability of each class. ``features`` is a column of arrays."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scored(arrays: pd.Series) -> pd.Series:
            if not len(arrays):
                return pd.Series([], dtype="object")
            model = shared.value
            margin = model.margins(np.stack(arrays.to_numpy()).astype("<f4"))
            return pd.Series(list(shares(margin, model.rules.classes) if model.rules.classes else margin))

        return df.withColumn(output, scored(features))

    def save(self, path: str) -> None:
        rounds = [[[a.tolist() for a in (t.feature, t.threshold, t.left, t.value)] for t in trees] for trees in self.rounds]
        rest = {"rules": vars(self.rules), "start": self.start.tolist(), "importances": self.importances.tolist()}
        lines = [(i, json.dumps(line)) for i, line in enumerate([rest, *rounds])]
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        spark.createDataFrame(lines, "line int, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/booster")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Booster:
        rest, *rounds = (json.loads(r["value"]) for r in spark.read.parquet(f"{path}/booster").orderBy("line").collect())
        trees = [[Tree(np.array(f, np.int32), np.array(t), np.array(n, np.int64), np.array(v)) for f, t, n, v in found] for found in rounds]
        return cls(Rules(**rest["rules"]), np.array(rest["start"]), trees, np.array(rest["importances"]))


def _start(blocks: matrix.Blocks, rules: Rules) -> np.ndarray:
    """The margins that fit best without features: the mean, the log odds, or the logarithms of the class shares."""
    size = max(rules.classes, 1)

    def sums(found: Iterator[matrix.Block]) -> np.ndarray:
        total = np.zeros(size)
        for block in found:
            total += np.bincount(block.y.astype(np.int64), minlength=size) if rules.classes else block.y.sum()
        return total

    share = matrix.summed(blocks, sums, size) / max(blocks.rows, 1)
    if not rules.classes:
        return share
    safe = np.clip(share, 1e-9, 1 - 1e-9)
    return np.log(safe[1:] / safe[:1]) if rules.classes == 2 else np.log(safe)


def fit(df: DataFrame, features: Sequence[Column], target: Column, rules: Rules, local_bytes: int = LOCAL_BYTES) -> Booster:
    """Boost trees on numeric features without nulls; class targets are numbers from 0."""
    blocks = matrix.packed(df, features, target, "<f4")
    edges = matrix.bin_edges(blocks, BINS, BIN_ROWS, rules.seed)
    start, p = _start(blocks, rules), blocks.features
    shared = df.sparkSession.sparkContext.broadcast((edges, start))

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, start = shared.value
        for block in matrix.read(batches, p, "<f4"):
            yield _batch(_Rows(block.part, block.seq, matrix.binned(block.x, edges), block.y, np.tile(start, (len(block.y), 1))))

    table = blocks.table.mapInArrow(bin_rows, _BINNED)
    if blocks.rows * (p + 8 + 32 * rules.outputs) <= local_bytes:

        def all_rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = sorted(read(batches, p, rules.outputs), key=lambda r: (r.part, r.seq))
            rounds, gains, splits = boost(_Here(rows, rules), p, rules)
            cells = [[[t.dump() for trees in rounds for t in trees]], [gains.tolist()], [splits.tolist()]]
            types = [pa.list_(pa.binary()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], ["trees", "gains", "splits"])

        row = table.repartition(1).mapInArrow(all_rounds, "trees array<binary>, gains array<double>, splits array<double>").first()
        every = [Tree.load(bytes(raw)) for raw in row["trees"]]
        rounds = [every[i : i + rules.outputs] for i in range(0, len(every), rules.outputs)]
        gains, splits = np.array(row["gains"]), np.array(row["splits"])
    else:
        cores, outputs = df.sparkSession.sparkContext.defaultParallelism, rules.outputs
        tasks = cores * math.ceil(blocks.rows * (p + 8 + 8 * outputs) / (cores * TASK_BYTES))
        passes = _Spread(table.repartition(tasks).rdd.map(lambda cells: _rows(cells, p, outputs)), rules)
        try:
            rounds, gains, splits = boost(passes, p, rules)
        finally:
            passes.close()
    for trees in rounds:
        for tree in trees:
            # From the number of a cut to its value.
            tree.threshold = np.array([edges[f][int(c)] if f >= 0 else c for f, c in zip(tree.feature, tree.threshold)])
    mean = np.divide(gains, splits, out=np.zeros(p), where=splits > 0)
    return Booster(rules, start, rounds, mean / mean.sum() if mean.any() else mean)
