"""Random forests of any depth: the top of each tree by distributed histograms, the rest inside tasks.

1. Rows are packed blocks (``functions.matrix``) of single-precision features. Bootstrap counts are Poisson draws
   seeded by tree and block, so no sample is ever stored and a repeated task draws the same.
2. While a node holds more rows than a task can take, its split comes from histograms over quantile bins: every
   task adds up its rows, the sums of a node meet in one task, and only the best split reaches the driver.
3. A node whose rows fit a task is grown to its leaves there, level by level in numpy, with exact splits: rows are
   routed through the tops of the trees, packed per (tree, node) and shuffled once.

Rows are routed to a hundred trees, so the routed rows are many times the table. Trees are grown one lot after the
other, a lot being as many as ``SHUFFLED_BYTES`` of rows go to, and each lot's shuffle files are deleted before the next.

The trees are rows of a written table, a subtree each, and never part of a task's closure. Scoring broadcasts
them while they are small (their bytes are counted); a larger forest is joined with the rows routed to it, in lots too.

Splits minimise the Gini impurity or the squared error. As many features as ``max_features`` says are drawn per
node, and more while the node has no split. A node is a leaf when its rows are of one value, when no feature
separates them, at ``max_depth``, or below ``min_samples_split`` rows; children hold ``min_samples_leaf`` rows.
"""

from __future__ import annotations

import functools
import io
import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabloom.functions import matrix
from tabloom.session import durable, folded, freed_shuffles

#: Bytes of rows that a task grows at once.
NODE_BYTES = 32 << 20
#: Bytes of rows, unpacked, that a task is sent for all its nodes.
ROUTED_BYTES = 256 << 20
#: Bytes of rows, unpacked, and of subtrees that are shuffled at once, for one tree or one group of subtrees at least.
SHUFFLED_BYTES = 4 << 30
#: Rows are numbered in this many bits while they are sorted.
ROW_BITS = 21
#: Bins of a feature in the histograms of the tops, and rows of the sample whose quantiles are the bins.
BINS = 256
BIN_ROWS = 200_000
#: Bytes of histograms that a task holds at once.
HISTOGRAM_BYTES = 64 << 20
#: Forests up to this size are broadcast for scoring.
BROADCAST_BYTES = 64 << 20
#: Bytes of the subtrees that score rows together, rows (and bytes of rows and their sums) that one copy of them scores,
#: and bytes of the parts that are summed at once.
GROUP_BYTES = 64 << 20
SCORED_ROWS = 16_000_000
SCORED_BYTES = 256 << 20
CHUNK_BYTES = 64 << 20


def drawn_features(value: Any, features: int) -> int:
    """How many features a node draws: 'sqrt', 'log2', 'all' or None, a share, or a number."""
    if value in (None, "all"):
        return features
    if value == "sqrt":
        return max(1, math.isqrt(features))
    if value == "log2":
        return max(1, int(math.log2(features))) if features else 1
    if isinstance(value, float):
        return max(1, int(value * features))
    return min(features, max(1, int(value)))


@dataclass
class Rules:
    """What decides where trees split and end; ``classes`` is 0 for numeric targets and for two classes."""

    trees: int = 100
    max_depth: int | None = None
    min_leaf: int = 1
    min_split: int = 2
    drawn: int = 1
    classes: int = 0
    seed: int = 42
    bootstrap: bool = True


@dataclass
class Tree:
    """Nodes as arrays, children after parents; a leaf has feature -1. Leaves of many classes list their shares."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    shares: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def dump(self) -> bytes:
        """Arrays as compressed bytes; an inner node needs no value and a leaf no threshold, so both share one array.

        Children that are numbered in the order of their parents need no numbers at all.
        """
        target = io.BytesIO()
        number = np.frombuffer(matrix.planes(np.where(self.feature >= 0, self.threshold, self.value)), np.uint8)
        left = self.left[:0] if np.array_equal(self.left, _children(self.feature)) else self.left
        widest = int(self.feature.max(initial=0))
        np.savez(target, self.feature.astype(np.int8 if widest < 128 else np.int32), number, left.astype(np.int32), *(self.shares or ()))
        return matrix.squeezed(target.getvalue())

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        # Trees that were saved plainly are archives as they are.
        found = np.load(io.BytesIO(raw if raw[:2] == b"PK" else matrix.unsqueezed(raw)))
        feature, number, left, *shares = (found[name] for name in found.files)
        if number.dtype == np.uint8:
            number = matrix.from_planes(number.tobytes(), "<f8")
        left = left.astype(np.int64) if len(left) == len(feature) else _children(feature)
        return cls(feature.astype(np.int32), number, left, number, tuple(shares) or None)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; the right child of a node follows its left child."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            node = at[rows]
            feature = self.feature[node]
            inner = feature >= 0
            rows, node, feature = rows[inner], node[inner], feature[inner]
            at[rows] = self.left[node] + (x[rows, feature] > self.threshold[node])
        return at

    def add(self, x: np.ndarray, total: np.ndarray) -> None:
        """Add the prediction for each row: a value, or shares per class."""
        leaf = self.leaves(x)
        if self.shares is None:
            total[:, 0] += self.value[leaf]
            return
        first, classes, share = self.shares
        n = first[leaf + 1] - first[leaf]
        at = np.repeat(first[leaf] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        np.add.at(total, (np.repeat(np.arange(len(x)), n), classes[at]), share[at])


def _children(feature: np.ndarray) -> np.ndarray:
    """Left children that follow each other in the order of their parents; 0 for leaves."""
    inner = feature >= 0
    return np.where(inner, 2 * np.cumsum(inner) - 1, 0).astype(np.int64)


class _Nodes:
    """Sums of the rows of each open node, and how good a split of sorted rows is.

    For a numeric target (and two classes, coded 0 and 1) the score of a side is (sum of targets)² / weight, for
    more classes the sum of squared class weights / weight: maximal where squared error or Gini impurity is least.
    """

    def __init__(self, slot: np.ndarray, n: int, w: np.ndarray, y: np.ndarray, classes: int) -> None:
        self.w, self.y, self.classes = w, y, classes
        self.weight = np.bincount(slot, w, n)
        self.rows = np.bincount(slot, minlength=n)
        if classes:
            self.kind = slot * classes + y.astype(np.int64)
            keys, self.kind = np.unique(self.kind, return_inverse=True)
            self.kind_weight = np.bincount(self.kind, w)
            self.squares = np.bincount(keys // classes, self.kind_weight**2, n)
            self.pure = np.bincount(keys // classes, minlength=n) <= 1
            self.score = self.squares / self.weight
        else:
            self.sum = np.bincount(slot, w * y, n)
            low, high = np.full(n, np.inf), np.full(n, -np.inf)
            np.minimum.at(low, slot, y)
            np.maximum.at(high, slot, y)
            self.pure = low == high
            self.score = self.sum**2 / self.weight

    def scores(self, row: np.ndarray, slot: np.ndarray, first: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Score of both sides for cuts behind the positions ``cut`` of sorted rows; ``first`` starts a slot's rows."""
        w = self.w[row]
        here = slot[cut]

        def left(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0.0], np.cumsum(values)])
            return total[cut + 1] - total[first[here]]

        weight = left(w)
        if not self.classes:
            part = left(w * self.y[row])
            return part**2 / weight + (self.sum[here] - part) ** 2 / (self.weight[here] - weight)
        kind = self.kind[row]
        order = np.argsort(kind, kind="stable")
        before = np.cumsum(w[order]) - w[order]
        starts = np.flatnonzero(np.concatenate([[True], kind[order][1:] != kind[order][:-1]]))
        before -= np.repeat(before[starts], np.diff(np.append(starts, len(order))))
        seen = np.empty(len(row))
        seen[order] = before
        squares = left(2 * w * seen + w * w)
        mixed = left(w * self.kind_weight[kind])
        return squares / weight + (self.squares[here] - 2 * mixed + squares) / (self.weight[here] - weight)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, rules: Rules, seed: Sequence[int], depth: int = 0) -> tuple[Tree, np.ndarray]:
    """A tree grown to its leaves on rows with weights (all positive), and the gain of each feature."""
    n, p = x.shape
    random = np.random.default_rng(seed)
    codes, values = np.empty((p, n), np.uint64), []
    for f in range(p):
        found, codes[f] = np.unique(x[:, f], return_inverse=True)
        values.append(found.astype(np.float64))
    code_bits = max(1, int(max(len(v) for v in values) - 1).bit_length())
    row_bits = max(1, int(n - 1).bit_length())
    gains = np.zeros(p)
    feature, threshold, left, value = [], [], [], []
    shares: tuple[list, list, list] = ([], [], [])
    slot, rows, a, done = np.zeros(n, np.int64), np.arange(n), 1, 1
    while a:
        nodes = _Nodes(slot, a, w[rows], y[rows], rules.classes)
        best = np.full(a, -np.inf)
        best_feature, best_code, best_threshold = np.full(a, -1), np.zeros(a, np.uint64), np.zeros(a)
        tried = ~nodes.pure & (nodes.rows >= max(rules.min_split, 2 * rules.min_leaf))
        if rules.max_depth is not None and depth >= rules.max_depth:
            tried[:] = False
        order = np.broadcast_to(np.arange(p, dtype=np.int16), (a, p)).copy() if tried.any() else np.zeros((a, 0), np.int16)
        for r in range(p):
            if r >= rules.drawn:
                tried = tried & np.isinf(best)
            if not tried.any():
                break
            # The next feature of each node's own random order.
            other = random.integers(r, p, a)
            every = np.arange(a)
            order[every, r], order[every, other] = order[every, other], order[every, r].copy()
            use = np.flatnonzero(tried[slot])
            f = order[slot[use], r].astype(np.int64)
            key = (slot[use].astype(np.uint64) << np.uint64(code_bits + row_bits)) | (codes[f, rows[use]] << np.uint64(row_bits)) | use.astype(np.uint64)
            key.sort()
            row = (key & np.uint64((1 << row_bits) - 1)).astype(np.int64)
            place = key >> np.uint64(row_bits)
            of = slot[row]
            first = np.searchsorted(of, np.arange(a))
            last = np.searchsorted(of, np.arange(a), "right")
            cut = np.flatnonzero((place[1:] != place[:-1]) & (of[1:] == of[:-1]))
            enough = (cut + 1 - first[of[cut]] >= rules.min_leaf) & (last[of[cut]] - cut - 1 >= rules.min_leaf)
            cut = cut[enough]
            if not len(cut):
                continue
            score = nodes.scores(row, of, first, cut)
            here = of[cut]
            starts = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
            top = np.maximum.reduceat(score, starts)
            counts = np.diff(np.append(starts, len(cut)))
            at = np.minimum.reduceat(np.where(score == np.repeat(top, counts), np.arange(len(cut)), len(cut)), starts)
            better = top > best[here[starts]]
            s, c = here[starts][better], cut[at[better]]
            best[s], best_feature[s] = top[better], order[s, r]
            mask = np.uint64((1 << code_bits) - 1)
            low, high = place[c] & mask, place[c + 1] & mask
            best_code[s] = low
            for g in np.unique(best_feature[s]):
                which = best_feature[s] == g
                lower, upper = values[g][low[which].astype(np.int64)], values[g][high[which].astype(np.int64)]
                middle = (lower + upper) / 2
                best_threshold[s[which]] = np.where(middle < upper, middle, lower)
        split = best_feature >= 0
        np.add.at(gains, best_feature[split], best[split] - nodes.score[split])
        child = np.zeros(a, np.int64)
        child[split] = done + 2 * np.arange(split.sum())
        feature.append(best_feature)
        threshold.append(best_threshold)
        left.append(child)
        if rules.classes:
            kinds, kind = np.unique(slot * rules.classes + y[rows].astype(np.int64), return_inverse=True)
            weights = np.bincount(kind, w[rows])
            of = kinds // rules.classes
            kept = ~split[of]
            shares[0].append(np.bincount(of[kept], minlength=a))
            shares[1].append(kinds[kept] % rules.classes)
            shares[2].append(weights[kept] / nodes.weight[of[kept]])
            value.append(np.zeros(a))
        else:
            value.append(nodes.sum / nodes.weight)
        inside = split[slot]
        rows, slot = rows[inside], slot[inside]
        right = codes[best_feature[slot], rows] > best_code[slot]
        slot = (child[slot] - done) + right
        done += 2 * int(split.sum())
        a = 2 * int(split.sum())
        depth += 1
    lists = None
    if rules.classes:
        lists = (np.concatenate([[0], np.cumsum(np.concatenate(shares[0]))]), np.concatenate(shares[1]).astype(np.int32), np.concatenate(shares[2]).astype(np.float32))
    tree = Tree(np.concatenate(feature).astype(np.int32), np.concatenate(threshold), np.concatenate(left), np.concatenate(value), lists)
    return tree, gains


def draws(block: matrix.Block, tree: int, rules: Rules) -> np.ndarray:
    """How often each row of a block is drawn for a tree."""
    if not rules.bootstrap:
        return np.ones(len(block.y), np.int64)
    return np.random.default_rng([rules.seed, tree, block.part, block.seq]).poisson(1.0, len(block.y))


@dataclass
class _Top:
    """The upper part of a tree; open nodes are grown in tasks."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    #: Nodes of one class or with too many rows for a task that are leaves, with their weight and the sums that make their values.
    closed: dict[int, np.ndarray] = field(default_factory=dict)

    def tree(self) -> Tree:
        return Tree(np.array(self.feature, np.int32), np.array(self.threshold), np.array(self.left, np.int64), np.zeros(len(self.left)))

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.left[node] = feature, threshold, len(self.left)
        for _ in range(2):
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(0)
            self.depth.append(self.depth[node] + 1)
        return self.left[node], self.left[node] + 1

    def leaf(self, node: int, classes: int) -> Tree:
        """A closed node as a tree."""
        weight, *sums = self.closed[node]
        value, shares = np.array([sums[0] / weight]), None
        if classes:
            kinds = np.flatnonzero(sums)
            value, shares = np.zeros(1), (np.array([0, len(kinds)]), kinds.astype(np.int32), (np.array(sums)[kinds] / weight).astype(np.float32))
        return Tree(np.array([-1], np.int32), np.zeros(1), np.zeros(1, np.int64), value, shares)


def _best_bins(histogram: np.ndarray, rules: Rules) -> tuple[int, int, int, float, np.ndarray, np.ndarray] | None:
    """Best cut of a node's histograms (drawn feature, bin, statistic): (which, bin, next bin with rows, gain,
    statistics of the left and of the right side).

    Statistics: rows, weight, then the sum of targets or the weight of each class.
    """
    total = histogram.sum(axis=1, keepdims=True)
    lower = np.cumsum(histogram, axis=1)[:, :-1]
    upper = total - lower
    fits = (lower[..., 0] >= rules.min_leaf) & (upper[..., 0] >= rules.min_leaf)
    if not fits.any():
        return None

    def score(part: np.ndarray) -> np.ndarray:
        return (part[..., 2:] ** 2).sum(axis=-1) / np.maximum(part[..., 1], 1e-300)

    gain = np.where(fits, score(lower) + score(upper) - score(total), -np.inf)
    which, bin = np.unravel_index(int(np.argmax(gain)), gain.shape)
    after = int(bin) + 1 + int(np.argmax(histogram[which, bin + 1 :, 0] > 0))
    return int(which), int(bin), after, float(gain[which, bin]), lower[which, bin], upper[which, bin]


def _pure(sums: Sequence[float], classes: int) -> bool:
    """Whether rows are of one class, from their weight and the weights of the classes (two: of the second one)."""
    weight, *kinds = sums
    return classes > 0 and max(*kinds, weight - sum(kinds)) == weight


def _grow_tops(blocks: matrix.Blocks, rules: Rules, node_rows: int, classes: int) -> tuple[list[_Top], np.ndarray]:
    """Split nodes by histograms until every open node has at most ``node_rows`` rows; others are closed as leaves.

    Nodes of one class are closed too: their rows need not be sent. ``classes`` counts two classes as two.
    """
    spark, p, dtype = blocks.table.sparkSession, blocks.features, blocks.dtype
    tops, gains = [_Top() for _ in range(rules.trees)], np.zeros((rules.trees, p))
    # A row is in a bootstrap sample with probability 1 - 1/e.
    sample = blocks.rows * (1 - math.exp(-1) if rules.bootstrap else 1)
    large = {(t, 0) for t in range(rules.trees)} if sample > node_rows and rules.max_depth != 0 else set()
    edges = matrix.bin_edges(blocks, BINS, BIN_ROWS, rules.seed) if large else []
    least = matrix.least_of_bins(blocks, edges, BINS) if large else np.zeros((p, BINS))
    stats = 2 + (rules.classes or 1)
    at_once = max(1, HISTOGRAM_BYTES // (rules.drawn * BINS * stats * 8))
    tries: dict[tuple[int, int], int] = {}
    while large:
        now = sorted(large)[:at_once]
        drawn = {}
        for t, node in now:
            order = np.random.default_rng([rules.seed, t, node]).permutation(p)
            start = tries.get((t, node), 0)
            # The last features of the order may be fewer than a node draws; doing one twice changes nothing.
            drawn[t, node] = np.resize(order[start : start + rules.drawn], rules.drawn)
        trees = {t: tops[t].tree() for t, _ in now}
        place = {t: np.full(len(tree.left), -1) for t, tree in trees.items()}
        for i, (t, node) in enumerate(now):
            place[t][node] = i
        shared = spark.sparkContext.broadcast((edges, trees, place, np.array([drawn[key] for key in now])))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, trees, place, chosen = shared.value
            total = np.zeros((len(chosen), rules.drawn, BINS, stats))
            for block in matrix.read(batches, p, dtype):
                bins = matrix.binned(block.x, edges)
                for t, tree in trees.items():
                    w = draws(block, t, rules)
                    where = place[t][tree.leaves(block.x)]
                    rows = np.flatnonzero((w > 0) & (where >= 0))
                    # The open nodes of a tree follow each other.
                    first, n = place[t][place[t] >= 0].min(), (place[t] >= 0).sum()
                    here, weight, y = where[rows], w[rows].astype(float), block.y[rows]
                    for r in range(rules.drawn):
                        cell = (here - first) * BINS + bins[rows, chosen[here, r]]
                        own = total[first : first + n, r]
                        own[..., 0] += np.bincount(cell, minlength=n * BINS).reshape(n, BINS)
                        own[..., 1] += np.bincount(cell, weight, n * BINS).reshape(n, BINS)
                        if rules.classes:
                            for kind in np.unique(y).astype(np.int64):
                                own[..., 2 + kind] += np.bincount(cell[y == kind], weight[y == kind], n * BINS).reshape(n, BINS)
                        else:
                            own[..., 2] += np.bincount(cell, weight * y, n * BINS).reshape(n, BINS)
            for i, (t, node) in enumerate(now):
                if total[i, 0, :, 0].any():
                    yield _histogram(t, node, total[i])

        def best(batches: pa.Table) -> pa.Table:
            t, node = batches.column("tree")[0].as_py(), batches.column("node")[0].as_py()
            total = sum(np.frombuffer(c.as_buffer(), "<f8") for c in batches.column("counts")).reshape(rules.drawn, BINS, stats)
            found = _best_bins(total, rules)
            which, bin, after, gain, lower, upper = found or (-1, 0, 0, 0.0, total[0].sum(axis=0), total[0, 0] * 0)
            return pa.table({"tree": [t], "node": [node], "which": [which], "bin": [bin], "after": [after], "gain": [gain], "lower": [lower.tolist()], "upper": [upper.tolist()]})

        counted = blocks.table.mapInArrow(count, "tree int, node long, counts binary")
        found = counted.groupBy("tree", "node").applyInArrow(best, "tree long, node long, which long, bin long, after long, gain double, lower array<double>, upper array<double>").collect()
        for row in found:
            key = row["tree"], row["node"]
            large.discard(key)
            if row["which"] < 0:
                # None of the drawn features separates the rows: the next ones; after the last the node is left whole.
                tries[key] = tries.get(key, 0) + rules.drawn
                if tries[key] < p:
                    large.add(key)
                else:
                    tops[key[0]].closed[key[1]] = np.array(row["lower"][1:])
                continue
            top, f = tops[key[0]], int(drawn[key][row["which"]])
            gains[key[0], f] += row["gain"]
            # Cuts are values; the threshold lies in the middle between a cut and the next value, as that of an exact split.
            cut, above = float(edges[f][row["bin"]]), float(least[f, row["after"]])
            middle = (cut + above) / 2
            children = top.split(key[1], f, middle if middle < above else cut)
            for child, sums in zip(children, (row["lower"], row["upper"])):
                if _pure(sums[1:], classes):
                    top.closed[child] = np.array(sums[1:])
                    continue
                if sums[0] <= node_rows:
                    continue
                if rules.max_depth is None or top.depth[child] < rules.max_depth:
                    large.add((key[0], child))
                else:
                    top.closed[child] = np.array(sums[1:])
        large -= {key for key in now if key not in {(r["tree"], r["node"]) for r in found}}
        shared.destroy()
    return tops, gains


def _histogram(tree: int, node: int, counts: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array([tree], pa.int32()), pa.array([node], pa.int64()), pa.array([counts.astype("<f8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(cells, ["tree", "node", "counts"])


@dataclass
class Forest:
    """The tops, and a written table of the subtrees (tree, node, arrays of a ``Tree``)."""

    rules: Rules
    features: int
    outputs: int
    tops: list[Tree]
    subtrees: DataFrame
    importances: np.ndarray
    bytes: int

    def predict(self, df: DataFrame, features: str, output: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Add an array: the mean value, or the mean share of each class. ``features`` is a column of arrays.

        A stream is always scored by broadcast, as a row's trees can't be summed without state.
        """
        if df.isStreaming or self.bytes <= broadcast_bytes:
            scored = self._by_broadcast(df, features, output)
        else:
            scored = self._by_join(df, features, output)
        if self.rules.classes and self.outputs == 1:
            second = F.get(output, F.lit(0))
            scored = scored.withColumn(output, F.array(1.0 - second, second))
        return scored

    def whole_trees(self) -> list[Tree]:
        """The trees with their subtrees put in. For looking at small forests of numeric targets or two classes."""
        if self.outputs > 1:
            raise ValueError("Trees of more than two classes stay in parts.")
        whole = [[top.feature.tolist(), top.threshold.tolist(), top.left.tolist(), [0.0] * len(top.left)] for top in self.tops]
        for r in self.subtrees.toLocalIterator():
            tree, node, part = whole[r["tree"]], r["node"], Tree.load(r["model"])
            # The root takes the node's place; the others follow what is there.
            shift = len(tree[2]) - 1
            for held, values in zip(tree, (part.feature, part.threshold, np.where(part.left > 0, part.left + shift, 0), part.value)):
                held[node] = values[0].item()
                held += values[1:].tolist()
        return [Tree(np.array(f, np.int32), np.array(t), np.array(n, np.int64), np.array(v)) for f, t, n, v in whole]

    def save(self, path: str) -> None:
        """Subtrees as Parquet, the rest as a line of JSON."""
        self.subtrees.write.mode("overwrite").parquet(f"{path}/subtrees")
        tops = [[t.feature.tolist(), t.threshold.tolist(), t.left.tolist()] for t in self.tops]
        rest = {"rules": vars(self.rules), "features": self.features, "outputs": self.outputs, "tops": tops, "importances": self.importances.tolist(), "bytes": self.bytes}
        self.subtrees.sparkSession.createDataFrame([(json.dumps(rest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/forest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        d = json.loads(spark.read.text(f"{path}/forest").first()[0])
        tops = [Tree(np.array(f, np.int32), np.array(t), np.array(n, np.int64), np.zeros(len(f))) for f, t, n in d["tops"]]
        subtrees = spark.read.parquet(f"{path}/subtrees")
        return cls(Rules(**d["rules"]), d["features"], d["outputs"], tops, subtrees, np.array(d["importances"]), d["bytes"])

    def _by_broadcast(self, df: DataFrame, features: str, output: str) -> DataFrame:
        subtrees = {(r["tree"], r["node"]): r["model"] for r in self.subtrees.toLocalIterator()}
        shared = df.sparkSession.sparkContext.broadcast((self.tops, subtrees))
        outputs, trees = self.outputs, self.rules.trees
        cache: dict = {}

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scored(arrays: pd.Series) -> pd.Series:
            if not len(arrays):
                return pd.Series([], dtype="object")
            tops, subtrees = shared.value
            x = np.stack(arrays.to_numpy()).astype("<f4")
            total = np.zeros((len(x), outputs))
            for t, top in enumerate(tops):
                leaf = top.leaves(x)
                for node in np.unique(leaf):
                    if (t, node) not in cache:
                        cache[t, node] = Tree.load(subtrees[t, int(node)])
                    rows = np.flatnonzero(leaf == node)
                    part = np.zeros((len(rows), outputs))
                    cache[t, node].add(x[rows], part)
                    total[rows] += part
            return pd.Series(list(total / trees))

        return df.withColumn(output, scored(features))

    def _by_join(self, df: DataFrame, features: str, output: str) -> DataFrame:
        """Rows are numbered, packed per group of subtrees they are routed to, scored beside the group, and summed.

        Neighbouring subtrees of up to ``GROUP_BYTES`` are a group, which a row is sent to once, however many trees of
        the group it passes. A group is sent once, and once more for every ``SCORED_ROWS`` or ``SCORED_BYTES`` of
        further rows. Rows of neighbouring numbers are a chunk; the parts of its rows meet in one task as packed numbers.
        Groups are scored in lots of up to ``SHUFFLED_BYTES``, each of which adds to the sums of those before.
        """
        spark, outputs, trees, p = df.sparkSession, self.outputs, self.rules.trees, self.features
        bits = min(13, max(4, (CHUNK_BYTES // (8 * outputs * trees)).bit_length() - 1))
        numbered = durable(df.withColumn("_row", F.monotonically_increasing_id()))
        sizes = self.subtrees.select("tree", "node", F.length("model").alias("bytes")).orderBy("tree", "node").collect()
        # Per tree the group of each of its leaves in the top.
        group_of, size, groups = [np.full(len(top.left), -1) for top in self.tops], 0, 1
        group_bytes = [0]
        for r in sizes:
            if size and size + r["bytes"] > GROUP_BYTES:
                size, groups = 0, groups + 1
                group_bytes.append(0)
            size += r["bytes"]
            group_bytes[-1] = size
            group_of[r["tree"]][r["node"]] = groups - 1
        shared = spark.sparkContext.broadcast((self.tops, group_of))

        def read(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Row numbers, features, and per group from ``low`` to ``high`` which rows pass it."""
            for batch in batches:
                if batch.num_rows:
                    ids = batch.column(0).to_numpy()
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype("<f4")
                    passed, every = np.zeros((high - low, len(ids)), bool), np.arange(len(ids))
                    for top, group in zip(*shared.value):
                        if ((group >= low) & (group < high)).any():
                            of = group[top.leaves(x)]
                            here = (of >= low) & (of < high)
                            passed[of[here] - low, every[here]] = True
                    yield ids, x, passed

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(groups, np.int64)
            for _, _, passed in read(batches, 0, groups):
                total += passed.sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups)), pa.array(total)], ["grp", "n"])

        pairs = numbered.select("_row", features)
        counted = pairs.mapInArrow(count, "grp long, n long").groupBy("grp").agg(F.sum("n").alias("n")).collect()
        salts = np.ones(groups, np.int64)
        for r in counted:
            salts[r["grp"]] = max(1, math.ceil(r["n"] / SCORED_ROWS), math.ceil(r["n"] * (4 * p + 8 * outputs) / SCORED_BYTES))

        # What a group has shuffled: its subtrees, its rows, and their sums.
        sent = np.array(group_bytes) * salts
        for r in counted:
            sent[r["grp"]] += r["n"] * (4 * p + 8 * outputs + 2)

        def routed(low: int, high: int) -> DataFrame:
            def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for ids, x, passed in read(batches, low, high):
                    values, chunks = matrix.coded(x), ids >> bits
                    for g in np.flatnonzero(passed.any(axis=1)):
                        rows = np.flatnonzero(passed[g])
                        picks = np.split(rows, np.flatnonzero(np.diff(chunks[rows])) + 1)
                        of = [int(chunks[k[0]]) for k in picks]
                        cells = [[low + int(g)] * len(picks), [c % int(salts[low + g]) for c in of], of]
                        cells += [[matrix.squeezed(matrix.planes((ids[k] & (1 << bits) - 1).astype("<u2"))) for k in picks], [matrix.cell(values, k) for k in picks]]
                        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, types)], ["grp", "salt", "chunk", "at", "x"])

            return pairs.mapInArrow(route, "grp long, salt long, chunk long, at binary, x binary")

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            ats = [int.from_bytes(at.as_buffer()[:8].to_pybytes(), "little") // 2 for at in left.column("at")]
            totals = [np.zeros((n, outputs)) for n in ats]
            models: dict[int, dict[int, int]] = {}
            for i, (t, node) in enumerate(zip(right.column("tree").to_pylist(), right.column("node").to_pylist())):
                models.setdefault(t, {})[node] = i
            for t in sorted(models) if totals else ():
                # The subtrees of one tree at a time are unpacked.
                top, parts = shared.value[0][t], {}
                for x, total in zip(left.column("x"), totals):
                    x = matrix.from_cell(x.as_py(), len(total), p, "<f4")
                    leaf = top.leaves(x)
                    for node in map(int, np.unique(leaf)):
                        if node not in models[t]:
                            continue
                        if node not in parts:
                            parts[node] = Tree.load(right.column("model")[models[t][node]].as_py())
                        rows = np.flatnonzero(leaf == node)
                        part = np.zeros((len(rows), outputs))
                        parts[node].add(x[rows], part)
                        total[rows] += part
            packed = [matrix.squeezed(matrix.planes(total.reshape(-1))) for total in totals]
            return pa.table({"chunk": left.column("chunk"), "grp": left.column("grp"), "at": left.column("at"), "part": pa.array(packed, pa.binary())})

        def added(rows: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
            """Chunk, places of its rows, and their sums; those of earlier lots (group -1) come first."""
            chunk, total, seen = rows.column("chunk")[0].as_py(), np.zeros((1 << bits, outputs)), np.zeros(1 << bits, bool)
            rows = rows.sort_by("grp")
            for at, part in zip(rows.column("at"), rows.column("part")):
                at = matrix.from_planes(matrix.unsqueezed(at.as_py()), "<u2")
                total[at] += matrix.from_planes(matrix.unsqueezed(part.as_py()), "<f8").reshape(-1, outputs)
                seen[at] = True
            at = np.flatnonzero(seen)
            return chunk, at, total[at]

        def add(rows: pa.Table) -> pa.Table:
            chunk, at, total = added(rows)
            return pa.table({"_row": pa.array(chunk << bits | at, pa.int64()), output: pa.array(list(total / trees), pa.list_(pa.float64()))})

        def keep(rows: pa.Table) -> pa.Table:
            chunk, at, total = added(rows)
            cells = [[chunk], [-1], [matrix.squeezed(matrix.planes(at.astype("<u2")))], [matrix.squeezed(matrix.planes(total.reshape(-1)))]]
            return pa.table([pa.array(c, k) for c, k in zip(cells, [pa.int64(), pa.int64(), pa.binary(), pa.binary()])], ["chunk", "grp", "at", "part"])

        places = [(r["tree"], r["node"], int(g), int(salts[g])) for r in sizes for g in (group_of[r["tree"]][r["node"]],)]
        places = spark.createDataFrame(places, "tree int, node long, grp long, salts long")
        models = self.subtrees.join(F.broadcast(places), ["tree", "node"])
        models = models.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
        by, schema = ["grp", "salt"], "chunk long, grp long, at binary, part binary"

        def scored(low: int, high: int) -> DataFrame:
            # Files of other trees are not read.
            of = [t for t, group in enumerate(group_of) if ((group >= low) & (group < high)).any()] or [0]
            own = models.where(F.col("tree").between(of[0], of[-1]) & (F.col("grp") >= low) & (F.col("grp") < high))
            return routed(low, high).groupBy(*by).cogroup(own.groupBy(*by)).applyInArrow(score, schema)

        def lot(low: int, high: int) -> Callable[[DataFrame | None], DataFrame]:
            def step(before: DataFrame | None) -> DataFrame:
                parts = scored(low, high)
                return (parts if before is None else parts.unionAll(before)).groupBy("chunk").applyInArrow(keep, schema)

            return step

        lots = _lots(sent.tolist(), SHUFFLED_BYTES)
        if len(lots) == 1:
            parts = scored(0, groups)
        else:
            with freed_shuffles(spark):
                parts = folded((lot(low, high) for low, high in lots), spark)
        sums = parts.groupBy("chunk").applyInArrow(add, f"_row long, `{output}` array<double>")
        return numbered.join(sums, "_row").drop("_row")


def _lots(sizes: Sequence[float], most: float) -> list[tuple[int, int]]:
    """Neighbours whose sizes add up to ``most`` at most, or that are alone: (first, end) of each lot."""
    lots, size = [[0, 0]], 0.0
    for i, own in enumerate(sizes):
        if i > lots[-1][0] and size + own > most:
            lots.append([i, i])
            size = 0.0
        size += own
        lots[-1][1] = i + 1
    return [(low, high) for low, high in lots]


def fit(df: DataFrame, features: Sequence[Column], target: Column, rules: Rules, node_bytes: int = NODE_BYTES) -> Forest:
    """Grow a forest on numeric features without nulls; class targets are numbers from 0.

    ``rules.classes`` is the number of classes, 0 for a numeric target.
    """
    with freed_shuffles(df.sparkSession):
        return _fit(df, features, target, rules, node_bytes)


def _fit(df: DataFrame, features: Sequence[Column], target: Column, rules: Rules, node_bytes: int) -> Forest:
    outputs = max(rules.classes, 1)
    # Two classes: squared error of 0 and 1 is half the Gini impurity.
    inner = Rules(**{**vars(rules), "classes": rules.classes if rules.classes > 2 else 0})
    blocks = matrix.packed(df, features, target, "<f4")
    p, dtype = blocks.features, blocks.dtype
    node_rows = min(1 << ROW_BITS, max(2, node_bytes // (4 * p + 16)))
    tops, gains = _grow_tops(blocks, inner, node_rows, rules.classes)
    trees = [top.tree() for top in tops]
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast([(tree, np.array(top.depth), set(top.closed)) for tree, top in zip(trees, tops)])

    def routed(low: int, high: int) -> DataFrame:
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in matrix.read(batches, p, dtype):
                x = matrix.coded(block.x)
                for t in range(low, high):
                    tree, _, closed = shared.value[t]
                    w = draws(block, t, inner)
                    leaf = tree.leaves(block.x)
                    picks = [(int(node), np.flatnonzero((leaf == node) & (w > 0))) for node in np.unique(leaf) if node not in closed]
                    picks = [(node, rows) for node, rows in picks if len(rows)]
                    cells = [[t] * len(picks), [node for node, _ in picks], [block.part] * len(picks), [block.seq] * len(picks)]
                    cells += [[matrix.cell(x, k) for _, k in picks], [matrix.squeezed(matrix.planes(block.y[k])) for _, k in picks]]
                    cells += [[matrix.squeezed(w[k].astype(np.uint8).tobytes()) for _, k in picks]]
                    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, types)], ["tree", "node", "part", "seq", "x", "y", "w"])

        return blocks.table.mapInArrow(route, "tree int, node long, part int, seq int, x binary, y binary, w binary")

    def finish(rows: pa.Table) -> pa.Table:
        t, node = rows.column("tree")[0].as_py(), rows.column("node")[0].as_py()
        rows = rows.sort_by([("part", "ascending"), ("seq", "ascending")])
        weights = [np.frombuffer(matrix.unsqueezed(c.as_py()), np.uint8) for c in rows.column("w")]
        x = np.concatenate([matrix.from_cell(c.as_py(), len(w), p, "<f4") for c, w in zip(rows.column("x"), weights)])
        y = np.concatenate([matrix.from_planes(matrix.unsqueezed(c.as_py()), "<f8") for c in rows.column("y")])
        w = np.concatenate(weights).astype(np.float64)
        depth = int(shared.value[t][1][node])
        model, gain = grow(x, y, w, inner, [inner.seed, t, node], depth)
        raw = model.dump()
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int64()), "model": pa.array([raw], pa.binary()), "bytes": [len(raw)], "gain": pa.array([gain.tolist()], pa.list_(pa.float64()))})

    share = 1 - math.exp(-1) if inner.bootstrap else 1
    tree_bytes = blocks.rows * share * (4 * p + 16)
    schema = "tree int, node long, model binary, bytes long, gain array<double>"

    def grown(low: int, high: int) -> DataFrame:
        # A task sorts what it is sent: more tasks where that is much.
        tasks = max(4 * spark.sparkContext.defaultParallelism, math.ceil((high - low) * tree_bytes / ROUTED_BYTES))
        tasks = min(tasks, sum(int((t.feature < 0).sum()) for t in trees[low:high]))
        rows = routed(low, high).repartition(max(tasks, 1), "tree", "node")
        found = rows.groupBy("tree", "node").applyInArrow(finish, schema)
        leaves = [(t, node, tops[t].leaf(node, inner.classes).dump()) for t in range(low, high) for node in tops[t].closed]
        if leaves:
            found = found.unionAll(spark.createDataFrame([(t, node, raw, len(raw), [0.0] * p) for t, node, raw in leaves], schema))
        return durable(found)

    lots = [grown(low, high) for low, high in _lots([tree_bytes] * inner.trees, SHUFFLED_BYTES)]
    subtrees = functools.reduce(DataFrame.unionAll, lots)
    per_tree = subtrees.select("tree", F.posexplode("gain").alias("f", "g")).groupBy("tree", "f").agg(F.sum("g").alias("g"))
    for row in per_tree.collect():
        gains[row["tree"], row["f"]] += row["g"]
    totals = gains.sum(axis=1, keepdims=True)
    shares = np.divide(gains, totals, out=np.zeros_like(gains), where=totals > 0)
    # Trees without a split say nothing about importance.
    split = totals[:, 0] > 0
    importances = shares[split].mean(axis=0) if split.any() else shares.mean(axis=0)
    size = subtrees.agg(F.sum("bytes")).first()[0] or 0
    return Forest(rules, p, outputs if inner.classes else 1, trees, subtrees.select("tree", "node", "model"), importances, size)


