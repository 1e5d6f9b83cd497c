"""Mutual information of numeric columns and a target by nearest neighbours (Kraskov, Stoegbauer and Grassberger).

For each complete row, r is the distance (the larger of both axes) to its k-th nearest row, and nx, ny are the rows
closer than r on one axis, itself included. The score is ``psi(n) + psi(k) - mean(psi(nx)) - mean(psi(ny))`` in nats.

All columns go through the same passes, as rows (column, id, x, y):

1. Axes are scaled to unit spread, and ties broken by a jitter from a hash (``jitter`` 0 leaves them).
2. Rows are dealt into cells: strips of x that hold equal shares (equal values stay together), cut by shares of y.
   Each cell finds its rows' k nearest inside; a row whose r reaches into other cells is sent there with its
   radius as a halo, and the nearest of all are merged. Only rows near an edge travel twice.
3. nx and ny are differences of two ranks. Both axes are cut into blocks of equal shares; x - r and x + r look up
   their rank in the block they fall into, whose first rank is known.

The cuts are approximate quantiles: they decide where rows meet, not the result. At most ``SIDE``² cells and
``BLOCKS`` blocks per column reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import number
from tabloom.session import durable

#: Rows of a cell, and at most so many strips and cells per strip.
CELL_ROWS = 4096
SIDE = 64
#: Rows of a block of ranks, and at most so many blocks.
BLOCK_ROWS = 16_384
BLOCKS = 1024
ACCURACY = 10_000


def nearest(x: np.ndarray, y: np.ndarray, k: int, queries: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The k least distances (queries x k, rising, infinite if there are fewer) to points sorted by ``y``.

    Without ``queries`` each point asks for the others; queries are (x, y, radius beyond which nothing counts).
    """
    n = len(x)
    if queries is None:
        qx, qy, limit = x, y, np.full(n, np.inf)
        up, down = np.arange(n) + 1, np.arange(n) - 1
    else:
        qx, qy, limit = queries
        up = np.searchsorted(y, qy, "left")
        down = up - 1
    best = np.full((len(qx), k), np.inf)
    for at, step in ((up, 1), (down, -1)):
        rows, at = np.arange(len(qx)), at.copy()
        while len(rows):
            inside = (at >= 0) & (at < n)
            rows, at = rows[inside], at[inside]
            dy = np.abs(y[at] - qy[rows])
            # Sorted by y: beyond the k-th distance so far nothing nearer follows.
            near = dy < np.minimum(best[rows, -1], limit[rows])
            rows, at, dy = rows[near], at[near], dy[near]
            distance = np.maximum(dy, np.abs(x[at] - qx[rows]))
            better = distance < best[rows, -1]
            changed = rows[better]
            best[changed, -1] = distance[better]
            best[changed] = np.sort(best[changed], axis=1)
            at = at + step
    return best


def inside_radius(values: np.ndarray, at: np.ndarray, radius: np.ndarray, side: int) -> np.ndarray:
    """For sorted values, how many lie before the end of the open interval around ``at``: its lower end (side -1, those
    that don't lie inside) or its upper end (side 1). A radius of 0 holds equal values."""
    n = len(values)

    def inside(index: np.ndarray) -> np.ndarray:
        gap = np.abs(values[np.clip(index, 0, n - 1)] - at)
        return (gap < radius) | ((radius == 0) & (gap == 0))

    count = np.searchsorted(values, at + side * radius, "left" if side < 0 else "right")
    # Sums round; differences decide.
    while True:
        if side > 0:
            over, under = (count > 0) & (values[np.maximum(count - 1, 0)] > at) & ~inside(count - 1), (count < n) & inside(count)
        else:
            over, under = (count > 0) & inside(count - 1), (count < n) & (values[np.minimum(count, n - 1)] < at) & ~inside(count)
        if not (over.any() or under.any()):
            return count
        count = count - over + (under & ~over)


def psi(m: Column) -> Column:
    """The digamma function of whole numbers from 1."""
    x = m.cast("double") + 8.0
    series = F.log(x) - 0.5 / x - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    for j in range(8):
        series = series - 1.0 / (m + j)
    return series


def _stats(df: DataFrame, names: Sequence[str], target: str) -> list[tuple[int, float, float, float, float]]:
    """Per column: complete rows, spreads of both axes, means of their absolute scaled values."""
    y, parts = number(target), []
    for name in names:
        x = number(name)
        both = x.isNotNull() & y.isNotNull()
        xs, ys = F.when(both, x), F.when(both, y)
        parts.append(F.struct(F.count(xs).alias("n"), F.stddev_pop(xs).alias("sx"), F.stddev_pop(ys).alias("sy"), F.avg(F.abs(xs)).alias("mx"), F.avg(F.abs(ys)).alias("my")))
    found = df.agg(F.array(*parts).alias("s")).first()["s"] if names else []
    rows = []
    for s in found:
        sx, sy = s["sx"] or 1.0, s["sy"] or 1.0
        rows.append((s["n"], sx, sy, max(1.0, (s["mx"] or 0.0) / sx), max(1.0, (s["my"] or 0.0) / sy)))
    return rows


def _pairs(df: DataFrame, names: Sequence[str], target: str, stats: list[tuple], jitter: float, seed: int) -> DataFrame:
    """(f, id, raw, x, y): complete rows per column, scaled; ``raw`` is x without jitter."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), *(number(c).alias(f"x{i}") for i, c in enumerate(names)), number(target).alias("y"))
    cells = []
    for i, (_, sx, sy, mx, my) in enumerate(stats):
        noise = [(F.xxhash64("row", F.lit(i), F.lit(axis), F.lit(seed)).cast("double") / 2.0**63) * (jitter * m) for axis, m in ((0, mx), (1, my))]
        raw = F.col(f"x{i}") / sx
        cells.append(F.struct(F.lit(i).alias("f"), (F.col("row") * len(names) + i).alias("id"), raw.alias("raw"), (raw + noise[0]).alias("x"), (F.col("y") / sy + noise[1]).alias("y")))
    # The row numbers hold once they are written.
    return durable(rows.select(F.inline(F.array(*cells))).where("x IS NOT NULL AND y IS NOT NULL"))


def _quantile_edges(df: DataFrame, by: list[str], value: str, cuts: int) -> dict[Any, np.ndarray]:
    """Different cut values at equal shares, per group."""
    if cuts < 2:
        return {}
    shares = [i / cuts for i in range(1, cuts)]
    found = df.groupBy(*by).agg(F.percentile_approx(value, shares, ACCURACY).alias("e")).collect()
    # A little above a value, so that no rounding puts neighbours of it on the other side.
    return {tuple(r[b] for b in by): np.unique([e + 3e-14 * max(1.0, abs(e)) for e in r["e"]]) for r in found}


def _with_cell(pairs: DataFrame, side: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Adds ``cell``; per column the boxes of its cells: (cell, least and greatest x, least and greatest y)."""
    spark = pairs.sparkSession
    strips = spark.sparkContext.broadcast({key[0]: e for key, e in _quantile_edges(pairs, ["f"], "raw", side).items()})

    def slots(edges: dict, key: Any, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(edges[key], values, "left") if key in edges else np.zeros(len(values), np.int64)

    def strip(batches):
        for batch in batches:
            f, raw = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            found = np.zeros(len(f), np.int64)
            for k in np.unique(f):
                found[f == k] = slots(strips.value, k, raw[f == k])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("f", "id", "x", "y")), pa.array(found, pa.int64())], ["f", "id", "x", "y", "strip"])

    dealt = pairs.mapInArrow(strip, "f int, id long, x double, y double, strip long")
    layers = spark.sparkContext.broadcast(_quantile_edges(dealt, ["f", "strip"], "y", side))

    def cell(batches):
        for batch in batches:
            f, y, found = batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy().copy()
            for k, s in {(int(a), int(b)) for a, b in np.unique(np.stack([f, found], axis=1), axis=0)} if len(f) else ():
                rows = (f == k) & (batch.column(4).to_numpy() == s)
                found[rows] = s * SIDE + slots(layers.value, (k, s), y[rows])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("f", "id", "x", "y")), pa.array(found, pa.int64())], ["f", "id", "x", "y", "cell"])

    cells = durable(dealt.mapInArrow(cell, "f int, id long, x double, y double, cell long"))
    boxes: dict[int, list] = {}
    for r in cells.groupBy("f", "cell").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).collect():
        boxes.setdefault(r["f"], []).append(tuple(r)[1:])
    return cells, {f: np.array(sorted(rows)) for f, rows in boxes.items()}


def _radii(cells: DataFrame, boxes: dict[int, np.ndarray], k: int) -> DataFrame:
    """(f, id, x, y, r): the distance to the k-th nearest row."""
    shared = cells.sparkSession.sparkContext.broadcast(boxes)
    schema = "f int, id long, x double, y double, cell long, crossing boolean, best array<double>"

    def arrow(f, ids, x, y, cell, crossing, best) -> pa.Table:
        n = len(ids)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(best.reshape(-1), pa.float64()))
        cols = [pa.array(np.full(n, f), pa.int32()), pa.array(ids, pa.int64()), pa.array(x), pa.array(y), pa.array(cell, pa.int64()), pa.array(crossing, pa.bool_()), flat]
        return pa.Table.from_arrays(cols, ["f", "id", "x", "y", "cell", "crossing", "best"])

    def local(rows: pa.Table) -> pa.Table:
        f, own = rows.column("f")[0].as_py(), rows.column("cell")[0].as_py()
        ids, x, y = (rows.column(c).to_numpy() for c in ("id", "x", "y"))
        order = np.argsort(y, kind="stable")
        ids, x, y = ids[order], x[order], y[order]
        best = nearest(x, y, k)
        r = best[:, -1]
        parts, crossing = [], np.zeros(len(ids), bool)
        for cell, x0, x1, y0, y1 in shared.value[f]:
            if cell == own:
                continue
            reach = np.flatnonzero((x - r < x1 + 1e-12) & (x + r > x0 - 1e-12) & (y - r < y1 + 1e-12) & (y + r > y0 - 1e-12))
            if len(reach):
                crossing[reach] = True
                parts.append(arrow(f, ids[reach], x[reach], y[reach], np.full(len(reach), int(cell)), np.ones(len(reach), bool), best[reach]))
        return pa.concat_tables([arrow(f, ids, x, y, np.full(len(ids), -1), crossing, best), *parts])

    def halo(queries: pa.Table, points: pa.Table) -> pa.Table:
        if not queries.num_rows:
            return pa.table({"f": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "best": pa.array([], pa.list_(pa.float64()))})
        x, y = points.column("x").to_numpy(), points.column("y").to_numpy()
        order = np.argsort(y, kind="stable")
        limit = queries.column("best").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)[:, -1]
        best = nearest(x[order], y[order], k, (queries.column("x").to_numpy(), queries.column("y").to_numpy(), limit))
        return arrow(queries.column("f")[0].as_py(), queries.column("id").to_numpy(), limit, limit, limit.astype("i8") * 0, limit > 0, best).select(["f", "id", "best"])

    found = durable(cells.groupBy("f", "cell").applyInArrow(local, schema))
    queries, own = found.where("cell >= 0"), found.where("cell < 0")
    other = queries.groupBy("f", "cell").cogroup(cells.groupBy("f", "cell")).applyInArrow(halo, "f int, id long, best array<double>")
    both = own.where("crossing").select("f", "id", "best").unionByName(other)
    merged = both.groupBy("f", "id").agg(F.get(F.sort_array(F.flatten(F.collect_list("best"))), F.lit(k - 1)).alias("r"))
    near = own.where("NOT crossing").select("f", "id", "x", "y", F.get("best", F.lit(k - 1)).alias("r"))
    return near.unionByName(own.where("crossing").select("f", "id", "x", "y").join(merged, ["f", "id"]))


def _rank_sums(radii: DataFrame, blocks: int) -> DataFrame:
    """(f, total): the sum of psi(nx) + psi(ny) over the rows of each column."""
    spark = radii.sparkSession
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(name).alias("v")) for a, name in enumerate("xy")))
    values = radii.select("f", "id", "r", F.explode(axes).alias("a")).select("f", "id", "r", "a.axis", "a.v")
    edges = spark.sparkContext.broadcast(_quantile_edges(values, ["f", "axis"], "v", blocks))

    def dealt(kind: str):
        def deal(batches):
            for batch in batches:
                f, ids, r, axis, v = (batch.column(i).to_numpy() for i in range(5))
                for key in {(int(a), int(b)) for a, b in np.unique(np.stack([f, axis], axis=1), axis=0)} if len(f) else ():
                    rows = np.flatnonzero((f == key[0]) & (axis == key[1]))
                    cuts = edges.value.get(key, np.zeros(0))
                    ends = [v[rows]] if kind == "points" else [v[rows] - r[rows], v[rows] + r[rows]]
                    found = [np.searchsorted(cuts, e, "left") for e in ends]
                    if kind == "points":
                        sides = [(np.arange(len(rows)), found[0], 0)]
                    else:
                        same = found[0] == found[1]
                        sides = [(np.flatnonzero(same), found[0], 0), (np.flatnonzero(~same), found[0], -1), (np.flatnonzero(~same), found[1], 1)]
                    for pick, block, side in sides:
                        at = rows[pick]
                        cells = [pa.array(f[at], pa.int32()), pa.array(axis[at], pa.int32()), pa.array(block[pick], pa.int32()), pa.array(ids[at], pa.int64())]
                        cells += [pa.array(v[at]), pa.array(r[at]), pa.array(np.full(len(at), side), pa.int32())]
                        yield pa.RecordBatch.from_arrays(cells, ["f", "axis", "block", "id", "v", "r", "side"])

        return values.mapInArrow(deal, "f int, axis int, block int, id long, v double, r double, side int")

    points, queries = durable(dealt("points").select("f", "axis", "block", "v")), dealt("queries")
    sizes: dict[tuple, dict[int, int]] = {}
    for row in points.groupBy("f", "axis", "block").count().collect():
        sizes.setdefault((row["f"], row["axis"]), {})[row["block"]] = row["count"]
    below = spark.sparkContext.broadcast({(*key, b): sum(n for c, n in found.items() if c < b) for key, found in sizes.items() for b in range(max(found) + 2)})

    def look_up(key: Any, asked: pa.Table, held: pa.Table) -> pa.Table:
        f, axis, block = (k.as_py() for k in key)
        first = below.value[f, axis, block]
        values = np.sort(held.column("v").to_numpy())
        at, r, side = (asked.column(c).to_numpy() for c in ("v", "r", "side"))
        part = np.zeros(len(at), np.int64)
        for end in (-1, 1):
            pick = (side == end) | (side == 0)
            count = inside_radius(values, at[pick], r[pick], end) if len(values) else np.zeros(int(pick.sum()), np.int64)
            part[pick] += end * (first + count)
        n = len(at)
        return pa.table({"f": pa.array(np.full(n, f), pa.int32()), "axis": pa.array(np.full(n, axis), pa.int32()), "id": asked.column("id"), "part": pa.array(part), "whole": pa.array(side == 0)})

    by = ["f", "axis", "block"]
    ranks = queries.groupBy(*by).cogroup(points.groupBy(*by)).applyInArrow(look_up, "f int, axis int, id long, part long, whole boolean")
    ranks = durable(ranks)
    halves = ranks.where("NOT whole").groupBy("f", "axis", "id").agg(F.sum("part").alias("part"))
    counts = ranks.where("whole").select("f", "part").unionByName(halves.select("f", "part"))
    return counts.groupBy("f").agg(F.sum(psi(F.col("part"))).alias("total"))


def neighbour_mutual_info(
    df: DataFrame,
    target: str,
    columns: Sequence[str],
    neighbours: int = 3,
    jitter: float = 1e-10,
    seed: int = 42,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows ``(feature, score)`` of numeric columns, in nats.

    Rows without a value on either axis are left out; a column with no more than ``neighbours`` complete rows
    scores 0.
    """
    spark = df.sparkSession
    stats = _stats(df, columns, target)
    used = [i for i, s in enumerate(stats) if s[0] > neighbours]
    names = [columns[i] for i in used]
    scores = {c: 0.0 for c in columns}
    if names:
        stats = [stats[i] for i in used]
        most = max(s[0] for s in stats)
        pairs = _pairs(df, names, target, stats, jitter, seed)
        cells, boxes = _with_cell(pairs, min(SIDE, math.ceil(math.sqrt(most / cell_rows))))
        radii = durable(_radii(cells, boxes, neighbours))
        sums = _rank_sums(radii, min(BLOCKS, math.ceil(most / block_rows)))
        terms = spark.createDataFrame([(i, s[0]) for i, s in enumerate(stats)], "f int, n long").join(sums, "f")
        value = psi(F.col("n")) + psi(F.lit(neighbours)) - F.col("total") / F.col("n")
        for row in terms.select("f", F.greatest(value, F.lit(0.0)).alias("score")).collect():
            scores[names[row["f"]]] = round(row["score"], 6)
    return spark.createDataFrame(list(scores.items()), "feature string, score double")
