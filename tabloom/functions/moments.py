"""Cross-product statistics of many columns in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.functions.columns import col, number

EXPRESSION_COLUMNS = 16
"""Up to here the sums are one aggregation expression each; beyond, blocks are multiplied in tasks."""


def means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Mean of the present values of every column."""
    if not columns:
        return {}
    if len(columns) <= EXPRESSION_COLUMNS:
        row = df.agg(*[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return {c: row[i] for i, c in enumerate(columns)}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = 0.0
        for batch in batches:
            for x in _slices(batch):
                totals = totals + np.stack([np.nansum(x, axis=0), (~np.isnan(x)).sum(axis=0)], axis=1)
        if not np.isscalar(totals):
            yield from _slabs({0: totals})

    found = _added(df.select(*map(col, columns)).mapInArrow(partial, _SLAB), 2)
    sums, counts = found[0].T if found else np.zeros((2, len(columns)))
    return {c: float(t / n) if n else None for c, t, n in zip(columns, sums, counts)}


COLUMN_BLOCK = 128
"""Columns whose pairs with as many others are summed together."""
_SLICE_CELLS = 1 << 20
_SLAB = "f int, a int, sums binary"


def _slices(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The numbers of a batch as matrices of bounded size, NULL as NaN."""
    rows = max(1, _SLICE_CELLS // max(batch.num_columns, 1))
    for at in range(0, batch.num_rows, rows):
        yield np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.slice(at, rows).columns])


def _slabs(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows ``_SLAB`` of keyed matrices, cut into ``COLUMN_BLOCK`` lines."""
    for f, found in totals.items():
        for a in range(0, len(found), COLUMN_BLOCK):
            cells = [pa.array([f], pa.int32()), pa.array([a], pa.int32()), pa.array([found[a : a + COLUMN_BLOCK].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["f", "a", "sums"])


def _added(slabs: DataFrame, width: int) -> dict[int, np.ndarray]:
    """The sum of the tasks' matrices per key. Equal slabs are added where they meet; the driver gets one of each."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in parts:
            for f, a, sums in zip(*(c.to_pylist() for c in batch.columns)):
                totals[f, a] = totals.get((f, a), 0.0) + np.frombuffer(sums, "<f8")
        for (f, a), found in totals.items():
            cells = [pa.array([f], pa.int32()), pa.array([a], pa.int32()), pa.array([found.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["f", "a", "sums"])

    rows = slabs.repartition("f", "a").mapInArrow(add, _SLAB).collect()
    keyed: dict[int, dict[int, np.ndarray]] = {}
    for row in rows:
        keyed.setdefault(row["f"], {})[row["a"]] = np.frombuffer(row["sums"], "<f8").reshape(-1, width)
    return {f: np.concatenate([parts[a] for a in sorted(parts)]) for f, parts in keyed.items()}


def pairwise_sums(df: DataFrame, columns: Sequence[str], centre: Sequence[float]) -> DataFrame:
    """Rows ``(i, j, n, sx, sy, sxx, syy, sxy, infinite)`` over the rows where columns i and j are present.

    ``centre`` is subtracted first to keep the sums well conditioned. Each task multiplies its rows as matrices, one
    per two blocks of columns (i's not behind j's); the sums of two blocks meet in one task, which unpacks them.
    ``infinite`` counts the complete rows with an infinite value; the sums leave them out.
    """
    p, width = len(columns), COLUMN_BLOCK
    shift = np.asarray(centre, dtype="float64")
    cuts = range(0, p, width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            rows = max(1, _SLICE_CELLS // max(p, 1))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], axis=1).astype("float64") - shift
                present = ~np.isnan(x)
                finite = np.isfinite(x)
                mask, bad, x = finite.astype("float64"), (present & ~finite).astype("float64"), np.where(finite, x, 0.0)
                square, some = x * x, present.astype("float64")
                for a in cuts:
                    for b in cuts:
                        if b < a:
                            continue
                        i, j = slice(a, a + width), slice(b, b + width)
                        sums = [mask[:, i].T @ mask[:, j], x[:, i].T @ mask[:, j], mask[:, i].T @ x[:, j], square[:, i].T @ mask[:, j]]
                        sums += [mask[:, i].T @ square[:, j], x[:, i].T @ x[:, j], bad[:, i].T @ some[:, j] + some[:, i].T @ bad[:, j]]
                        total[a, b] = total.get((a, b), 0.0) + np.stack(sums)
        for (a, b), found in total.items():
            cells = [pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([found.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["a", "b", "sums"])

    def unpack(rows: pa.Table) -> pa.Table:
        a, b = rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
        shape = (7, min(width, p - a), min(width, p - b))
        total = sum(np.frombuffer(c.as_buffer(), "<f8") for c in rows.column("sums")).reshape(shape)
        i, j = np.meshgrid(np.arange(a, a + shape[1]), np.arange(b, b + shape[2]), indexing="ij")
        kept = i <= j
        names = ["n", "sx", "sy", "sxx", "syy", "sxy", "infinite"]
        return pa.table({"i": i[kept], "j": j[kept]} | {name: total[k][kept] for k, name in enumerate(names)})

    schema = "i long, j long, n double, sx double, sy double, sxx double, syy double, sxy double, infinite double"
    parts = df.select(*[number(c).alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(partial, "a int, b int, sums binary")
    return parts.groupBy("a", "b").applyInArrow(unpack, schema)


def gram_by_fold(
    df: DataFrame, columns: Sequence[str], fold: str, centre: Sequence[float]
) -> dict[int, np.ndarray]:
    """Per fold the Gram matrix of ``[1, columns]`` (mean-filled and centred), from one pass.

    The driver receives one (p+1)×(p+1) matrix per fold, whatever the number of rows.
    """
    p = len(columns)
    shift = [float(c) for c in centre]
    size = p + 1
    if p <= EXPRESSION_COLUMNS:
        filled = [F.coalesce(number(c) - F.lit(shift[k]), F.lit(0.0)) for k, c in enumerate(columns)]
        table = df.select(F.col(fold).cast("int").alias("_fold"), *[f.alias(f"c{k}") for k, f in enumerate(filled)])
        terms = [F.lit(1.0), *[F.col(f"c{k}") for k in range(p)]]
        cells = [(a, b) for a in range(size) for b in range(a, size)]
        rows = table.groupBy("_fold").agg(*[F.sum(terms[a] * terms[b]).alias(f"g{a}_{b}") for a, b in cells]).collect()
        grams = {}
        for row in rows:
            g = np.zeros((size, size))
            for a, b in cells:
                g[a, b] = g[b, a] = row[f"g{a}_{b}"]
            grams[row["_fold"]] = g
        return grams

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in _slices(batch):
                folds = x[:, 0].copy()
                x = np.nan_to_num(x - [0.0, *shift], nan=0.0, posinf=np.inf, neginf=-np.inf)
                x[:, 0] = 1.0
                for f in np.unique(folds):
                    part = x[folds == f]
                    totals[int(f)] = totals.get(int(f), 0.0) + part.T @ part
        yield from _slabs(totals)

    return _added(df.select(F.col(fold).cast("int"), *map(col, columns)).mapInArrow(partial, _SLAB), size)
