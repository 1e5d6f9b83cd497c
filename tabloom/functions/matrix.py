"""Tables of numbers as packed blocks of rows, for solvers that pass over the rows many times.

A block is one row of a written table: ``part`` and ``seq`` (its place, fixed for good), ``n`` rows, their features
(row after row) and targets as bytes. Blocks are bounded in bytes, so a pass is a map over a few large values;
a pass gives sums, which meet in two steps, so neither a task nor the driver sees an array per task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.session import durable

#: Bytes of features in a block.
BLOCK_BYTES = 1 << 20
_SCHEMA = "part int, seq int, n int, x binary, y binary"


@dataclass
class Block:
    """Some rows in a task. ``part`` and ``seq`` can seed draws that a repeated task repeats."""

    part: int
    seq: int
    x: np.ndarray
    y: np.ndarray


@dataclass
class Blocks:
    """The packed table."""

    table: DataFrame
    features: int
    rows: int
    dtype: str
    tasks: int

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        return read(batches, self.features, self.dtype)


def read(batches: Iterator[pa.RecordBatch], features: int, dtype: str) -> Iterator[Block]:
    for batch in batches:
        part, seq, n, x, y = (batch.column(c) for c in ("part", "seq", "n", "x", "y"))
        for i in range(batch.num_rows):
            rows = n[i].as_py()
            values = np.frombuffer(x[i].as_buffer(), dtype, rows * features).reshape(rows, features)
            yield Block(part[i].as_py(), seq[i].as_py(), values, np.frombuffer(y[i].as_buffer(), "<f8", rows))


def packed(df: DataFrame, features: Sequence[Column], target: Column, dtype: str = "<f8", block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Write numeric features (no nulls) and a numeric target as blocks."""
    p = len(features)
    rows = max(1, block_bytes // (np.dtype(dtype).itemsize * max(p, 1)))
    flat = df.select(F.array(*(f.cast("double") for f in features)).alias("x"), target.cast("double").alias("y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def block(n: int) -> pa.RecordBatch:
            nonlocal held, size, seq
            x, y = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held, size = [(x[n:], y[n:])], size - n
            seq += 1
            cells = [[part], [seq - 1], [n], [x[:n].astype(dtype).tobytes()], [y[:n].tobytes()]]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], ["part", "seq", "n", "x", "y"])

        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
            held.append((x, batch.column(1).to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            while size >= rows:
                yield block(rows)
        if size:
            yield block(size)

    table = durable(flat.mapInArrow(pack, _SCHEMA))
    return Blocks(table, p, table.agg(F.sum("n")).first()[0] or 0, dtype, table.rdd.getNumPartitions())


def summed(blocks: Blocks, of: Callable[[Iterator[Block]], np.ndarray | None], size: int) -> np.ndarray:
    """The sum over tasks of the array of ``size`` numbers that ``of`` makes of a task's blocks.

    The arrays of about the square root of the tasks are added in one task each; that many reach the driver.
    """
    features, dtype = blocks.features, blocks.dtype
    groups = max(1, math.isqrt(blocks.tasks))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = of(read(batches, features, dtype))
        if total is not None:
            yield _cell(TaskContext.get().partitionId() % groups, total)

    sums = blocks.table.mapInArrow(partial, "grp int, total binary")
    if groups > 1:
        sums = sums.repartition(groups, "grp").mapInArrow(lambda batches: _added(batches, size), "grp int, total binary")
    total = np.zeros(size)
    for row in sums.toLocalIterator():
        total += np.frombuffer(row["total"], "<f8")
    return total


def _cell(group: int, total: np.ndarray) -> pa.RecordBatch:
    values = np.ascontiguousarray(total, "<f8").ravel().tobytes()
    return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([values], pa.binary())], ["grp", "total"])


def _added(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total, some = np.zeros(size), False
    for batch in batches:
        for cell in batch.column(1):
            total += np.frombuffer(cell.as_buffer(), "<f8")
            some = True
    if some:
        yield _cell(0, total)


def squeezed(raw: bytes) -> bytes:
    """Compressed bytes that know their length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def planes(values: np.ndarray) -> bytes:
    """First bytes of all numbers, second bytes, and so on, which compress better than number after number."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def coded(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per feature its different values, if they are at most 256, and each row's number of its value; else no values
    and the column."""
    found = []
    for f in range(x.shape[1]):
        values, code = np.unique(x[:, f], return_inverse=True)
        found.append((values, code.astype(np.uint8)) if len(values) <= 256 else (values[:0], np.ascontiguousarray(x[:, f])))
    return found


def cell(features: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray) -> bytes:
    """Some rows of ``coded`` features as compressed bytes."""
    parts = []
    for values, column in features:
        parts += [len(values).to_bytes(2, "little"), values.tobytes(), planes(column[rows])]
    return squeezed(b"".join(parts))


def from_cell(raw: bytes, rows: int, features: int, dtype: str) -> np.ndarray:
    raw, at, size = unsqueezed(raw), 0, np.dtype(dtype).itemsize
    x = np.empty((rows, features), dtype)
    for f in range(features):
        n = int.from_bytes(raw[at : at + 2], "little")
        values, at = np.frombuffer(raw, dtype, n, at + 2), at + 2 + n * size
        length = rows if n else rows * size
        x[:, f] = values[np.frombuffer(raw, np.uint8, rows, at)] if n else from_planes(raw[at : at + length], dtype)
        at += length
    return x


def different_values(blocks: Blocks, most: int) -> list[np.ndarray | None]:
    """Per feature its different values in all rows, None if they are more than ``most``."""
    features, dtype = blocks.features, blocks.dtype

    def rows(found: list[tuple[int, np.ndarray | None]]) -> pa.RecordBatch:
        cells = [pa.array([f for f, _ in found], pa.int32()), pa.array([None if v is None else v.tobytes() for _, v in found], pa.binary())]
        return pa.RecordBatch.from_arrays(cells, ["f", "found"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray | None] = [np.zeros(0, dtype)] * features
        for block in read(batches, features, dtype):
            for f, known in enumerate(found):
                if known is not None:
                    merged = np.union1d(known, block.x[:, f])
                    found[f] = merged if len(merged) <= most else None
        yield rows(list(enumerate(found)))

    def merged(table: pa.Table) -> pa.Table:
        parts = [None if c is None else np.frombuffer(c, dtype) for c in table.column("found").to_pylist()]
        every = None if any(v is None for v in parts) else np.unique(np.concatenate(parts))
        return pa.Table.from_batches([rows([(table.column("f")[0].as_py(), every if every is not None and len(every) <= most else None)])])

    few: list[np.ndarray | None] = [None] * features
    for r in blocks.table.mapInArrow(partial, "f int, found binary").groupBy("f").applyInArrow(merged, "f int, found binary").collect():
        few[r["f"]] = None if r["found"] is None else np.frombuffer(r["found"], dtype)
    return few


def least_of_bins(blocks: Blocks, edges: Sequence[np.ndarray], bins: int) -> np.ndarray:
    """Per feature and bin the least value in it, infinite where there is none."""
    features, dtype = blocks.features, blocks.dtype

    def rows(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        cells = [pa.array([f for f, _ in found], pa.int32()), pa.array([v.tobytes() for _, v in found], pa.binary())]
        return pa.RecordBatch.from_arrays(cells, ["f", "found"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full((features, bins), np.inf)
        for block in read(batches, features, dtype):
            which = binned(block.x, edges)
            for f in range(features):
                np.minimum.at(least[f], which[:, f], block.x[:, f])
        yield rows(list(enumerate(least)))

    def merged(table: pa.Table) -> pa.Table:
        found = np.min([np.frombuffer(c.as_buffer(), "<f8") for c in table.column("found")], axis=0)
        return pa.Table.from_batches([rows([(table.column("f")[0].as_py(), found)])])

    least = np.full((features, bins), np.inf)
    for r in blocks.table.mapInArrow(partial, "f int, found binary").groupBy("f").applyInArrow(merged, "f int, found binary").collect():
        least[r["f"]] = np.frombuffer(r["found"], "<f8")
    return least


def bin_edges(blocks: Blocks, bins: int, sample_rows: int, seed: int) -> list[np.ndarray]:
    """Per feature at most ``bins - 1`` rising cut values (a value at or below a cut lies left of it).

    A feature of few enough different values is cut at all of them, any other at the quantiles of a random sample of
    about ``sample_rows`` rows.
    """
    features, dtype, share = blocks.features, blocks.dtype, min(1.0, sample_rows / max(blocks.rows, 1))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read(batches, features, dtype):
            kept = np.random.default_rng([seed, block.part, block.seq]).random(len(block.y)) < share
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(block.x[kept]).tobytes()], pa.binary())], ["x"])

    drawn = np.frombuffer(b"".join(r["x"] for r in blocks.table.mapInArrow(sample, "x binary").toLocalIterator()), dtype).reshape(-1, features)
    few = different_values(blocks, bins) if share < 1 else [None] * features
    return [_cuts(drawn[:, f] if values is None else values, bins) for f, values in enumerate(few)]


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    found = np.unique(values)
    if len(found) <= bins:
        return found[:-1].astype(np.float64)
    # Quantiles that are values of the sample.
    cuts = np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))
    return cuts[cuts < found[-1]].astype(np.float64)


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """The number of cuts below each value."""
    return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1).astype(np.uint8 if all(len(e) < 256 for e in edges) else np.int32)
