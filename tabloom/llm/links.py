"""Groups of rows that may link, compared block by block inside tasks, and components of links over the cluster.

A group of any size is cut into blocks by a hash of the id; every two blocks meet in one task. No pair leaves
a task: tasks give one row per member (a link count, the least member it reaches), so rows grow with members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.llm import blocks as B
from tabloom.session import durable

#: Pairs that one step of numpy work compares.
STEP_PAIRS = 1 << 18


def paired_blocks(members: DataFrame, keys: list[str], key: str, n_blocks: Column) -> DataFrame:
    """Groups of two rows or more, each row once for every block that its own block meets.

    ``n_blocks`` is an aggregate over a group, and decides how many blocks it is cut into. Adds ``lo`` and
    ``hi``, the two blocks that meet, and ``block``, that of the row.
    """
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), n_blocks.cast("int").alias("_blocks")).where("_n > 1").drop("_n")
    cut = members.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64(F.lit(3), key), F.col("_blocks")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return cut.withColumns({"lo": F.least("block", "_other"), "hi": F.greatest("block", "_other")}).drop("_other", "_blocks")


def together(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with equal (keys, lo, hi) next to each other in one partition."""
    by = [*keys, "lo", "hi"]
    return rows.repartition(*by).sortWithinPartitions(*by)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the first row of each group (one entry more); rows come sorted."""
    rest: pa.Table | None = None
    by = [*keys, "lo", "hi"]

    def ends(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for name in by:
            values = table.column(name).to_numpy()
            change |= values[1:] != values[:-1]
        return np.flatnonzero(change) + 1

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        cuts = ends(table)
        if len(cuts):
            yield table.slice(0, cuts[-1]), np.concatenate([[0], cuts])
            rest = table.slice(cuts[-1]).combine_chunks()
        else:
            rest = table
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def pairs(first: np.ndarray, block: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of the same group, in steps: any two if a block meets itself, else one from each block."""
    n = int(first[-1])
    partners = np.repeat(first[1:], np.diff(first)) - np.arange(n) - 1
    upto = np.cumsum(partners)
    at = 0
    while at < n:
        before = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + STEP_PAIRS, "right")))
        rows = np.arange(at, stop)
        left = np.repeat(rows, partners[at:stop])
        right = B.spread(rows + 1, partners[at:stop])
        meet = (lo[left] == hi[left]) | (block[left] != block[right])
        yield left[meet], right[meet]
        at = stop


class Forest:
    """Least members reached over links among rows of one table."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.root[left], self.root[right]
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                jumped = self.root[self.root]
                if (jumped == self.root).all():
                    break
                self.root = jumped


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): component is the least node that links reach.

    Alternating stars: each node's larger, then its smaller neighbours, move to its least neighbour, until
    nothing moves; the rounds grow with the logarithm of the longest path. Every round is a stored table.
    """

    def stored(some: DataFrame) -> tuple[DataFrame, tuple]:
        table = durable(some.where("u != v").distinct())
        return table, tuple(table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges, state = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges, after = stored(small)
        if after == state:
            break
        state = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
