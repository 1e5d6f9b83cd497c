"""Near-duplicate vectors by spherical-cap filters from a structured random product code.

A filter is a direction made of one code word for each half of a vector; a vector passes the filters whose
direction it exceeds by a fixed inner product, and list-decoding finds them all from the sorted inner products
with the few code words. Vectors that pass a common filter are compared by their true cosine. Vectors of one
length are first turned by one random rotation, so that their halves carry like shares of their energy even if
they are padded, sparse or ordered by variance.

The code grows with the table: a filter is passed by about BUCKET rows, and a vector passes about PASSED
filters, so the work grows with rows, not with their square. Two vectors at cosine 0.93 pass a given one of
their filters together with probability about a half; the tests measure the recall.

Only vectors of equal, non-null label and equal length are compared. Vectors that are null, empty, zero, or
hold null or non-finite components link with nothing. Equal vectors are one class, counted, not paired. Rows
without an id are rows of their own without links. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.llm import links
from tabloom.session import durable

COSINE = 0.93
PASSED, BUCKET = 96, 256
#: Share of the sphere in a cap: at most the first, so that few rows get selective filters too.
LARGEST_CAP, SMALLEST_CAP = 0.005, 1e-6
#: Rows that a block of a group holds on average.
FILTER_BLOCK, COMPONENT_BLOCK = 512, 256
SEED = 17


class ProductCode:
    """The filters for vectors of one length: every pair of a word of the first and one of the second half."""

    def __init__(self, dims: int, rows: int) -> None:
        cap = min(LARGEST_CAP, max(SMALLEST_CAP, BUCKET / max(1, rows)))
        words = max(2, round((PASSED / cap) ** 0.5))
        rng = np.random.default_rng([SEED, dims, words])
        self.half = (dims + 1) // 2
        turn, scale = np.linalg.qr(np.random.default_rng([SEED, dims]).standard_normal((dims, dims)))
        self.rotation = turn * np.where(np.diag(scale) < 0, -1.0, 1.0)
        # Words come as random rotations of the axes.
        self.first, self.second = (self._directions(rng, words, max(1, d)) for d in (self.half, dims - self.half))
        # A share ``cap`` of the sphere exceeds this inner product with the direction (first + second) / sqrt(2):
        # one coordinate t of a random unit vector has t sqrt(d - 1) / sqrt(1 - t^2) distributed as Student's t,
        # whose quantile follows from the normal one by the first terms of its expansion.
        z, free = NormalDist().inv_cdf(1 - cap), max(1, dims - 1)
        student = z + (z**3 + z) / (4 * free) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * free**2)
        self.least = student / (free + student**2) ** 0.5 * 2**0.5

    @staticmethod
    def _directions(rng: np.random.Generator, words: int, dims: int) -> np.ndarray:
        parts = []
        while sum(map(len, parts)) < words:
            parts.append(np.linalg.qr(rng.standard_normal((dims, dims)))[0].T)
        return np.concatenate(parts)[:words]

    def turned(self, unit: np.ndarray) -> np.ndarray:
        """The rows as decode() takes them: turned, so that no half is short of energy."""
        return unit @ self.rotation

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for every filter that a turned row passes; a row that passes none gets its best one."""
        a = unit[:, : self.half] @ self.first.T
        b = unit[:, self.half :] @ self.second.T if unit.shape[1] > self.half else np.zeros((len(unit), len(self.second)))
        order = np.argsort(-b, axis=1)
        ordered = np.take_along_axis(b, order, axis=1)
        rows, filters = [], []
        for r in range(len(unit)):
            # The second words in falling order: how many of them each first word can take.
            n = np.searchsorted(-ordered[r], a[r] - self.least, "right")
            if not n.any():
                n[a[r].argmax()] = 1
            first = np.repeat(np.arange(len(n)), n)
            second = order[r][np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)]
            rows.append(np.full(len(first), r))
            filters.append(first * len(self.second) + second)
        return np.concatenate(rows), np.concatenate(filters)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares of very large or small components stay finite."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _units(vectors: pa.Array, dims: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) for each length."""
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield at, _unit(vectors.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(-1, d))


def _linked(table: pa.Table, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of links) of each group; the rows of a group have one length."""
    block, dims = (table.column(c).to_numpy() for c in ("block", "dims"))
    same = table.column("lo").to_numpy() == table.column("hi").to_numpy()
    # Groups of one length follow each other: they are one matrix.
    runs = np.concatenate([[0], np.flatnonzero(dims[first[1:-1]] != dims[first[:-2]]) + 1, [len(first) - 1]]) if len(first) > 2 else np.array([0, len(first) - 1])
    for begin, end in zip(runs[:-1].tolist(), runs[1:].tolist()):
        start = int(first[begin])
        flat = table.column("vector").slice(start, int(first[end]) - start).combine_chunks().flatten().to_numpy()
        unit = _unit(flat.astype(np.float64).reshape(-1, int(dims[start])))
        for a, b in zip(first[begin:end].tolist(), first[begin + 1 : end + 1].tolist()):
            part = unit[a - start : b - start]
            linked = part @ part.T >= COSINE
            np.fill_diagonal(linked, False)
            if not same[a]:
                linked &= block[a:b, None] != block[None, a:b]
            yield a, linked


def _filter_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, first in links.whole_groups(batches, ["label", "dims", "filter"]):
        key = table.column("key").to_numpy()
        forest, found, n_found = links.Forest(len(key)), [np.zeros((2, 0), np.int64)], 0
        for a, linked in _linked(table, first):
            if linked.any():
                found.append(np.stack(np.nonzero(np.triu(linked))) + a)
                n_found += found[-1].shape[1]
            if n_found > links.STEP_PAIRS:
                forest.link(*np.concatenate(found, axis=1))
                found, n_found = [np.zeros((2, 0), np.int64)], 0
        forest.link(*np.concatenate(found, axis=1))
        moved = np.flatnonzero(forest.root != np.arange(len(key)))
        yield pa.RecordBatch.from_arrays([pa.array(key[moved]), pa.array(key[forest.root[moved]])], ["u", "v"])


def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, first in links.whole_groups(batches, ["cluster"]):
        key, weight = (table.column(c).to_numpy() for c in ("key", "weight"))
        counts = np.zeros(len(key), np.int64)
        for a, linked in _linked(table, first):
            counts[a : a + len(linked)] = linked @ weight[a : a + len(linked)]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(counts)], ["key", "n_links"])


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: key, n_links, component_id (least key that links reach, itself included), kept.

    Labels of any type are compared as they are: whole numbers as such, all others by their text.
    """
    kind = "long" if isinstance(vectors.schema[label].dataType, T.IntegralType) else "string"
    # Adding 0 makes the two zeros of a float one.
    same = F.col(label) + F.lit(0.0) if isinstance(vectors.schema[label].dataType, T.FractionalType) else F.col(label)
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), same.cast(kind).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = rows.where(F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite).dropDuplicates(["key"])
    usable = durable(usable.withColumn("dims", F.size("vector")))
    classes = usable.groupBy("label", "dims", "vector").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("weight"))
    one = durable(classes)
    of_class = usable.select("key", "label", "dims", "vector").join(one, ["label", "dims", "vector"]).select("key", "class_id", "weight")
    of_class = durable(of_class)
    n_rows = one.count()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                keys, dims, labels = part.column(0).to_numpy(), part.column(2).to_numpy(), part.column(1)
                for at, unit in _units(part.column(3), dims):
                    if (code := codes.get(unit.shape[1])) is None:
                        code = codes[unit.shape[1]] = ProductCode(unit.shape[1], n_rows)
                    row, filters = code.decode(code.turned(unit))
                    own = at[row]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[own]), labels.take(pa.array(own)), pa.array(dims[own]), pa.array(filters, pa.int64())], ["key", "label", "dims", "filter"])

    named = one.select(F.col("class_id").alias("key"), "label", "dims", "vector", "weight")
    passed = named.select("key", "label", "dims", "vector").mapInArrow(decoded, f"key long, label {kind}, dims int, filter long")
    met = links.paired_blocks(passed, ["label", "dims", "filter"], "key", F.ceil(F.count(F.lit(1)) / FILTER_BLOCK))
    met = met.join(named.select("key", "vector"), "key")
    edges = links.together(met, ["label", "dims", "filter"]).mapInArrow(_filter_edges, "u long, v long")
    clusters = durable(links.components(edges).withColumnsRenamed({"node": "key", "component": "cluster"}))
    # Links are counted between all members of a component, also those that met under no filter.
    members = clusters.join(named.select("key", "vector", "dims", "weight"), "key")
    met = links.paired_blocks(members, ["cluster"], "key", F.ceil(F.count(F.lit(1)) / COMPONENT_BLOCK))
    counts = links.together(met, ["cluster"]).mapInArrow(_exact_links, "key long, n_links long").groupBy(F.col("key").alias("class_id")).agg(F.sum("n_links").alias("to_others"))
    found = of_class.join(counts, "class_id", "left").join(clusters.withColumnRenamed("key", "class_id"), "class_id", "left")
    found = found.select(
        F.col("key").alias("_key"),
        (F.coalesce("to_others", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("cluster", "class_id").alias("component_id"),
    )
    out = rows.select("key").join(found, F.col("key") == F.col("_key"), "left")
    out = out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "key").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
