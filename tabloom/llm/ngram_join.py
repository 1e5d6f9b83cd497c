"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of five-word shingles; documents with equal sets are one class. Classes that share a
MinHash band are candidates. Their MinHash values are compared sixteen at a time: after n values with m equal,
the similarity has a Beta(m + 1, n - m + 1) posterior (uniform prior), and a pair whose posterior probability
of reaching the threshold is below TOLERANCE goes. Surviving pairs join classes to clusters; inside a cluster
all similarities are computed exactly from the shingles, so links and counts are exact for what was found.

A pair at exactly the threshold shares no band with probability (1 - 0.8^4)^24 = 3e-6.

Words are runs of characters other than space and control characters 9 to 13, as they stand. A text of one to
four words is one shingle; texts without words (null, empty) form one class. Rows with equal ids are one
document and must have equal texts; rows without an id are linked to nothing and stay. An empty table gives an
empty table. Other columns do not take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm import blocks as B, links
from tabloom.session import durable

SHINGLE_WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, BAND_VALUES, STEP = 24, 4, 16
HASHES = BANDS * BAND_VALUES
#: Rows, and shingles, that a block of a group holds on average.
CANDIDATE_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 512, 256, 1 << 17
#: Cells of one dense part of a cluster's membership matrix.
MATRIX_CELLS = 1 << 22


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, sorted, and the first of each document (one entry more)."""
    starts, ends, first = B.words(data, offsets)
    hashes = B.SpanHash(data)(starts, ends)
    n_words = np.diff(first)
    at = np.flatnonzero(B.whole_windows(first, SHINGLE_WORDS))
    grams = B.window_hashes(hashes, SHINGLE_WORDS)[at]
    of = np.searchsorted(first, at, "right") - 1
    for n in range(1, SHINGLE_WORDS):
        short = np.flatnonzero(n_words == n)
        if len(short):
            grams = np.concatenate([grams, B.window_hashes(hashes, n)[first[short]]])
            of = np.concatenate([of, short])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(len(offsets)))


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    values = B.mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    return values[:HASHES] | np.uint64(1), values[HASHES:]


def signatures(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values (documents x HASHES); zeros for empty sets."""
    out = np.zeros((len(first) - 1, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        for k, (a, b) in enumerate(zip(*_seeds())):
            out[full, k] = np.minimum.reduceat(((grams * a + b) >> np.uint64(32)).astype(np.uint32), first[full])
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After 16, 32, … values, the fewest equal ones with posterior P(J >= threshold) >= tolerance.

    1 - I_t(m + 1, n - m + 1) is the probability of at most m successes in n + 1 draws of probability t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(values: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no step of the comparison prunes."""
    equal = np.zeros(len(left), np.int32)
    for step, need in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        equal += (values[left, part] == values[right, part]).sum(axis=1)
        stays = equal >= need
        left, right, equal = left[stays], right[stays], equal[stays]
    return left, right


def _sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, two sums that stand for the shingle set, its size, and the MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in B.blocks(batch.column(1)):
                grams, first = shingle_sets(data, offsets)
                both = [B.sums(B.mixed(grams + np.uint64(s)).view(np.int64), first) for s in (0, 1)]
                raw = signatures(grams, first).astype("<u4").tobytes()
                values = pa.Array.from_buffers(pa.binary(4 * HASHES), len(offsets) - 1, [None, pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(offsets) - 1), pa.array(both[0]), pa.array(both[1]), pa.array(np.diff(first), pa.int32()), values],
                    ["key", "d1", "d2", "n", "values"],
                )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"key {kind}, d1 long, d2 long, n int, values binary")


def _shingles(docs: DataFrame) -> DataFrame:
    """cluster, key, weight and ``grams`` (little-endian 64-bit values as bytes) from cluster, key, weight, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in B.blocks(batch.column(3)):
                grams, first = shingle_sets(data, offsets)
                raw = [grams[a:b].tobytes() for a, b in zip(first, first[1:])]
                kept = batch.slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array(raw, pa.binary()), pa.array(np.diff(first), pa.int64())], ["cluster", "key", "weight", "grams", "n"])

    return docs.select("cluster", "key", "weight", "text").mapInArrow(run, "cluster long, key long, weight long, grams binary, n long")


def _candidate_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least = least_matches()
    for table, first in links.whole_groups(batches, ["band", "value"]):
        key = table.column("key").to_numpy()
        values = np.frombuffer(b"".join(table.column("values").to_pylist()), "<u4").reshape(len(key), HASHES)
        forest = links.Forest(len(key))
        for left, right in links.pairs(first, *(table.column(c).to_numpy() for c in ("block", "lo", "hi"))):
            forest.link(*surviving(values, left, right, least))
        moved = np.flatnonzero(forest.root != np.arange(len(key)))
        yield pa.RecordBatch.from_arrays([pa.array(key[moved]), pa.array(key[forest.root[moved]])], ["u", "v"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from dense parts of their membership matrix."""
    sizes = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(len(sets)), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    out = np.zeros((len(sets), len(sets)))
    width = max(1, MATRIX_CELLS // len(sets))
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [begin, begin + width]))
        matrix = np.zeros((len(sets), width), np.float32)
        matrix[member[part], column[part] - begin] = 1
        out += matrix @ matrix.T
    return out


def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, first in links.whole_groups(batches, ["cluster"]):
        key, weight, block = (table.column(c).to_numpy() for c in ("key", "weight", "block"))
        same = table.column("lo").to_numpy() == table.column("hi").to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in table.column("grams").to_pylist()]
        forest, counts = links.Forest(len(key)), np.zeros(len(key), np.int64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            shared = shared_counts(sets[a:b])
            sizes = np.array([len(s) for s in sets[a:b]])
            # J >= t as |A and B| >= t |A or B|, in whole thousandths.
            linked = 1000 * shared >= round(1000 * THRESHOLD) * (sizes[:, None] + sizes[None, :] - shared)
            np.fill_diagonal(linked, False)
            if not same[a]:
                linked &= block[a:b, None] != block[None, a:b]
            counts[a:b] = linked @ weight[a:b]
            left, right = np.nonzero(np.triu(linked))
            forest.link(left + a, right + a)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(counts), pa.array(key[forest.root])], ["key", "n_links", "root"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, class_id (least id with the same shingles), n_links, component_id, kept."""
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    sketched = durable(_sketch(docs, "key", "text").dropDuplicates(["key"]))
    # All classes: one row per shingle set, aggregated before the shuffle.
    classes = sketched.groupBy("d1", "d2", "n").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("weight"))
    of_class = durable(sketched.select("key", "d1", "d2", "n").join(classes, ["d1", "d2", "n"]).select("key", "class_id", "weight", "n"))
    representatives = of_class.where("key = class_id and n > 0").select("key", "weight")

    values = sketched.select("key", "values").join(representatives.select("key"), "key")
    banded = values.select("key", F.posexplode(F.array(*(F.xxhash64(F.substring("values", 1 + 4 * BAND_VALUES * b, 4 * BAND_VALUES)) for b in range(BANDS)))).alias("band", "value"))
    met = links.paired_blocks(banded, ["band", "value"], "key", F.ceil(F.count(F.lit(1)) / CANDIDATE_BLOCK))
    met = met.join(sketched.select("key", "values"), "key")
    edges = links.together(met, ["band", "value"]).mapInArrow(_candidate_edges, "u long, v long")

    clusters = links.components(edges).withColumnsRenamed({"node": "key", "component": "cluster"})
    clustered = durable(clusters.join(representatives, "key"))
    sets = durable(_shingles(docs.join(clustered, "key").dropDuplicates(["key"])))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / CLUSTER_BLOCK, F.sum("n") / CLUSTER_SHINGLES))
    met = links.paired_blocks(sets, ["cluster"], "key", blocks)
    found = durable(links.together(met, ["cluster"]).mapInArrow(_exact_links, "key long, n_links long, root long"))
    roots = links.components(found.select(F.col("key").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"node": "class_id"})
    counts = found.groupBy(F.col("key").alias("class_id")).agg(F.sum("n_links").alias("to_others"))
    return (
        of_class.join(counts, "class_id", "left")
        .join(roots, "class_id", "left")
        .select(
            F.col("key").alias(key),
            "class_id",
            (F.coalesce("to_others", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
        )
        .withColumn("kept", F.col(key) == F.col("component_id"))
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the first document of each component; rows without an id stay."""
    gone = near_duplicates(docs, key, text).where("not kept").select(F.col(key).alias("_gone"))
    return docs.join(gone, F.col(key) == F.col("_gone"), "left_anti")
