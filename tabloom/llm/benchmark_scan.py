"""Benchmark passages in documents: Wu-Manber multi-pattern search over words.

A test string is a window of ``WINDOW`` consecutive words of a benchmark item, or a shorter item as a whole.
The alphabet of the search is words (ASCII lower-cased runs of letters, digits and all characters beyond
ASCII) and a block is two of them:

1. Test strings of similar length share a table. ``shift`` gives, for the hash of a block, how far the window's
   end may move because no test string holds that block nearer to its end. Few positions of a text are looked
   at, and only their words are hashed.
2. Where the shift is zero, the block may end a test string: buckets by the hash of that block (the suffix) and
   of the first block (the prefix) hold the test strings to try.
3. Direct comparison of word lengths and bytes confirms each occurrence.

Many stretches of a text block move at once, as numpy arrays. The documents make one narrow pass. The test
strings of up to ``PART_BYTES`` of benchmark text are broadcast; a larger benchmark is dealt by hash into parts
of that size, which the documents meet one after the other (a written table between two passes).

Null and empty texts have no words and are clean; null and empty items hold no test string. A null item id is
spelled as the empty string, equal ids are one item. Repeated document rows get equal results. Other columns
pass through; one with the name of a result is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.functions.columns import col
from tabloom.llm import blocks as B
from tabloom.session import durable

#: Words of a test string; items of fewer words are one test string.
WINDOW = 10
#: Benchmark text whose test strings are broadcast at once, as positions in that text; tables take some tens of bytes a word.
PART_BYTES = 2 << 20
#: Items are cut into overlapping pieces of so many words, so that parts can be dealt evenly.
PIECE_WORDS = 4096
#: Words of a stretch that one cursor walks.
STRETCH = 96

_BLANK = 32
_FOLD = np.full(256, _BLANK, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

RESULTS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = [
    pa.field("n_words", pa.int64()),
    pa.field("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    pa.field("items", pa.list_(pa.string())),
]


@dataclass
class Words:
    """Folded bytes and the words in them."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        folded = np.full(len(data) + 8, _BLANK, np.uint8)
        np.take(_FOLD, data, out=folded[: len(data)])
        starts, ends = B.runs(folded[: len(data)] != _BLANK, offsets)
        return cls(folded, starts, ends, np.searchsorted(starts, offsets))

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """Hashes of words from their length, first and last eight bytes; comparison settles the rest."""
        eights = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        starts, ends = self.starts[at], self.ends[at]
        n = ends - starts
        head = eights[starts] & _MASKS[np.minimum(n, 8)]
        tail = eights[np.maximum(ends - 8, starts)] & _MASKS[np.minimum(n, 8)]
        return (head * _A + tail) * _C + n.astype(np.uint64)

    def block(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words that end at ``at``."""
        total = self.hashes(at)
        for k in range(1, size):
            total = total * _A + self.hashes(at - k)
        return B.mixed(total)


@dataclass
class Table:
    """Shifts and buckets of the test strings of similar length."""

    shortest: int
    size: int
    shift: np.ndarray
    keys: np.ndarray
    strings: np.ndarray

    @classmethod
    def of(cls, words: Words, at: np.ndarray, lengths: np.ndarray, strings: np.ndarray) -> Table:
        """``at`` is the first word of each of ``strings``."""
        shortest = int(lengths.min())
        size = min(2, shortest)
        blocks = [words.block(at + end - 1, size) for end in range(size, shortest + 1)]
        bits = max(10, math.ceil(math.log2(8 * len(np.unique(np.concatenate(blocks))))))
        shift = np.full(1 << bits, shortest - size + 1, np.uint8)
        for end, block in enumerate(blocks, size):
            np.minimum.at(shift, (block >> np.uint64(64 - bits)).astype(np.int64), np.uint8(shortest - end))
        keys = cls.bucket(words.block(at + shortest - 1, size), words.block(at + size - 1, size))
        order = np.argsort(keys, kind="stable")
        return cls(shortest, size, shift, keys[order], strings[order])

    @staticmethod
    def bucket(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return B.mixed(suffix * _C + prefix)

    def candidates(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words and the test strings whose bucket they meet."""
        n = len(words.starts)
        low = np.arange(self.shortest - 1, n, STRETCH)
        cursor, stop = low.copy(), np.minimum(low + STRETCH, n)
        down = np.uint64(64 - int(math.log2(len(self.shift))))
        ends, suffixes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        while len(cursor):
            suffix = words.block(cursor, self.size)
            step = self.shift[(suffix >> down).astype(np.int64)].astype(np.int64)
            found = step == 0
            ends.append(cursor[found])
            suffixes.append(suffix[found])
            cursor = cursor + np.maximum(step, 1)
            going = cursor < stop
            if not going.all():
                cursor, stop = cursor[going], stop[going]
        at = np.concatenate(ends) - self.shortest + 1
        keys = self.bucket(np.concatenate(suffixes), words.block(at + self.size - 1, self.size))
        left = np.searchsorted(self.keys, keys, "left")
        count = np.searchsorted(self.keys, keys, "right") - left
        return np.repeat(at, count), self.strings[B.spread(left, count)]


class Passages:
    """The different test strings of some benchmark pieces, their items and their tables."""

    def __init__(self, pieces: Sequence[tuple[str, str]]) -> None:
        """``pieces``: item id and words joined by a blank."""
        raw = [piece.encode() for _, piece in pieces]
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) for r in raw], out=offsets[1:])
        self.words = Words.of(np.frombuffer(b"".join(raw), np.uint8), offsets)
        known: dict[bytes, int] = {}
        items: list[set[str]] = []
        at, lengths = [], []
        for (item, _), text, first in zip(pieces, raw, self.words.first):
            words = text.split(b" ")
            for k in range(max(1, len(words) - WINDOW + 1)):
                window = words[k : k + WINDOW]
                number = known.setdefault(b" ".join(window), len(items))
                if number == len(items):
                    items.append(set())
                    at.append(first + k)
                    lengths.append(len(window))
                items[number].add(item)
        self.at, self.lengths = np.array(at, np.int64), np.array(lengths, np.int64)
        self.items = [sorted(i) for i in items]
        self.tables = []
        kinds = np.array([int(n).bit_length() for n in self.lengths], np.int64)
        for kind in np.unique(kinds):
            strings = np.flatnonzero(kinds == kind)
            self.tables.append(Table.of(self.words, self.at[strings], self.lengths[strings], strings))

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words in the text and the test strings that occur there."""
        found = [self._confirmed(words, *table.candidates(words)) for table in self.tables]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([at for at, _ in found]), np.concatenate([strings for _, strings in found])

    def _confirmed(self, words: Words, at: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stop = words.first[np.searchsorted(words.first, at, "right")]
        whole = at + self.lengths[strings] <= stop
        at, strings = at[whole], strings[whole]
        n = self.lengths[strings]
        here, there = B.spread(at, n), B.spread(self.at[strings], n)
        sizes = words.ends[here] - words.starts[here]
        equal = sizes == self.words.ends[there] - self.words.starts[there]
        # Words of equal length are compared byte by byte; the others have failed already.
        left = words.data[B.spread(words.starts[here[equal]], sizes[equal])]
        right = self.words.data[B.spread(self.words.starts[there[equal]], sizes[equal])]
        equal[equal] = B.sums((left != right).astype(np.int64), B.sums_before(sizes[equal])) == 0
        kept = B.sums((~equal).astype(np.int64), B.sums_before(n)) == 0
        return at[kept], strings[kept]

    def search(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Per document of a block: its number of words, the runs of hit words, the items that occur."""
        words = Words.of(data, offsets)
        at, strings = self.occurrences(words)
        n_docs = len(offsets) - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
        items: list[set[str]] = [set() for _ in range(n_docs)]
        if len(at):
            change = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(change, at, 1)
            np.subtract.at(change, at + self.lengths[strings], 1)
            starts, ends = B.runs(np.cumsum(change[:-1]) > 0, words.first)
            docs = np.searchsorted(words.first, starts, "right") - 1
            for d, a, b in zip(docs, starts - words.first[docs], ends - words.first[docs]):
                spans[d].append((int(a), int(b)))
            docs = np.searchsorted(words.first, at, "right") - 1
            for d, s in np.unique(np.stack([docs, strings], axis=1), axis=0):
                items[d].update(self.items[s])
        return np.diff(words.first), spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching runs as one."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded words of each item, cut into pieces that overlap by a window less one word."""
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = _FOLD[raw].tobytes().decode().split()
            step = PIECE_WORDS - WINDOW + 1
            pieces = [" ".join(words[k : k + PIECE_WORDS]) for k in range(0, max(len(words) - WINDOW + 1, min(len(words), 1)), step)]
            yield pa.RecordBatch.from_arrays([pa.array([item or ""] * len(pieces), pa.string()), pa.array(pieces, pa.string())], ["item", "piece"])


def parts(benchmark: DataFrame, item: str = "item_id", text: str = "text", limit: int = PART_BYTES) -> tuple[DataFrame, int]:
    """The pieces of all items with the part that each is dealt to, and the number of parts, all of at most about ``limit`` bytes."""
    raw = benchmark.select(col(item).cast("string").alias("item"), col(text).alias("text"))
    pieces = durable(raw.mapInArrow(_pieces, "item string, piece string").distinct())
    size = F.length(F.encode("piece", "utf-8")) + F.length(F.encode("item", "utf-8"))
    total = pieces.agg(F.sum(size)).first()[0] or 0
    n = math.ceil(total / limit)
    return pieces.withColumn("part", F.pmod(F.xxhash64("item", "piece"), F.lit(max(n, 1)))), n


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep_text: bool = True,
    limit: int = PART_BYTES,
) -> DataFrame:
    """Adds ``n_words``, ``spans`` (runs of hit words, by word number) and ``items`` (ids of items that occur, sorted)."""
    spark = docs.sparkSession
    pieces, n_parts = parts(benchmark, item, item_text, limit)
    results = RESULTS.names
    if text in results:
        raise ValueError(f"The text column '{text}' has the name of a result.")
    passed = [c for c in docs.columns if c not in results and c != text]
    kept = [*passed, text]
    table = docs.select(*map(col, kept)).withColumns({"n_words": F.lit(None).cast("long"), "spans": F.lit(None).cast(RESULTS["spans"].dataType), "items": F.lit(None).cast("array<string>")})
    for part in range(max(n_parts, 1)):
        strings = spark.sparkContext.broadcast(Passages([(r["item"], r["piece"]) for r in pieces.where(F.col("part") == part).select("item", "piece").collect()]))
        last = part == max(n_parts, 1) - 1
        names = kept if keep_text or not last else passed
        schema = T.StructType([*(table.schema[c] for c in names), *RESULTS.fields])

        def search(batches: Iterator[pa.RecordBatch], strings=strings, names=names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text))
                before = batch.select(results[1:])
                for first, data, offsets in B.blocks(texts):
                    n = len(offsets) - 1
                    words, spans, items = strings.value.search(data, offsets)
                    for k, (old_spans, old_items) in enumerate(zip(*(before.column(c).slice(first, n).to_pylist() for c in results[1:]))):
                        if old_items:
                            spans[k] = _merged([*spans[k], *((s["start"], s["stop"]) for s in old_spans)])
                            items[k].update(old_items)
                    runs = [[{"start": a, "stop": b} for a, b in found] for found in spans]
                    new = [pa.array(words, pa.int64()), pa.array(runs, _ARROW[1].type), pa.array([sorted(i) for i in items], _ARROW[2].type)]
                    rows = batch.select(names).slice(first, n)
                    yield pa.RecordBatch.from_arrays([*rows.columns, *new], [*names, *results])

        table = table.mapInArrow(search, schema)
        if not last:
            table = durable(table)
    return table


def contaminated(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """``scan`` in numbers: n_words, n_hit, n_items, items_sha256 (of the sorted ids joined by commas), contaminated."""
    found = scan(docs, benchmark, keep_text=False, **names)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    joined = F.sha2(F.encode(F.concat_ws(",", "items"), "utf-8"), 256)
    added = {"n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": joined, "contaminated": n_hit > 0}
    return found.withColumns(added).drop("spans", "items")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """The documents that hold no test string, with their own columns."""
    if clash := set(docs.columns) & set(RESULTS.names):
        raise ValueError(f"Columns {sorted(clash)} would be replaced.")
    return scan(docs, benchmark, **names).where(F.size("items") == 0).drop(*RESULTS.names)
