"""Quality rules by repetition coverage.

Rolling hashes of n-grams of several lengths mark every word inside an n-gram that equals an earlier one of
the document; the share of characters in marked words, and in lines that repeat an earlier line, decides.

Null and empty texts have no words and fail the base rule. Repeated rows get equal verdicts. Columns other
than the text pass through untouched; a column with the name of a measure raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm import blocks as B

#: Largest share of characters in repeated n-grams, by n: documented thresholds, as in published web-text filters.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines that repeat an earlier line.
LINE_LIMIT = 0.20
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long"
_SYMBOLS = np.frombuffer(b"[#*$%&|<>]".strip(b"[]"), np.uint8)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _covered(hashes: np.ndarray, salt: np.ndarray, first: np.ndarray, n: int, copies_only: bool) -> np.ndarray:
    """Which words lie in an n-word window that their document holds twice or more; with ``copies_only``,
    in one that equals an earlier window."""
    inside = B.whole_windows(first, n)
    at = np.flatnonzero(inside)
    grams = B.window_hashes(hashes, n)[at] ^ salt[at]
    repeated = _repeated(grams)
    at, grams = at[repeated], grams[repeated]
    if copies_only:
        at = np.delete(at, np.unique(grams, return_index=True)[1])
    change = np.zeros(len(hashes) + 1, np.int32)
    change[at] += 1
    np.subtract.at(change, at + n, 1)
    return np.cumsum(change[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    """The measures of each document of a block."""
    starts, ends, first = B.words(data, offsets)
    span_hash = B.SpanHash(data)
    hashes = span_hash(starts, ends)
    salt = np.repeat(B.mixed(np.arange(1, len(offsets), dtype=np.uint64)), np.diff(first))
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    out = {
        "n_words": np.diff(first),
        "word_chars": B.sums(chars, first),
        "n_symbols": B.sums(np.isin(data, _SYMBOLS), offsets),
    }
    # Lines end at line feeds and at document edges; only those with a word count.
    line_starts, line_ends = B.runs(data != 10, offsets)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    of = np.searchsorted(offsets, line_starts, "right") - 1
    keys = span_hash(line_starts, line_ends) ^ B.mixed((of + 1).astype(np.uint64))
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    bounds = np.searchsorted(line_starts, offsets)
    out["n_dup_lines"] = B.sums(again, bounds)
    out["dup_line_chars"] = B.sums(again * (points[line_ends] - points[line_starts]), bounds)
    out["n_repeat_words"] = B.sums(_covered(hashes, salt, first, 3, False), first)
    for n in lengths:
        out[f"chars_in_repeated_{n}"] = B.sums(chars * _covered(hashes, salt, first, n, True), first)
    return out


def repetition(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each whole text."""
    added = MEASURES + "".join(f", chars_in_repeated_{n} long" for n in NGRAM_LIMITS)
    names = [x.split()[0] for x in added.split(", ")]
    if clash := {c.lower() for c in docs.columns} & set(names):
        raise ValueError(f"Columns have the names of measures: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text))
            for first, data, offsets in B.blocks(texts):
                found = measure(data, offsets)
                kept = batch.slice(first, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(found[n], pa.int64()) for n in names)], [*kept.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, {added}")


def verdicts(measured: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept``: the base rule first, then the shares of repeated characters."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = F.col("dup_line_chars") <= LINE_LIMIT * (F.col("word_chars") + F.col("n_words"))
    for n, limit in NGRAM_LIMITS.items():
        fine &= F.col(f"chars_in_repeated_{n}") <= limit * F.col("word_chars")
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only."""
    return verdicts(repetition(docs, text)).where("kept").select(docs.columns)
