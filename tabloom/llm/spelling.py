"""Spelling variants in a corpus: asymmetric q-chunks find the words that are one edit apart.

1. ``word_counts``: the runs of letters of all texts are counted in the tasks (Arrow value counts), merged by word.
2. ``near_pairs``: of two words one edit apart, the one that is not longer contributes two disjoint chunks, each
   half of its length, and the other its positional grams of that length. One edit leaves a chunk whole and shifts
   it by at most one: the first not at all, the second by the difference in length. So of all positional grams
   only those two per length can join, and only they are sent. Joined rows are verified by their edit distance.
   A pair that both chunks find counts at the first.
3. A chunk that many words share would make all pairs of them. Such groups are cut by one more key, the word
   without one of its other code points, so that a group has at most as many words as there are letters; rows grow
   with the members' lengths, not with their square. Words of over ``LONGEST_CUT`` code points, which no such
   group of natural words holds, are compared in pairs.
   Tables of words are merged, never broadcast: Spark takes their size from compressed files, before words are cut
   into chunks, so a table of many times a broadcast's limit passes for a small one.
4. ``forms``: counts and best neighbours are aggregates of the pairs; roots come by pointer doubling, whose rounds
   grow with the logarithm of the longest chain (each step at least doubles the count, so chains are short).

Null and empty texts have no words. A null key counts as the empty string. Repeated rows count as often as they
occur. Ties among neighbours go to the least word in code-point order. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import col
from tabloom.llm import blocks as B
from tabloom.session import durable

#: Words have at least so many code points and occurrences.
LEAST_POINTS = 5
LEAST_COUNT = 3
#: One run in so many, by its checksum with the document's key, loses a code point.
LOSS = 97
#: A chunk whose words make more pairs is cut by one more key.
GROUP_PAIRS = 1 << 12
LONGEST_CUT = 64
#: Up to so many keys of such chunks, of at most half that many code points each, are broadcast.
BROADCAST_KEYS = 1 << 16
#: Distinct words that a task gathers before it passes them on.
GATHERED = 1 << 17
GATHERED_BYTES = 32 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
#: The lead byte of U+00C0 to U+00FF.
_LEAD = 0xC3
#: Runs of more bytes take their checksum one by one.
_LONG = 48


def _checksum_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _checksum_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of spans, each carried on from the checksum ``before`` it."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    lengths, at = lengths[order], starts[order]
    n_long = int(np.searchsorted(-lengths, -_LONG, "left"))
    state = ~before[order].astype(np.uint32)
    for k in range(n_long):
        state[k] = ~np.uint32(zlib.crc32(data[at[k] : at[k] + lengths[k]].tobytes(), int(~state[k])))
    left, at, state_left = lengths[n_long:], at[n_long:], state[n_long:]
    active = len(left)
    for k in range(int(left[0]) if active else 0):
        active = int(np.searchsorted(-left, -k, "left"))
        part = state_left[:active]
        state_left[:active] = _TABLE[(part ^ data[at[:active] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    result = np.empty(len(state), np.uint32)
    result[order] = ~state
    return result


def block_words(data: np.ndarray, offsets: np.ndarray, keys: list[str]) -> list[pa.Array]:
    """The words of a block, with repeats: those left as they are, and those that lost a code point."""
    folded = _FOLD[data]
    lead = folded == _LEAD
    follows = np.zeros(len(lead), bool)
    follows[1:] = lead[:-1]
    starts, ends = B.runs(_LETTER[folded] | lead | follows, offsets)
    points = ends - starts - B.sums(lead.astype(np.int64), np.stack([starts, ends], axis=1).ravel())[::2] if len(starts) else ends - starts
    enough = points >= LEAST_POINTS
    starts, ends, points = starts[enough], ends[enough], points[enough]
    before = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32)
    sums = checksums(folded, starts, ends, before[np.searchsorted(offsets, starts, "right") - 1])
    loses = sums % LOSS == 0
    lost = []
    for s, e, k in zip(starts[loses], ends[loses], sums[loses] % points[loses]):
        run = folded[s:e].tobytes().decode()
        if len(run) > LEAST_POINTS:
            lost.append(run[:k] + run[k + 1 :])
    starts, ends = starts[~loses], ends[~loses]
    places = B.sums_before(ends - starts)
    letters = folded[B.spread(starts, ends - starts)]
    whole = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.tobytes()), pa.py_buffer(letters.tobytes()))
    return [whole, pa.array(lost, pa.large_string())]


def _counted(words: pa.Array) -> pa.Table:
    counts = pc.value_counts(words)
    return pa.table({"word": counts.field("values"), "n": counts.field("counts")})


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]) if tables else pa.table({"word": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gathered: list[pa.Table] = []

    def passed() -> Iterator[pa.RecordBatch]:
        for batch in _summed(gathered).to_batches(max_chunksize=1 << 14):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1)], ["word", "n"])
        gathered.clear()

    for batch in batches:
        keys = batch.column(0).to_pylist()
        for first, data, offsets in B.blocks(batch.column(1)):
            gathered.extend(_counted(words) for words in block_words(data, offsets, keys[first : first + len(offsets) - 1]))
            if len(gathered) > 32 or sum(t.nbytes for t in gathered) > GATHERED_BYTES:
                gathered[:] = [_summed(gathered)]
                if gathered[0].num_rows > GATHERED or gathered[0].nbytes > GATHERED_BYTES // 2:
                    yield from passed()
    yield from passed()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the different words of at least ``LEAST_POINTS`` code points and ``LEAST_COUNT`` occurrences."""
    named = docs.select(F.coalesce(col(key).cast("string"), F.lit("")).alias("key"), col(text).alias("text"))
    counts = named.mapInArrow(_word_counts, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def _chunk_rows(words: DataFrame) -> DataFrame:
    """(size, place, gram, longer, word, n): chunks of each word, and grams where shorter words have chunks.

    ``size`` is the length of the words with that chunk, ``longer`` tells the grams of words longer by one.
    """
    rows = []
    for longer in (0, 1):
        size = F.char_length("word") - longer
        for place in (0, 1):
            start = F.lit(1) if place == 0 else _half(size) + 1 + longer
            gram = F.substring("word", start, _half(size))
            rows.append(F.struct(size.alias("size"), F.lit(place).alias("place"), gram.alias("gram"), F.lit(longer).alias("longer")))
    cut = words.select("word", "n", F.explode(F.array(*rows)).alias("c")).select("c.*", "word", "n")
    return cut.where(F.col("size") >= LEAST_POINTS)


def _joined(rows: DataFrame, by: list[str]) -> DataFrame:
    """Chunks with the grams of their key: (place, a, n_a, b, n_b), a not longer than b."""
    left = rows.where("longer = 0").select(*by, F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = rows.select(*by, "longer", F.col("word").alias("b"), F.col("n").alias("n_b"))
    return left.join(right.hint("merge"), by).where("longer = 1 OR a < b").select("place", "a", "n_a", "b", "n_b")


def _holes(rows: DataFrame) -> DataFrame:
    """One row per code point that may be the edit, with the word without it (``rest``) and its place (``hole``).

    In words of equal length the edit is at the same place outside the chunk. A longer word meets the whole
    shorter word (hole -1) after losing a code point behind chunk 0 or before chunk 1; of a run of equal code
    points, leaving out any gives the same word, so the first is enough.
    """
    m, i, half = F.char_length("word"), F.col("i"), _half(F.col("size"))
    longer, first_chunk = F.col("longer") == 1, F.col("place") == 0
    outside = F.when(first_chunk, i >= half).when(longer, i <= half).otherwise((i < half) | (i >= 2 * half))
    starts_run = (i == F.when(first_chunk, half).otherwise(0)) | (F.substring("word", i, F.lit(1)) != F.substring("word", i + 1, F.lit(1)))
    without = F.concat(F.substring("word", F.lit(1), i), F.substring("word", i + 2, m))
    cut = rows.withColumn("i", F.explode(F.sequence(F.lit(0), m - 1))).where(outside & (~longer | starts_run))
    cut = cut.select(*rows.columns, F.when(longer, -1).otherwise(i).alias("hole"), without.alias("rest"))
    return cut.unionByName(rows.where(~longer).withColumns({"hole": F.lit(-1), "rest": F.col("word")}))


def near_pairs(words: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """(a, n_a, b, n_b): every two words one edit apart, once."""
    by = ["size", "place", "gram"]
    rows = _chunk_rows(words)
    sizes = rows.groupBy(*by).agg(F.sum(1 - F.col("longer")).alias("chunks"), F.count(F.lit(1)).alias("grams"))
    hot = durable(sizes.where((F.col("chunks") * F.col("grams") > group_pairs) & (F.col("size") <= LONGEST_CUT)).select(*by))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot.hint("merge")
    plain = _joined(rows.join(hot, by, "left_anti"), by)
    holes = _holes(rows.join(hot, by, "left_semi"))
    # A whole shorter word meets longer words only.
    cut = _joined(holes.where("hole >= 0"), ["size", "place", "hole", "rest"])
    whole = holes.where("hole < 0 AND longer = 0").select("size", "place", "rest", F.col("word").alias("a"), F.col("n").alias("n_a"))
    lost = holes.where("hole < 0 AND longer = 1").select("size", "place", "rest", F.col("word").alias("b"), F.col("n").alias("n_b"))
    cut = cut.unionByName(whole.join(lost.hint("merge"), ["size", "place", "rest"]).select("place", "a", "n_a", "b", "n_b"))
    half = _half(F.char_length("a"))
    found_before = (F.col("place") == 1) & (F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half))
    near = plain.unionByName(cut).where(~found_before & (F.levenshtein("a", "b", 1) == 1))
    return near.select("a", "n_a", "b", "n_b")


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per word: ``n``, ``n_near``, ``form`` (the commonest near word, if at least twice as common), ``form_n``, ``root``."""
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n")),
    )
    near = pairs.select(F.explode(sides).alias("s")).select("s.*")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"), F.first("n").alias("own"))
    fits = -F.col("best.m") >= 2 * F.col("own")
    best = durable(best.select("word", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")))
    roots = durable(best.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = durable(roots.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = step.agg(F.max("moved")).first()[0]
        roots = step.select("word", "root")
        if not moved:
            break
    joined = words.join(best.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """``forms`` of all words of the documents."""
    words = durable(word_counts(docs, key, text))
    return forms(words, near_pairs(words, group_pairs))
