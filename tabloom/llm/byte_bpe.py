"""Byte-level BPE by two tiers: a minimal perfect hash for whole pre-tokens, merges for the rest.

A merge step is taken in all of a block's other pre-tokens at once, one row of a matrix each; long ones have a heap.

Null texts are empty; an empty text has no ids. Special tokens are ordinary text. Vocabulary files are a
parameter, read on the driver; their tables are broadcast (one vocabulary, about 6 MB).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tabloom.llm import blocks as B

#: Bytes up to which a missed pre-token is a row of a matrix. The work of a row grows with the square of its bytes.
ROW_BYTES = 64
#: Cells of a matrix of missed pre-tokens.
MATRIX_CELLS = 1 << 18
_NO_RANK, _FREE = np.iinfo(np.int32).max, np.uint64((1 << 64) - 1)


class PerfectHash:
    """Levels of bit arrays: a key lives at the first level where no other remaining key shares its place.

    The index of a key is the number of taken places before its own, so n keys have the indices 0 … n - 1.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[np.ndarray] = []
        rest, taken = keys, 0
        while len(rest):
            size = 2 * len(rest) + 1
            place = self._place(rest, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            index = np.full(size, -1, np.int32)
            index[alone] = taken + np.arange(int(alone.sum()))
            taken += int(alone.sum())
            self.levels.append(index)
            rest = rest[~alone[place]]
            if len(self.levels) > 64:
                raise ValueError("Keys repeat")

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (B.mixed(keys + np.uint64(level * 0x5851F42D4C957F2D & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """An index for each key; any index, or -1, for a key that isn't among those built from."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, index in enumerate(self.levels):
            found = index[self._place(keys[left], level, len(index))]
            out[left[found >= 0]] = found[found >= 0]
            left = left[found < 0]
            if not len(left):
                break
        return out


class PairTable:
    """Ranks of two neighbouring ids as one token: a table with free places, the next one if one is taken."""

    def __init__(self, ranks: dict[int, int]) -> None:
        self.bits = (2 * len(ranks) + 1).bit_length()
        self.key, self.rank = np.full(1 << self.bits, _FREE), np.full(1 << self.bits, _NO_RANK, np.int32)
        keys, values = np.fromiter(ranks, np.uint64, len(ranks)), np.fromiter(ranks.values(), np.int32, len(ranks))
        at = self._place(keys)
        while len(keys):
            free = self.key[at] == _FREE
            self.key[at[free]] = keys[free]
            stays = self.key[at] == keys
            self.rank[at[stays]] = values[stays]
            keys, values, at = keys[~stays], values[~stays], self._next(at[~stays])

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return at + 1 & len(self.key) - 1

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._place(keys)
        found = self.key[at]
        out = np.where(found == keys, self.rank[at], _NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found != _FREE))
        while len(open_):
            at[open_] = self._next(at[open_])
            found = self.key[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.rank[at[open_[hit]]]
            open_ = open_[~hit & (found != _FREE)]
        return out


class Vocabulary:
    """Ranks of byte strings with both tiers and the way back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        tokens = sorted(ranks, key=ranks.get)
        lengths = np.array([len(t) for t in tokens], np.int64)
        pool = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum(lengths)
        keys = B.SpanHash(pool)(ends - lengths, ends)
        self.hash = PerfectHash(keys)
        at = self.hash(keys)
        ids = np.array([ranks[t] for t in tokens], np.int64)
        self.key_at, self.id_at = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64)
        self.key_at[at], self.id_at[at] = keys, ids
        # By id, for decoding.
        self.pool = pool
        self.start, self.length = np.zeros(int(ids.max()) + 1, np.int64), np.zeros(int(ids.max()) + 1, np.int64)
        self.start[ids], self.length[ids] = ends - lengths, lengths
        # Ranks of neighbours by their two ids; parts have ids from the start if every byte is a token.
        one = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.by_rows = min(one) >= 0 and len(set(ranks.values())) == len(ranks) and int(ids.max()) < _NO_RANK
        if self.by_rows:
            self.byte_id = np.array(one, np.int32)
            pairs = {
                ranks[t[:cut]] << 32 | ranks[t[cut:]]: rank for t, rank in ranks.items() for cut in range(1, len(t)) if t[:cut] in ranks and t[cut:] in ranks
            }
            self.pairs = PairTable(pairs)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """First tier: the id of each span that is a token, else -1. The bytes of a find are compared."""
        at = self.hash(keys)
        ids = np.where((at >= 0) & (self.key_at[at] == keys), self.id_at[at], -1)
        hit = np.flatnonzero(ids >= 0)
        lengths = (ends - starts)[hit]
        same_length = self.length[ids[hit]] == lengths
        ids[hit[~same_length]] = -1
        hit, lengths = hit[same_length], lengths[same_length]
        differ = data[B.spread(starts[hit], lengths)] != self.pool[B.spread(self.start[ids[hit]], lengths)]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        ids[hit[B.sums(differ, bounds) > 0]] = -1
        return ids

    def merge_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Second tier: the ids of all given spans, and where those of each span start and how many they are."""
        lengths = ends - starts
        begin, sizes = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        flat, done = [], 0

        def finish(spans: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
            nonlocal done
            sizes[spans], begin[spans] = counts, done + np.cumsum(counts) - counts
            flat.append(ids)
            done += len(ids)

        order = np.argsort(lengths, kind="stable")
        at, short = np.searchsorted(lengths[order], [0, ROW_BYTES if self.by_rows else 0], "right").tolist()
        while at < short:
            # Rows of one matrix have nearly the same length.
            width = -(-int(lengths[order[at]]) // 4) * 4
            last = min(int(np.searchsorted(lengths[order[:short]], width, "right")), at + MATRIX_CELLS // width)
            self._merge_rows(data, starts, lengths, order[at:last], width, finish)
            at = last
        for i in order[short:].tolist():
            ids = self.merge(data[starts[i] : ends[i]].tobytes())
            finish(np.array([i]), np.array([len(ids)]), np.array(ids, np.int64))
        return np.concatenate([np.zeros(0, np.int64), *flat]), begin, sizes

    def _merge_rows(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, spans: np.ndarray, width: int, finish: Callable) -> None:
        """Merge the lowest-ranked neighbours of each span, leftmost among equals, until none is left in any of them."""
        place = np.arange(width)
        filled = place < lengths[spans, None]
        parts = np.where(filled, self.byte_id[data[np.minimum(starts[spans, None] + place, len(data) - 1)]], -1)
        # The rank of a part with the next one.
        ranks = np.full(parts.shape, _NO_RANK, np.int32)
        pair = np.nonzero(filled[:, 1:])
        ranks[pair] = self.pairs(parts[pair], parts[pair[0], pair[1] + 1])
        while len(spans):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(spans)), at]
            if (over := best == _NO_RANK).any():
                rest = parts[over]
                finish(spans[over], (rest >= 0).sum(axis=1), rest[rest >= 0].astype(np.int64))
                spans, parts, ranks, at, best = (a[~over] for a in (spans, parts, ranks, at, best))
            row = np.arange(len(spans))
            # The right part goes, those behind it move up: a column less for all.
            behind = np.arange(parts.shape[1] - 1) > at[:, None]
            parts = np.where(behind, parts[:, 1:], parts[:, :-1])
            ranks = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            parts[row, at] = best
            ranks[row, at] = _NO_RANK
            if (more := np.flatnonzero(at > 0)).size:
                left = at[more] - 1
                ranks[more, left] = self.pairs(parts[more, left], best[more])
            more = np.flatnonzero(at + 1 < parts.shape[1])
            more = more[parts[more, at[more] + 1] >= 0]
            ranks[more, at[more]] = self.pairs(best[more], parts[more, at[more] + 1])

    def merge(self, token: bytes) -> list[int]:
        """Second tier for long ones: merge the lowest-ranked neighbours first, leftmost among equals.

        Places are linked to their right and left neighbours; the heap holds possible merges, and an entry
        is void when either of its parts has changed since.
        """
        n = len(token)
        end = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := self.ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            gone = end[i]
            alive[gone] = False
            end[i] = stop
            if stop < n:
                left[stop] = i
                if (rank := self.ranks.get(token[i : end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (before := left[i]) >= 0 and (rank := self.ranks.get(token[before:stop])) is not None:
                heapq.heappush(heap, (rank, before, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[token[i : end[i]]])
            i = end[i]
        return out


def load(path: str, pattern: str) -> Vocabulary:
    """A vocabulary from lines of base64 bytes and rank."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


class Encoder:
    """Encodes and decodes blocks of documents; one per task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.find = vocabulary, regex.compile(vocabulary.pattern).findall

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pre-tokens with the block's end, and the first of each document."""
        starts, counts = [], []
        for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            raw = data[begin:end]
            text = raw.tobytes().decode("utf-8")
            parts = self.find(text)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            at = np.cumsum(sizes) - sizes
            if len(text) != end - begin:
                at = np.flatnonzero((raw & 0xC0) != 0x80)[at]
            if sizes.sum() != len(text):
                raise ValueError("The pattern leaves out characters")
            starts.append(at + begin)
            counts.append(len(parts))
        return np.concatenate([*starts, [len(data)]]).astype(np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block and the first id of each document (one entry more than documents)."""
        bounds, first = self._spans(data, offsets)
        starts, ends = bounds[:-1], bounds[1:]
        keys = B.SpanHash(data)(starts, ends)
        ids = self.vocabulary.lookup(data, starts, ends, keys)
        missed = np.flatnonzero(ids < 0)
        _, one, which = np.unique(keys[missed], return_index=True, return_inverse=True)
        flat, pool_starts, sizes = self.vocabulary.merge_all(data, starts[missed[one]], ends[missed[one]])
        # One pool: the found ids, then those of the missed pre-tokens.
        lengths, begin = np.ones(len(ids), np.int64), np.arange(len(ids))
        lengths[missed], begin[missed] = sizes[which], len(ids) + pool_starts[which]
        out = np.concatenate([ids, flat])[B.spread(begin, lengths)]
        return out, np.concatenate([[0], np.cumsum(lengths)])[first]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids and the first byte of each document."""
        lengths = self.vocabulary.length[ids]
        data = self.vocabulary.pool[B.spread(self.vocabulary.start[ids], lengths)]
        return data, np.concatenate([[0], np.cumsum(lengths)])[first]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", digests: bool = False) -> DataFrame:
    """``docs`` without the text, with ``ids`` (array of int) and ``decoded`` (binary, from the ids).

    With ``digests``, instead n_tokens, ids_sha256 (little-endian unsigned 32-bit) and decoded_sha256.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path, pattern))
    others = [c for c in docs.columns if c != text]
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} if digests else {"ids": "array<int>", "decoded": "binary"}
    if clash := {c.lower() for c in others} & set(added):
        raise ValueError(f"Columns have the names of results: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            names = batch.schema.names
            for row, data, offsets in B.blocks(batch.column(names.index(text))):
                ids, first = encoder.encode(data, offsets)
                back, back_first = encoder.decode(ids, first)
                if digests:
                    raw = ids.astype("<u4")
                    results = [
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(first, first[1:])]),
                        pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(back_first, back_first[1:])]),
                    ]
                else:
                    results = [
                        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array([back[a:b].tobytes() for a, b in zip(back_first, back_first[1:])], pa.binary()),
                    ]
                kept = batch.slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*(kept.column(names.index(c)) for c in others), *results], [*others, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(run, ", ".join([*fields, *(f"{k} {v}" for k, v in added.items())]))
