"""Repeated 100-byte strings, found by a column-wise transform of many text pieces at once.

A byte goes when a string of WINDOW bytes covers it that also starts earlier: in a document of smaller id, or
earlier in the same one. Strings are bytes of UTF-8; they never cross documents.

1. Every window has an anchor: the leftmost of its ANCHOR-byte strings with the least hash. Equal windows have
   equal anchors at equal places. A piece is a run of neighbouring windows with the same anchor, so equal
   windows lie in pieces of equal key, and a piece costs one narrow row for about 35 bytes of text.
2. Sorting the rows by (key, content, document, start) over ranges of rows, which splits a hot key over tasks,
   tells equal pieces: all but the first are repeats. Keys with different pieces go on, one piece per content.
3. The text of those is fetched and the pieces are lined up by their anchors. Round by round, from the last
   column to the first, one symbol of each piece is inserted: the order of all suffixes that start in the
   column follows from the order before by one stable pass over the symbols (the Burrows-Wheeler transform of
   that column), and common prefixes by minima between neighbours of equal symbol. As equal windows stand in
   equal columns, the transform is kept one column at a time: symbols, order and prefixes are sequential files
   of the task, read and written once a round. Neighbours that share WINDOW bytes or more are equal windows.
4. A key with many different pieces is cut into single windows without text, one narrow row each, told by their
   hashes as pieces are. Equal windows are dealt by document and place into groups of about HOT_PIECES, where all
   but the first are repeats; the first ones of the groups are compared with the first of all.

Null texts are empty; texts under WINDOW bytes lose nothing. Rows without an id are returned as they are and
compared with nothing. Rows with equal ids must have equal texts and are one document. Ids are whole numbers.
Other columns pass through.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tabloom.llm import blocks as B
from tabloom.session import durable

WINDOW, ANCHOR = 100, 32
#: Windows that hold the same place as their anchor, and so the most windows of a piece.
PLACES = WINDOW - ANCHOR + 1
COLUMNS = PLACES - 1 + WINDOW
#: Different pieces of a key above which it is cut into single windows; equal windows dealt to one group then.
HOT_PIECES = 1_024
#: Pieces that one round covers in a task.
CHUNK_PIECES = 100_000
#: Bytes of a document that are read at once; longer ones are read in parts that overlap.
_PART = 1 << 24


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, number of windows, bytes before the anchor, key and content of each piece of a block."""
    if len(data) > _PART:
        if len(offsets) != 2:
            raise ValueError("A block of several documents is too long")
        # Each part has the windows that start in its step; a piece that is cut in two stays right.
        step = _PART - WINDOW + 1
        found = []
        for begin in range(0, len(data) - WINDOW + 1, step):
            part = data[begin : begin + _PART]
            start, *others = pieces(part, np.array([0, len(part)]))
            found.append((start + begin, *others))
        return tuple(np.concatenate(x) for x in zip(*found))
    if len(data) < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    span_hash = B.SpanHash(data)
    at = np.arange(len(data) - ANCHOR + 1)
    hashes = span_hash(at, at + ANCHOR)
    place_bits = np.uint64(24)
    least = (hashes >> place_bits << place_bits) | at.astype(np.uint64)
    width = 1
    while 2 * width <= PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (PLACES - width)], least[PLACES - width :])
    anchor = (least & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    # Windows that lie in one document, and where the anchor or the document changes among them.
    n_windows = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    starts = B.spread(offsets[:-1], n_windows)
    anchor = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    begin, anchor = starts[first], anchor[first]
    return begin, n, anchor - begin, hashes[anchor], span_hash(begin, begin + n + WINDOW - 1)


def _packed(start: np.ndarray, lead: np.ndarray, n: np.ndarray) -> np.ndarray:
    return start << 14 | lead << 7 | n


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 14, at >> 7 & 127, at & 127


def _piece_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, data, offsets in B.blocks(batch.column(1)):
                start, n, lead, key, content = pieces(data, offsets)
                of = np.searchsorted(offsets, start, "right") - 1
                columns = [key.view(np.int64), content.view(np.int64), ids[row + of], _packed(start - offsets[of], lead, n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "content", "doc", "at"])

    return docs.mapInArrow(run, "key long, content long, doc long, at long")


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted rows: repeats of the piece before, and first pieces of keys that have several or lie at an edge."""
    held: np.ndarray | None = None  # the last row that started a content, not yet given out
    held_needed, first_key, last = False, None, None

    def out(rows: np.ndarray, repeats: np.ndarray | bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in rows), pa.array(np.broadcast_to(repeats, rows.shape[1]))], ["key", "content", "doc", "at", "repeats"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns])
        before = np.concatenate([last[:, None] if last is not None else rows[:, :1] - 1, rows[:, :-1]], axis=1)
        last = rows[:, -1].copy()
        same = (rows[:2] == before[:2]).all(axis=0)
        again = same & (rows[2:] != before[2:]).any(axis=0)
        if again.any():
            yield out(rows[:, again], True)
        starts = rows[:, ~same]
        if not starts.shape[1]:
            continue
        if first_key is None:
            first_key = starts[0, 0]
        if held is not None:
            starts = np.concatenate([held[:, None], starts], axis=1)
        shared = starts[0, 1:] == starts[0, :-1]
        needed = np.zeros(starts.shape[1], bool)
        needed[1:] |= shared
        needed[:-1] |= shared
        needed |= starts[0] == first_key
        needed[0] |= held is not None and held_needed
        give = needed.copy()
        give[-1] = False
        if give.any():
            yield out(starts[:, give], False)
        held, held_needed = starts[:, -1], bool(needed[-1])
    if held is not None:
        # The last key may go on in the next range.
        yield out(held[:, None], False)


class Rounds:
    """The column-wise construction over pieces of bytes lined up by their anchors.

    Three sequential files hold the symbols by column, and the order and common prefixes of the round before.
    """

    def __init__(self, texts: list[bytes], lead: np.ndarray) -> None:
        self.n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, self.n)
        lines = np.zeros((self.n, COLUMNS), np.uint8)
        lines.reshape(-1)[B.spread(np.arange(self.n) * COLUMNS + PLACES - 1 - lead, lengths)] = np.frombuffer(b"".join(texts), np.uint8)
        self.symbols, self.state = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        for column in range(COLUMNS - 1, -1, -1):
            self.symbols.write(lines[:, column].tobytes())
        self.symbols.seek(0)
        self._write(np.arange(self.n, dtype=np.int32), np.zeros(self.n, np.uint8))

    def _write(self, order: np.ndarray, prefix: np.ndarray) -> None:
        self.state.seek(0)
        self.state.write(order.tobytes())
        self.state.write(prefix.tobytes())

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(column, order of the suffixes that start there, common prefix of each with the one before)."""
        for column in range(COLUMNS - 1, -1, -1):
            self.state.seek(0)
            order = np.frombuffer(self.state.read(4 * self.n), np.int32)
            prefix = np.frombuffer(self.state.read(self.n), np.uint8)
            # The transform: the symbol before each suffix, in the order of the suffixes.
            transform = np.frombuffer(self.symbols.read(self.n), np.uint8)[order]
            moved = np.argsort(transform, kind="stable")
            grown = np.zeros(self.n, np.uint8)
            equal = transform[moved][1:] == transform[moved][:-1]
            if self.n > 1:
                # Between neighbours of equal symbol, the least common prefix of all that stood between them.
                bounds = np.stack([moved[:-1] + 1, moved[1:] + 1], axis=1).reshape(-1)
                between = np.minimum.reduceat(np.append(prefix, 0), bounds)[::2]
                grown[1:] = np.where(equal, between + 1, 0)
            order = order[moved]
            self._write(order, grown)
            yield column, order, grown
        self.symbols.close()
        self.state.close()


def later_windows(texts: list[bytes], lead: np.ndarray, n: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows of the pieces (pieces x PLACES, by column) equal one of a piece of smaller rank."""
    out = np.zeros((len(texts), PLACES), bool)
    first = PLACES - 1 - lead
    none = np.iinfo(np.int64).max
    for column, order, prefix in Rounds(texts, lead):
        if column >= PLACES:
            continue
        runs = np.flatnonzero(prefix < WINDOW)
        lengths = np.diff(np.append(runs, len(order)))
        if (lengths == 1).all():
            continue
        valid = (first[order] <= column) & (column < first[order] + n[order])
        ranks = np.where(valid, rank[order], none)
        earliest = np.repeat(np.minimum.reduceat(ranks, runs), lengths)
        out[order[valid & (ranks > earliest)], column] = True
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered spans (doc, start, length) from rows sorted by (key, part) with texts, or with the hash of a single window.

    Of equal windows of a group, the first is given out with its key and hash.
    """
    names = ["doc", "start", "length", "key", "content"]

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        single = pc.is_valid(table.column("content"))
        if (windows := table.filter(single)).num_rows:
            yield from of_windows(windows)
        if (rest := table.filter(pc.invert(single))).num_rows:
            yield of_pieces(rest)

    def of_windows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group, place = (np.stack([table.column(c).to_numpy() for c in by]) for by in (("key", "part", "content"), ("doc", "at")))
        rank = np.lexsort((*place[::-1], *group[::-1]))
        group, place = group[:, rank], place[:, rank]
        new, moved = (np.append(True, (x[:, 1:] != x[:, :-1]).any(axis=0)) for x in (group, place))
        for rows, first in ((new, True), (~new & moved, False)):
            spans = [pa.array(place[0, rows]), pa.array(_unpacked(place[1, rows])[0]), pa.array(np.full(rows.sum(), WINDOW))]
            told = [pa.array(group[i, rows]) if first else pa.nulls(rows.sum(), pa.int64()) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([*spans, *told], names)

    def of_pieces(table: pa.Table) -> pa.RecordBatch:
        doc = table.column("doc").to_numpy()
        start, lead, n = _unpacked(table.column("at").to_numpy())
        rank = np.lexsort((start + lead, doc))
        ranks = np.empty(len(doc), np.int64)
        # Rows of the same document and place are the same piece and share a rank.
        new = np.ones(len(doc), bool)
        new[1:] = (doc[rank][1:] != doc[rank][:-1]) | ((start + lead)[rank][1:] != (start + lead)[rank][:-1])
        ranks[rank] = np.cumsum(new)
        later = later_windows(table.column("text").to_pylist(), lead, n, ranks)
        edges = np.diff(np.pad(later, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edges == 1)
        end = np.nonzero(edges == -1)[1]
        spans = [doc[row], start[row] + begin - (PLACES - 1 - lead[row]), end - begin + WINDOW - 1]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in spans), *[pa.nulls(len(row), pa.int64())] * 2], names)

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        if sum(b.num_rows for b in rest) >= CHUNK_PIECES:
            table = pa.Table.from_batches(rest)
            key, part = table.column("key").to_numpy(), table.column("part").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            if len(cuts):
                yield from done(table.slice(0, cuts[-1]))
                rest = table.slice(cuts[-1]).combine_chunks().to_batches()
    if rest and (table := pa.Table.from_batches(rest)).num_rows:
        yield from done(table)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted pieces of each document; of hot keys, the hashes of their single windows."""
    for batch in batches:
        for row in range(batch.num_rows):
            raw, doc = (batch.column("text")[row].as_py() or "").encode(), batch.column("doc")[row].as_py()
            wanted = batch.column("wanted")[row].values
            keys, ats, parts = (wanted.field(f).to_numpy() for f in ("key", "at", "parts"))
            hot = parts > 1
            starts, leads, ns = _unpacked(ats)
            texts = [raw[s : s + n + WINDOW - 1] for s, n in zip(starts[~hot].tolist(), ns[~hot].tolist())]
            out_key, out_part, out_at = [keys[~hot]], [np.zeros(int((~hot).sum()), np.int64)], [ats[~hot]]
            texts += [None] * int(ns[hot].sum())
            content = np.zeros(len(texts), np.int64)
            if hot.any():
                s = B.spread(starts[hot], ns[hot])
                lead = np.repeat(starts[hot] + leads[hot], ns[hot]) - s
                windows = B.SpanHash(np.frombuffer(raw, np.uint8))(s, s + WINDOW)
                dealt = B.mixed(np.uint64(doc & (1 << 64) - 1) ^ B.mixed(s.astype(np.uint64))) % np.repeat(parts[hot], ns[hot]).astype(np.uint64)
                content[len(texts) - len(s) :] = windows.view(np.int64)
                out_key.append(np.repeat(keys[hot], ns[hot]))
                out_part.append(B.mixed(windows ^ B.mixed(dealt + np.uint64(1))).view(np.int64))
                out_at.append(_packed(s, lead, np.ones(len(s), np.int64)))
            columns = [np.concatenate(x) for x in (out_key, out_part, out_at)]
            whole = np.arange(len(texts)) < len(out_key[0])
            columns = [pa.array(columns[0]), pa.array(columns[1]), pa.array(content, mask=whole), pa.array(np.full(len(texts), doc)), pa.array(columns[2])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], ["key", "part", "content", "doc", "at", "text"])


def repeats(docs: DataFrame) -> DataFrame:
    """Covered spans (doc, start, length) in bytes; they may overlap. ``docs`` has doc and text."""
    rows = _piece_rows(docs.select("doc", "text"))
    order = ["key", "content", "doc", "at"]
    sifted = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sift, "key long, content long, doc long, at long, repeats boolean"))
    # A content at the edge of a range may have begun before: one row for each range that it spans.
    by_content = Window.partitionBy("key", "content").orderBy("doc", "at")
    firsts = sifted.where("not repeats").withColumn("nth", F.rank().over(by_content))
    firsts = durable(firsts.select("key", "content", "doc", "at", (F.col("nth") > 1).alias("repeats")))
    several = firsts.where("not repeats").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.when(F.col("n") > HOT_PIECES, F.ceil(F.col("n") / HOT_PIECES) + 1).otherwise(1).cast("long")
    wanted = firsts.where("not repeats").join(several.select("key", parts.alias("parts")), "key")
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "at", "parts")).alias("wanted"))
    texts = wanted.join(docs.select("doc", "text"), "doc").select("doc", "wanted", "text").mapInArrow(_texts, "key long, part long, content long, doc long, at long, text binary")
    spans = "doc long, start long, length long"
    found = durable(texts.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_compare, f"{spans}, key long, content long"))
    # The first window of a group is a repeat unless it is the first of all groups.
    leads = found.where("content is not null")
    least = leads.groupBy("key", "content").agg(F.min(F.struct("doc", "start")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    leads = leads.join(least, ["key", "content"]).where(F.struct("doc", "start") != F.col("least"))
    compared = found.where("content is null").select("doc", "start", "length").unionAll(leads.select("doc", "start", "length"))
    length = F.col("at").bitwiseAND(127) + WINDOW - 1
    equal = sifted.where("repeats").select("doc", "at").unionAll(firsts.where("repeats").select("doc", "at"))
    return equal.select("doc", F.shiftright("at", 14).alias("start"), length.cast("long").alias("length")).unionAll(compared)


def _merged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of spans; spans that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:] - 1, len(starts) - 1)] if len(first) else ends


def _with_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with ``spans``, all covered spans of the document (at most one per piece of it)."""
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    per = repeats(named).groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("spans")).withColumnRenamed("doc", "_doc")
    return docs.join(per, F.col(key).cast("long") == F.col("_doc"), "left").drop("_doc")


def _cut(batches: Iterator[pa.RecordBatch], text: str, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts, spans = batch.column(names.index(text)), batch.column(names.index("spans"))
        results: list[tuple] = []
        for row in range(batch.num_rows):
            whole = texts[row].as_py()
            raw = (whole or "").encode()
            n_removed = n_spans = 0
            if spans[row].is_valid:
                starts, ends = _merged(*(spans[row].values.field(f).to_numpy() for f in ("start", "length")))
                if not digest and len(raw) != len(whole):
                    # A character goes when all its bytes do.
                    inner = (np.frombuffer(raw + b" ", np.uint8) & 0xC0) == 0x80
                    at = np.flatnonzero(~inner)
                    starts, ends = at[np.searchsorted(at, starts)], at[np.searchsorted(at, ends, "right") - 1]
                    ends = np.maximum(starts, ends)
                n_removed, n_spans = int((ends - starts).sum()), len(starts)
                kept = zip([0, *ends.tolist()], [*starts.tolist(), len(raw)])
                raw = b"".join(raw[a:b] for a, b in kept)
            results.append((len(raw) + n_removed, n_removed, n_spans, hashlib.sha256(raw).hexdigest()) if digest else (None if whole is None else raw.decode(),))
        others = [n for n in names if n not in (text, "spans")]
        kept_columns = [batch.column(names.index(n)) for n in others]
        added = zip(*results) if results else [[]] * (4 if digest else 1)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] if digest else [pa.string()]
        new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else [text]
        yield pa.RecordBatch.from_arrays([*kept_columns, *(pa.array(list(a), k) for a, k in zip(added, kinds))], [*others, *new])


def _applied(docs: DataFrame, key: str, text: str, digest: bool) -> DataFrame:
    others = [f for f in docs.schema.fields if f.name != text]
    if clash := {f.name.lower() for f in others} & ({"n_bytes", "n_removed", "n_spans", "kept_sha256"} if digest else set()) | {f.name.lower() for f in others} & {"spans", "_doc"}:
        raise ValueError(f"Columns have the names of results: {sorted(clash)}")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in others]
    fields += ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"] if digest else [f"`{text}` string"]
    spans = _with_spans(docs, key, text)
    return spans.mapInArrow(lambda batches: _cut(batches, text, digest), ", ".join(fields))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    return _applied(docs, key, text, digest=True)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of the text; only whole characters go."""
    return _applied(docs, key, text, digest=False).select(docs.columns)
