"""CSV records with line breaks in quoted values, read in parallel.

Whether a split of a file begins inside a quoted value depends on all text before it. A first pass finds for every
split where its lines lead from either beginning; as these maps compose, a running total over one narrow row per split
tells how each begins. A second pass cuts every split into records; the pieces of those that reach over splits, at most
two per split, are put together by the split in which they open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabloom.session import durable

SMALL_SPLITS = 16 << 20
"""Bytes of measured rows, one per split, up to which they are broadcast; beyond, they are joined by a shuffle."""
_ROWS = 4096
_SPLIT = ["file", "start", "length"]


def open_after(line: str, inside: bool, sep: str, quote: str) -> bool:
    """Whether a quoted value is still open at the end of a line that begins inside or outside one.

    A value is quoted if the quote is its first character; a doubled quote inside stands for itself. What follows the
    closing quote up to the separator belongs to the value as it is.
    """
    if quote not in line:
        return inside
    body = _body(quote)
    at = 0
    if not inside and line.startswith(quote):
        inside, at = True, 1
    while True:
        if inside:
            at = body.match(line, at).end()
            if at == len(line):
                return True
            at += 1
        at = line.find(sep + quote, at)
        if at < 0:
            return False
        inside, at = True, at + 2


_BODIES: dict[str, re.Pattern] = {}


def _body(quote: str) -> re.Pattern:
    if quote not in _BODIES:
        q = re.escape(quote)
        _BODIES[quote] = re.compile(f"[^{q}]*(?:{q}{q}[^{q}]*)*")
    return _BODIES[quote]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    source = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    return source.select(
        "value",
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("start"),
        meta["file_block_length"].alias("length"),
        F.monotonically_increasing_id().alias("place"),
    )


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, dict]]:
    """Every line as (split, whether it is the split's first, its fields); a byte order mark is cut."""
    last = None
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            row = dict(zip(names, values))
            split = tuple(row[c] for c in _SPLIT)
            first = split != last
            last = split
            if first and row["start"] == 0:
                row["value"] = row["value"].removeprefix("\ufeff")
            yield split, first, row


def _ways(lines: DataFrame, sep: str, quote: str) -> DataFrame:
    """Per split ``(from_outside, from_inside, closes)``: open at its end from either beginning; whether a value open
    at its beginning is closed at the end of one of its lines."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            cells = [[v] for v in (*split, outside, inside, closes)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names)

        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
        names = [*_SPLIT, "from_outside", "from_inside", "closes"]
        split = None
        outside, inside, closes = False, True, False
        for at, first, line in _by_split(batches):
            if first:
                if split is not None:
                    yield row()
                split, outside, inside, closes = at, False, True, False
            same = outside == inside
            outside = open_after(line["value"], outside, sep, quote)
            inside = outside if same else open_after(line["value"], inside, sep, quote)
            closes = closes or not inside
        if split is not None:
            yield row()

    schema = "file string, start long, length long, from_outside boolean, from_inside boolean, closes boolean"
    return lines.drop("place").mapInArrow(scan, schema)


def _beginnings(ways: DataFrame) -> DataFrame:
    """Per split ``(inside, opener)``: whether it begins inside a value, and the split that holds that record's start."""
    so_far = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    # A split leads to the same end from both beginnings, turns them around, or keeps them.
    fixed = F.col("from_outside") == F.col("from_inside")
    turns = F.col("from_outside") & ~F.col("from_inside")
    counted = ways.withColumn("turned", F.count_if(turns).over(so_far))
    known = F.last(F.when(fixed, F.struct(F.col("from_outside").alias("open"), "turned")), ignorenulls=True).over(before)
    since = F.col("turned") - turns.cast("long") - F.coalesce(F.col("known.turned"), F.lit(0))
    began = counted.withColumn("known", known).withColumn("inside", F.coalesce(F.col("known.open"), F.lit(False)) != (since % 2 == 1))
    ends_open = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    opens = ends_open & (~F.col("inside") | F.col("closes"))
    opener = F.last(F.when(opens, F.col("start")), ignorenulls=True).over(before)
    return began.select(*_SPLIT, "inside", F.when(F.col("inside"), opener).alias("opener"))


def _pieces(lines: DataFrame, sep: str, quote: str) -> DataFrame:
    """Whole records, and with ``opener`` the pieces of records that reach over splits. ``first``: first of its file."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.large_string()]
        out: list[tuple] = []

        def flushed():
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*out), types)]
            arrays[-1] = arrays[-1].cast(pa.string())
            return pa.RecordBatch.from_arrays(arrays, ["file", "start", "opener", "first", "text"])

        split, held, opener, is_open, fresh, size = None, [], None, False, False, 0
        for at, first, line in _by_split(batches):
            if first:
                if held:
                    out.append((split[0], split[1], opener, fresh, "\n".join(held)))
                split, held, opener, is_open = at, [], line["opener"], line["inside"]
                fresh = at[1] == 0
            value = line["value"]
            if not held and not is_open:
                opener = at[1]
            held.append(value)
            began_inside = is_open and opener != at[1]
            is_open = open_after(value, is_open, sep, quote)
            if not is_open:
                text = "\n".join(held)
                held = []
                if began_inside:
                    out.append((at[0], at[1], opener, False, text))
                    opener = at[1]
                elif text.rstrip("\r"):
                    out.append((at[0], at[1], None, fresh, text.removesuffix("\r")))
                    fresh = False
                size += len(text)
            if len(out) >= _ROWS or (out and size > _ROWS << 10):
                yield flushed()
                out, size = [], 0
        if held:
            out.append((split[0], split[1], opener, fresh, "\n".join(held)))
        if out:
            yield flushed()

    schema = "file string, start long, opener long, first boolean, text string"
    return lines.mapInArrow(cut, schema)


def quoted_records(spark: SparkSession, path: str, sep: str = ",", quote: str = '"', header: bool = True) -> DataFrame:
    """Rows ``(text)``: the records of CSV files whose quoted values may hold line breaks; empty lines are left out.

    Lines end with ``\\n`` or ``\\r\\n``. With ``header`` the first record of every file is left out. The records are
    written once to the shared folder; all that is read later comes from there. A value that is never closed reaches to
    the end of its file. Files must not change, nor the session's split size, while the two passes run: a split that
    the first pass hasn't seen stops the job.
    """
    begun = durable(_beginnings(_ways(_lines(spark, path), sep, quote)))
    size = begun.agg(F.sum(F.octet_length("file") + F.lit(40))).first()[0] or 0
    lines = _lines(spark, path).join(F.broadcast(begun) if size <= SMALL_SPLITS else begun, _SPLIT, "left")
    message = F.concat(F.lit("The splits changed between two passes: "), F.col("file"))
    known = F.when(F.col("inside").isNull(), F.raise_error(message).cast("boolean")).otherwise(F.col("inside"))
    lines = lines.withColumn("inside", known).sortWithinPartitions("file", "start", "place").drop("place")
    pieces = durable(_pieces(lines, sep, quote))
    parts = pieces.where(F.col("opener").isNotNull()).groupBy("file", "opener")
    joined = parts.agg(F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
    whole = F.regexp_replace(F.array_join(F.col("parts.text"), "\n"), r"\r\z", "")
    records = pieces.where(F.col("opener").isNull()).select("first", "text").unionByName(joined.select("first", whole.alias("text")))
    return (records.where(~F.col("first")) if header else records).select("text")
