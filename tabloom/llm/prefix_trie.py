"""Prefix trie of conversations: which openings they share, and how many words a shared prefix saves.

A turn is a big-endian id of ``WIDTH`` bytes (of the SHA-256 of role and text), a conversation the ids of its
turns one after the other. Conversations are sorted over the cluster by these bytes, so rows with a common
opening lie next to each other, and a hot opening or a conversation with many copies spreads over tasks.

1. Each task cuts its sorted rows into units of bounded size and builds an adaptive radix tree of each
   (``radix_tree``): path compression skips what all keys below share, and only byte depths that are multiples
   of ``WIDTH`` emit nodes. Nodes that can't reach beyond the unit are final there.
2. A node on the path of a unit's first or last key may go on in another unit. Of these a unit gives partial sums:
   two rows per depth. In the order of units they are a walk through the top of the whole trie, which one task
   merges with a stack as deep as the longest conversation; its rows grow with the number of units, not of rows.
   Hashes of members are carried on in that order, as SHA-256 can only be computed from front to back.
3. The smallest members of the shared nodes are an aggregate, joined to the nodes below by unit and place.

Conversations without an id are left out. Null roles and texts are empty, null turns come first, turns with equal
numbers are ordered by their ids. Repeated rows are repeated turns. Other columns are ignored. The turns of one
conversation have to fit in a row (16 bytes each), as does its text at the source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import col
from tabloom.llm.radix_tree import RadixTree
from tabloom.session import durable

#: Bytes of a turn id.
WIDTH = 16
#: Rows and bytes of keys that one radix tree holds at most (a longer key is a unit of its own).
UNIT_ROWS = 20_000
UNIT_BYTES = 8 << 20

_UNIT = (
    "shared boolean, part int, unit int, place int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, turn_id string, node string, parent string, words long, ends binary"
)
_MERGED = "depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_id string, node string, parent string"
_MERGED_INPUT = ["depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "turn_id", "node", "parent", "words", "ends"]
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id"]


def turn_id(role: Column, text: Column) -> Column:
    """Hexadecimal id of a turn; the length keeps role and text apart."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(F.encode(whole, "utf-8"), 256), 1, 2 * WIDTH)


def sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the ids and numbers of words of each conversation's turns, in order."""
    rows = conversations.where(col(conv).isNotNull()).select(
        col(conv).cast("long").alias("conv_id"),
        col(turn).alias("turn"),
        F.coalesce(col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col(text).cast("string"), F.lit("")).alias("text"),
    )
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = rows.select("conv_id", F.struct("turn", turn_id(F.col("role"), F.col("text")).alias("id"), words.alias("words")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))))


def with_shared_openings(own: DataFrame, block: int = 20, most: int = 3) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % ``block`` instead of its own first h.

    h is the checksum of c's digits modulo ``most`` + 1.
    """
    c = F.col("conv_id")
    heads = own.where(F.pmod(c, F.lit(block)) == 0).select(c.alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(c.cast("string").cast("binary")) % (most + 1)).cast("int")
    joined = own.withColumn("base", c - F.pmod(c, F.lit(block))).withColumn("h", h).join(heads, "base", "left")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


class _Open:
    """A node whose subtree is being walked; ``place`` and ``name`` if it may go on in another unit."""

    __slots__ = ("least", "n", "children", "leaves", "saved", "member", "ends", "place", "name", "below")

    def __init__(self, place: int | None = None, name: str | None = None) -> None:
        self.least: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        #: The key of a member and its words per turn.
        self.member: tuple[bytes, list[int]] | None = None
        self.ends: list[int] = []
        self.place = place
        self.name = name
        self.below: list[dict] = []


def _path_names(key: bytes) -> list[str]:
    """A name for each beginning of a key that consists of whole turns."""
    whole = hashlib.sha256()
    names = [whole.hexdigest()]
    for at in range(0, len(key), WIDTH):
        whole.update(key[at : at + WIDTH])
        names.append(whole.hexdigest())
    return names


def _joined(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def _agreed(known: int, above: int, own: bytes, key: bytes) -> int:
    """How many first bytes of a node's whole path a key shares, if it shares ``known`` of its parent's."""
    if known < above:
        return known
    if key.startswith(own, above):
        return above + len(own)
    return above + next((i for i, (a, b) in enumerate(zip(key[above : above + len(own)], own)) if a != b), len(key) - above)


def unit_nodes(rows: list[tuple[bytes, int, list[int]]], part: int = 0, unit: int = 0) -> list[dict]:
    """The nodes of sorted rows (key, conversation, words per turn): final ones, and partial sums of shared ones."""
    tree = RadixTree()
    members: dict[bytes, tuple[bytes, list[int], list[int]]] = {}
    for key, conv, words in rows:
        if key in members:
            members[key][1].append(conv)
        else:
            members[key] = (key, [conv], words)
            tree.insert(key, members[key])
    edges = rows[0][0], rows[-1][0]
    names = [_path_names(edge) for edge in edges]
    result: list[dict] = []
    opened: list[_Open] = []
    #: Per open tree node the depth of its first trie node, and the bytes that the edges share with its path.
    tree_path = [(0, (0, 0))]
    places = 0
    for entered, above, own, node in tree.walk():
        if entered:
            agreed = tuple(_agreed(known, above, own, edge) for known, edge in zip(tree_path[-1][1], edges))
            tree_path.append((len(opened), agreed))
            for depth in range(len(opened), (above + len(own)) // WIDTH + 1):
                side = next((s for s in (0, 1) if depth * WIDTH <= agreed[s]), None)
                opened.append(_Open() if side is None else _Open(places, names[side][depth]))
                places += side is not None
            if node.value is not None:
                here = opened[-1]
                key, here.ends, words = node.value
                here.member, here.least, here.n = (key, words), here.ends[0], len(here.ends)
            continue
        top, _ = tree_path.pop()
        while len(opened) > top:
            here = opened.pop()
            depth, parent = len(opened), opened[-1] if opened else None
            key, words = here.member
            n_words = words[depth - 1] if depth else 0
            row: dict[str, Any] = {
                "shared": here.place is not None,
                "part": part,
                "unit": unit,
                "conv_id": here.least,
                "depth": depth,
                "n_convs": here.n,
                "turn_id": key[(depth - 1) * WIDTH : depth * WIDTH].hex() if depth else None,
            }
            if here.place is None:
                here.saved += (here.n - 1) * n_words
                here.leaves = here.leaves or 1
                row |= {"place": parent.place, "ends_sha256": hashlib.sha256(_joined(here.ends)).hexdigest()}
                parent.children += 1
                parent.leaves += here.leaves
                parent.saved += here.saved
                parent.below.append(row)
                for below in here.below:
                    below["parent_conv_id"] = here.least
            else:
                row |= {"place": here.place, "node": here.name, "parent": parent.name if parent else None, "words": n_words, "ends": _joined(here.ends)}
            row |= {"n_children": here.children, "n_leaves": here.leaves, "saved_tokens": here.saved}
            if parent is not None:
                parent.n += here.n
                parent.least = here.least if parent.least is None else min(parent.least, here.least)
                parent.member = parent.member or here.member
            result.append(row)
    return result


def _batches(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 1 << 14):
        yield pa.RecordBatch.from_pylist([{name: row.get(name) for name in schema.names} for row in rows[at : at + (1 << 14)]], schema=schema)


_ARROW_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW_TYPES[kind]) for name, kind in (field.split() for field in ddl.split(","))])


def _units(unit_rows: int, unit_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = _arrow(_UNIT)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, unit, size = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple[bytes, int, list[int]]] = []
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in ("key", "conv_id", "words"))):
                if rows and (len(rows) >= unit_rows or size + len(row[0]) > unit_bytes):
                    yield from _batches(unit_nodes(rows, part, unit), schema)
                    rows, unit, size = [], unit + 1, 0
                rows.append(row)
                size += len(row[0])
        if rows:
            yield from _batches(unit_nodes(rows, part, unit), schema)

    return build


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared nodes of all units, in the order of units and places: a walk whose open nodes are a stack."""
    schema = _arrow(_MERGED)
    opened: list[dict] = []
    done: list[dict] = []

    def close(depth: int) -> None:
        while len(opened) > depth:
            here = opened.pop()
            here["saved_tokens"] += (here["n_convs"] - 1) * here["words"]
            here["n_leaves"] = here["n_leaves"] or 1
            here["ends_sha256"] = here.pop("hash").hexdigest()
            if opened:
                opened[-1]["n_children"] += 1
                opened[-1]["n_leaves"] += here["n_leaves"]
                opened[-1]["saved_tokens"] += here["saved_tokens"]
            done.append(here)

    for batch in batches:
        for row in batch.to_pylist():
            depth = row["depth"]
            if depth < len(opened) and opened[depth]["node"] == row["node"]:
                here = opened[depth]
                for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    here[name] += row[name]
            else:
                close(depth)
                here = {name: row[name] for name in (*schema.names, "words") if name in row} | {"hash": hashlib.sha256(), "ended": False}
                opened.append(here)
            if row["ends"]:
                here["hash"].update((b"," if here["ended"] else b"") + row["ends"])
                here["ended"] = True
        if len(done) >= 1 << 14:
            yield from _batches(done, schema)
            done.clear()
    close(0)
    yield from _batches(done, schema)


def trie(own: DataFrame, unit_rows: int = UNIT_ROWS, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, turns), as ``sequences`` gives them.

    Per node: its smallest member ``conv_id``, ``depth``, ``parent_conv_id``, members, children, childless nodes
    below, words that sharing saves below, hash of the members that end there, id of its last turn.
    """
    keys = own.select(
        F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"), "conv_id", F.transform("turns", lambda t: t["words"]).alias("words")
    )
    ordered = keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    units = durable(ordered.mapInArrow(_units(unit_rows, unit_bytes), _UNIT))
    shared = units.where("shared")
    walk = shared.select("part", "unit", "place", *_MERGED_INPUT).repartition(1).sortWithinPartitions("part", "unit", "place")
    merged = durable(walk.mapInArrow(_merge, _MERGED))
    least = shared.groupBy("node").agg(F.min("conv_id").alias("least"))
    named = merged.join(least.withColumnRenamed("least", "conv_id"), "node")
    named = named.join(least.select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id")), "parent", "left")
    places = shared.select("part", "unit", "place", "node").join(least, "node").drop("node")
    final = units.where("NOT shared")
    inner = final.where("parent_conv_id IS NOT NULL").select(*NODES)
    outer = final.where("parent_conv_id IS NULL").drop("parent_conv_id").join(places, ["part", "unit", "place"])
    outer = outer.withColumnRenamed("least", "parent_conv_id").select(*NODES)
    return inner.unionByName(outer).unionByName(named.select(*NODES))
