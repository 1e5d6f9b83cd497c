import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from tabloom.llm import prefix_trie as S
from tabloom.llm.radix_tree import LAYOUTS, RadixTree

COLUMNS = "conv_id long, turn long, role string, text string, words int, place string"


def turn_name(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows, rebuild=True):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0), turn_name(role, text), role, text))
    own = {conv: [(r, t) for _, _, r, t in sorted(ts)] for conv, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 4
        whole = tuple(own.get(conv - conv % 20, [])[:h] + own[conv][h:]) if rebuild else tuple(own[conv])
        ends[whole].append(conv)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(conv)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * words
            leaves[node[:d]] += not children[node]
    return sorted(
        (
            (min(convs), len(n), min(members[n[:-1]]) if n else None, len(convs), children[n], leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(), turn_name(*n[-1])[: 2 * S.WIDTH] if n else None)
            for n, convs in members.items()
        ),
        key=str,
    )


def result(conversations, rebuild=True, **more):
    own = S.sequences(conversations)
    nodes = S.trie(S.with_shared_openings(own) if rebuild else own, **more)
    return sorted((tuple(r[c] for c in S.NODES) for r in nodes.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    """Few different turns, so that openings are shared; copies, nulls, ties, gaps, negative ids, a long conversation."""
    rng = random.Random(6)
    texts = ["hello there", "yes", "", None, "a b  c\td", "größe 日本"]
    rows = []
    for conv in [*range(-25, 130), 400, 401, 419]:
        kind = rng.random()
        if kind < 0.3:
            rows += [(conv, k, "user", "the same", 1, "x") for k in range(4)]
        else:
            rows += [(conv, rng.choice([k, k, None]), rng.choice(["user", None, "u"]), rng.choice(texts), 1, "x") for k in range(rng.randint(1, 6))]
    rows += [(500, k, "user", f"{k % 7}", None, None) for k in range(700)] + [(501, k, "user", f"{k % 7}", None, None) for k in range(650)]
    return rows + [(None, 0, "user", "lost", 1, "x"), rows[0], (130, 0, "u", "ser" * 2, 1, "x"), (131, 0, "us", "erser", 1, "x")]


@pytest.fixture(scope="module")
def conversations(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.mark.parametrize("unit_rows, unit_bytes", [(20_000, 8 << 20), (3, 8 << 20), (1, 8 << 20), (100, 200)])
def test_equals_brute_force(conversations, rows, unit_rows, unit_bytes):
    assert result(conversations, unit_rows=unit_rows, unit_bytes=unit_bytes) == brute(rows)


def test_conversations_as_they_are(conversations, rows):
    assert result(conversations, rebuild=False) == brute(rows, rebuild=False)


def test_empty_table_and_turnless_conversations(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert result(none) == []
    # A conversation whose opening is cut off and whose block has no first conversation keeps no turn.
    conv = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    rows = [(conv, 0, "user", "x", 1, "x")]
    assert result(spark.createDataFrame(rows, COLUMNS)) == brute(rows) and len(brute(rows)) == 1


keys = st.lists(st.binary(max_size=5) | st.integers(0, 255).map(lambda b: bytes([7, b, 1])) | st.integers(0, 60).map(lambda b: b"long path" + bytes([b])), max_size=400)


@given(keys)
@settings(max_examples=60, deadline=None)
def test_radix_tree_holds_what_was_put(keys):
    tree, expected = RadixTree(), {}
    for key in keys:
        if key not in expected:
            expected[key] = len(expected)
            tree.insert(key, expected[key])
    found, path = [], []
    for entered, above, own, node in tree.walk():
        if entered:
            path.append(own)
            assert above == len(b"".join(path[:-1])) and node.size <= node.layout and node.layout in LAYOUTS
            assert node.size != 1 or node.value is not None
            if node.value is not None:
                found.append((b"".join(path), node.value))
        else:
            path.pop()
    assert found == sorted(expected.items())


def test_layouts_grow():
    tree = RadixTree()
    sizes = []
    for b in range(256):
        tree.insert(bytes([b, 1]), b)
        sizes.append(tree.root.layout)
    assert [sizes[n] for n in (4, 5, 16, 17, 48, 49, 255)] == [16, 16, 48, 48, 256, 256, 256]
    assert [child.value for _, child in tree.root.items()] == list(range(256))
