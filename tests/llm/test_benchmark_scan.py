import hashlib
import random
import re

import numpy as np
import pytest

from tabloom.llm import benchmark_scan as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    strings = {}
    for item, text in items:
        words = fold(text)
        for k in range(max(1, len(words) - 9) if words else 0):
            strings.setdefault(tuple(words[k : k + 10]), set()).add("" if item is None else str(item))
    lengths = {len(s) for s in strings}
    rows = []
    for doc, text in docs:
        words, hit, found = fold(text), set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                if (window := tuple(words[k : k + n])) in strings:
                    hit.update(range(k, k + n))
                    found |= strings[window]
        joined = ",".join(sorted(found)).encode()
        rows.append((doc, len(words), len(hit), len(found), hashlib.sha256(joined).hexdigest(), bool(hit)))
    return sorted(rows, key=str)


def result(docs, items, **more):
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r[n] for n in names) for r in S.contaminated(docs, items, **more).collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    """Short and long items, overlapping ones, null and empty ones, repeated rows, ids that sort as strings."""
    rng = random.Random(3)
    words = "a b c the of größe 日本 x1 longerword anotherlongword2".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(8, 30)))) for i in range(30)]
    rows += [(100, "of THE größe"), (9, "x1!"), (10, "unseen"), (11, None), (12, ""), (13, " -- "), (None, "c c c c"), (14, rows[0][1]), rows[1]]
    return spark.createDataFrame(rows, "item_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def docs(spark, items, edge_docs):
    rng = random.Random(4)
    words = "a b c the of größe 日本 x1 longerword anotherlongword2 other".split()
    rows = [(1000 + i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(150)]
    passages = sorted(r.text for r in items.collect() if r.text and len(r.text) > 40)
    rows += [(2000 + i, f"Start,{p.upper().replace(' ', ', ')}...END {p[:50]}") for i, p in enumerate(passages)]
    # Halves of a passage in two documents next to each other hold nothing.
    rows += [(3000, passages[0][: len(passages[0]) // 2]), (3001, passages[0][len(passages[0]) // 2 :])]
    rows += [(4000, " ".join(rng.choices(words, k=40000)))]
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))


def test_equals_brute_force(docs, items):
    expected = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert sum(r[5] for r in expected) > 100
    assert result(docs, items) == expected


def test_parts_give_the_same_rows(docs, items):
    some = docs.where("doc_id < 3002")
    assert S.parts(items, limit=600)[1] > 3
    assert result(some, items, limit=600) == result(some, items)


def test_long_items_are_cut_without_loss(spark):
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(3 * S.PIECE_WORDS)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[S.PIECE_WORDS - 5 : S.PIECE_WORDS + 5])), (2, " ".join(words[7:16]))], "doc_id long, text string")
    rows = result(docs, items)
    assert [(r[0], r[2]) for r in rows] == [(0, len(words)), (1, 10), (2, 0)]


def test_empty_tables_and_clashing_columns(spark, edge_docs, no_docs, items):
    none = items.limit(0)
    assert {r.n_hit for r in S.contaminated(edge_docs, none).collect()} == {0}
    assert S.contaminated(no_docs, items).count() == 0
    docs = spark.createDataFrame([(1, "x1 and more", "mine", 5), (2, "clean", "too", 6)], "doc_id long, text string, spans string, n_hit int")
    rows = {r.doc_id: r for r in S.contaminated(docs, items.withColumnRenamed("text", "body").withColumn("text", items.item_id), item_text="body").collect()}
    assert rows[1].n_hit == 1 and not rows[2].contaminated
    with pytest.raises(ValueError):
        S.without_contaminated(docs, items)
    kept = S.without_contaminated(docs.drop("spans"), items)
    assert kept.columns == ["doc_id", "n_hit", "text"] and [r.doc_id for r in kept.collect()] == [2]
    with pytest.raises(ValueError):
        S.scan(docs, items, text="spans")


def test_shifts_skip_most_positions(items):
    """Few positions of a text without test strings are looked at."""
    strings = S.Passages([(str(r.item_id), " ".join(fold(r.text))) for r in items.collect() if len(fold(r.text)) >= 10])
    raw = " ".join(f"word{i}" for i in range(20000)).encode()
    words = S.Words.of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    looked = []
    block = words.block
    words.block = lambda at, size: (looked.append(len(at)), block(at, size))[1]
    strings.occurrences(words)
    assert sum(looked) < 20000 / 7


def test_blocks_do_not_change_results(docs, items):
    rows = [tuple(r) for r in docs.where("doc_id < 3002").collect()]
    strings = S.Passages([("" if r.item_id is None else str(r.item_id), " ".join(fold(r.text))) for r in items.collect() if fold(r.text)])
    raw = [(t or "").encode() for _, t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    together = strings.search(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, text in enumerate(raw):
        alone = strings.search(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert (together[0][i], together[1][i], together[2][i]) == (alone[0][0], alone[1][0], alone[2][0])
    
